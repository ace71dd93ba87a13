"""Texts cut to lines and blocks a batch at a time, in Arrow.

A text is one row, so nothing is dealt or sorted for its lines: what cannot matter
is left out before Spark groups the rest by source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.rx import SPACE, glance, re2


def _split(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of all texts, and for each the place of its text and its own in the text."""
    lists = pc.split_pattern(texts, separator)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return lists.flatten(), of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _spans(parts: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where parts begin and stop in their texts, in code points; one character parts them."""
    size = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size + 1) - (size + 1)
    begin = begin - begin[np.searchsorted(of, of)] if len(of) else begin
    return begin, begin + size


def _blocks(parts: pa.Array, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of the parts ``inside`` between ``starts``: the parts, the first place in them of each run and one beyond the last, and the runs' texts."""
    at = np.flatnonzero(inside)
    no = np.cumsum(starts)[at]
    firsts = np.flatnonzero(np.r_[True, no[1:] != no[:-1]]) if len(at) else at
    firsts = np.r_[firsts, len(at)].astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), parts.take(pa.array(at)))
    return at, firsts, pc.binary_join(lists, "\n")


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def lines_in_question(sources: DataFrame, rules: tuple[str, ...], cues: tuple[str, ...]) -> DataFrame:
    """Of segment.lines() those in whose block one of ``rules`` or ``cues`` may match (text.may_have), with ``above`` and ``below``, their neighbours, and ``starts``.

    Told beside: ``may_be_ruled``, lines in which one of ``rules`` may match, and ``may_be_noise``, as segment.MAY_BE_NOISE has it.  A block is cut at blank lines and behind lines that end a sentence, ``starts`` tells its first line; the blocks of
    segment.line_blocks() are parts of such ones, so no block is told by less than its text.
    """
    rule, noise = ("|".join(map(glance, ps)) for ps in (rules, [p for ps in lx.DEMOTIONS.values() for p in ps]))
    one = "|".join([rule, *map(glance, cues)])
    end = re2(lx.SENTENCE_END)

    def run(batches):
        for b in batches:
            b = b.filter(b.column("text").is_valid())
            lines, of, ln = _split(b.column("text"), "\n")
            begin, stop = _spans(lines, of)
            bare = pc.utf8_trim(lines, SPACE)
            blank = _flags(pc.equal(bare, ""))
            # the text is trimmed, so its last two characters tell how it ends
            ends = _flags(pc.match_substring_regex(pc.utf8_slice_codeunits(bare, -2), end))
            starts = (ln == 0) | blank | np.r_[False, (blank | ends)[:-1]] if len(ln) else blank
            at, firsts, texts = _blocks(lines, starts, ~blank)
            at = at[np.repeat(_flags(pc.match_substring_regex(texts, one)), np.diff(firsts))]
            last = np.r_[ln[1:] == 0, True] if len(ln) else blank
            take = lambda i, none: lines.take(pa.array(np.where(none, 0, i), mask=none))
            line, bare = lines.take(pa.array(at)), bare.take(pa.array(at))
            noisy = pc.and_(pc.less(pc.utf8_length(bare), lx.PROSE), pc.match_substring_regex(bare, noise))
            told = pa.StructArray.from_arrays([line, pa.array(begin[at]), pc.match_substring_regex(line, rule), noisy], names=["line", "begin", "ruled", "noisy"])
            firsts = np.flatnonzero(starts[at] | np.r_[True, np.diff(at) != 1][: len(at)])
            head, tail = at[firsts], at[np.r_[firsts[1:], len(at)] - 1] if len(at) else at
            block = pa.ListArray.from_arrays(pa.array(np.r_[firsts, len(at)], pa.int32()), told)
            yield pa.RecordBatch.from_arrays([b.column("source_id").take(pa.array(of[head])), pa.array(ln[head].astype(np.int32)), take(head - 1, ln[head] == 0), take(tail + 1, last[tail]), block], names=["source_id", "first", "before", "after", "block"])

    kind = sources.schema["source_id"].dataType.simpleString()
    blocks = sources.select("source_id", tx.normalized("text").alias("text")).mapInArrow(run, f"source_id {kind}, first int, before string, after string, block array<struct<line: string, begin: long, ruled: boolean, noisy: boolean>>")
    rows = blocks.select("*", F.posexplode("block").alias("pos", "l"))
    near = lambda step, end: F.when(F.col("pos") + step == end, F.col("before" if step < 0 else "after")).otherwise(F.get("block", F.col("pos") + step)["line"])
    return rows.select(
        "source_id", (F.col("first") + F.col("pos")).alias("ln"), "l.begin", (F.col("l.begin") + F.length("l.line")).alias("stop"), "l.line", near(-1, F.lit(-1)).alias("above"), near(1, F.size("block")).alias("below"),
        (F.col("pos") == 0).alias("starts"), F.col("l.ruled").alias("may_be_ruled"), F.col("l.noisy").alias("may_be_noise"),
    )


def plain_blocks(sources: DataFrame) -> DataFrame:
    """segment.semantic_blocks() of sources without headings: the blocks between blank lines and form feeds; their ``path`` is empty."""

    def run(batches):
        for b in batches:
            b = b.filter(b.column("text").is_valid())
            lines, of, ln = _split(b.column("text"), "\n")
            parts, line, no = _split(lines, "\f")
            of, first = of[line], (ln[line] == 0) & (no == 0)
            begin, stop = _spans(parts, of)
            blank = _flags(pc.equal(pc.utf8_trim(parts, SPACE), ""))
            at, firsts, texts = _blocks(parts, first | blank | (no > 0), ~blank)
            head, tail = at[firsts[:-1]], at[firsts[1:] - 1]
            yield pa.RecordBatch.from_arrays([b.column("source_id").take(pa.array(of[head])), pa.array(begin[head]), pa.array(stop[tail]), texts], names=["source_id", "begin", "stop", "text"])

    kind = sources.schema["source_id"].dataType.simpleString()
    found = sources.select("source_id", tx.normalized("text").alias("text")).mapInArrow(run, f"source_id {kind}, begin long, stop long, text string")
    return found.withColumn("path", F.array().cast("array<string>"))
