"""Substring dedup by repeated-phrase automata.

A word goes if it is covered by a window of ``WINDOW`` words whose sequence
also starts anywhere else.  Each window is anchored at one phrase of ``PHRASE``
words (anchors.py); consecutive windows of one anchor form a context.  Recurring
passages are confirmed first: a context met twice is one as a whole; of a context
met once whose anchor recurs, the windows are compared with all others at such
anchors by a 128-bit hash, and each run of windows met twice is one.  Passages are
dealt, as texts, to the blocks of documents that they were seen in.  Each block
compiles its passages to Aho-Corasick automata, with one letter for each word and
shards of about ``SHARD_LETTERS`` letters, streams its documents through each, and
removes every occurrence whose words agree by their 64-bit hashes: what goes is
what the automata located.
Documents are dealt to blocks of about ``BLOCK_MB``, by a hash.

Cases: null and empty texts have no words; fewer than ``WINDOW`` words stay
whole; repeated rows are occurrences of each other and each give their row;
an empty table gives no rows; long texts are worked on in pieces, and with all
rows of equal id and text in one block; other columns aren't read, whatever their
names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _A, PIECE, gram_hashes, mixed, pieces, window_anchors, window_starts
from .common import block_count, may_be_in, written
from .suffix_dedup import _OTHER, _contexts

WINDOW = 35
PHRASE = 8
BLOCK_MB = 8
#: Letters of the passages that one automaton holds; a longer passage has one for itself.
SHARD_LETTERS = 1 << 18


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class _Texts:
    """The hashes of the words of some texts, and the texts' contexts piece by piece."""

    def __init__(self, texts, window: int, phrase: int):
        hashes = [np.zeros(0, np.uint64)]
        for t in texts:
            hashes.append(word_hashes((t or b"").split()))
        self.lengths = [len(h) for h in hashes[1:]]
        self.hashes = np.concatenate(hashes)
        self.begins = np.cumsum([0, *self.lengths])
        self.window, self.phrase = window, phrase

    def contexts(self):
        """(units, first and last window starts of each context, its place in all words, its anchor)."""
        for batch in pieces(self.lengths, self.window):
            units = np.concatenate([self.hashes[self.begins[d] + b : self.begins[d] + e] for d, b, e in batch])
            offsets, starts = window_starts(batch, self.window)
            grams = gram_hashes(units, self.phrase)
            at, first, last = window_anchors(grams, self.window - self.phrase + 1, starts)
            shift = np.array([self.begins[d] + b for d, b, _ in batch]) - offsets
            place = first + shift[np.searchsorted(offsets, first, side="right") - 1]
            yield units, first, last, place, grams[at].view(np.int64)


def mine(blocked: DataFrame, window: int, phrase: int) -> DataFrame:
    """(block, a): anchor phrases that recur, for each block that has them."""

    def run(batches):
        for b in batches:
            texts = _Texts((t.as_py() for t in b.column(1)), window, phrase)
            block = np.repeat(b.column(0).to_numpy(), texts.lengths).astype(np.int64)
            found = [np.zeros((0, 2), np.int64)]
            for _, _, _, place, anchor in texts.contexts():
                found.append(np.column_stack([block[place], anchor]))
            rows, n = _counted(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(np.ascontiguousarray(rows[:, 1])), pa.array(n.astype(np.int32))], names=["block", "a", "n"])

    mined = written(blocked.select("block", "t").mapInArrow(run, "block int, a long, n int"), "anchors")
    recurring = mined.groupBy("a").agg(F.sum("n").alias("total")).where("total >= 2").select("a")
    return mined.select("block", "a").join(recurring, "a").select("block", "a").distinct()


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each comes."""
    rows = rows[np.lexsort(rows.T)]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.diff(np.r_[first, len(rows)])


def packed_texts(blocked: DataFrame) -> DataFrame:
    """``blocked`` with its texts compressed one by one, as they are shuffled twice."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(t.as_py() or b"") for t in b.column(1)], pa.binary()), b.column(2)], names=["block", "t", "doc_id"])

    return blocked.mapInArrow(run, blocked.schema)


def _unpacked(docs: pa.Table):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(t.as_py()) for t in docs.column("t"))


def _words_at(docs: pa.Table, texts: _Texts):
    """A function that gives the words from one place of ``texts`` to another of the same text; asked in order, it splits each text once."""
    held = [-1, []]

    def words(begin: int, end: int) -> list[bytes]:
        d = int(np.searchsorted(texts.begins, begin, side="right")) - 1
        if held[0] != d:
            held[:] = d, next(_unpacked(docs.slice(d, 1))).split()
        return held[1][begin - texts.begins[d] : end - texts.begins[d]]

    return words


def contexts(packed: DataFrame, phrases: DataFrame, window: int, phrase: int) -> DataFrame:
    """(block, c1, c2, n, passage): the distinct contexts of each block whose anchor recurs, two hashes of their words, how often the block has them, and the words."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        wanted = np.sort(known.column("a").to_numpy())
        at, rows, passages = {}, [], []
        texts = _Texts(_unpacked(docs) if len(wanted) else (), window, phrase)
        words = _words_at(docs, texts)
        for units, first, last, place, a in texts.contexts():
            hit = np.flatnonzero(wanted[np.searchsorted(wanted, a).clip(max=len(wanted) - 1)] == a)
            keys = _contexts(units.tobytes(), 8 * first[hit], 8 * last[hit], 8 * window)
            for c, begin, end in zip(map(tuple, keys.tolist()), place[hit].tolist(), (place + last - first)[hit].tolist()):
                k = at.setdefault(c, len(rows))
                if k < len(rows):
                    rows[k][2] += 1
                else:
                    rows.append([*c, 1])
                    passages.append(b" ".join(words(begin, end + window)))
        rows = np.array(rows, np.int64).reshape(-1, 3)
        return pa.table({"block": pa.array(np.full(len(rows), block, np.int32)), "c1": pa.array(rows[:, 0].copy()), "c2": pa.array(rows[:, 1].copy()), "n": pa.array(rows[:, 2].astype(np.int32)), "passage": pa.array(passages, pa.binary())})

    return packed.groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(run, "block int, c1 long, c2 long, n int, passage binary")


def window_rows(leads: DataFrame, window: int) -> DataFrame:
    """(block, c1, c2, n, lo, w1, w2): two hashes of each window of the contexts ``leads`` (block, c1, c2, n, passage)."""

    def run(batches):
        for b in batches:
            split = [p.as_py().split(b" ") for p in b.column(4)]
            size = np.array([len(w) for w in split], np.int64)
            units = word_hashes([w for ws in split for w in ws])
            count, begin = size - window + 1, np.cumsum(size) - size
            own = np.repeat(np.arange(len(size)), count)
            lo = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            start = begin[own] + lo
            h = [gram_hashes(u, window, f)[start].view(np.int64) for u, f in ((units, _A), (mixed(units), _OTHER))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(own)) for k in range(4)), pa.array(lo.astype(np.int32)), *map(pa.array, h)], names=["block", "c1", "c2", "n", "lo", "w1", "w2"])

    return leads.mapInArrow(run, "block int, c1 long, c2 long, n int, lo int, w1 long, w2 long")


def confirmed(found: DataFrame, window: int) -> DataFrame:
    """(block, c1, c2, at): contexts with windows met twice: all of them, or, if not null, those that start at ``at``."""
    key = F.xxhash64("block", "c1", "c2").alias("key")
    # of equal contexts one speaks for all
    counts = written(found.groupBy("c1", "c2").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("total"), F.min("block").alias("block")), "contexts")
    likely = may_be_in(found.select("*", key), "key", counts.select(key), counts.count())
    leads = likely.join(counts, ["block", "c1", "c2"]).select("block", "c1", "c2", F.col("total").alias("n"), "passage")
    each = written(window_rows(leads, window), "windows")
    twice = written(each.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total >= 2").select("w1", "w2"), "repeated")
    single = may_be_in(each.where("n = 1"), "w1", twice, twice.count())
    # at most WINDOW - PHRASE + 1 starts for a context
    parts = single.join(twice, ["w1", "w2"], "left_semi").groupBy("block", "c1", "c2").agg(F.sort_array(F.collect_list("lo")).alias("at"))
    whole = found.select("block", "c1", "c2").join(counts.where("total = 2").select("c1", "c2"), ["c1", "c2"])
    return whole.select("block", "c1", "c2", F.lit(None).cast("array<int>").alias("at")).unionByName(parts)


def _letters(hashes: np.ndarray) -> str:
    """One letter for each word, of its hash's last byte."""
    return hashes.astype(np.uint8).tobytes().decode("latin-1")


def _shards(passages, window: int, letters: int):
    """Runs of windows of the passages, as hashes by their letters, about ``letters`` letters at a time."""
    keys, held = {}, 0
    for passage, at in passages:
        h = word_hashes(passage.split(b" "))
        starts = np.arange(len(h) - window + 1) if at is None else np.array(at)
        cuts = np.flatnonzero(np.diff(starts) > 1)
        for lo, hi in zip(starts[np.r_[0, cuts + 1]].tolist(), starts[np.r_[cuts, len(starts) - 1]].tolist()):
            part = h[lo : hi + window]
            keys.setdefault(_letters(part), set()).add(part.tobytes())
            held += len(part)
        if held >= letters:
            yield keys
            keys, held = {}, 0
    if keys:
        yield keys


def locate(texts: _Texts, passages, letters: int = SHARD_LETTERS) -> np.ndarray:
    """Which words lie in an occurrence of a passage (all of it, or its windows that start at the places given), as automata over all passages find them."""
    import ahocorasick

    change = np.zeros(len(texts.hashes) + 1, dtype=np.int32)
    raw = texts.hashes.tobytes()
    for keys in _shards(passages, texts.window, letters):
        automaton, longest = ahocorasick.Automaton(), max(map(len, keys))
        for key, parts in keys.items():
            automaton.add_word(key, parts)
        automaton.make_automaton()
        begin, end = [], []
        for d, n in zip(texts.begins.tolist(), texts.lengths):
            for cut in range(d, d + n, PIECE):
                for last, parts in automaton.iter(_letters(texts.hashes[cut : min(d + n, cut + PIECE + longest - 1)])):
                    stop = cut + last + 1
                    for part in parts:  # of equal length
                        start = stop - len(part) // 8
                        if raw.startswith(part, 8 * start):
                            begin.append(start)
                            end.append(stop)
        np.add.at(change, np.array(begin, np.int64), 1)
        np.add.at(change, np.array(end, np.int64), -1)
    return np.cumsum(change[:-1]) > 0


def repeated_words(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block_mb: int = BLOCK_MB, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, and ``kept`` (the text that stays) if ``texts``."""
    n_blocks = block_count(docs, text_col, block_mb)
    block = F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(n_blocks)).cast("int")
    blocked = docs.select(block.alias("block"), F.col(text_col).cast("binary").alias("t"), F.col(id_col).alias("doc_id"))
    packed = packed_texts(blocked)
    found = written(contexts(packed, mine(blocked, window, phrase), window, phrase), "passages")
    told = found.select("block", "c1", "c2", "passage", F.lit(None).cast("array<int>").alias("at")).unionByName(confirmed(found, window), allowMissingColumns=True)
    id_type = blocked.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        found = _Texts(_unpacked(docs), window, phrase)
        is_text = pa.compute.is_valid(told["passage"])
        seen, recur = told.filter(is_text), told.filter(pa.compute.invert(is_text))
        row = {key: k for k, key in enumerate(zip(seen["c1"].to_pylist(), seen["c2"].to_pylist()))}
        passages, places = seen["passage"].combine_chunks(), recur["at"].combine_chunks()
        gone = locate(found, ((passages[row[key]].as_py(), places[k].as_py()) for k, key in enumerate(zip(recur["c1"].to_pylist(), recur["c2"].to_pylist()))))
        removed, sha, kept = [], [], []
        for text, begin, end in zip(_unpacked(docs), found.begins[:-1].tolist(), found.begins[1:].tolist()):
            mask = gone[begin:end]
            n = int(mask.sum())
            words = text.split()
            rest = b" ".join([w for w, g in zip(words, mask.tolist()) if not g] if n else words)
            removed.append(n)
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode() if texts else None)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(found.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    out = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")


def op7_phrase_dedup(docs: DataFrame) -> DataFrame:
    return repeated_words(docs)


OP7_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select rid, i, md5(array_to_string(w[i:i+{WINDOW - 1}], ' ')) as g from d, unnest(range(1, len(w) - {WINDOW - 2})) as u(i) where len(w) >= {WINDOW}),
r as (select rid, i from g qualify count(*) over (partition by g) > 1),
c as (select distinct rid, i + k as p from r, unnest(range(0, {WINDOW})) as u(k)),
n as (select rid, count(*) as n from c group by rid),
k as (select d.rid, string_agg(w[p], ' ' order by p) as kept from (select rid, w, p from d, unnest(range(1, len(w) + 1)) as u(p)) d anti join c on c.rid = d.rid and c.p = d.p group by d.rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join n using (rid) left join k using (rid)
"""
