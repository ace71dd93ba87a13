"""Fill-in-middle transformation with a sparse exception index.

Texts are cut at code points but handled as bytes.  For a slice of texts only the
characters of more than one byte are recorded: their place and how many bytes
they have beyond one.  A cut at a code point is turned to a byte (and back) by
``searchsorted`` among those; in a span without any, the two differ by a constant.
No text is decoded.  All is one map over the rows, without a shuffle.

Two of a text's four hash values give the cuts, one decides whether it stays
plain, one which form it takes; they derive from its id alone, so reruns and
any partitioning agree.

Cases: a null text is empty and plain; a text that holds a marker stays plain, so
that every output can be taken apart; repeated rows give equal rows; a null id is
hashed as an empty one; an empty table gives no rows; a long text is a slice of
its own; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import flat, slices

#: Bytes of texts worked on at a time.
SLICE = 8 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class ExceptionIndex:
    """Characters of several bytes in UTF-8 ``data``: byte places, code-point places, and the excess bytes before each."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))))
        self.chars = self.bytes - self.excess[:-1]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before byte places that are no inner byte of a character."""
        return places - self.excess[np.searchsorted(self.bytes, places)]

    def to_bytes(self, places: np.ndarray) -> np.ndarray:
        return places + self.excess[np.searchsorted(self.chars, places)]


def hash_values(ids: list[str | None], seed: str) -> np.ndarray:
    """Four unsigned 32-bit values of each id."""
    raw = b"".join([hashlib.sha256(f"{seed}:{i or ''}".encode()).digest()[:16] for i in ids])
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``: one row for each row of ``docs``.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first.
    """
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for b in slices(batches, "t", SLICE):
            data, at = flat(b.column("t"))
            index, raw = ExceptionIndex(data), data.tobytes()
            starts = index.to_chars(at)
            n = np.diff(starts)
            h = hash_values(b.column("i").to_pylist(), seed)
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            first, second = (index.to_bytes(starts[:-1] + cuts[:, k]).tolist() for k in (0, 1))
            begin, end = at[:-1].tolist(), at[1:].tolist()
            draws, swapped = (h[:, 2] % 100 >= rate).tolist(), (h[:, 3] % 100 < spm).tolist()
            forms, outputs = [], []
            for k in range(b.num_rows):
                text = raw[begin[k] : end[k]]
                if not text or draws[k] or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                pre, mid, suf = raw[begin[k] : first[k]], raw[first[k] : second[k]], raw[second[k] : end[k]]
                forms.append("spm" if swapped[k] else "psm")
                outputs.append(b"".join((s, suf, p, pre, m, mid) if swapped[k] else (p, pre, s, suf, m, mid)))
            plain = np.array([f == "plain" for f in forms])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n), pa.array(forms), pa.array(cuts[:, 0], mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from an output and its form."""
    after = lambda mark: F.locate(mark, output) + F.lit(len(mark))
    span = lambda a, b: F.substring(output, after(a), F.locate(b, output) - after(a))
    rest = F.substring(output, after(MIDDLE), F.length(output))
    psm = F.concat(span(PREFIX, SUFFIX), rest, span(SUFFIX, MIDDLE))
    spm = F.concat(span(PREFIX, MIDDLE), rest, span(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    done = fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256(concat('1:', coalesce(cast(doc_id as varchar), ''))) as h from documents),
c as (select doc_id, t, cast(length(t) as bigint) as n, cast(concat('0x', substr(h, 1, 8)) as bigint) as h1, cast(concat('0x', substr(h, 9, 8)) as bigint) as h2, cast(concat('0x', substr(h, 17, 8)) as bigint) as h3, cast(concat('0x', substr(h, 25, 8)) as bigint) as h4 from d),
f as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from c),
s as (select doc_id, t, n, form, a, b, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as u from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', u, '<M>', m) else concat('<S>', u, '<P>', p, '<M>', m) end) as output_sha256, sha256(t) as restored_sha256 from s
"""
