"""Suffix-array dedup by bucket-pointer refinement.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
anywhere else.  Windows of that length are anchored at a gram of ``GRAM`` bytes
(anchors.py), and the windows of one anchor form one context.  Contexts met
twice are repeated whole.  Contexts met once whose anchor recurs are dealt, with
one copy of each repeated context of that anchor, to shards by anchor, where the
suffixes at their window starts are sorted as far as ``LENGTH`` bytes: initial
buckets by (a 64-bit hash of) ``Q``-byte grams are refined by sorting on the bucket identifiers at
later offsets, each round reusing the last one's updates at twice the depth.
Windows that end in one bucket are equal.  Only grams that recur reach that sort.

An anchor with more than ``HOT`` different contexts would fill one shard: its
windows are compared by 128-bit hashes instead, counted once a block of
documents and spread by hash.  Both ways are exact and neither drops a window.

Cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` stay
whole; repeated rows are occurrences of each other and each give their row; an
empty table gives no rows; long texts are worked on in overlapping pieces; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import gram_hashes, mixed, pieces, window_anchors, window_starts
from .common import block_count, checkpoint

LENGTH = 400
GRAM = 24
Q = 50
HOT = 20_000
BLOCK_MB = 8
#: Bytes of contexts sorted at a time.
SORT_BYTES = 1 << 20
_OTHER = np.uint64(0xD6E8FEB86659FD93)
#: What is known of a context: repeated, to be sorted, to be compared by hashes.
REPEATED, SORTED, HASHED = 0, 1, 2


def _parts(texts: list[bytes], length: int, gram: int):
    """Piece by piece: (bytes, shift of each piece to all bytes, offsets, anchors, first and last window starts, gram hashes of the anchors)."""
    lengths = [len(t) for t in texts]
    begins = np.cumsum([0, *lengths])
    for batch in pieces(lengths, length):
        data = b"".join([texts[d][b:e] for d, b, e in batch])
        units = mixed(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1))
        offsets, starts = window_starts(batch, length)
        grams = gram_hashes(units, gram)
        at, first, last = window_anchors(grams, length - gram + 1, starts)
        shift = np.array([begins[d] + b for d, b, _ in batch]) - offsets
        yield data, units, shift, offsets, first, last, grams[at].view(np.int64)


def _contexts(data: bytes, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of each context's bytes."""
    import xxhash

    digest, view = xxhash.xxh3_128_digest, memoryview(data)
    raw = b"".join([digest(view[i : j + length]) for i, j in zip(first.tolist(), last.tolist())])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _rows_in(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row of three int64 its place in ``table`` (sorted as _key sorts), or -1."""
    if not len(table) or not len(rows):
        return np.full(len(rows), -1)
    key, wanted = _key(rows), _key(table)
    at = np.searchsorted(wanted, key).clip(max=len(wanted) - 1)
    return np.where(wanted[at] == key, at, -1)


def _key(rows: np.ndarray) -> np.ndarray:
    """One 64-bit value of (anchor, two hashes): equal inside a block only for equal contexts, but for one chance in 2^64 a pair."""
    u = rows.view(np.uint64)
    return mixed(mixed(u[:, 0]) + u[:, 1]) ^ u[:, 2]


def _numbers(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy().astype(np.int64, copy=False) for n in names], axis=1)


def mine(blocked: DataFrame, length: int, gram: int) -> DataFrame:
    """(block, a, c1, c2, n): the contexts of each block's documents, as far as a batch shows them."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            block = b.column(0).to_numpy()
            begins = np.cumsum([len(t) for t in texts])
            found = [np.zeros((0, 4), np.int64)]
            for data, _, shift, offsets, first, last, a in _parts(texts, length, gram):
                place = first + shift[np.searchsorted(offsets, first, side="right") - 1]
                own = block[np.searchsorted(begins, place, side="right")].astype(np.int64)
                found.append(np.column_stack([own, a, _contexts(data, first, last, length)]))
            rows, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)), pa.array(n.astype(np.int32))], names=["block", "a", "c1", "c2", "n"])

    return checkpoint(blocked.select("block", "t").mapInArrow(run, "block int, a long, c1 long, c2 long, n int"))


def judge(mined: DataFrame, hot: int) -> DataFrame:
    """(block, a, c1, c2, state, n, lead): contexts whose anchor recurs; ``lead`` in the one block that speaks for a context."""
    contexts = mined.groupBy("a", "c1", "c2").agg(F.sum("n").alias("n"), F.min("block").alias("first"))
    anchors = contexts.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total >= 2")
    state = F.when(F.col("n") >= 2, REPEATED).when(F.col("kinds") <= hot, SORTED).otherwise(HASHED)
    known = contexts.join(anchors, "a").select("a", "c1", "c2", "first", F.least("n", F.lit(2)).cast("int").alias("n"), state.alias("state"), (F.col("kinds") > 1).alias("compared"), (F.col("kinds") > hot).alias("hot"))
    rows = mined.select("block", "a", "c1", "c2").distinct().join(known, ["a", "c1", "c2"])
    return rows.select("block", "a", "c1", "c2", "state", "n", "hot", (F.col("compared") & (F.col("block") == F.col("first"))).alias("lead"))


def evidence(blocked: DataFrame, judged: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """Contexts to sort, with their bytes, by shard of the anchor; windows to compare by hashes (``data`` null), by shard of the hash."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        known = known.filter(known["lead"])
        table = _numbers(known, ("a", "c1", "c2", "n", "hot"))
        table = table[np.argsort(_key(table[:, :3].copy()))]
        keys, done = table[:, :3].copy(), np.zeros(len(table), dtype=bool)
        out, data_out, hashed = [np.zeros((0, 4), np.int64)], [], [np.zeros((0, 3), np.int64)]
        for data, units, _, _, first, last, a in _parts([t.as_py() or b"" for t in docs.column("t")], length, gram) if len(table) else ():
            rows = np.column_stack([a, _contexts(data, first, last, length)])
            at = _rows_in(rows, keys)
            for i in np.flatnonzero(at >= 0).tolist():
                k = at[i]
                if done[k]:
                    continue
                done[k] = True
                if table[k, 4]:
                    s = slice(first[i], last[i] + length)
                    h1, h2 = gram_hashes(units[s], length), gram_hashes(mixed(units[s]), length, _OTHER)
                    hashed.append(np.column_stack([h1.view(np.int64), h2.view(np.int64), np.full(len(h1), table[k, 3])]))
                else:
                    out.append(table[k : k + 1, :4])
                    data_out.append(data[first[i] : last[i] + length])
        rows = np.concatenate(out)
        h = np.concatenate(hashed)
        pairs, inverse = np.unique(h[:, :2], axis=0, return_inverse=True)
        n = np.bincount(inverse.ravel(), weights=h[:, 2], minlength=len(pairs)).astype(np.int64)
        a, c1, c2 = (np.r_[rows[:, k], x] for k, x in ((0, pairs[:, 0]), (1, pairs[:, 0]), (2, pairs[:, 1])))
        shard = mixed(a.view(np.uint64)) % np.uint64(shards)
        return pa.table({"shard": shard.astype(np.int32), "a": a, "c1": c1, "c2": c2, "n": np.r_[rows[:, 3], n].astype(np.int32), "block": np.full(len(a), block, np.int32), "data": pa.array([*data_out, *[None] * len(pairs)], pa.binary())})

    return blocked.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(run, "shard int, a long, c1 long, c2 long, n int, block int, data binary")


def equal_suffixes(text: np.ndarray, depth: int, q: int = Q) -> np.ndarray:
    """A bucket for each position of ``text`` (bytes): two positions share one only if their next ``depth`` bytes are equal.

    Buckets are numbered by where they begin in the order of the suffixes.  Positions alone in a bucket are sorted and leave the work.
    """
    n, q = len(text), min(q, depth)
    padded = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(q - 1, np.uint64)]
    gram = gram_hashes(mixed(padded), q) if n else padded
    order = np.argsort(gram, kind="stable")
    bucket = _numbered(gram[order], order, np.zeros(n, np.int64))
    reach = q
    while reach < depth:
        step = min(reach, depth - reach)
        size = np.bincount(bucket, minlength=n)
        open_ = np.flatnonzero(size[bucket] > 1)
        if not len(open_):
            break
        later = np.where(open_ + step < n, bucket[np.minimum(open_ + step, n - 1)] + 1, 0)
        key = bucket[open_].astype(np.uint64) * np.uint64(n + 1) + later.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        bucket = bucket.copy()
        bucket[open_[order]] = _refined(key[order], bucket[open_[order]])
        reach += step
    return bucket


def _numbered(keys: np.ndarray, order: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    bucket[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return bucket


def _refined(keys: np.ndarray, old: np.ndarray) -> np.ndarray:
    """New bucket numbers for positions sorted by (old bucket, later bucket): the old number plus the place inside."""
    place = np.arange(len(keys))
    begins = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
    inside = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], place, 0))
    return old + inside - begins


def repeated_windows(contexts: list[bytes], weights: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, from, to): runs of window starts in contexts of weight 1 whose ``length`` bytes come elsewhere too."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    begin = np.cumsum(size) - size
    bucket = equal_suffixes(text, length)
    count = size - length + 1
    own = np.repeat(np.arange(len(contexts)), count)
    start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    weight = np.bincount(bucket[start], weights=weights[own], minlength=len(text))
    hit = (weight[bucket[start]] >= 2) & (weights[own] == 1)
    own, offset = own[hit], (start - begin[own])[hit]
    if not len(own):
        return []
    first = np.r_[True, (own[1:] != own[:-1]) | (offset[1:] != offset[:-1] + 1)]
    last = np.r_[first[1:], True]
    return list(zip(own[first].tolist(), offset[first].tolist(), offset[last].tolist()))


def sort_shards(found: DataFrame, length: int) -> DataFrame:
    """(block, a, c1, c2, lo, hi): repeated windows of contexts met once, as runs; of hashes, those met twice (``lo`` null)."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("a")
        is_hash = pa.compute.is_null(shard["data"])
        out = []
        hashed = _numbers(shard.filter(is_hash), ("c1", "c2", "n", "block"))
        if len(hashed):
            _, inverse = np.unique(hashed[:, :2], axis=0, return_inverse=True)
            hit = hashed[np.bincount(inverse.ravel(), weights=hashed[:, 2])[inverse.ravel()] >= 2]
            out.append(pa.table({"block": hit[:, 3].astype(np.int32), "a": hit[:, 0], "c1": hit[:, 0], "c2": hit[:, 1], "lo": pa.nulls(len(hit), pa.int32()), "hi": pa.nulls(len(hit), pa.int32())}))
        table = shard.filter(pa.compute.invert(is_hash))
        rows = _numbers(table, ("a", "c1", "c2", "n", "block"))
        data = table.column("data")
        at = 0
        while at < len(rows):  # whole anchors, as many as fit
            end, held = at, 0
            while end < len(rows) and (held < SORT_BYTES or rows[end, 0] == rows[end - 1, 0]):
                held += len(data[end].as_buffer())
                end += 1
            runs = repeated_windows([x.as_py() for x in data[at:end]], rows[at:end, 3].astype(float), length)
            if runs:
                own, lo, hi = (np.array(x) for x in zip(*runs))
                r = rows[at + own]
                out.append(pa.table({"block": r[:, 4].astype(np.int32), "a": r[:, 0], "c1": r[:, 1], "c2": r[:, 2], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}))
            at = end
        none = pa.table({k: pa.array([], t) for k, t in (("block", pa.int32()), ("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))})
        return pa.concat_tables([none, *out])

    return found.groupBy("shard").applyInArrow(run, "block int, a long, c1 long, c2 long, lo int, hi int")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_mb: int = BLOCK_MB, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept`` (the bytes that stay) if ``texts``."""
    n_blocks = block_count(docs, text_col, block_mb)
    block = F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(n_blocks)).cast("int")
    blocked = docs.select(block.alias("block"), F.col(text_col).cast("binary").alias("t"), F.col(id_col).alias("doc_id"))
    judged = checkpoint(judge(mine(blocked, length, gram), hot))
    verdicts = sort_shards(evidence(blocked, judged, 2 * n_blocks, length, gram), length)
    # what a block is told: its contexts that are repeated whole (lo -1) or by hashes (lo -2), and the runs and hashes that repeat
    told = judged.where(f"state <> {SORTED}").select("block", "a", "c1", "c2", F.when(F.col("state") == REPEATED, -1).otherwise(-2).alias("lo"), F.lit(0).alias("hi")).unionByName(verdicts)
    id_type = blocked.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        contents = [t.as_py() or b"" for t in docs.column("t")]
        begins = np.cumsum([0, *map(len, contents)])
        change = np.zeros(begins[-1] + 1, dtype=np.int32)
        hashes = told.filter(pa.compute.is_null(told["lo"]))
        repeated = np.sort(_numbers(hashes, ("c1", "c2")).view(np.uint64) @ np.array([1, int(_OTHER)], np.uint64))
        table = _numbers(told.filter(pa.compute.is_valid(told["lo"])), ("a", "c1", "c2", "lo", "hi"))
        key = _key(table[:, :3].copy())
        table = table[np.argsort(key, kind="stable")]
        keys = np.sort(key)
        for data, units, shift, offsets, first, last, a in _parts(contents, length, gram) if len(table) else ():
            own = _key(np.column_stack([a, _contexts(data, first, last, length)]))
            left, right = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            i = np.repeat(np.arange(len(own)), right - left)
            k = np.repeat(left, right - left) + np.arange(len(i)) - np.repeat(np.cumsum(right - left) - (right - left), right - left)
            lo, hi = table[k, 3], table[k, 4]
            begin = np.where(lo < 0, first[i], first[i] + lo)
            end = np.where(lo < 0, last[i], first[i] + hi)
            begin, end = [begin[lo >= -1]], [end[lo >= -1]]
            for j in i[lo == -2].tolist():
                s = slice(first[j], last[j] + length)
                h = gram_hashes(units[s], length) + gram_hashes(mixed(units[s]), length, _OTHER) * _OTHER
                at = first[j] + (np.flatnonzero(repeated[np.searchsorted(repeated, h).clip(max=len(repeated) - 1)] == h) if len(repeated) else np.zeros(0, np.int64))
                begin.append(at)
                end.append(at)
            begin, end = np.concatenate(begin), np.concatenate(end)
            move = shift[np.searchsorted(offsets, begin, side="right") - 1]
            np.add.at(change, begin + move, 1)
            np.add.at(change, end + move + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for k, t in enumerate(contents):
            mask = gone[begins[k] : begins[k + 1]]
            n = int(mask.sum())
            rest = np.frombuffer(t, np.uint8)[~mask].tobytes() if n else t
            spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
            out.append((len(t), n, spans, hashlib.sha256(rest).hexdigest(), rest if texts else None))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string()), "kept": pa.array(cols[4], pa.binary())})

    out = blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")


def op4_suffix_dedup(docs: DataFrame) -> DataFrame:
    return repeated_bytes(docs)
