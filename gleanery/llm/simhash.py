"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``TAU`` bits must, for any thresholds of the partitions
with sum(threshold + 1) = TAU + 1, be within the threshold in one partition.
Bits that vary together share a partition; each fingerprint gets its own
thresholds by dynamic programming over estimated candidate counts, which come
from the partitions' histograms (2^22 values each at most, whatever the input).
Every fingerprint is indexed by its partition values and probes the values
within its thresholds.  A bucket is verified by blocks of ``TILE`` rows against
``TILE`` rows; large buckets are dealt over as many tasks as they have pairs of
blocks.  A block hands on a spanning forest of its links, never all pairs: no
link between different fingerprints is lost for the components.

Cases: null and empty texts have fingerprint zero, linked like any other;
fewer than three words are one shingle; repeated rows each give their row and
share a component; rows without an id don't lower a component's id;
a text of any length is one row's fingerprint; an empty table gives no rows; other
columns aren't read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, packed
from .components import components

TAU = 3
TILE = 2048
_WORDS = 3
_SEED = 42


def fingerprint(text: bytes | None) -> int:
    """64 bits: set where more than half of the 3-word shingles' XXH64 have it set."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(_WORDS)))) if len(words) >= _WORDS else [b" ".join(words)]
    xxh = xxhash.xxh64_intdigest
    h = np.array([xxh(s, _SEED) for s in shingles], dtype="<u8")
    n = len(h)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):  # bounded work space for very long texts
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key`` (hash of id and text), ``fp`` (long): one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).cast("binary").alias("t"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(distinct: DataFrame, n_parts: int) -> list[list[int]]:
    """The 64 bits in ``n_parts`` groups, most correlated together; from sums of products, 4096 a task."""

    def run(batches):
        total = np.zeros((65, 65), dtype=np.int64)
        for b in batches:
            x = np.hstack([_bits(b.column(0).to_numpy(zero_copy_only=False)), np.ones((b.num_rows, 1), np.uint8)]).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], names=["cell", "n"])

    cells = distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 65 x 65 sums
    c = np.zeros(65 * 65)
    for r in cells:
        c[r["cell"]] = r["n"]
    c = c.reshape(65, 65)
    n = max(c[64, 64], 1)
    cov = c[:64, :64] / n - np.outer(c[64, :64], c[64, :64]) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, parts = list(range(64)), []
    for k in range(n_parts):
        width = len(left) // (n_parts - k)
        part = [max(left, key=lambda b: (round(corr[b, left].sum(), 9), -b))]
        while len(part) < width:
            part.append(max((b for b in left if b not in part), key=lambda b: (round(corr[b, part].sum(), 9), -b)))
        parts.append(sorted(part))
        left = [b for b in left if b not in part]
    return parts


def _values(fp: np.ndarray, part: list[int]) -> np.ndarray:
    v = np.zeros(len(fp), dtype=np.int64)
    for j, b in enumerate(part):
        v |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return v


def _within(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row t: how many fingerprints have a partition value within t bits of each value."""
    exact = np.zeros((most + 1, len(hist)), dtype=np.float32)
    exact[0] = hist
    index = np.arange(len(hist))
    for b in range(width):
        flipped = exact[:, index ^ (1 << b)]
        exact[1:] += flipped[:-1]
    return np.cumsum(exact, axis=0)


def allocate(cost: list[np.ndarray], tau: int) -> np.ndarray:
    """Thresholds (partitions x queries) of least total cost with sum(threshold + 1) = tau + 1; ``cost[i][t]`` is by query."""
    n = cost[0].shape[1]
    best = np.full((tau + 2, n), np.inf)
    best[0] = 0
    chosen = []
    for c in cost:
        new, pick = best.copy(), np.zeros((tau + 2, n), dtype=np.int8)  # threshold -1: the partition isn't probed
        for used in range(1, tau + 2):
            for t in range(min(used, len(c))):
                total = best[used - t - 1] + c[t]
                better = total < new[used]
                new[used][better] = total[better]
                pick[used][better] = t + 1
        best = new
        chosen.append(pick)
    out, left = np.zeros((len(cost), n), dtype=np.int8), np.full(n, tau + 1)
    for i in range(len(cost) - 1, -1, -1):
        got = chosen[i][left, np.arange(n)]
        out[i] = got - 1
        left = left - got
    return out


def links(distinct: DataFrame, tau: int = TAU, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between different fingerprints (``fp``) that connect all those linked within ``tau`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    n_parts = 4 if n <= 1 << 22 else 3
    parts = correlated_parts(distinct, n_parts)

    def histogram(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, part in enumerate(parts):
                v, c = np.unique(_values(fp, part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(v), pa.array(c)], names=["part", "value", "n"])

    # 2^22 values of each of three or four partitions at most: bounded whatever the number of documents
    counts = distinct.select("fp").mapInArrow(histogram, "part long, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    within = []
    for i, part in enumerate(parts):
        mine = counts.filter(pa.compute.equal(counts["part"], i))
        hist = np.zeros(1 << len(part), dtype=np.int64)
        hist[mine["value"].to_numpy()] = mine["n"].to_numpy()
        within.append(_within(hist, len(part), tau if n_parts == 4 else 1))
    shared = spark.sparkContext.broadcast((parts, within))
    shards = max(1, n * 10 // 200_000)

    def deal(batches):
        parts, within = shared.value
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            value = [_values(fp, p) for p in parts]
            cost = [np.stack([w[t][v] + sum(comb(len(p), k) for k in range(t + 1)) for t in range(len(w))]) for p, v, w in zip(parts, value, within)]
            limits = allocate(cost, tau)
            out = []
            for i, (p, v, w) in enumerate(zip(parts, value, within)):
                out.append(_dealt(i, v, fp, w, True, tile))
                for t in range(tau + 1):
                    at = np.flatnonzero(limits[i] >= t)
                    for flip in combinations(range(len(p)), t) if len(at) else ():
                        out.append(_dealt(i, v[at] ^ sum(1 << f for f in flip), fp[at], w, False, tile))
            bucket, side, fps = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array((bucket % shards).astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(side), pa.array(fps.view(np.int64))], names=["shard", "bucket", "side", "fp"])

    def verify(table: pa.Table) -> pa.Table:
        a, b = verified(*(table.column(k).to_numpy() for k in ("bucket", "side", "fp")), tau, tile)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "shard int, bucket long, side boolean, fp long").groupBy("shard").applyInArrow(verify, "a long, b long")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _dealt(part: int, value: np.ndarray, fp: np.ndarray, within: np.ndarray, index: bool, tile: int):
    """(bucket, side, fp): a value's bucket is split in n x n blocks if n tiles hold it; an index row goes to one row of blocks, a probe to one column."""
    n = np.ceil(within[min(1, len(within) - 1)][value] / tile).astype(np.int64)
    n = np.maximum(n, 1)
    own = (_mix(fp) % n.astype(np.uint64)).astype(np.int64)
    rep = np.repeat(np.arange(len(fp)), n)
    other = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    row, col = (own[rep], other) if index else (other, own[rep])
    bucket = _mix(_mix(value[rep].astype(np.uint64) * np.uint64(8) + np.uint64(part)) + _mix(row.astype(np.uint64) * np.uint64(1 << 24) + col.astype(np.uint64) + np.uint64(1)))
    return bucket, np.full(len(rep), index), fp[rep]


def verified(bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, tau: int, tile: int):
    """Edges of a spanning forest of the links found in each bucket, index rows against probes."""
    order = np.lexsort((side, bucket))
    bucket, side, fp = bucket[order], side[order], fp[order].view(np.uint64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    stop = np.r_[start[1:], len(bucket)]
    middle = start + np.add.reduceat(~side, start) if len(start) else start  # probes, then index rows
    n_probe, n_index = middle - start, stop - middle
    work = n_probe * n_index
    a, b = [], []
    small = np.flatnonzero((work > 0) & (work <= 4096))
    for at in range(0, len(small), 4096):
        s = small[at : at + 4096]
        k = np.repeat(s, work[s])
        r = np.arange(len(k)) - np.repeat(np.cumsum(work[s]) - work[s], work[s])
        x, y = fp[start[k] + r // n_index[k]], fp[middle[k] + r % n_index[k]]
        hit = (x < y) & (np.bitwise_count(x ^ y) <= tau) | (x > y) & (np.bitwise_count(x ^ y) <= tau)
        a.append(x[hit])
        b.append(y[hit])
    for k in np.flatnonzero(work > 4096):
        probes, index = np.unique(fp[start[k] : middle[k]]), np.unique(fp[middle[k] : stop[k]])
        for i in range(0, len(probes), tile):
            for j in range(0, len(index), tile):
                x, y = _forest(probes[i : i + tile], index[j : j + tile], tau)
                a.append(x)
                b.append(y)
    a, b = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (a, b))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _forest(x: np.ndarray, y: np.ndarray, tau: int):
    """Edges that connect all of ``x`` and ``y`` within ``tau`` bits: at most one for each row, by least labels spread to a fixed point."""
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= tau
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, x, y = near[np.ix_(i, j)], x[i], y[j]
    if not near.size:
        return x[:0], x[:0]
    top = np.iinfo(np.int32).max
    label_x, label_y = np.arange(len(x), dtype=np.int32), np.full(len(y), top, dtype=np.int32)
    while True:
        label_y = np.where(near, label_x[:, None], top).min(axis=0)
        new = np.minimum(label_x, np.where(near, label_y[None, :], top).min(axis=1))
        if (new == label_x).all():
            break
        label_x = new
    left, right = np.r_[x, y], np.r_[x[label_x], x[label_y]]
    keep = left != right
    return left[keep], right[keep]


def near_duplicates(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``fp``, ``component_id`` (smallest id reachable) and ``first_key`` (of the row that leads the group)."""
    found = checkpoint(fingerprints(docs, id_col, text_col))
    groups = checkpoint(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("lead")))
    root = components(links(groups.select("fp"), tau))
    rooted = groups.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", "lead", F.coalesce("root", "fp").alias("root"))
    merged = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("lead").alias("lead"))
    by_fp = rooted.select("fp", "root").join(merged, "root").select("fp", "component_id", F.col("lead.key").alias("first_key"))
    return found.join(by_fp, "fp").select("doc_id", "key", "fp", "component_id", "first_key")


def keep_first(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row of each group of near-duplicates: the one of smallest id, repeated rows once; columns as given, whatever their names."""
    leads = near_duplicates(docs.select("doc_id", "text"), tau).select(F.col("first_key").alias("key")).distinct()
    return packed(docs).join(leads, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op3_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
