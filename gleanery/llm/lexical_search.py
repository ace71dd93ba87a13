"""Ranked lexical search: accumulators from short lists, documents at a time over long ones.

``build_index`` writes an inverted index of whole texts in one map over the rows,
without a shuffle: each slice of about ``SHARD`` bytes of texts is a shard with
postings of all its terms.  Documents of a shard are numbered in ascending order
of id.  Lists longer than 1/``LONG`` of the shard's documents have, for each cell
of ``CELL`` documents, the greatest term frequency and the least length there, which
bound every score in the cell whatever the corpus's totals are.

``search`` takes queries in blocks of about ``TERMS`` terms, brings the document
frequencies of these terms to the driver, and joins them to the index.  A shard
answers each query in two phases.  The short lists are added up term at a time;
their sums, sorted by document, then are one more iterator with an upper bound in
each cell.  That iterator and the long lists are passed through document at a
time: a cell whose bounds add up to less than the k-th best score so far (at first
the k-th greatest sum of the short lists) is skipped in all lists; documents in
other cells are scored whole, in order.  The best of the shards are merged in two
steps.  Scores are exact integers, so skipping changes no row.

Cases: null texts and texts without terms are in no list and count nowhere; a query
without terms, or whose terms come nowhere, has no rows; repeated rows are documents
of their own and repeated queries are answered each; null ids come last among equal
scores; an empty table gives no rows; a long text is a shard of its own; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buffers import binaries, flat, slices
from .common import ascii_lower, shared_folder

#: Bytes of texts in a shard.
SHARD = 16 << 20
#: A list of more than 1/LONG of the shard's documents is long.
LONG = 16
#: Documents of a cell, and cells scored at a time.
CELL, CELLS = 128, 32
#: Distinct terms of the queries answered by one job.
TERMS = 1 << 16
#: Groups in which the shards' best are merged first.
MERGE = 256
#: What separates terms.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_TERM = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def shard_postings(data: np.ndarray, at: np.ndarray, rank: np.ndarray):
    """Of UTF-8 texts: (terms, offsets of their lists, documents, frequencies, lengths); document k is numbered ``rank[k]``."""
    inside = _TERM[data]
    before = np.concatenate(([False], inside[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    place = np.cumsum(inside, dtype=np.int64)
    letters = _LOWER[data[inside]]
    coded = binaries(letters, np.append(place[starts] - 1, len(letters))).dictionary_encode()
    own = rank[np.searchsorted(at, starts, side="right") - 1]
    n_docs = len(rank)
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n_docs + own, return_counts=True)
    term, docs = np.divmod(key, max(n_docs, 1))
    offsets = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    return coded.dictionary, offsets, docs, tf, np.bincount(own, minlength=n_docs)


def cell_bounds(docs: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each cell that a list has documents in: cell, greatest frequency, least length."""
    cell = docs // CELL
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return np.column_stack([cell[first], np.maximum.reduceat(tf, first), np.minimum.reduceat(n[docs], first)]).astype("<u4")


def build_index(docs: DataFrame, path: str, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (shard, term, df, total, docs, tfs, cells) for each term of a shard, and a row with null ``term`` for the shard: documents with terms, terms, lengths in ``tfs``, ids."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for b in slices(batches, "t", shard):
            ids = b.column("doc_id")
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            terms, offsets, found, tf, n = shard_postings(*flat(b.column("t")), rank)
            sizes, count = np.diff(offsets), len(terms)
            sums = np.add.reduceat(tf, offsets[:-1]) if count else tf
            cells = [b""] * count
            for k in np.flatnonzero(sizes * LONG > len(order)).tolist():
                s = slice(offsets[k], offsets[k + 1])
                cells[k] = cell_bounds(found[s], tf[s], n).tobytes()
            as_bytes = lambda values: binaries(values.astype("<u4").view(np.uint8), offsets * 4).cast(pa.binary())
            names = ["shard", "term", "df", "total", "docs", "tfs", "cells", "ids"]
            none = pa.ListArray.from_arrays(pa.array([0] * (count + 1), pa.int32()), ids.slice(0, 0))
            yield pa.RecordBatch.from_arrays([pa.array([number] * count, pa.int64()), terms.cast(pa.string()), pa.array(sizes.astype(np.int64)), pa.array(sums), as_bytes(found), as_bytes(tf), pa.array(cells, pa.binary()), none], names=names)
            all_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([b""]), pa.array([n.astype("<u4").tobytes()], pa.binary()), pa.array([b""]), all_ids], names=names)
            number += 1

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    index = rows.mapInArrow(run, f"shard long, term string, df long, total long, docs binary, tfs binary, cells binary, ids array<{rows.schema['doc_id'].dataType.simpleString()}>")
    index.write.option("compression", "zstd").parquet(path)


class Lengths:
    """Score parts of one term, from the corpus's number of documents and of terms."""

    def __init__(self, n: np.ndarray, documents: int, terms: int):
        n = n.astype(np.int64)
        if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
            n = n.astype(object)  # beyond 64 bits
        self.m = (25 + 75 * n * documents // terms).astype(np.int64) if terms else n

    @staticmethod
    def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def best_of_shard(query: list[tuple[int, int]], lists: dict, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best, ties by document; ``query`` has (term, weight), ``lists`` of a term (documents, frequencies, cells' bounds)."""
    short, long = [], []
    for term, weight in query:
        if term in lists and weight > 0:
            (long if lists[term][2] is not None else short).append((weight, *lists[term]))
    # term at a time: the short lists' sums
    held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:
        docs = np.concatenate([d for _, d, _, _ in short])
        parts = np.concatenate([w * Lengths.part(tf, m[d]) for w, d, tf, _ in short])
        order = np.argsort(docs, kind="stable")
        docs, parts = docs[order], parts[order]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        held, sums = docs[first], np.add.reduceat(parts, first)
    if not long:
        return _top(held, sums, k)
    least = int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 1
    # document at a time: each iterator's bound in each cell
    bound = np.zeros(-(-len(m) // CELL), np.int64)
    for w, _, _, (cell, cell_tf, cell_m) in long:
        bound[cell] += w * Lengths.part(cell_tf, cell_m)
    if len(held):
        cell = held // CELL
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bound[cell[first]] += np.maximum.reduceat(sums, first)
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, alive = 0, np.flatnonzero(bound >= least)
    while begin < len(alive):
        cells = alive[begin : begin + CELLS]
        begin += CELLS
        cells = cells[bound[cells] >= least]  # the least has risen since
        if not len(cells):
            continue
        lo, hi = cells[0] * CELL, min((cells[-1] + 1) * CELL, len(m))
        wanted = np.zeros(cells[-1] - cells[0] + 1, bool)
        wanted[cells - cells[0]] = True
        total = np.zeros(hi - lo, np.int64)
        for w, d, tf, _ in long:
            s = slice(*np.searchsorted(d, (lo, hi)))
            at, f = d[s] - lo, tf[s]
            if len(cells) < len(wanted):
                hit = wanted[at // CELL]
                at, f = at[hit], f[hit]
            total[at] += w * Lengths.part(f, m[at + lo])
        s = slice(*np.searchsorted(held, (lo, hi)))
        total[held[s] - lo] += sums[s]
        found = np.flatnonzero(total >= least)
        found = found[wanted[found // CELL]]
        best, scores = _top(np.concatenate([best, found + lo]), np.concatenate([scores, total[found]]), k)
        if len(best) == k:
            least = max(least, int(scores[-1]))
    return best, scores


def _top(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    positive = np.flatnonzero(scores > 0)
    order = positive[np.lexsort((docs[positive], -scores[positive]))[:k]]
    return docs[order], scores[order]


def _query_blocks(queries: DataFrame, most: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Blocks of (id, terms), each of about ``most`` distinct terms; one block at a time is on the driver."""
    block, seen = [], set()
    for row in queries.toLocalIterator():
        if row.terms:
            block.append((row.item_id, row.terms))
            seen.update(row.terms)
            if len(seen) >= most:
                yield block
                block, seen = [], set()
    if block:
        yield block


def search(spark: SparkSession, index_path: str, queries: DataFrame, k: int = 10, terms_a_block: int = TERMS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best of the index for each query."""
    index = spark.read.parquet(index_path)
    id_type, doc_type = queries.schema[id_col].dataType, index.schema["ids"].dataType.elementType
    path = f"{shared_folder(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    documents, terms = index.where("term is null").agg(F.sum("df"), F.sum("total")).first()
    split = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), BREAK + "+"), "")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _query_blocks(queries.select(F.col(id_col).alias("item_id"), split.alias("terms")), terms_a_block):
        _search_block(spark, index_path, block, documents or 0, terms or 0, k, id_type, doc_type).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _search_block(spark: SparkSession, path: str, block: list, documents: int, terms: int, k: int, id_type: T.DataType, doc_type: T.DataType) -> DataFrame:
    index = spark.read.parquet(path)
    numbers: dict[str, int] = {}
    for _, words in block:
        for w in words:
            numbers.setdefault(w, len(numbers))
    wanted = F.broadcast(spark.createDataFrame(list(numbers.items()), "term string, number int"))  # the block's terms
    lists = index.where("term is not null").join(wanted, "term").select("shard", "number", "df", "docs", "tfs", "cells")
    df = dict(map(tuple, lists.groupBy("number").agg(F.sum("df")).collect()))
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    items = [sorted(Counter(numbers[w] for w in words if numbers[w] in df).items()) for _, words in block]
    plan = spark.sparkContext.broadcast([[(t, weight[t] * n) for t, n in item] for item in items])

    def run(lengths: pa.Table, found: pa.Table) -> pa.Table:
        ids = lengths.column("ids").combine_chunks().values
        none = pa.table({"shard": pa.array([], pa.int64()), "q": pa.array([], pa.int32()), "doc_id": ids.slice(0, 0), "score": pa.array([], pa.int64())})
        if not found.num_rows:
            return none
        n = np.frombuffer(lengths.column("tfs")[0].as_py(), "<u4")
        m = Lengths(n, documents, terms).m
        held = {}
        for t, d, f, c in zip(*(found.column(x).to_pylist() for x in ("number", "docs", "tfs", "cells"))):
            cells = None
            if c:
                cell = np.frombuffer(c, "<u4").reshape(-1, 3).astype(np.int64)
                cells = (cell[:, 0], cell[:, 1], Lengths(cell[:, 2], documents, terms).m)
            held[t] = (np.frombuffer(d, "<u4").astype(np.int64), np.frombuffer(f, "<u4").astype(np.int64), cells)
        out = [(np.full(len(best), q), best, scores) for q, item in enumerate(plan.value) for best, scores in [best_of_shard(item, held, m, k)] if len(best)]
        q, best, scores = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"shard": pa.array(np.full(len(q), lengths.column("shard")[0].as_py()), pa.int64()), "q": pa.array(q, pa.int32()), "doc_id": ids.take(pa.array(best)), "score": pa.array(scores, pa.int64())})

    doc_rows = spark.read.parquet(path).where("term is null").select("shard", "tfs", "ids")
    answers = doc_rows.groupBy("shard").cogroup(lists.groupBy("shard")).applyInArrow(run, f"shard long, q int, doc_id {doc_type.simpleString()}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    merged = answers.withColumn("part", F.pmod("shard", F.lit(MERGE)))
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", id_type)])))
    return merged.join(names, "q").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/index-{uuid.uuid4().hex}"
    build_index(docs, path)
    return search(docs.sparkSession, path, items)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP12_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select cast(count(*) as bigint) as docs, cast(sum(len(w)) as bigint) as terms from d where len(w) > 0),
i as (select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
u as (select q, t, count(*) as k from (select q, unnest(w) as t from i) group by q, t),
p as (select r, n, t, count(*) as tf from (select r, cast(len(w) as bigint) as n, unnest(w) as t from d) where t in (select t from u) group by r, n, t),
f as (select t, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from p, g group by t, docs),
s as (select q, r, cast(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as bigint) as score from u join p using (t) join f using (t), g group by q, r)
select item_id, cast(rank as int) as rank, doc_id, score from (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s join d using (r) where score > 0) join i using (q) where rank <= 10
"""
