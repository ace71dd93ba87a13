"""Mixing sources to target weights by capped water-filling.

Sources share the words of the corpus by weight.  A source whose share is more
than ``cap`` times its size is clamped there, and the excess is shared among the
others by weight, until none is above.  Each round is one aggregate that brings
two sums to the driver.  A source's share is met by whole repetitions of all its
documents, and one more of those that come first in a seeded order until the
rest is filled: the error is at most half of one document.  The order's running
sums are taken over 4096 hash buckets first and inside a bucket last, so that a
large source is never in one task.

Cases: a null or empty text has size 0 and is taken 0 times; null is a source of
its own, the last; repeated rows are sampled one by one; an empty table gives
no rows; reruns agree; a text of any length counts whole; other columns aren't read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, words

_RANK_PARTS = 64


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last: counted in range partitions, then offset by those before."""
    parts = checkpoint(sources.repartitionByRange(_RANK_PARTS, F.col("source").isNull(), F.col("source")).withColumn("pid", F.spark_partition_id()))
    counts = parts.groupBy("pid").agg(F.count("*").alias("n"))
    offsets = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("offset"))  # _RANK_PARTS rows at most
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").isNull(), "source")) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(offsets), "pid").withColumn("rank", F.col("inside") + F.col("offset")).drop("pid", "inside", "offset")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source``, ``source_size`` and ``target`` (double) for rows (source, source_size)."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    table = checkpoint(ranked(sources).select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, weigh, clamped = total, None, None
    while True:
        # A source is clamped if its share at the last level was above its cap; levels only rise.
        free = ~clamped if clamped is not None else F.lit(True)
        row = table.agg(F.sum(F.when(~free, F.col("most")).otherwise(0)).alias("used"), F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("w")).first()
        now = (total - (row["used"] or 0), row["w"] or 0)
        if now == (left, weigh) or not now[1]:
            break
        left, weigh = now
        over = F.lit(float(left)) * F.col("weight") / F.lit(float(weigh)) > F.col("most")
        clamped = over if clamped is None else clamped | over
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weigh or 1))
    return table.select("source", "source_size", F.when(clamped, F.col("most").cast("double")).otherwise(share).alias("target") if clamped is not None else share.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``key``, ``size``, ``source_size``, ``target``, ``copies``: one row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), order.alias("h"), F.xxhash64(F.col(id_col), text).alias("key")))
    sized = sized.withColumn("bucket", F.substring("h", 1, 3))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap).withColumnRenamed("source", "s")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    filled = buckets.withColumn("before", before).join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s", "n").withColumnsRenamed({"source": "s", "bucket": "b"})
    placed = sized.withColumn("upto", F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(filled, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    # a document is in the fractional repetition if its middle comes before the rest's end
    extra = (2 * (F.col("before") + F.col("upto")) - F.col("size")).cast("double") <= 2 * rest
    copies = F.when(F.col("size") > 0, whole + F.when((rest > 0) & extra, 1).otherwise(0)).otherwise(0)
    return joined.select("doc_id", "source", "key", "size", "source_size", "target", copies.cast("long").alias("copies"))


def op6_mix(docs: DataFrame) -> DataFrame:
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
  md5(concat('mix:', coalesce(cast(doc_id as varchar), ''), ':', md5(coalesce(text, '')))) as h from documents),
s as (select source, cast(sum(size) as bigint) as n from d group by source),
w as (select source, n, (array[5, 2, 1])[1 + cast((row_number() over (order by source nulls last) - 1) % 3 as int)] as w from s),
o as (select *, row_number() over (order by 3.0 * n / w, source nulls last) as k, sum(3 * n) over (order by 3.0 * n / w, source nulls last) - 3 * n as used, sum(w) over (order by 3.0 * n / w, source nulls last) - w as gone, sum(n) over () as total, sum(w) over () as weigh from w),
l as (select cast(total - used as double) as r, cast(weigh - gone as double) as w, k from o where cast(total - used as double) * w / cast(weigh - gone as double) <= 3 * n order by k limit 1),
t as (select source, n, case when o.k >= l.k then l.r * o.w / l.w else cast(3 * n as double) end as target from o, l),
u as (select doc_id, size, n, target, case when n > 0 then floor(target / n) else 0 end as whole, sum(size) over (partition by d.source order by h, size rows unbounded preceding) as upto from d join t on d.source is not distinct from t.source)
select doc_id, size, n as source_size, round(target, 6) as target, cast(case when size > 0 then size * (whole + case when target - whole * n > 0 and cast(2 * upto - size as double) <= 2 * (target - whole * n) then 1 else 0 end) else 0 end as bigint) as taken from u
"""
