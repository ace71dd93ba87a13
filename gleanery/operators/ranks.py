"""Ranks inside groups of any size: range partitions, counted, then offset by those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import persisted


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their place from 0 in the group ``by``, in ascending ``order`` (which should leave no ties).

    Rows are dealt by ranges of (by, order), so that a group of any size is spread over several tasks; what is ordered
    in one task is one range.  A group's offsets come from one row for each range that it reaches into.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = persisted(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", *[F.col(c).alias(f"_{c}") for c in by], (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1)
    same = inside["_part"] == offsets["_part"]
    for c in by:
        same &= inside[c].eqNullSafe(offsets[f"_{c}"])
    placed = inside.join(offsets, same)
    return placed.select(*[inside[c] for c in rows.columns], (F.col("_before") + F.col("_inside")).cast("long").alias(name))
