"""Runs over batches of sources that go on where the last good one ended.

A cursor is a row (source, signature, next_batch): the signature is that of the
outline that the batches are mapped to, so a changed outline begins anew, and a
changed-back one goes on.  A run takes some batches of each source; the cursor
then moves over the good prefix of what was taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Batches of a source that one run takes.
A_RUN = 5


def _begin(next_batch: Column, total: Column) -> Column:
    return F.least(F.greatest(F.coalesce(next_batch, F.lit(0)), F.lit(0)), total)


def positions(batches: DataFrame, cursor: DataFrame, signature: str) -> DataFrame:
    """(source, begin, total): where a run with this outline begins in each source of ``batches`` (source, batch), clamped to what there is."""
    totals = batches.groupBy("source").agg(F.count("*").alias("total"))
    own = cursor.where(F.col("signature") == signature).groupBy("source").agg(F.max("next_batch").alias("next_batch"))
    return totals.join(own, "source", "left").select("source", _begin(F.col("next_batch"), F.col("total")).alias("begin"), "total")


def take(batches: DataFrame, cursor: DataFrame, signature: str, most: int = A_RUN) -> DataFrame:
    """The batches (numbered from 0 in each source) of the next run."""
    at = positions(batches, cursor, signature)
    met = batches.join(at, "source").where((F.col("batch") >= F.col("begin")) & (F.col("batch") < F.col("begin") + most))
    return met.select(*batches.columns)


def advance(batches: DataFrame, cursor: DataFrame, outcome: DataFrame, signature: str) -> DataFrame:
    """The cursor after a run whose batches ended as ``outcome`` (source, batch, status): behind those before the first that isn't ``ok``.

    Rows of other outlines stay, and so do sources without an outcome.
    """
    run = outcome.groupBy("source").agg(F.min(F.when(F.col("status") != "ok", F.col("batch"))).alias("bad"), F.max("batch").alias("last"))
    moved = positions(batches, cursor, signature).join(run, "source").select("source", F.lit(signature).alias("signature"), _begin(F.coalesce("bad", F.col("last") + 1), F.col("total")).cast("long").alias("moved"))
    return cursor.join(moved, ["source", "signature"], "full_outer").select("source", "signature", F.coalesce("moved", F.col("next_batch").cast("long")).alias("next_batch"))
