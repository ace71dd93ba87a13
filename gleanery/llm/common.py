"""Helpers shared by the operators: checkpoints, word splitting, block counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import persisted, shared_folder

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]"
#: sha256 of the empty string.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``."""
    return persisted(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet, compressed, to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def packed(docs: DataFrame) -> DataFrame:
    """(row, key): all columns of ``docs`` (doc_id, text, ...) in one struct, so that none clashes with a stage's own, and the row's key."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.withColumn("key", row_key(F.col("row.doc_id"), F.col("row.text")))


#: Bits of the filters that keep rows without a partner from being shuffled: 8 for each key, up to 2^26 (16 MB of rows).
_LEAST_BITS, _MOST_BITS = 20, 26


def flagged(rows: DataFrame, column: Column, keys: DataFrame, n_keys: int, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: true if ``column`` (long) is among ``keys`` (one column of longs), and of few others.

    The bits are broadcast; their number is bounded, and a full filter only lets more rows pass.
    """
    bits = min(max(_LEAST_BITS, (8 * n_keys).bit_length()), _MOST_BITS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word, bit = lambda c: F.shiftright(place(c), 6), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    key = F.col(keys.columns[0])
    filled = keys.groupBy(word(key).alias("bit_word")).agg(F.bit_or(bit(key)).alias("bits"))
    met = rows.join(F.broadcast(filled), word(column) == F.col("bit_word"), "left")
    return met.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(bit(column)) != 0, F.lit(False))).drop("bit_word", "bits")


def may_be_in(rows: DataFrame, column: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """``rows`` whose ``column`` may be among ``keys``: all that are, and few others."""
    return flagged(rows, F.col(column), keys.select(column), n_keys, "may_be_in").where("may_be_in").drop("may_be_in")


def words(text: Column | str) -> Column:
    """The words of a text as an array; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def block_count(df: DataFrame, text: str, block_mb: int) -> int:
    """How many blocks of about ``block_mb`` MB the texts fill: one number from one aggregate."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // (block_mb << 20)))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
