"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage works on all rows its predecessor kept and returns the columns of
documents; the last adds how often the mix takes a document (``copies``, at
least 1) and its words (``taken``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from gleanery.llm.common import checkpoint, load, packed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality_rules.keep(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines like an earlier one; documents that lose all lines go."""
    return line_dedup.keep_first_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies`` and ``taken``; repeated rows are paired with their draws one by one.

    Given columns of these names stay, and the mix's are then ``mix_copies`` and ``mix_taken``.
    """
    draws = mixing.mix(docs.select("doc_id", "text", "source"))
    draws = draws.select("key", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.row_number().over(Window.partitionBy("key").orderBy("copies")).alias("no"))
    rows = packed(docs).withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("row.source")))
    names = {c.lower() for c in docs.columns}
    added = [F.col(c).alias(c if c not in names else f"mix_{c}") for c in ("copies", "taken")]
    return rows.join(draws, ["key", "no"]).where("copies > 0").select("row.*", *added)


STAGES = [
    ("quality rules", quality),
    ("line dedup", unique_lines),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources", mixed),
]
#: Edit distances of lines and XXH64 fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
