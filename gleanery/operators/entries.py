"""Knowledge entries: decisions, build, index, upsert, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

def with_decisions(candidates: DataFrame, log: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Candidates with their latest decision, and its event, of ``log`` (source_id, candidate_id, decision, updated_at, event_id), ``pending`` if there is none.

    Only records up to ``as_of`` count, in whatever order they came; of equal times the greatest event id wins.  The
    log is keyed by source and candidate alone, so a decision stays when a candidate is scored anew.
    """
    known = log if as_of is None else log.where(F.col("updated_at") <= as_of)
    latest = known.groupBy("source_id", "candidate_id").agg(F.max(F.struct("updated_at", "event_id", "decision")).alias("last"), F.count("*").alias("n_records"))
    joined = candidates.join(latest, ["source_id", "candidate_id"], "left")
    return joined.withColumns({"decision": F.coalesce("last.decision", F.lit("pending")), "decided_by": F.col("last.event_id"), "n_records": F.coalesce("n_records", F.lit(0))}).drop("last")


def savable(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("action") != "ignore") & ~F.col("decision").isin("held", "discarded"))


def build(candidates: DataFrame, mapping: DataFrame, now: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One entry for each source and outline node (``unclassified`` without one), its claims in document order."""
    rows = candidates.join(mapping.select("candidate_id", "node_id"), "candidate_id", "left")
    node = F.coalesce("node_id", F.lit("unclassified"))
    claim = F.struct("begin", "stop", "candidate_id", F.col("candidate_id").alias("claim_id"), F.col("title").alias("statement"), F.lit("").alias("translated_text"), F.col("source_text").alias("original_text"), F.col("refs").alias("evidence_refs"))
    claims = F.array_sort(F.collect_list(claim))
    terms = F.array_sort(F.collect_list(F.struct("begin", "stop", F.col("original_terms").alias("t"))))
    grouped = rows.groupBy("source_id", node.alias("node")).agg(claims.alias("claims"), F.flatten(F.transform(terms, lambda x: x["t"])).alias("all_terms"))
    grouped = grouped.withColumn("low", F.transform("all_terms", F.lower))
    unique = F.slice(F.filter("all_terms", lambda t, i: F.array_position("low", F.lower(t)) == i + 1), 1, 24)
    return grouped.select(
        F.concat_ws("-", "source_id", "node").alias("id"), F.col("node").alias("title"), F.lit("extracted").alias("category"), F.lit("draft").alias("status"),
        F.when(F.col("node") != "unclassified", F.col("node")).alias("outline_node_id"), F.array("source_id").alias("source_ids"), unique.alias("original_terms"), "claims", F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("related"),
        F.transform("claims", lambda c: c["candidate_id"]).alias("created_from_candidates"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
    )


def index(entries: DataFrame) -> DataFrame:
    return entries.select("id", "title", "category", "status", "outline_node_id", F.size("claims").cast("long").alias("n_claims"), "updated_at").orderBy("id")


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def reviewed(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims (candidate_id, statement, original_text) with non-empty statements of reviews put in; originals stay."""
    given = reviews.select("candidate_id", tx.trimmed(F.col("statement")).alias("given"))
    joined = claims.join(given, "candidate_id", "left")
    return joined.withColumn("statement", F.when(F.coalesce(F.col("given"), F.lit("")) != "", F.col("given")).otherwise(F.col("statement"))).drop("given")


def lineage(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("id").alias("entry_id"), F.explode("created_from_candidates").alias("candidate_id"))


def file_leaf(key: str) -> Column:
    """A key as part of a file name; only for display."""
    leaf = F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9_-]", "-"), r"\A-+|-+\z", "")
    return F.when(leaf == "", "entry").otherwise(leaf)
