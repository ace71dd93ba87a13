"""Six-criterion scores of candidates, and what they recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from . import matching as mt


def scored(candidates: DataFrame, chunks: DataFrame, keywords: DataFrame, entries: DataFrame, table: DataFrame) -> DataFrame:
    """The candidates' (with ``page``, if they have one) sub-scores, total, structural reason, recommended action, target and rationale."""
    rows = tx.with_structural_reason(candidates, "type", "title", F.col("summary"), F.col("evidence_text"))
    rows = rows.withColumn("_hay", F.concat_ws("\n", "title", "summary", "evidence_text"))
    # tried only in texts that RE2 lets them match
    rows = rows.withColumns({"_noisy": tx.may_have("_hay", *tx.NOISE), "_claiming": tx.may_have("_hay", *tx.CLAIMS), "_bounded": tx.may_have("_hay", lx.BOUNDARY_SCORE_CUE)})
    rows = rows.withColumn("kinds", F.when(F.col("_noisy"), tx.demotion_kinds("_hay")).otherwise(F.array().cast("array<string>"))).withColumn("claims", F.when(F.col("_claiming"), tx.claim_count("_hay")).otherwise(0)).withColumn("bounded", F.col("_bounded") & tx.has(F.col("_hay"), lx.BOUNDARY_SCORE_CUE))
    rows = rows.join(mt.schema_fit(candidates, keywords, table), "candidate_id").join(mt.anchored(candidates, chunks).drop("source_id"), "candidate_id").join(mt.best_entry(candidates, entries, table), "candidate_id")
    flag = lambda c: F.when(c, 1).otherwise(0)
    held, many = F.col("how") == "inside", F.size("refs") >= 2
    paged = F.col("page").isNotNull() if "page" in candidates.columns else F.lit(False)
    rows = rows.select(
        "candidate_id", "source_id", "type", "reason", "kinds", "target", "sim", "matched", "begin",
        F.least("n_matched", F.lit(3)).cast("int").alias("schema_fit"),
        F.least(F.greatest("claims", F.lit(0)), F.lit(3)).cast("int").alias("claim_strength"),
        F.least(flag(held) + flag(held & (F.col("n_text") >= 200)) + flag(paged) + flag(many), F.lit(3)).alias("evidence_quality"),
        (flag(F.col("type").isin("concept", "argument", "method", "objection")) + flag(held & (F.col("n_path") > 0)) + flag(F.length(tx.trimmed(F.col("title"))) >= 6)).alias("reusability"),
        F.when(F.col("sim") >= lx.SIM_UPDATE, 0).when(F.col("sim") >= lx.SIM_LINK, 1).otherwise(2).alias("novelty"),
        F.least(flag(F.col("bounded")) + 1 + flag(F.col("type") == "quotation"), F.lit(3)).alias("boundary"),
        F.when(F.col("reason").isNotNull(), -99).otherwise(-3 * F.size("kinds")).alias("penalty"),
    )
    rows = rows.withColumn("total", sum(F.col(c) for c in ("schema_fit", "claim_strength", "evidence_quality", "reusability", "novelty", "boundary", "penalty")))
    gone = (F.size("kinds") > 0) | F.col("reason").isNotNull() | (F.col("total") <= lx.IGNORE_TOTAL)
    action = F.when(gone, "ignore").when(F.col("sim") >= lx.SIM_UPDATE, "update_existing").when(F.col("sim") >= lx.SIM_LINK, "link_only").otherwise("create_new")
    why = F.array_compact(F.array(F.when(F.size("matched") > 0, F.concat(F.lit("keywords: "), F.array_join("matched", ", "))), F.when(F.col("claim_strength") > 0, F.lit("claim verbs")), F.when(F.col("reason").isNotNull(), F.concat(F.lit("structure: "), "reason"))))
    return rows.withColumn("action", action).withColumn("target", F.when(F.col("action").isin("update_existing", "link_only"), F.col("target"))).withColumn("why", why)
