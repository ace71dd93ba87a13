"""Links between entries: an edge table, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def edges(entries: DataFrame) -> DataFrame:
    """src, dst, place, relation, rationale, valid: each entry's ``related`` ids (array), the first of equal ones.

    ``payload`` is a JSON object with relation and rationale; if it is none, the edge stays with ``related`` and ``valid`` is false.
    No payload at all is valid.
    """
    parsed = F.from_json("payload", "relation string, rationale string")
    given = tx.trimmed(F.coalesce("payload", F.lit(""))) != ""
    valid = ~given | F.coalesce(F.get_json_object("payload", "$").startswith("{"), F.lit(False))
    rows = entries.select(F.col("id").alias("src"), F.posexplode("related").alias("place", "dst"), F.when(valid, parsed).alias("p"), valid.alias("valid"))
    rows = rows.withColumn("dst", tx.trimmed(F.col("dst"))).where("dst <> ''")
    once = rows.groupBy("src", "dst").agg(F.min(F.struct("place", "valid", "p")).alias("r"))
    return once.select("src", "dst", "r.place", F.coalesce("r.p.relation", F.lit("related")).alias("relation"), F.coalesce("r.p.rationale", F.lit("")).alias("rationale"), "r.valid")


def checked(links: DataFrame, entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """The links with ``known`` (there is such an entry), ``mutual`` (the other links back), and the decision on the entry that links.

    ``entries`` has one row an id, so that a hub that many link to is a skewed join at most, and never pairs of links.
    """
    ids = entries.select(F.col("id").alias("dst")).distinct().withColumn("_known", F.lit(True))
    back = links.select(F.col("src").alias("dst"), F.col("dst").alias("src")).withColumn("_back", F.lit(True))
    latest = decisions.groupBy(F.col("source_id").alias("src")).agg(F.max(F.struct("updated_at", "event_id", "decision")).alias("_last"))
    joined = links.join(ids, "dst", "left").join(back, ["src", "dst"], "left").join(latest, "src", "left")
    return joined.select(*[links[c] for c in links.columns if c not in ("src", "dst")], "src", "dst", F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce("_back", F.lit(False)).alias("mutual"), F.coalesce("_last.decision", F.lit("pending")).alias("decision"))


def dangling(links: DataFrame) -> DataFrame:
    """dst, n_links, first_src: ids that are linked to and aren't entries."""
    return links.where("not known").groupBy("dst").agg(F.count("*").alias("n_links"), F.min("src").alias("first_src"))
