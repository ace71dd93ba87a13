"""Entries as Markdown texts, and back.

A text has front matter, a title, the summary, and a block for each claim with
its translation and original between marker lines.  Texts may hold such lines
themselves: writing puts a backslash before them, reading takes it off, so that
every entry comes back whole.  Reading is a job over the table of lines: what a
line belongs to follows from the last marker and the last claim before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

_LISTS = ("source_ids", "original_terms", "tags", "related", "created_from_candidates")
_TR, _OR, _END = lx.MD_TRANSLATED, lx.MD_ORIGINAL, lx.MD_END
#: A line that reading takes for structure, behind any number of backslashes.
_STRUCTURE = rf"((?:[ \t]*(?:{_TR}|{_OR}|{_END})[ \t]*$)|{lx.MD_CLAIMS_START})"
CLAIM = "claim_id string, statement string, translated_text string, original_text string, evidence_refs array<string>, candidate_id string"


def _flat(c: Column) -> Column:
    return tx.trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), "\r?\n", " "))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?dm)^(\\*){_STRUCTURE}", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?dm)^\\(\\*){_STRUCTURE}", "$1$2")


def to_markdown(entries: DataFrame) -> DataFrame:
    """id, markdown. Columns that ``entries`` has not are written as empty; list values are joined by ``, `` (reading splits at commas)."""

    def value(k: str) -> Column:
        if k not in entries.columns:
            return F.lit("")
        return F.array_join(F.transform(F.coalesce(k, F.array().cast("array<string>")), _flat), ", ") if k in _LISTS else _flat(F.col(k))

    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), value(k)) for k in lx.MD_KEYS], F.lit("---"))
    text = lambda c: escaped(F.coalesce(c, F.lit("")))
    block = lambda c: F.concat_ws(
        "\n", F.concat(F.lit("### "), _flat(c["statement"])), F.concat(F.lit("- claim_id: "), _flat(c["claim_id"])), F.concat(F.lit("- candidate_id: "), _flat(c["candidate_id"])),
        F.concat(F.lit("- evidence: "), F.array_join(F.transform(c["evidence_refs"], _flat), ", ")), F.lit(""), F.lit(_TR), text(c["translated_text"]), F.lit(_OR), text(c["original_text"]), F.lit(_END), F.lit(""),
    )
    summary = tx.trimmed(F.coalesce(F.col("summary"), F.lit(""))) if "summary" in entries.columns else F.lit("")
    head = F.concat_ws("\n", front, F.lit(""), F.concat(F.lit("# "), _flat(F.col("title"))), F.lit(""), F.when(summary != "", F.concat(escaped(summary), F.lit("\n"))), F.lit(lx.MD_CLAIMS), F.lit(""))
    return entries.select("id", F.when(F.size("claims") > 0, F.concat_ws("\n", head, F.array_join(F.transform("claims", block), "\n"))).otherwise(head).alias("markdown"))


def _items(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), tx.trimmed), lambda x: x != "")


def from_markdown(texts: DataFrame) -> DataFrame:
    """key and all fields of the entries in texts (key, markdown), one a row.

    Unknown statuses are ``draft``; a claim without id gets ``c`` and its number; texts are trimmed; what is missing is empty or null.
    """
    line = F.regexp_replace("markdown", "\r\n?", "\n")
    lines = texts.select("key", F.posexplode(F.split(line, "\n")).alias("ln", "line")).withColumn("bare", tx.trimmed(F.col("line")))
    whole, order = Window.partitionBy("key"), Window.partitionBy("key").orderBy("ln")
    fenced = F.max(F.when(F.col("ln") == 0, F.col("bare") == "---")).over(whole)
    closing = F.min(F.when((F.col("ln") > 0) & (F.col("bare") == "---"), F.col("ln"))).over(whole)
    rows = lines.withColumn("front", F.when(fenced, F.coalesce(closing, F.lit(1 << 30))).otherwise(-1))
    heading = F.min(F.when((F.col("ln") > F.col("front")) & F.col("line").startswith(lx.MD_CLAIMS_START), F.col("ln"))).over(whole)
    rows = rows.withColumn("body", F.coalesce(heading, F.lit(1 << 30)))
    marker = F.when(F.col("ln") > F.col("front"), F.when(F.col("bare") == _TR, "t").when(F.col("bare") == _OR, "o").when(F.col("bare") == _END, "-"))
    rows = rows.withColumn("marker", marker).withColumn("part", F.coalesce(F.last("marker", ignorenulls=True).over(order), F.lit("-")))
    starts = (F.col("ln") > F.col("body")) & (F.col("part") == "-") & F.col("marker").isNull() & F.col("line").startswith("### ")
    rows = rows.withColumn("no", F.sum(F.when(starts, 1).otherwise(0)).over(order))

    of = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ln", "line")))), lambda x: x["line"])
    joined = lambda test: tx.trimmed(unescaped(F.array_join(of(test), "\n")))
    plain = F.col("marker").isNull()
    claim = F.col("no") > 0
    grouped = rows.groupBy("key", "no").agg(
        of(claim & (F.col("part") == "-") & plain).alias("head"),
        joined(claim & (F.col("part") == "t") & plain).alias("translated_text"),
        joined(claim & (F.col("part") == "o") & plain).alias("original_text"),
        of(~claim & (F.col("ln") > 0) & (F.col("ln") < F.col("front"))).alias("fields"),
        of(~claim & (F.col("ln") > F.col("front")) & (F.col("ln") < F.col("body"))).alias("before"),
    )
    rest = F.slice("head", 2, 1 << 30)
    n_meta = F.array_position(F.transform(rest, lambda x: x.startswith("- ")), False) - 1
    meta = F.transform(F.slice(rest, F.lit(1), F.when(n_meta < 0, F.size(rest)).otherwise(n_meta).cast("int")), lambda x: F.substring(x, 3, 1 << 30))
    last = lambda pairs, k: F.try_element_at(F.transform(F.filter(pairs, lambda x: tx.trimmed(F.substring_index(x, ":", 1)) == k), lambda x: tx.trimmed(F.substring(x, F.locate(":", x) + 1, F.length(x)))), F.lit(-1))
    named = lambda pairs: F.filter(pairs, lambda x: F.contains(x, F.lit(":")))
    claims = grouped.withColumn("meta", named(meta)).select(
        "key", "no", "fields", "before",
        F.struct(
            "no",
            F.coalesce(F.nullif(last(F.col("meta"), "claim_id"), F.lit("")), F.concat(F.lit("c"), F.col("no").cast("string"))).alias("claim_id"), tx.trimmed(F.substring(F.get("head", F.lit(0)), 5, 1 << 30)).alias("statement"),
            "translated_text", "original_text", _items(last(F.col("meta"), "evidence")).alias("evidence_refs"), F.nullif(last(F.col("meta"), "candidate_id"), F.lit("")).alias("candidate_id"),
        ).alias("claim"),
    )
    whole_texts = claims.groupBy("key").agg(
        F.first(F.when(F.col("no") == 0, named(F.col("fields"))), ignorenulls=True).alias("f"),
        F.first(F.when(F.col("no") == 0, F.col("before")), ignorenulls=True).alias("b"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("no") > 0, F.col("claim")))), lambda c: c.dropFields("no")).alias("claims"),
    )
    # the summary: behind the first line that isn't blank, if that is a title
    filled = F.array_position(F.transform("b", lambda x: tx.trimmed(x) != ""), True).cast("int")
    titled = F.get("b", filled - 1).startswith("# ")
    summary = tx.trimmed(unescaped(F.array_join(F.when(filled == 0, F.array().cast("array<string>")).otherwise(F.slice("b", filled + F.when(titled, 1).otherwise(0), 1 << 30)), "\n")))
    field = lambda k: F.coalesce(last(F.col("f"), k), F.lit(""))
    given = lambda k: F.nullif(field(k), F.lit(""))
    status = F.when(field("status").isin(*lx.MD_STATUSES), field("status")).otherwise("draft")
    return whole_texts.select(
        "key", field("id").alias("id"), field("title").alias("title"), F.coalesce(last(F.col("f"), "category"), F.lit("extracted")).alias("category"), status.alias("status"), given("outline_node_id").alias("outline_node_id"),
        F.nullif(summary, F.lit("")).alias("summary"), "claims", *[_items(field(k)).alias(k) for k in _LISTS], given("created_at").alias("created_at"), field("updated_at").alias("updated_at"), given("review_notes").alias("review_notes"),
    )
