"""Claim candidates from lines, prose blocks and Markdown blocks, merged by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.rx import java
from . import cuts
from . import segment as sg

COLUMNS = ["candidate_id", "source_id", "type", "title", "summary", "begin", "stop", "refs", "source_text", "evidence_text", "original_terms"]


#: A line is taken by a rule through one of these, or by none.
RULES = (lx.CONCEPT_LINE, lx.KO_DEFINITION, lx.DEFINED_AS, lx.REFERS_TO, lx.IS_A, *lx.QUOTES)
#: What segment.lines() may tell beside: lines that a rule may take.
MAY_BE_RULED = {"may_be_ruled": lambda line: tx.may_have(line, *RULES)}


def line_rules(lines: DataFrame) -> DataFrame:
    """``lines`` with ``rule`` (struct type, title, summary) of the first rule that takes the line: Concept, Korean, English definition, quotation."""
    # lines that no rule can take go through as null
    lines = lines.withColumn("_ruled", F.when(sg.told(lines, "may_be_ruled"), F.col("line")))
    line = F.col("_ruled")
    rule = lambda kind, title, summary: F.struct(F.lit(kind).alias("type"), F.substring(title, 1, 80).alias("title"), F.substring(summary, 1, 240).alias("summary"))
    body = tx.trimmed(tx.group(line, lx.CONCEPT_LINE, 1))
    head = tx.trimmed(F.get(F.split(tx.group(line, lx.CONCEPT_LINE, 1), "[—–-]|:"), F.lit(0)))
    lines = tx.with_definition(lines, "_ruled", "_found").withColumn("_quote", tx.quotation(line))
    found, quote = F.col("_found"), F.col("_quote")
    return lines.withColumn(
        "rule",
        tx.once(F.when(tx.has(line, lx.CONCEPT_LINE), rule("concept", F.when(head == "", body).otherwise(head), body))
        .when(tx.has(line, lx.KO_DEFINITION), rule("concept", tx.trimmed(tx.group(line, lx.KO_DEFINITION, 1)), tx.trimmed(tx.group(line, lx.KO_DEFINITION, 2))))
        .when(found.isNotNull(), rule("concept", found["title"], found["summary"]))
        .when(quote.isNotNull(), rule("quotation", tx.trimmed(quote), tx.trimmed(quote)))),
    ).drop("_ruled", "_found", "_quote")


def title_term(type_: Column, title: Column) -> Column:
    """A concept's title if it can stand as a term: 2 to 80 characters, six words at most, no noise."""
    clean = tx.one_line(F.regexp_replace(title, java("\\A[\\s\"'“”‘’.,;:()\\[\\]{}]+|[\\s\"'“”‘’.,;:()\\[\\]{}]+\\z"), ""))
    fits = (type_ == "concept") & F.length(clean).between(2, 80) & (F.size(F.split(clean, " ")) <= 6) & ~tx.demoted(clean)
    return F.when(fits, F.array(clean)).otherwise(F.array().cast("array<string>"))


def finished(raw: DataFrame) -> DataFrame:
    """Adds ids and original terms to rows (source_id, type, title, summary, begin, stop, refs, source_text, evidence_text)."""
    ids = F.substring(F.sha2(F.concat_ws(":", "source_id", "type", "begin", "stop"), 256), 1, 16)
    raw = tx.with_terms(raw, F.concat_ws("\n", "title", "summary", "source_text"), "_terms").withColumn("_own", title_term(F.col("type"), F.col("title")))
    both = F.slice(F.array_distinct(F.concat("_own", "_terms")), 1, lx.MAX_TERMS)
    return raw.withColumn("candidate_id", ids).withColumn("original_terms", both).select(*COLUMNS)


def raw_plain_candidates(sources: DataFrame) -> DataFrame:
    """Candidates of plain texts (source_id, text), repeated ones too: each line goes to one rule at most, the others form prose blocks. Both come from one pass over the lines that may have a cue or a rule in their block."""
    ruled = line_rules(cuts.lines_in_question(sources, RULES, tx.PROSE_CUES)).withColumn("consumed", F.col("rule").isNotNull())
    near = lambda c: tx.let(tx.trimmed(c), lambda x: F.when(F.length(x).between(1, lx.CONTEXT_LINE), x))
    context = F.array_join(F.array_compact(F.array(near(F.col("above")), tx.trimmed(F.col("line")), near(F.col("below")))), "\n")
    ruled = ruled.withColumn("context", F.when(F.col("rule.type") == "quotation", context)).drop("above", "below")
    blocks = sg.line_blocks(ruled, F.first("rule").alias("rule"), F.first("context").alias("context"))  # a ruled line is a block of its own
    typed = tx.typed(blocks.withColumn("_prose", F.when(~F.col("consumed"), F.col("text"))), "_prose").withColumn("type", F.coalesce("rule.type", "type"))
    ref = F.when(F.col("first_line") == F.col("last_line"), F.concat("source_id", F.lit("#line-"), F.col("first_line") + 1)).otherwise(F.concat("source_id", F.lit("#lines-"), F.col("first_line") + 1, F.lit("-"), F.col("last_line") + 1))
    told = lambda line, block: F.when(F.col("consumed"), line).otherwise(block)
    return finished(tx.only(typed, F.col("type").isNotNull()).select(
        "source_id", "type", told(F.col("rule.title"), tx.prose_title("text")).alias("title"), told(F.col("rule.summary"), tx.truncated("text", 300)).alias("summary"), "begin", "stop", F.array(ref).alias("refs"), F.col("text").alias("source_text"),
        F.when(F.col("type") == "quotation", tx.clean_evidence("context")).when(F.col("consumed"), F.col("text")).otherwise(tx.clean_evidence("text")).alias("evidence_text"),
    ))


def raw_markdown_candidates(sources: DataFrame) -> DataFrame:
    """Candidates of Markdown sources, repeated ones too: concept headings with the next paragraph, bold definitions, other paragraphs by type, block quotes."""
    order = Window.partitionBy("source_id").orderBy("first_line")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    blocks = sg.markdown_blocks(sources).withColumn("no", F.row_number().over(order) - 1)
    plain = F.regexp_replace(F.regexp_replace("raw", r"\*\*|__", ""), r"[*_]", "")
    blocks = blocks.withColumn("plain", F.when(F.col("kind") == "paragraph", plain).otherwise(F.col("raw")))
    blocks = blocks.withColumn("next", F.first(F.when(F.col("kind") == "paragraph", F.struct("no", "stop", "plain", "raw")), ignorenulls=True).over(after))
    ref = lambda n: F.concat("source_id", F.lit("#md-block-"), n)
    row = lambda type_, title, summary, stop, refs, source: F.struct(F.lit(type_).alias("type") if isinstance(type_, str) else type_.alias("type"), title.alias("title"), summary.alias("summary"), stop.alias("stop"), refs.alias("refs"), source.alias("source_text"))
    heading = tx.trimmed(F.regexp_replace("raw", java(r"\A#{1,6}\s+"), ""))
    concept = lx.CONCEPT_HEADING
    name = tx.trimmed(F.regexp_replace(F.regexp_replace(heading, concept, ""), java(r"\A[\s:—–-]+"), ""))
    bold, body = F.regexp_extract("raw", lx.BOLD_DEFINITION, 1), F.regexp_extract("raw", lx.BOLD_DEFINITION, 2)
    clean = tx.one_line(body)
    first, rest = F.regexp_extract(clean, lx.BOLD_SENTENCE, 1), tx.trimmed(F.regexp_extract(clean, lx.BOLD_SENTENCE, 2))
    blocks = tx.typed(blocks.withColumn("rest", rest), "rest", "rest_type")
    blocks = tx.typed(blocks, "plain", "plain_type")
    rest, rest_type, plain_type = F.col("rest"), F.col("rest_type"), F.col("plain_type")
    quote = tx.trimmed(F.regexp_replace("raw", r"(?m)^>\s?", ""))
    found = F.array_compact(
        F.array(
            F.when(
                (F.col("kind") == "heading") & heading.rlike(concept),
                row("concept", F.when(name == "", heading).otherwise(name), F.coalesce(F.substring(F.regexp_replace("next.plain", "\n", " "), 1, 240), heading), F.coalesce("next.stop", "stop"), F.array_compact(F.array(ref("no"), F.when(F.col("next").isNotNull(), ref(F.col("next.no"))))), F.concat_ws("\n\n", "raw", "next.raw")),
            ),
            F.when((F.col("kind") == "paragraph") & (bold != ""), row("concept", tx.trimmed(bold), tx.truncated(F.when(rest_type.isNotNull(), tx.trimmed(first)).otherwise(clean), 240), F.col("stop"), F.array(ref("no")), F.col("raw"))),
            F.when((F.col("kind") == "paragraph") & (bold != "") & rest_type.isNotNull(), row(rest_type, tx.prose_title(rest), tx.truncated(rest, 300), F.col("stop"), F.array(ref("no")), F.col("raw"))),
            F.when((F.col("kind") == "paragraph") & (bold == "") & plain_type.isNotNull(), row(plain_type, tx.prose_title("plain"), tx.truncated("plain", 300), F.col("stop"), F.array(ref("no")), F.col("raw"))),
            F.when((F.col("kind") == "blockquote") & (F.length(quote) >= 8), row("quotation", F.substring(F.get(F.split(quote, "\n"), F.lit(0)), 1, 80), F.when(F.length(quote) > 240, F.concat(F.substring(quote, 1, 237), F.lit("…"))).otherwise(quote), F.col("stop"), F.array(ref("no")), F.col("raw"))),
        )
    )
    # not explode: of it a filter on the array's size is inferred, which would build the array twice
    rows = blocks.select("source_id", "begin", F.explode_outer(found).alias("c")).where("c is not null").select("source_id", "begin", "c.*")
    return finished(rows.withColumn("evidence_text", F.col("source_text")))


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One candidate for each (source, type, title, summary) without regard to case: the first, with the refs and terms of all in order, twelve at most."""
    at = F.struct("begin", "stop", "candidate_id")
    rest = [c for c in COLUMNS if c not in ("source_id", "type", "refs", "original_terms")]
    gathered = lambda c: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(c).alias("v")))), lambda x: x["v"]))), 1, lx.MAX_REFS).alias(c)
    keys = ["source_id", "type", F.lower(tx.one_line("title")).alias("k_title"), F.lower(tx.one_line("summary")).alias("k_summary")]
    return candidates.groupBy(*keys).agg(F.min(F.struct(at.alias("at"), *rest)).alias("first"), gathered("refs"), gathered("original_terms")).select("source_id", "type", "refs", "original_terms", *[f"first.{c}" for c in rest]).select(*COLUMNS)


def plain_candidates(sources: DataFrame) -> DataFrame:
    """Candidates of plain texts (source_id, text), repeated ones merged."""
    return deduplicated(raw_plain_candidates(sources))


def markdown_candidates(sources: DataFrame) -> DataFrame:
    """Candidates of Markdown sources, repeated ones merged."""
    return deduplicated(raw_markdown_candidates(sources))


def violations(candidates: DataFrame) -> DataFrame:
    """candidate_id and the schema rules that a candidate breaks."""
    rules = {
        "candidate_id": F.length("candidate_id") > 0,
        "title": F.length(F.coalesce("title", F.lit(""))) > 0,
        "type": F.col("type").isin("concept", "argument", "method", "objection", "quotation", "question", "example", "other"),
        "summary": F.length(F.coalesce("summary", F.lit(""))) > 0,
        "refs": F.size("refs") > 0,
        "source_id": F.length("source_id") > 0,
        "span": (F.col("begin") >= 0) & (F.col("stop") >= F.col("begin")),
        "evidence_text": F.length(F.coalesce("evidence_text", F.lit(""))) > 0,
    }
    return candidates.select("source_id", "candidate_id", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])).alias("violations"))
