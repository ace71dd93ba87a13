"""What is handed to a model or a reviewer: ranked cards, prompts, excerpts, locators, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from . import matching as mt

ANSWER = "Answer with one JSON object: wiki_candidates."
NO_SCHEMA = "(no outline given)"


def _rank(column: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)).cast("int") - 1


def card_order(cards: DataFrame) -> list[Column]:
    """By decision, total, action, source and id."""
    return [_rank("decision", lx.DECISIONS), F.desc("total"), _rank("action", lx.ACTIONS), F.col("source_id"), F.col("candidate_id")]


def open_cards(cards: DataFrame) -> DataFrame:
    """Cards (action, decision) that are neither ignored, held nor discarded."""
    return cards.where((F.col("action") != "ignore") & ~F.col("decision").isin("held", "discarded"))


def top_cards(cards: DataFrame, n: int = lx.TOP_CARDS) -> DataFrame:
    """The ``n`` first open cards with ``rank`` from 1."""
    first = open_cards(cards).orderBy(*card_order(cards)).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*card_order(cards))))  # n rows


def reading_order(cards: DataFrame) -> DataFrame:
    """Cards with ``place``: by page, those without one last, then by begin, in each source."""
    return cards.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_last("page"), "begin", "candidate_id")))


def tally(cards: DataFrame) -> DataFrame:
    """(place, action, n): how many cards have each action, in the fixed order of actions."""
    return cards.groupBy("action").agg(F.count("*").alias("n")).select(_rank("action", lx.ACTIONS).alias("place"), "action", "n")


def chunk_block(source: str = "source_id") -> Column:
    """A chunk (chunk_id, page, text) as it stands in a prompt: its text whole, indented."""
    return F.concat_ws("\n", F.concat(F.lit("- chunk_id: "), "chunk_id"), F.concat(F.lit("  source_id: "), source), F.concat(F.lit("  page: "), F.coalesce(F.col("page").cast("string"), F.lit("(none)"))), F.lit("  text:"), F.concat(F.lit("    "), F.regexp_replace("text", "\n", "\n    ")))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["part"]), "\n")


def _sections(**blocks: Column) -> Column:
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"[{name}]\n"), block) for name, block in blocks.items()], F.lit(ANSWER))


def card_prompts(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidate_id, prompt: one for each card (candidate_id, source_id, begin, stop, type, title), with the chunks around it. ``chunks`` has ``page``."""
    near = mt.neighbours(cards, chunks).select("candidate_id", "source_id", F.explode("chunk_ids").alias("chunk_id"))
    blocks = near.join(chunks.select("source_id", "chunk_id", "ord", "page", "text"), ["source_id", "chunk_id"]).withColumn("part", chunk_block())
    held = blocks.groupBy("candidate_id").agg(_joined(F.struct("ord", "part")).alias("chunks"))
    card = F.concat_ws("\n", F.concat(F.lit("- title: "), "title"), F.concat(F.lit("- type: "), "type"))
    joined = cards.join(held, "candidate_id", "left")
    return joined.select("candidate_id", _sections(CANDIDATE=card, SCHEMA=F.lit(NO_SCHEMA), CANDIDATE_CHUNKS=F.coalesce("chunks", F.lit("(no chunk)"))).alias("prompt"))


def ranked_chunks(cards: DataFrame, chunks: DataFrame, per_card: int = lx.CARD_CHUNKS) -> DataFrame:
    """(no, source_id, chunk_id): the first ``per_card`` chunks around each ranked card, each chunk once, where it is seen first."""
    near = mt.neighbours(cards, chunks).join(cards.select("candidate_id", "rank"), "candidate_id")
    seen = near.select("source_id", "rank", F.posexplode(F.slice("chunk_ids", 1, per_card)).alias("place", "chunk_id"))
    return seen.groupBy("source_id", "chunk_id").agg(F.min(F.struct("rank", "place")).alias("at"))


def batch_prompt(cards: DataFrame, chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """n_cards, n_chunks, prompt: one prompt for the ranked cards (of :func:`top_cards`, with title, summary, evidence_text, related), empty for none."""
    line = lambda name, value, test=None: F.when(F.lit(True) if test is None else test, F.concat(F.lit(f"  {name}: "), value))
    card = F.concat_ws(
        "\n", F.concat(F.lit("- batch_index: "), F.col("rank").cast("string")), line("source_id", F.col("source_id")), line("local_candidate_id", F.col("candidate_id")), line("title", F.col("title")), line("type", F.col("type")),
        line("recommended_action", F.col("action")), line("related_existing_entry", F.col("related"), F.coalesce("related", F.lit("")) != ""), line("summary", F.col("summary"), (F.col("summary") != "") & (F.col("summary") != F.col("title"))),
        line("evidence_preview", tx.one_line("evidence_text"), F.col("evidence_text") != ""),
    )
    listed = cards.select("rank", card.alias("part")).agg(F.count("*").alias("n_cards"), _joined(F.struct("rank", "part")).alias("cards"))
    held = ranked_chunks(cards, chunks).join(chunks.select("source_id", "chunk_id", "page", "text"), ["source_id", "chunk_id"]).withColumn("part", chunk_block())
    blocks = held.agg(F.count("*").alias("n_chunks"), _joined(F.struct("at", "part")).alias("chunks"))
    schema = F.lit("\n".join(f"- {k}" for k in keywords) or NO_SCHEMA)
    prompt = _sections(CANDIDATES=F.col("cards"), SCHEMA=schema, CANDIDATE_CHUNKS=F.when(F.col("n_chunks") == 0, F.lit("(no chunk)")).otherwise(F.col("chunks")))
    return listed.crossJoin(blocks).select("n_cards", "n_chunks", F.when(F.col("n_cards") == 0, F.lit("")).otherwise(prompt).alias("prompt"))  # one row each


def excerpt(text: Column, most: int = 360) -> Column:
    return tx.truncated(text, most)


def context(text: Column, needle: Column, around: int = 160) -> Column:
    """What stands around the begin of ``needle`` in a text, without regard to case; the text's begin if it isn't there."""
    def of(clean: Column) -> Column:
        at = F.position(F.lower(F.substring(clean, 1, 80)), F.lower(text))
        begin = F.greatest(at - 1 - around, F.lit(0))
        stop = F.least(at - 1 + F.length(clean) + around, F.length(text))
        return F.when((clean == "") | (at == 0), excerpt(text)).otherwise(excerpt(F.substring(text, begin + 1, stop - begin)))

    return tx.let(tx.one_line(needle), of)


def locator(refs: Column) -> Column:
    """struct(page, line) of the first ref that names a line; nulls if none does."""
    named = F.get(F.filter(refs, lambda r: r.rlike(r"#(?:page-\d+-)?line-\d+")), F.lit(0))
    page = F.nullif(F.regexp_extract(named, r"#page-(\d+)-line-\d+", 1), F.lit(""))
    return F.struct(page.cast("int").alias("page"), F.nullif(F.regexp_extract(named, r"#(?:page-\d+-)?line-(\d+)", 1), F.lit("")).cast("int").alias("line"))


def outline_signature(nodes: DataFrame) -> DataFrame:
    """source_id, signature: the key that a run over an outline (source_id, ord, level, label, title) resumes by."""
    line = F.concat_ws("\t", F.col("level").cast("string"), F.coalesce("label", F.lit("")), tx.one_line("title"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")
    return nodes.groupBy("source_id").agg(F.concat(F.lit("outline:"), F.substring(F.sha2(lines, 256), 1, 8)).alias("signature"))


def pure_source(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, idx, n_sources, owner: the one source that the chunks of a candidate's evidence (source_id, idx, chunk_id) are from; null if there are none or several."""
    known = evidence.select("source_id", "idx", "chunk_id").distinct().join(chunks.select("chunk_id", F.col("source_id").alias("owner")).distinct(), "chunk_id", "left")
    grouped = known.groupBy("source_id", "idx").agg(F.countDistinct("owner").alias("n_sources"), F.min("owner").alias("owner"))
    return grouped.withColumn("owner", F.when(F.col("n_sources") == 1, F.col("owner")))
