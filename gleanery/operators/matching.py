"""Joins of candidates with chunks, entries and outline nodes.

A best entry or node counts from a threshold on only, so similarities are joined
with it (similarity.py): what cannot reach it never meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources.store import persisted
from . import lists
from . import similarity as sm


def token_rows(texts: DataFrame) -> DataFrame:
    """(id, token), distinct, of rows (id, text); other columns but ``text`` stay beside ``id``."""
    keep = [c for c in texts.columns if c != "text"]
    split = texts.select(*keep, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")).alias("token"))
    return split.where(tx.is_token(F.col("token"))).distinct()


def synonyms(spark: SparkSession, table: dict[str, str] = lx.SYNONYMS) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, v in table.items() for s in v.split(", ")], "token string, synonym string")


def expanded(tokens: DataFrame, table: DataFrame, hops: int = 1) -> DataFrame:
    """(id, token) with the synonyms of tokens, ``hops`` times."""
    for _ in range(hops):
        keep = [c for c in tokens.columns if c != "token"]
        tokens = tokens.unionByName(tokens.join(F.broadcast(table), "token").select(*keep, F.col("synonym").alias("token"))).distinct()  # the vocabulary is a parameter of some dozen rows
    return tokens


def kinds_of(fields: DataFrame, kinds: dict[str, tuple[str, ...]], table: DataFrame, widened: tuple[str, ...]) -> DataFrame:
    """(id, kind, token) from rows (id, field, text): each text is split once, a kind is a set of fields, and ``widened`` kinds have synonyms."""
    of = {f: [k for k, fields_ in kinds.items() if f in fields_] for f in {f for fs in kinds.values() for f in fs}}
    chosen = F.create_map(*[x for f, ks in of.items() for x in (F.lit(f), F.array(*map(F.lit, ks)))])
    rows = token_rows(fields).select("id", "token", F.explode(F.element_at(chosen, F.col("field"))).alias("kind")).distinct()
    return rows.where(~F.col("kind").isin(*widened)).unionByName(expanded(rows.where(F.col("kind").isin(*widened)), table))


def _fields(df: DataFrame, key: str, **fields) -> DataFrame:
    """(id, field, text), a row for each field."""
    return df.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in fields.items()])).alias("f")).select("id", "f.*")


def entry_names(entries: DataFrame) -> Column:
    return F.concat_ws(" ", *[c for c in ("title", "tags", "original_terms", "related") if c in entries.columns])


def entry_sets(candidates: DataFrame, entries: DataFrame, table: DataFrame) -> DataFrame:
    """Ranked sets of candidates (all, terms, name) and of entries (id, ord, title, summary, and tags, original_terms, related, if there are any): all, name."""
    terms = F.array_join("original_terms", " ")
    left = kinds_of(_fields(candidates, "candidate_id", title=F.col("title"), summary=F.col("summary"), terms=terms), {"all": ("title", "summary", "terms"), "terms": ("terms",), "name": ("title", "terms")}, table, ("all", "terms"))
    names = entry_names(entries)
    right = kinds_of(_fields(entries, "ord", names=names, summary=F.col("summary")), {"all": ("names", "summary"), "name": ("names",)}, table, ("all",))
    return sm.ranked_sets(left, right)


def _best_listed(candidates: DataFrame, entries: DataFrame, n: int, table: DataFrame, least: float) -> DataFrame:
    title, terms, names = tx.tokens("title"), tx.tokens(F.array_join("original_terms", " ")), tx.tokens(entry_names(entries))
    asked = candidates.select(F.col("candidate_id").alias("id"), F.concat(title, tx.tokens("summary"), terms).alias("all"), terms.alias("terms"), F.concat(title, terms).alias("name"))
    right = entries.select(F.col("id").alias("label"), F.col("ord").cast("long").alias("ord"), F.concat(names, tx.tokens("summary")).alias("all"), names.alias("name"))
    best = lists.best_of(asked, right, n, lists.Entries, table, least)
    return best.select(F.col("id").alias("candidate_id"), F.col("label").alias("target"), F.col("score").alias("sim"))


def best_entry(candidates: DataFrame, entries: DataFrame, table: DataFrame, least: float = lx.SIM_LINK) -> DataFrame:
    """(candidate_id, target, sim): the most similar entry from ``least`` (a quarter at most) on, the first of equals; null and 0 if there is none.

    One block of entries is counted by lists; of more, only entries that can reach ``least`` are met.
    """
    n = entries.count()
    if n <= lists.NODES:
        return _best_listed(candidates, entries, n, table, least)
    sets = persisted(entry_sets(candidates, entries, table))
    order = entries.select(F.col("ord").cast("string").alias("r"), "ord")
    pairs = sm.jaccard_from(sets, ["all", "terms"], "all", least).unionByName(sm.contained_best(sets, "name", "name", order))
    named = entries.select(F.col("ord").cast("string").alias("r"), "ord", F.col("id").alias("target"))
    best = pairs.join(named, "r").groupBy("l").agg(F.min(F.struct((-F.col("sim")).alias("s"), "ord", "target")).alias("best"))
    return candidates.select("candidate_id").join(best, F.col("candidate_id") == F.col("l"), "left").select("candidate_id", "best.target", F.coalesce(-F.col("best.s"), F.lit(0.0)).alias("sim"))


def best_node(queries: DataFrame, nodes: DataFrame, table: DataFrame, graded: bool = False) -> DataFrame:
    """(id, node_id, score) of rows (id, primary, context) against nodes (node_id, ord, text).

    The first node that equals, contains or is contained in the primary text
    wins; else the best of token similarity, bigram similarity of query and
    primary, and a keyword bonus, from 0.18. ``graded`` leaves out containment and bonus.
    """
    whole, empty = F.concat_ws("\n", "primary", "context"), F.coalesce(F.col("primary"), F.lit("")) == ""
    compact = lambda c: F.coalesce(tx.compact(c), F.lit(""))
    asked = queries.select("id", tx.tokens(whole).alias("words"), compact(whole).alias("whole"), compact("primary").alias("own"), F.when(empty, compact("context")).alias("other"))
    of_node = nodes.select(F.col("node_id").alias("label"), F.col("ord").cast("long").alias("ord"), tx.tokens("text").alias("words"), compact("text").alias("compact"))
    best = lists.best_of(asked, of_node, nodes.count(), lists.GradedNodes if graded else lists.Nodes, table, lx.OUTLINE_LEAST)
    return best.select("id", F.col("label").alias("node_id"), "score")


def best_group(cards: DataFrame, nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(id, ord) of rows (id, text): the node (ord, text) whose words fit best, 0.24 for any shared keyword, from 0.18 on; null if none does."""
    plain = token_rows(cards.select("id", F.lit("plain").alias("kind"), "text"))
    right = expanded(token_rows(nodes.select(F.col("ord").alias("id"), F.lit("words").alias("kind"), "text")), table)
    sets = persisted(sm.ranked_sets(plain.unionByName(expanded(plain.withColumn("kind", F.lit("words")), table)), right))
    order = nodes.select(F.col("ord").cast("string").alias("r"), "ord")
    # a pair with words of its own in common counts 0.24 at least; without (its synonyms alone are shared) from the threshold on
    pairs = sm.jaccard_from(sets, ["words"], "words", lx.OUTLINE_LEAST).unionByName(sm.first_sharing(sets, "plain", "words", order).withColumn("sim", F.lit(0.24)))
    best = pairs.join(order, "r").groupBy("l").agg(F.min(F.struct((-F.col("sim")).alias("s"), "ord")).alias("b"))
    return cards.select("id").join(best, F.col("id").cast("string") == F.col("l"), "left").select("id", "b.ord")


def anchored(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidate_id, chunk_id, chunk_ord, how: the first chunk of the source that holds the candidate's begin, else the first that overlaps it."""
    c = candidates.select("candidate_id", "source_id", "begin", "stop")
    k = chunks.select("source_id", "chunk_id", "ord", F.col("begin").alias("cb"), F.col("stop").alias("ce"), (F.col("n_text") if "n_text" in chunks.columns else F.length(tx.trimmed(F.col("text")))).alias("n_text"), (F.size("path") if "path" in chunks.columns else F.lit(0)).alias("n_path"))
    inside = (F.col("begin") >= F.col("cb")) & (F.col("begin") < F.col("ce"))
    over = (F.col("begin") < F.col("ce")) & (F.col("stop") > F.col("cb"))
    met = c.join(k, "source_id").where(inside | over).groupBy("candidate_id").agg(F.min(F.struct((~inside).alias("later"), "ord", "chunk_id", "n_text", "n_path")).alias("k"))
    return c.select("candidate_id", "source_id").join(met, "candidate_id", "left").select("candidate_id", "source_id", "k.chunk_id", F.col("k.ord").alias("chunk_ord"), F.col("k.n_text"), F.col("k.n_path"), F.when(F.col("k.later"), "overlap").when(~F.col("k.later"), "inside").otherwise("none").alias("how"))


def neighbours(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidate_id and the chunks around its own (one before, one after); all of its source if it has none."""
    order = Window.partitionBy("source_id").orderBy("ord")
    around = chunks.select("source_id", "ord", F.collect_list("chunk_id").over(order.rowsBetween(-1, 1)).alias("near"))
    found = anchored(candidates, chunks)
    hit = found.where("chunk_ord is not null").join(around.withColumnRenamed("ord", "chunk_ord"), ["source_id", "chunk_ord"]).select("candidate_id", "source_id", F.col("near").alias("chunk_ids"))
    rest = found.where("chunk_ord is null").select("candidate_id", "source_id")
    # all chunks of a source: only of those that a candidate without its own is from
    asked = chunks.join(rest.select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id")
    everything = asked.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("all_chunks"))
    return hit.unionByName(rest.join(everything, "source_id", "left").select("candidate_id", "source_id", F.coalesce("all_chunks", F.array().cast("array<string>")).alias("chunk_ids")))


def schema_fit(candidates: DataFrame, keywords: DataFrame, table: DataFrame) -> DataFrame:
    """candidate_id, n_matched: keyword tokens (column ``text``), expanded twice, that the candidate's text has."""
    needle = expanded(token_rows(keywords.select(F.lit(0).alias("id"), "text")).distinct(), table, 2).select("token").distinct()
    text = F.concat_ws("\n", "title", "summary", "evidence_text", F.array_join("original_terms", "\n"))
    hay = token_rows(candidates.select(F.col("candidate_id").alias("id"), text.alias("text")))
    found = hay.join(needle, "token").groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("token")).alias("matched"))
    return candidates.select("candidate_id").join(found, F.col("candidate_id") == F.col("id"), "left").select("candidate_id", F.coalesce("n", F.lit(0)).alias("n_matched"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))
