"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``size`` consecutive words (an item of fewer
words is one window).  A window is a set of shingles of ``SHINGLE`` words
(itself, if it has fewer).  It counts as contained only if all its shingles are
there in order, so the necessary prefix of its shingles, ordered by rarity in
the corpus, is one: the rarest.  Documents' shingles are joined with those
prefix shingles only; a shingle's place in its window bounds where the window
would start and end (the length and positional bounds), and what is left is
verified word by word.  Shingles meet by a 64-bit hash.

The items' side is broadcast when its windows are few (``BROADCAST_WINDOWS``,
counted first); otherwise bits of the prefix shingles keep all but the rows that
may have one from being shuffled, each with the words around it.  Both give the
same rows.  Rarity is counted over all documents: sums in each task first, then
joined with the windows' shingles, which are dealt by window where they are many.

Cases: null or empty texts have no words and no hits; items without words have
no windows; repeated documents each give their row; equal windows of several
items count for each of them; an empty benchmark hits nothing.  A text of any
length is one row, its shingles are rows of their own.  Columns of ``docs`` keep
their names and values in ``drop_contaminated``, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import EMPTY_SHA256, ascii_lower, checkpoint, may_be_in, packed, row_key

#: Windows up to which the items' side may be broadcast: some 300 bytes each.
BROADCAST_WINDOWS = 100_000
#: Words of a shingle.
SHINGLE = 3
#: Parts that a shingle's windows are dealt to.
SPREAD = 16
_WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """ASCII lower case, then runs of ASCII letters, digits and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _WORD_GAP), "")


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``item`` as string, ``win`` (array of words)."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return cut.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("win")).distinct()


def _shingle(words: str, at: Column, n: Column | int) -> Column:
    """The hash of the ``SHINGLE`` words of an array from place ``at`` (from 0); fewer if ``n`` is less. Words beyond the end don't count."""
    return F.xxhash64(*[F.when(F.lit(k) < n, F.get(words, at + k)) for k in range(SHINGLE)])


def document_shingles(keyed: DataFrame, sizes: list[int], *more: str) -> DataFrame:
    """(``more``, pos, w, sh): the shingles of documents (w: array of words) at each place, for each of the sizes."""
    at = keyed.select(*more, "w", F.posexplode("w").alias("pos", "first"))
    if len(sizes) == 1:
        return at.select(*more, "w", "pos", _shingle("w", F.col("pos"), sizes[0]).alias("sh"))
    return at.select(*more, "w", "pos", F.explode(F.array(*[_shingle("w", F.col("pos"), n) for n in sizes])).alias("sh"))


def prefix_index(wins: DataFrame, docs_words: DataFrame, n_wins: int) -> DataFrame:
    """For each distinct window its rarest shingle in the corpus (``sh``), that shingle's first place (``at``), and ``items``.

    ``docs_words`` has ``w``.  Ties go to the smaller hash; a shingle that no document has is rarest.
    """
    few = n_wins <= BROADCAST_WINDOWS
    distinct = wins.groupBy("win").agg(F.collect_set("item").alias("items"))
    length = F.least(F.size("win"), F.lit(SHINGLE))
    places = distinct.select("win", "items", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("win") - length), lambda i: _shingle("win", i, length))).alias("at", "sh"))
    vocabulary = places.select("sh").distinct()
    shingles = document_shingles(docs_words, window_sizes(wins))
    if few:
        counts = shingles.join(F.broadcast(vocabulary), "sh").groupBy("sh").agg(F.count("*").alias("n"))
    else:
        may = may_be_in(shingles, "sh", vocabulary, n_wins * SPREAD)
        counts = may.groupBy("sh").agg(F.count("*").alias("n")).join(vocabulary, "sh")
    if few:  # no more shingles than words in the windows
        ranked = places.join(F.broadcast(counts), "sh", "left")
    else:  # a shingle that most windows have is dealt by window
        salted = counts.select("sh", "n", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
        ranked = places.withColumn("salt", F.pmod(F.xxhash64("win"), F.lit(SPREAD)).cast("int")).join(salted, ["sh", "salt"], "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh", "at"))
    rarest = ranked.groupBy("win").agg(best.alias("r"), F.first("items").alias("items"))
    return rarest.select("win", F.size("win").alias("len"), "items", F.col("r.sh").alias("sh"), F.col("r.at").alias("at"))


def window_sizes(wins: DataFrame) -> list[int]:
    """The sizes of shingles that the windows have: ``SHINGLE`` at most."""
    return sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect())


def hits(keyed: DataFrame, wins: DataFrame, size: int) -> DataFrame:
    """Occurrences (key, start, len, items) of windows of at most ``size`` words in documents (key, w)."""
    wins = checkpoint(wins)
    n_wins = wins.count()
    few = n_wins <= BROADCAST_WINDOWS
    sizes = window_sizes(wins)
    if not sizes:
        return keyed.select("key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items")).where("false")
    index = prefix_index(wins, keyed.select("w"), n_wins)
    shingles = document_shingles(keyed, sizes, "key")
    if few:
        found = shingles.join(F.broadcast(index), "sh")
        begin, around = F.col("pos") - F.col("at"), F.col("w")
    else:
        index = checkpoint(index)
        low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
        near = may_be_in(shingles, "sh", index, n_wins).select("key", "sh", "pos", low.alias("low"), F.slice("w", low + 1, F.lit(2 * size)).alias("w"))
        found = near.join(index, "sh")
        begin, around = F.col("pos") - F.col("at") - F.col("low"), F.col("w")
    within = (begin >= 0) & (begin + F.col("len") <= F.size(around))
    same = F.slice(around, F.greatest(begin, F.lit(0)) + 1, F.col("len")) == F.col("win")
    return found.where(within & same).select("key", (F.col("pos") - F.col("at")).alias("start"), "len", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document row: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings); ``carry`` columns follow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("doc_id"), item_words(F.col(text_col)).alias("w"), *carry)
    occurrences = hits(base.select("key", "w"), windows(items, size), size).groupBy("key", "start").agg(F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    before = Window.partitionBy("key").orderBy("start")
    ended = F.coalesce(F.max(F.col("start") + F.col("len")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.col("start") + F.col("len") - F.greatest("start", ended), F.lit(0))
    per_doc = occurrences.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = base.select("key", "doc_id", F.size("w").cast("long").alias("n_words"), *carry).join(per_doc, "key", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *carry)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are not contaminated, with their columns."""
    key = row_key(F.col("doc_id"), F.col("text"))
    judged = contamination(docs.select("doc_id", "text", key.alias("row_key")), items, size, carry=("row_key",))
    bad = judged.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("row_key").alias("key")).distinct()
    return packed(docs).join(bad, "key", "left_anti").select("row.*")


def op9_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    judged = contamination(docs, items)
    ids = F.when(F.size("items") == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(F.array_join("items", ","), 256))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


OP9_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, array_to_string(w[i:i+12], ' ') as g, least(13, len(w)) as n from b, unnest(range(1, greatest(2, len(w) - 11))) as u(i) where len(w) > 0),
lens as (select distinct n from win),
dg as (select rid, i, n, array_to_string(w[i:i+n-1], ' ') as g from d, lens, unnest(range(1, len(w) - n + 2)) as u(i) where len(w) >= n),
hit as (select rid, i, dg.n, item from dg join win using (g, n)),
cov as (select rid, count(distinct i + k) as n_hit from (select distinct rid, i, n from hit) h, unnest(range(0, n)) as u(k) group by rid),
it as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by rid),
r as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256 from d left join cov using (rid) left join it using (rid))
select *, n_hit > 0 and 20 * n_hit >= n_words as contaminated from r
"""
