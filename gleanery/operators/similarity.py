"""Similarity joins with a threshold: pairs that cannot reach it never meet.

Sets are ordered by how rare their tokens are.  Two sets whose overlap must be
``a`` at least share a token among the first ``n - a + 1`` of each, so only these
prefixes are joined; lengths, and the places of the first shared token, rule out
most of what is left, and the rest is counted whole.  Texts that contain each
other are found by one rare trigram of the contained one.  Everything is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ratios are compared with room for rounding; what they let pass is counted whole.
_ROOM = 1e-9


def ranked_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id, kind, tokens): the distinct tokens of rows (id, kind, token) of both sides (``l``, ``r``), rarest first."""
    rows = left.select(F.lit("l").alias("side"), F.col("id").cast("string").alias("id"), "kind", "token").unionByName(right.select(F.lit("r").alias("side"), F.col("id").cast("string").alias("id"), "kind", "token"))
    frequency = rows.groupBy("token").agg(F.count("*").alias("n"))
    own = rows.join(frequency, "token").groupBy("side", "id", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("s"))
    return own.select("side", "id", "kind", F.transform("s", lambda x: x["token"]).alias("tokens"))


def _prefixes(sets: DataFrame, side: str, kind: Column, length: Column) -> DataFrame:
    """(token, kind, <side>, n<side>, i<side>) of the first ``length`` tokens."""
    rows = sets.where((F.col("side") == side) & kind).withColumn("n", F.size("tokens"))
    return rows.select(F.col("id").alias(side), *(["kind"] if side == "l" else []), F.col("n").alias(f"n{side}"), F.posexplode(F.slice("tokens", 1, F.greatest(length, F.lit(0)))).alias(f"i{side}", "token"))


def meeting(sets: DataFrame, left_kinds: list[str], right_kind: str, prefix: Column, overlap: Column, lengths: Column | None = None) -> DataFrame:
    """(l, kind, r), distinct: pairs whose prefixes share a token and whose overlap may be ``overlap`` (of ``nl``, ``nr``)."""
    a, b = _prefixes(sets, "l", F.col("kind").isin(left_kinds), prefix), _prefixes(sets, "r", F.col("kind") == right_kind, prefix)
    reach = 1 + F.least(F.col("nl") - 1 - F.col("il"), F.col("nr") - 1 - F.col("ir"))
    met = a.join(b, "token").where(reach >= overlap)
    return (met if lengths is None else met.where(lengths)).select("l", "kind", "r").distinct()


def counted(sets: DataFrame, pairs: DataFrame, right_kind: str) -> DataFrame:
    """(l, kind, r, both, nl, nr) of pairs (l, kind, r)."""
    a = sets.where("side = 'l'").select(F.col("id").alias("l"), "kind", F.col("tokens").alias("a"))
    b = sets.where((F.col("side") == "r") & (F.col("kind") == right_kind)).select(F.col("id").alias("r"), F.col("tokens").alias("b"))
    whole = pairs.join(a, ["l", "kind"]).join(b, "r")
    return whole.select("l", "kind", "r", F.size(F.array_intersect("a", "b")).alias("both"), F.size("a").alias("nl"), F.size("b").alias("nr"))


def jaccard_candidates(sets: DataFrame, left_kinds: list[str], right_kind: str, least: float) -> DataFrame:
    """(l, kind, r) that may have a Jaccard similarity of ``least``."""
    n = F.col("n")
    overlap = F.ceil((F.col("nl") + F.col("nr")) * (least / (1 + least)) - _ROOM)
    lengths = (F.col("nr") >= F.col("nl") * least - _ROOM) & (F.col("nl") >= F.col("nr") * least - _ROOM)
    return meeting(sets, left_kinds, right_kind, (n - F.ceil(n * least - _ROOM) + 1).cast("int"), overlap, lengths)


def jaccard_from(sets: DataFrame, left_kinds: list[str], right_kind: str, least: float) -> DataFrame:
    """(l, r, sim) of all pairs with a Jaccard similarity of ``least`` and more."""
    pairs = counted(sets, jaccard_candidates(sets, left_kinds, right_kind, least), right_kind)
    return pairs.select("l", "r", (F.col("both") / (F.col("nl") + F.col("nr") - F.col("both"))).alias("sim")).where(F.col("sim") >= least)


def overlapping(sets: DataFrame, left_kind: str, right_kind: str, least: int, ratio: float = 0.0) -> DataFrame:
    """(l, r, both, nl, nr) of all pairs that share ``least`` tokens and ``ratio`` of the smaller set."""
    need = F.greatest(F.lit(least), F.ceil(F.least("nl", "nr") * ratio - _ROOM))
    pairs = counted(sets, meeting(sets, [left_kind], right_kind, F.col("n") - (least - 1), need), right_kind)
    return pairs.where((F.col("both") >= least) & (F.col("both") >= F.least("nl", "nr") * ratio)).drop("kind")


def first_sharing(sets: DataFrame, left_kind: str, right_kind: str, order: DataFrame, right: Column | None = None) -> DataFrame:
    """(l, r): for each left set the right one, first by ``order`` (r, ord), of those that share a token.

    Each token is met by its first set alone, so the join has one row a token of the left sets.
    """
    rows = sets.where((F.col("side") == "r") & (F.col("kind") == right_kind) & (F.lit(True) if right is None else right))
    firsts = rows.select(F.col("id").alias("r"), F.explode("tokens").alias("token")).join(order, "r").groupBy("token").agg(F.min(F.struct("ord", "r")).alias("f"))
    asked = sets.where((F.col("side") == "l") & (F.col("kind") == left_kind)).select(F.col("id").alias("l"), F.explode("tokens").alias("token"))
    return asked.join(firsts, "token").groupBy("l").agg(F.min("f").alias("f")).select("l", F.col("f.r").alias("r"))


#: Up to so many tokens, any shared token gives a contained similarity of a quarter.
NARROW = 8


def contained_best(sets: DataFrame, left_kind: str, right_kind: str, order: DataFrame) -> DataFrame:
    """(l, r, sim): pairs among which each left set's best is, if its similarity is a quarter or more.

    The similarity is a quarter for one shared token, else the shared part of the smaller set.  It is below a quarter
    only if both sets have more than NARROW tokens.  So pairs with two shared tokens are joined by prefixes; of those
    with one, only the first in order matters: a narrow set's is the first that shares anything; a wide set's is that among
    narrow sets, or one of the wide sets, which are met whole.
    """
    several = overlapping(sets, left_kind, right_kind, 2, 0.25).select("l", "r", (F.col("both") / F.least("nl", "nr")).alias("sim"))
    wide = F.size("tokens") > NARROW
    left = sets.where((F.col("side") == "l") & (F.col("kind") == left_kind))
    right = sets.where((F.col("side") == "r") & (F.col("kind") == right_kind))
    of_narrow = first_sharing(left.where(~wide).unionByName(right), left_kind, right_kind, order)
    to_narrow = first_sharing(left.where(wide).unionByName(right.where(~wide)), left_kind, right_kind, order)
    shared = left.where(wide).select(F.col("id").alias("l"), F.explode("tokens").alias("token")).join(right.where(wide).select(F.col("id").alias("r"), F.explode("tokens").alias("token")), "token")
    single = shared.groupBy("l", "r").agg(F.count("*").alias("n")).where("n = 1").select("l", "r")
    # a pair of the first kind may share more than one token; then ``several`` has its similarity too, which is no less
    one = of_narrow.unionByName(to_narrow).unionByName(single).select("l", "r", F.lit(0.25).alias("sim"))
    return several.unionByName(one)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; of a shorter text, none."""
    n = F.length(text)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))))


def containing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) of rows (id, text): one text, of three characters or more, is part of the other.

    The contained text has all its trigrams in the other, its rarest too: a text whose trigrams the other side hasn't all
    is out, any other is looked up by its rarest alone, and what is found is compared as text.  Trigrams go without their
    texts, and only those that both sides have are grouped and joined.
    """
    whole = lambda df, c: df.where(F.length("text") >= 3).select(F.col("id").cast("string").alias(c), F.col("text").alias(f"t{c}"))
    texts = {"l": whole(left, "l"), "r": whole(right, "r")}
    grams = {c: t.select(c, F.explode(trigrams(F.col(f"t{c}"))).alias("gram")) for c, t in texts.items()}

    def inside(s: str, g: str) -> DataFrame:
        found = grams[g].join(grams[s].select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        wanted = texts[s].select(s, F.size(trigrams(F.col(f"t{s}"))).alias("own"))
        met = grams[s].join(found, "gram").groupBy(s).agg(F.count("*").alias("met"), F.min(F.struct("n", "gram")).alias("k"))
        asked = met.join(wanted, s).where("met = own").select(s, F.col("k.gram").alias("gram"))
        pairs = grams[g].join(asked, "gram").select("l", "r")
        return pairs.join(texts["l"], "l").join(texts["r"], "r").where(F.contains(F.col(f"t{g}"), F.col(f"t{s}"))).select("l", "r")

    return inside("l", "r").unionByName(inside("r", "l")).distinct()
