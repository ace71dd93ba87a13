"""Joins with a threshold against counting every pair, and how many pairs they join."""

import random

from pyspark.sql import functions as F

from gleanery.functions import lexicon as lx
from gleanery.operators import matching as mt
from gleanery.operators import similarity as sm

WORDS = [f"w{j}x" for j in range(400)]


def _bags(rng, n, most, kind):
    weights = [1 / (j + 3) for j in range(len(WORDS))]
    return [(f"{i}", kind, sorted(set(rng.choices(WORDS, weights, k=rng.randint(1, most))))) for i in range(n)]


def _sets(spark, left, right):
    rows = lambda bags: spark.createDataFrame([(i, k, t) for i, k, ts in bags for t in ts], "id string, kind string, token string")
    return sm.ranked_sets(rows(left), rows(right)).persist()


def test_thresholds_agree_with_all_pairs(spark):
    rng = random.Random(2)
    left, right = _bags(rng, 120, 25, "a"), _bags(rng, 90, 14, "b")
    sets = _sets(spark, left, right)
    jac = lambda x, y: len(x & y) / len(x | y)
    pairs = [(i, j, set(x), set(y)) for i, _, x in left for j, _, y in right]
    for least in (0.18, 0.2, 0.5, 1.0):
        want = {(i, j): jac(x, y) for i, j, x, y in pairs if jac(x, y) >= least}
        assert {(r.l, r.r): r.sim for r in sm.jaccard_from(sets, ["a"], "b", least).collect()} == want
    want = {(i, j): len(x & y) for i, j, x, y in pairs if len(x & y) >= 3 and len(x & y) >= 0.4 * min(len(x), len(y))}
    assert {(r.l, r.r): r.both for r in sm.overlapping(sets, "a", "b", 3, 0.4).collect()} == want
    order = spark.createDataFrame([(j, int(j)) for j, _, _ in right], "r string, ord int")
    best = {}
    for r in sm.contained_best(sets, "a", "b", order).collect():
        best[r.l] = min(best.get(r.l, (0, 0)), (-r.sim, int(r.r)))
    want = {}
    for i, j, x, y in pairs:
        n = len(x & y)
        sim = 0 if not n else 0.25 if n == 1 else n / min(len(x), len(y))
        if sim >= 0.25:
            want[i] = min(want.get(i, (0, 0)), (-sim, int(j)))
    assert best == want
    firsts = {}
    for i, j, x, y in pairs:
        if x & y:
            firsts[i] = min(firsts.get(i, 10**6), int(j))
    assert {r.l: int(r.r) for r in sm.first_sharing(sets, "a", "b", order).collect()} == firsts


def test_containing_finds_all_and_looks_up_few(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(150)]
    left, right = texts[:80], texts[80:] + ["日本語の本", "本語"]
    left = [*left, "日本語", "xx", "xx"]
    df = lambda ts: spark.createDataFrame(list(enumerate(ts)), "id long, text string")
    want = {(str(i), str(j)) for i, a in enumerate(left) for j, b in enumerate(right) if min(len(a), len(b)) >= 3 and (a in b or b in a)}
    got = [(r.l, r.r) for r in sm.containing(df(left), df(right)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_few_pairs_meet(spark):
    """Titles of some ten words over a vocabulary like a language's: under a tenth of all pairs is counted whole."""
    rng = random.Random(8)
    words = [f"v{j}z" for j in range(6000)]
    weights = [1 / (j + 10) for j in range(len(words))]
    bags = lambda n, kind: [(f"{i}", kind, sorted(set(rng.choices(words, weights, k=rng.randint(6, 14))))) for i in range(n)]
    sets = _sets(spark, bags(300, "a"), bags(300, "b"))
    sharing = sets.where("side = 'l'").select("id", F.explode("tokens").alias("t")).join(sets.where("side = 'r'").select(F.col("id").alias("r"), F.explode("tokens").alias("t")), "t").select("id", "r").distinct().count()
    met = sm.jaccard_candidates(sets, ["a"], "b", lx.SIM_LINK).count()
    assert met < 9000 < sharing


def test_first_of_equal_entries_and_their_tags(spark):
    table = mt.synonyms(spark)
    schema = "candidate_id string, title string, summary string, original_terms array<string>"
    found = spark.createDataFrame([("c1", "record keeping", "", []), ("c2", "zebra", "", ["quagga"]), ("c3", "nothing here", "", [])], schema)
    entries = spark.createDataFrame([(3, "late", "record", "", [], []), (2, "early", "record", "", [], []), (1, "tagged", "animals", "", ["quagga"], ["zebra"])], "ord int, id string, title string, summary string, tags array<string>, related array<string>")
    got = {r.candidate_id: (r.target, r.sim) for r in mt.best_entry(found, entries, table).collect()}
    assert got["c1"][0] == "early" and got["c2"][0] == "tagged" and got["c3"] == (None, 0.0)
