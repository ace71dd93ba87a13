import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, r, i, score) for r, (_, _, i, score) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["the", "Of", "ÉTÉ", "été", "日本", "x9", *["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]]
    weights = [1 / (1 + j) for j in range(len(words))]
    text = lambda n: " ,.-\n"[rng.randint(0, 4)].join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(900)]
    docs += [(900, None), (901, ""), (902, "... --- !"), (903, text(30_000)), (904, docs[5][1]), (905, docs[5][1])] + [(906, "same the row")] * 30
    rng.shuffle(docs)
    items = [(j, text(rng.randint(1, 30))) for j in range(25)] + [(50, None), (51, "..."), (52, "nowhere found"), (53, "the the the of"), (53, "x9")]
    return docs, items


def run(spark, tmp_path, docs, items, **given):
    d = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, shard int, term string").repartition(4)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, q int")
    path = f"{tmp_path}/{random.random()}"
    ls.build_index(d, path, shard=20_000)
    return sorted(map(tuple, ls.search(spark, path, q, **given).collect()))


def test_rows_agree_with_scoring_everything(spark, tmp_path, corpus):
    docs, items = corpus
    assert run(spark, tmp_path, docs, items) == sorted(brute(docs, items))
    assert run(spark, tmp_path, docs, items, k=3, terms_a_block=20) == sorted(brute(docs, items, 3))


def test_cells_are_skipped_and_small_cells_agree(corpus, monkeypatch):
    docs, _ = corpus
    monkeypatch.setattr(ls, "CELL", 4)
    monkeypatch.setattr(ls, "CELLS", 2)
    rng = np.random.default_rng(0)
    n = rng.integers(1, 400, 5000)
    m = 25 + 75 * n // 200
    for _ in range(40):
        lists, query = {}, []
        for t in range(rng.integers(1, 7)):
            d = np.flatnonzero(rng.random(5000) < rng.choice([0.002, 0.01, 0.3, 0.9]))
            tf = rng.geometric(0.6, len(d))
            bounds = None
            if len(d) * ls.LONG > 5000:
                cell = ls.cell_bounds(d, tf, n).astype(np.int64)
                bounds = (cell[:, 0], cell[:, 1], 25 + 75 * cell[:, 2] // 200)
            lists[t] = (d, tf, bounds)
            query.append((t, int(rng.integers(0, 9000))))
        total = np.zeros(5000, np.int64)
        for t, w in query:
            total[lists[t][0]] += w * ls.Lengths.part(lists[t][1], m[lists[t][0]])
        want = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s > 0))[:10]
        best, scores = ls.best_of_shard(query, lists, m, 10)
        assert [(-s, d) for d, s in zip(best.tolist(), scores.tolist())] == want


def test_large_totals_stay_exact():
    m = ls.Lengths(np.array([10**7, 5]), 10**12, 10**15).m
    assert m.tolist() == [25 + 75 * 10**7 * 10**12 // 10**15, 25]


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], [(1, "a")]) == [] and run(spark, tmp_path, [(1, "a")], []) == []
    assert run(spark, tmp_path, [(None, "rare"), (4, "rare"), (5, "other"), (6, "third")], [(1, "RARE")]) == brute([(4, "rare"), (None, "rare"), (5, "other"), (6, "third")], [(1, "rare")])
