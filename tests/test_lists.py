"""Best outline nodes against a plain loop over all pairs, in one block and in several."""

import random
import re

import pytest

from gleanery.functions import lexicon as lx
from gleanery.operators import lists
from gleanery.operators import matching as mt


def _tokens(text):
    return {t for t in re.split(r"[^\w]+|_", text.lower()) if not re.fullmatch(r"[0-9]*|[a-z]", t) and t not in lx.STOP_WORDS}


def _wide(tokens):
    return tokens | {s for t in tokens if t in lx.SYNONYMS for s in lx.SYNONYMS[t].split(", ")}


def _compact(text):
    return re.sub(r"[\W_]+", "", text.lower())


def _pairs(text):
    return {text} if len(text) == 1 else {text[i : i + 2] for i in range(len(text) - 1)}


def _best(primary, context, nodes, graded):
    jac = lambda x, y: s if x | y and (s := len(x & y) / len(x | y)) >= 0.18 else 0.0
    parts = lambda a, b: len(a) >= 3 and len(b) >= 3 and (a in b or b in a)
    whole = "\n".join(t for t in (primary, context) if t is not None)
    first, w, p = _compact((primary or context) or ""), _compact(whole), _compact(primary or "")
    ranked = []
    for node_id, ord_, text in nodes:
        n, words = _compact(text or ""), _wide(_tokens(text or ""))
        shared = len(_tokens(whole) & words)
        sims = [jac(_wide(_tokens(whole)), words), jac(_pairs(w), _pairs(n)), jac(_pairs(p), _pairs(n))]
        sims += [min(0.34, 0.18 + shared * 0.05)] if shared and not graded else []
        sims += [0.92] if parts(w, n) else []
        sims += [1.0] if n and w == n else []
        holds = bool(n) and (first == n or parts(first, n))
        if holds and graded:
            sims += [1.0 if first == n else 0.92]
        later, sim = (False, 1.0) if holds and not graded else (True, max(sims))
        if sim > 0:
            ranked.append((later, -sim, ord_, node_id))
    return (min(ranked)[3], -min(ranked)[1]) if ranked else (None, 0.0)


@pytest.mark.parametrize(("nodes_of_block", "graded"), [(20_000, False), (9, False), (9, True)])
def test_best_nodes_agree_with_all_pairs(spark, monkeypatch, nodes_of_block, graded):
    monkeypatch.setattr(lists, "NODES", nodes_of_block)
    monkeypatch.setattr(lists, "CELLS", 64)
    monkeypatch.setattr(lists, "STEPS", 7)
    rng = random.Random(3)
    words = ["record", "of", "intertextuality", "상호텍스트성", "typology", "예표론", "ab", "x", "12", "𝒳𝒴𝒵", "criticism", "the", "source", "é", "日本", "-"]
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    nodes = [(f"n{j}", 40 - j, text(4)) for j in range(40)] + [("none", 50, None), ("one", 51, "Q"), ("two", 52, "zq"), ("same", 53, "Source criticism"), ("again", 54, "source-Criticism")]
    asked = [(f"q{i}", text(3), text(6)) for i in range(150)]
    asked += [("e0", None, None), ("e1", "", "source criticism"), ("e2", None, "q"), ("e3", " - ", "source criticism"), ("e4", "Q", ""), ("e5", "zq", None), ("e6", "zqa", "w" * 5000), ("e7", "\x00\x00", "\U0010ffff")]
    found = mt.best_node(spark.createDataFrame(asked, "id string, primary string, context string"), spark.createDataFrame(nodes, "node_id string, ord int, text string"), mt.synonyms(spark), graded)
    got = {r.id: (r.node_id, r.score) for r in found.collect()}
    assert got == {i: _best(p, c, nodes, graded) for i, p, c in asked}


def test_no_nodes_and_no_rows_dealt(spark):
    asked = spark.createDataFrame([("a", "source criticism", "")], "id string, primary string, context string")
    node = spark.createDataFrame([("n", 1, "Source criticism")], "node_id string, ord int, text string")
    assert mt.best_node(asked, node.limit(0), mt.synonyms(spark)).collect() == [("a", None, 0.0)]
    best = mt.best_node(asked, node, mt.synonyms(spark))
    assert best.collect() == [("a", "n", 1.0)] and "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_listed_entries_agree_with_joined_ones(spark, monkeypatch):
    rng = random.Random(6)
    words = ["record", "of", "intertextuality", "상호텍스트성", "typology", "예표론", "ab", "criticism", "source", "éa", "日本", *[f"w{j}x" for j in range(12)]]
    text = lambda most: " ".join(rng.choices(words, k=rng.randint(0, most)))
    found = [(f"c{i}", text(4), text(9), [text(2) for _ in range(rng.randint(0, 9))]) for i in range(120)] + [("none", None, None, None), ("wide", " ".join(words), "", []), ("z", "zzz", "", [])]
    entries = [(40 - j, f"e{j}", text(3), text(9), [text(2)], text(12) if j % 4 == 0 else "") for j in range(40)] + [(50, "null", None, None, None, None), (51, "all", " ".join(words[:11]), "", [], "")]
    left = spark.createDataFrame(found, "candidate_id string, title string, summary string, original_terms array<string>")
    right = spark.createDataFrame(entries, "ord int, id string, title string, summary string, tags array<string>, related string")
    best = lambda: {r.candidate_id: (r.target, r.sim) for r in mt.best_entry(left, right, mt.synonyms(spark)).collect()}
    listed = mt.best_entry(left, right, mt.synonyms(spark))
    assert "Exchange" not in listed._jdf.queryExecution().executedPlan().toString()
    got = best()
    monkeypatch.setattr(lists, "NODES", 0)
    assert got == best() and len({t for t, _ in got.values()}) > 10 and got["z"] == got["none"] == (None, 0.0)
