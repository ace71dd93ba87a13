import random
import re

import numpy as np
import xxhash

from gleanery.llm import simhash
from gleanery.llm.components import components


def brute_fp(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, tau=3):
    """fps: {id: fp} -> {id: smallest id reachable}."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    f = np.array([fps[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[k]) <= tau):
            a, b = sorted((find(i), find(ids[j])))
            root[b] = a
    return {i: find(i) for i in ids}


def test_fixture_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}É" if i % 3 else f"W{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(40)]
    texts = list(base)
    for t in base:
        for _ in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append("  ".join(w) if rng.random() < 0.3 else "\n".join(w))
    texts += [None, "", " \t\n", "one", "One", "x y z w v"] + [base[0]] * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op3_simhash(docs).collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)


def test_dense_cluster_in_many_tiles(spark):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 2**63, dtype=np.uint64)
    flips = rng.integers(0, 64, size=(400, 3))
    dense = {int(center) ^ sum(1 << int(b) for b in set(row)) for row in flips}
    other = {int(x) for x in rng.integers(0, 2**63, size=300, dtype=np.uint64)}
    fps = {i: f for i, f in enumerate(sorted(dense | other))}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps.values()], "fp long")
    edges = simhash.links(df, tile=16)
    got = {r.node: r.root for r in components(edges).collect()}
    signed = {i: int(np.uint64(f).view(np.int64)) for i, f in fps.items()}
    want = {}
    for i, c in brute_components(fps).items():
        want.setdefault(c, set()).add(signed[i])
    groups = {}
    for f in signed.values():
        groups.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert edges.count() < 20 * len(fps)


def test_allocation_is_best():
    rng = np.random.default_rng(5)
    cost = [np.cumsum(rng.random((4, 50)), axis=0) for _ in range(4)]
    got = simhash.allocate(cost, 3)
    assert ((got + 1).sum(axis=0) == 4).all()
    from itertools import product

    for q in range(50):
        best = min(sum(cost[i][t, q] for i, t in enumerate(ts) if t >= 0) for ts in product(range(-1, 4), repeat=4) if sum(t + 1 for t in ts) == 4)
        assert abs(best - sum(cost[i][t, q] for i, t in enumerate(got[:, q]) if t >= 0)) < 1e-6


def test_empty_nulls_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key int, fp int, root int")
    assert simhash.op3_simhash(empty).count() == 0
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (3, None, 3), (4, "", 4), (5, "a b c d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lead_key int")
    got = simhash.op3_simhash(docs.withColumnRenamed("lead_key", "fp"))
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 5), (-1, 5), (3, 3), (4, 3), (5, 5)]
    kept = simhash.keep_first(docs.withColumnRenamed("lead_key", "fp"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, None), (5, "a b c d")]


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(51)}
