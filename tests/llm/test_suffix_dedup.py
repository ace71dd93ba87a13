import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import suffix_dedup


def brute(texts, length):
    docs = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abcdefgé \n"
    text = lambda n: "".join(rng.choices(letters, k=n))
    passages = [text(rng.randint(length // 2, 3 * length)) for _ in range(5)]
    texts = [text(rng.randint(0, length)) + rng.choice(passages) + text(rng.randint(0, length)) for _ in range(40)]
    for t in texts[:12]:
        k = rng.randrange(len(t))
        texts.append(t[:k] + "X" + t[k + 1 :])
    return texts + [texts[0]] * 3 + [None, "", "short", "z" * (3 * length), "ab" * length, text(length - 1)] + ["q" * (length - 1)] * 2 + [passages[0][:length]] * 2


@pytest.mark.parametrize("length,hot,sort_bytes", [(400, 20_000, 2 << 20), (400, 2, 2 << 20), (60, 20_000, 5_000), (60, 0, 2 << 20)])
def test_fixture_against_brute_force(spark, length, hot, sort_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "block_count", lambda *a: 5)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    texts = corpus(length + hot, length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.repeated_bytes(docs, length=length, hot=hot, texts=True).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in rows)


def test_long_text_in_overlapping_pieces(spark, monkeypatch):
    from gleanery.llm import anchors

    rng = random.Random(2)
    part = "".join(rng.choices("abcd", k=900))
    texts = ["".join(rng.choices("abcd", k=3000)) + part + "".join(rng.choices("abcd", k=2000)), part]
    monkeypatch.setattr(anchors.pieces, "__defaults__", (700,))
    got = {}
    for begin_end in anchors.pieces([len(t) for t in texts], 400):
        for d, b, e in begin_end:
            got.setdefault(d, []).extend(range(b, e - 400 + 1))
    assert all(got[d] == list(range(len(t) - 399)) for d, t in enumerate(texts))


def test_buckets_are_equal_prefixes():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[300:420] = text[100:220]
    for depth in (8, 11, 16, 40, 100):
        bucket = suffix_dedup.equal_suffixes(text, depth)
        raw = bytes(text)
        seen = {}
        for i in range(len(raw) - depth + 1):
            seen.setdefault(raw[i : i + depth], set()).add(int(bucket[i]))
        assert all(len(b) == 1 for b in seen.values()) and len({min(b) for b in seen.values()}) == len(seen)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, block int, lo int")
    assert suffix_dedup.op4_suffix_dedup(empty).count() == 0
    docs = spark.createDataFrame([(None, "é", 1), (1, None, 2)], "doc_id long, text string, block int")
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.op4_suffix_dedup(docs).collect()) == [(0, 0, 0), (2, 0, 0)]
