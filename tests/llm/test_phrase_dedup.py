import hashlib
import random
from collections import Counter

import pytest

from gleanery.llm import phrase_dedup


def brute(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 90))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        texts.append((" " if rng.random() < 0.5 else "\n\n").join(parts))
    for t in texts[:10]:  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [None, "", "  \n", "short text", "same " * 300, " ".join(vocabulary[:34]), " ".join(vocabulary[:34]), " ".join(vocabulary[:35]), " ".join(vocabulary[:35])]
    return texts


@pytest.mark.parametrize("block_mb", [1, 16])
def test_fixture_against_brute_force(spark, block_mb, monkeypatch):
    texts = corpus(7)
    if block_mb == 1:  # many blocks
        monkeypatch.setattr(phrase_dedup, "block_count", lambda *a: 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "x")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.repeated_words(docs, block_mb=block_mb).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 35)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, block int, a long")
    assert phrase_dedup.op7_phrase_dedup(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b", 1), (1, None, 2)], "doc_id long, text string, block int")
    assert sorted((r.n_words, r.n_removed) for r in phrase_dedup.op7_phrase_dedup(docs).collect()) == [(0, 0), (2, 0)]


def test_automaton_locates_whole_passages_only():
    words = [f"w{i}" for i in range(60)]
    near = words.copy()  # another word with the same letter in the middle of the passage
    letter = phrase_dedup._letters(phrase_dedup.word_hashes([b"w20"]))
    near[20] = next(f"x{i}" for i in range(10_000) if phrase_dedup._letters(phrase_dedup.word_hashes([f"x{i}".encode()])) == letter)
    docs = [" ".join(["before", *words, "after"]), " ".join(near), "", " ".join(words[:39] * 2), " ".join(words[5:])]
    texts = phrase_dedup._Texts([d.encode() for d in docs], 35, 8)
    passage = " ".join(words[:40]).encode()
    whole = phrase_dedup.locate(texts, [(passage, None)])
    assert whole.nonzero()[0].tolist() == list(range(1, 41))
    run = phrase_dedup.locate(texts, [(passage, [0, 1, 2, 5])])
    begins = texts.begins.tolist()
    spans = [(1, 38), (6, 41), (begins[3], begins[3] + 37), (begins[3] + 39, begins[3] + 76), (begins[4], begins[4] + 35)]
    assert set(run.nonzero()[0].tolist()) == {i for a, b in spans for i in range(a, b)}
    both = [(passage, None), (" ".join(words[22:]).encode(), [1, 3])]
    assert all((phrase_dedup.locate(texts, both, letters) == phrase_dedup.locate(texts, both)).all() for letters in (1, 41, 1000))
