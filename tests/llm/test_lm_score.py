import random

import numpy as np
import pytest
import xxhash

from gleanery.llm import lm_score as M


def h(word):
    """A word's hash as a signed number."""
    x = xxhash.xxh64_intdigest(word.encode(), 42)
    return x - (x >> 63 << 64)


def sentence(rng, n):
    """Words whose neighbours tell what they are: w(k) is followed by one of two."""
    k, out = rng.randrange(40), []
    for _ in range(n):
        out.append(f"w{k}")
        k = (k * 3 + rng.choice([1, 7])) % 40
    return " ".join(out)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, sentence(rng, 300)) for i in range(400)], "doc_id long, text string").coalesce(2)
    docs = M.hashed(docs)
    vocab = M.vocabulary(docs, top=32)
    return vocab, M.train(docs, vocab, rounds=4, rate=2.0)


def test_held_out_text_beats_shuffled(spark, model):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        w = sentence(rng, 50).split()
        rows.append((2 * i, " ".join(w)))
        rng.shuffle(w)
        rows.append((2 * i + 1, " ".join(w)))
    got = {r.doc_id: r.pll for r in M.score(M.hashed(spark.createDataFrame(rows, "doc_id long, text string")), *model).collect()}
    assert np.mean([got[2 * i] > got[2 * i + 1] for i in range(60)]) > 0.9
    uniform = -np.log(len(model[0]) + M.OTHERS) * 50
    assert np.mean([got[2 * i] for i in range(60)]) > uniform


def test_scores_against_plain_loop(spark, model):
    vocab, flat = model
    tokens_of, net = M.Tokenizer(vocab), M.Network(M.Tokenizer(vocab).size, flat)
    text = "w1 w4 unseen w13 w9\tw1\n w2"
    t = tokens_of(np.array([h(w) for w in text.split()]))
    want = 0.0
    for i in range(len(t)):
        around = [t[j] if 0 <= j < len(t) else net.size for j in (i - 2, i - 1, i + 1, i + 2)]
        hid = np.tanh(np.concatenate([net.emb[a] for a in around]) @ net.w + net.b)
        z = hid @ net.cls + net.cls_b
        c = t[i] // net.members
        own = slice(c * net.members, (c + 1) * net.members)
        y = net.out[own] @ hid + net.out_b[own]
        want += z[c] - np.log(np.exp(z).sum()) + y[t[i] - own.start] - np.log(np.exp(y).sum())
    docs = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, text)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.pll) for r in M.score(M.hashed(docs), vocab, flat).collect()}
    assert got[1][0] == 7 and abs(got[1][1] - want) < 1e-3 and got[4] == got[1] and got[2] == got[3] == (0, 0.0)


def test_gradient_descends():
    rng = np.random.default_rng(3)
    net = M.Network(64)
    target = rng.integers(0, 64, 2000)
    context = np.stack([target, (target + 1) % 64, target, (target + 2) % 64], axis=1)
    before = net.log_prob(context, target).mean()
    for _ in range(60):
        net.step(context, target, 1.0)
    assert net.log_prob(context, target).mean() > before + 0.5


def test_empty_table_and_reruns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    assert M.op10_lm_score(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c a b c"), (1, "a b c a b c"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, M.op10_lm_score(docs).collect())) == sorted(map(str, M.op10_lm_score(docs).collect()))


def test_every_word_has_its_own_probability(spark, model):
    vocab, flat = model
    words = [w for k in range(80) for w in [f"rare{k}"] * (1 + k % 5)]
    docs = spark.createDataFrame([(1, " ".join(words[:100])), (2, " ".join(words[100:]) + " w1"), (2, " ".join(words[100:]) + " w1"), (3, None), (4, "w1")], "doc_id long, text string")
    words_of = {h(w): w for r in docs.collect() for w in (r.text or "").split()}
    n = {words_of[r.w]: r.n for r in M.word_counts(M.hashed(docs)).collect()}
    bucket = lambda w: h(w) % M.OTHERS
    total = {}
    for w in n:
        if h(w) not in vocab:
            total[bucket(w)] = total.get(bucket(w), 0) + n[w]
    shares = M.bucket_shares(M.word_counts(M.hashed(docs)), vocab)
    plain = {r.doc_id: r.pll for r in M.score(M.hashed(docs), vocab, flat).collect()}
    rows = M.score(M.hashed(docs), vocab, flat, shares=shares).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 2, 3, 4]
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    for r in rows:
        want = sum(np.log(n[w] / total[bucket(w)]) for w in texts[r.doc_id] if h(w) not in vocab)
        assert abs(r.pll - plain[r.doc_id] - want) < 1e-3


def test_random_strings_score_below_less_frequent_words(spark):
    rng = random.Random(5)
    usual = [f"u{k}" for k in range(M.TOP_WORDS)] * 6
    seldom = [f"s{k}" for k in range(300)] * 4
    pool = usual + seldom
    rng.shuffle(pool)
    rows = [(k, " ".join(pool[k * 60 : k * 60 + 60])) for k in range(-(-len(pool) // 60))]
    rows += [(9001, " ".join(f"s{k}" for k in range(60))), (9002, " ".join("".join(rng.choices("bcdfgxyz", k=9)) for _ in range(60)))]
    got = {r.doc_id: r.mean_lp for r in M.op10_lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9001] > got[9002] + 1


def test_vocabulary_grows_with_the_corpus(spark):
    distinct = 4_000_000
    assert M.vocabulary_size(100) == M.TOP_WORDS and M.vocabulary_size(16 * distinct) == 4 * M.vocabulary_size(distinct) > 4 * M.TOP_WORDS
    tokens_of = M.Tokenizer(list(range(M.vocabulary_size(16 * distinct))))
    net = M.Network(tokens_of.size)
    assert net.members * net.classes == net.size and net.classes > M.CLASSES and tokens_of.others > M.OTHERS
