import random

import numpy as np
import pytest

from gleanery.llm import language_id as L

SYLLABLES = {"en": "the and ing tion er re".split(), "fr": "eau oi eux tre que é".split(), "de": "sch ung keit ein ß ü".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, text(rng, lang, 60), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, labelled):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.{lang}.example/", f"<html lang={lang}><script>the the</script><p>{text(rng, lang, 12)}</p>", lang) for i, lang in enumerate(["en", "fr", "de"] * 50)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.lang for r in L.identify(pages, labelled).collect()}
    assert np.mean([got[i] == lang for i, _, _, lang in rows]) > 0.97


def test_against_brute_force(spark, labelled):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "fr", "de"])
        rows.append((i, rng.choice([None, "odd", f"http://a{i % 5}.x{i % 2}.{lang}/p", "https://u:p@B.C.org:80/x"]), rng.choice([None, "", f"<p>{text(rng, lang, 3)}</p>", f"<html lang='{lang}'>{text(rng, lang, 2)}"])))
    rows += [rows[-1]] * 3
    names, model = L.fit(labelled)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ev = L.evidence(pages, names, model).collect()
    soft = []
    for r in ev:
        e = np.exp(np.array(r.ll))
        soft.append(np.round(e / e.sum(), 9))

    def level(key, k):
        at = [i for i, r in enumerate(ev) if key(r) == k]
        return len(at), sum((soft[i] for i in at), np.zeros(len(names)))

    want = []
    kinds = len({r.declared for r in ev})
    for r, p in zip(ev, soft):
        n, s = level(lambda x: 0, 0)
        prior = (s + 1) / (n + len(names))
        for key in (lambda x: x.suffix, lambda x: x.domain):
            n, s = level(key, key(r))
            prior = (s + L.STRENGTH * prior) / (n + L.STRENGTH)
        n, s = level(lambda x: x.host, r.host)
        prior = (np.maximum(s - p, 0) + L.STRENGTH * prior) / (n - 1 + L.STRENGTH)
        lp = np.array(r.ll) + np.log(prior)
        if r.declared:
            _, d = level(lambda x: x.declared, r.declared)
            lp = lp + np.log((d + 0.5) / (sum(soft) + 0.5 * kinds))
        q = np.exp(lp - lp.max())
        want.append((r.page_id, names[int(lp.argmax())], round(float(1 / q.sum()), 4)))
    got = [(r.page_id, r.lang, round(r.prob, 4)) for r in L.fuse(L.evidence(pages, names, model), names).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-4


def test_empty_tables(spark, labelled):
    pages = spark.createDataFrame([(1, "http://a.fr/", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    assert {(r.page_id, r.lang) for r in L.identify(pages, labelled.limit(0)).collect()} == {(1, None), (None, None)}
    assert L.identify(pages.limit(0), labelled).count() == 0
    assert L.identify(pages, labelled).count() == 2
