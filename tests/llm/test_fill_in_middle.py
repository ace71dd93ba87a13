import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import fill_in_middle as fim


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abé日😀\n"), max_size=30), min_size=1, max_size=5))
def test_places_convert_both_ways(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    index = fim.ExceptionIndex(data)
    chars = np.arange(len("".join(texts)) + 1)
    places = np.array([len("".join(texts)[:c].encode()) for c in chars])
    assert (index.to_bytes(chars) == places).all() and (index.to_chars(places) == chars).all()


def _expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rows_agree_with_plain_strings(spark):
    texts = ["", None, "a", "é", "<P", "<S>x", "a<M>b", "x < S > y", "日本語テキスト", "😀" * 40, "plain ascii words " * 20, "mixé 日 😀 " * 30, "é" * 300_000 + "x" * 900_000, "<" * 50, "<P<S<M"]
    rows = [(i, texts[i % len(texts)]) for i in range(300)] + [(7, "same row")] * 3 + [(None, "no id at all")]
    docs = spark.createDataFrame([(i, t, "out", 0) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = fim.fill_in_middle(docs)
    found = [tuple(r) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    assert sorted(found, key=key) == sorted([_expected(*r) for r in rows], key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    back = got.select("doc_id", "form", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r[0] or -1, r[2]) for r in back)) == sorted((i or -1, t or "") for i, t in rows)


def test_small_slices_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "é b" * (i % 5)) for i in range(40)], "doc_id long, text string")
    assert fim.op13_fill_in_middle(docs.limit(0)).count() == 0
    want = sorted(map(tuple, fim.op13_fill_in_middle(docs).collect()))
    monkeypatch.setattr(fim, "SLICE", 4)
    assert sorted(map(tuple, fim.op13_fill_in_middle(docs).collect())) == want
