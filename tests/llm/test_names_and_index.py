"""Stages on columns of any name and on empty tables; the secret index decides what is tried."""

import random

import pytest

import corpus_pipeline
from gleanery.llm import language_id, secret_scan

NAMES = ["key", "row", "row_key", "bad_key", "lead_key", "line_key", "line_row_no", "line_gone", "gone", "lid", "ks", "ln", "no", "mix_no", "mix_key", "copies", "taken", "size", "w", "sh", "fp", "n_hit", "fail_bits", "kept", "rules"]


def write(spark, rows, names, path):
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{n}` int" for n in names]])
    spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    text = lambda n: "\n".join(" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(12)) for _ in range(n))
    clean = [text(6) for _ in range(5)]
    return [*clean, clean[0], " ".join(f"item{i}" for i in range(30)), None, "", text(400)]


def test_clashing_names(spark, tmp_path, texts):
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    write(spark, rows + rows[:1], NAMES, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    given = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        last = k + 1 == len(corpus_pipeline.STAGES)
        assert docs.columns == given + (["mix_copies", "mix_taken"] if last else [])
        assert all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} <= {0, 1, 2, 3, 4, 9} and docs.count() == docs.select("doc_id").distinct().count()


def test_empty_table(spark, tmp_path):
    write(spark, [], ["copies"], tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_index_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "password=abcdefghijklmnop"), (2, "no word of it"), (3, "0123456789abcdef0123")], "doc_id long, text string")
    spans = lambda: {r.doc_id: [s["k"] for s in r.spans] for r in secret_scan.scan(docs).collect()}
    assert spans() == {1: [0], 2: [], 3: [2]}
    found = secret_scan.candidates
    monkeypatch.setattr(secret_scan, "candidates", lambda index, rules: found(index, rules).limit(0))
    assert spans() == {1: [], 2: [], 3: [2]}  # rules with trigrams are tried nowhere, the others everywhere


def test_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(i, f"the and ing {i}", "en") for i in range(300)] + [(7, "eau oi tre", "fr")] * 200
    names, model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=400)
    once, other = language_id.fit(spark.createDataFrame(rows[:301], "doc_id long, text string, lang string"), sample_rows=400)
    assert names == once == ["en", "fr"] and (model == other).all()
    few, _ = language_id.fit(spark.createDataFrame(rows[:300], "doc_id long, text string, lang string"), sample_rows=5)
    assert few == ["en"]
