"""Cases of cards, prompts, pages, bibliographies and incremental jobs on literal rows."""

import datetime

from pyspark.sql import functions as F

from gleanery.operators import handoff as ho
from gleanery.operators import matching as mt
from gleanery.operators import reports as rp
from gleanery.operators import responses as rs
from gleanery.operators import scoring as sc
from gleanery.operators import segment as sg
from gleanery.sources import store
from gleanery.streaming import jobs


def test_top_cards_leave_out_and_rank(spark):
    rows = [("a", "s", "pending", 9, "create_new"), ("b", "s", "approved", 1, "link_only"), ("c", "s", "held", 20, "create_new"), ("d", "s", "pending", 20, "ignore"), ("e", "r", "pending", 9, "create_new"), ("f", "s", "pending", 9, "update_existing")]
    cards = spark.createDataFrame(rows, "candidate_id string, source_id string, decision string, total int, action string")
    assert [(r.candidate_id, r.rank) for r in ho.top_cards(cards, 3).orderBy("rank").collect()] == [("b", 1), ("e", 2), ("a", 3)]
    assert ho.top_cards(cards.limit(0)).count() == 0
    assert [(r.place, r.action, r.n) for r in ho.tally(cards).orderBy("place").collect()] == [(0, "create_new", 3), (1, "update_existing", 1), (2, "link_only", 1), (3, "ignore", 1)]


def test_pages(spark):
    pages = spark.createDataFrame([("s", 2, "two\n\nmore"), ("s", 1, "one"), ("s", 3, ""), ("s", 4, "four")], "source_id string, page int, text string")
    docs = sg.page_documents(pages)
    assert docs.first().text == "one\ftwo\n\nmore\f\ffour" and docs.first().page_starts == [0, 4, 14, 15]
    cut = sg.with_page(sg.chunks(docs.withColumn("kind", F.lit("pdf"))), docs)
    assert [(r.page, r.text) for r in cut.orderBy("ord").collect()] == [(1, "one"), (2, "two"), (2, "more"), (4, "four")]
    cards = spark.createDataFrame([("s", None, 0, "a"), ("s", 2, 9, "b"), ("s", 1, 5, "c")], "source_id string, page int, begin int, candidate_id string")
    assert [r.candidate_id for r in ho.reading_order(cards).orderBy("place").collect()] == ["c", "b", "a"]


def test_excerpts_and_locators(spark):
    text = "x" * 300 + " The needle stands here. " + "y" * 600
    df = spark.createDataFrame([(text, "the  NEEDLE stands", ["s#page-3-line-7"]), ("short", "", ["s", "s#line-2"]), ("z" * 500, "absent", [])], "t string, n string, refs array<string>")
    got = df.select(ho.context(F.col("t"), F.col("n")).alias("c"), ho.locator(F.col("refs")).alias("l")).collect()
    assert got[0].c.startswith("x" * 159) and "The needle stands" in got[0].c and len(got[0].c) <= 360
    assert got[1].c == "short" and got[2].c == "z" * 359 + "…"
    assert [(r.l.page, r.l.line) for r in got] == [(3, 7), (None, 2), (None, None)]


def test_page_and_heading_points(spark):
    schema = "candidate_id string, source_id string, type string, title string, summary string, begin long, stop long, refs array<string>, source_text string, evidence_text string, original_terms array<string>, page int"
    row = ["c", "s", "argument", "The author argues", "It is so.", 0, 10, ["r"], "t", "It is argued.", []]
    keys = spark.createDataFrame([("zzz",)], "text string")
    entries = spark.createDataFrame([], "id string, ord long, title string, summary string")
    chunks = spark.createDataFrame([("s", "k", 0, 0, 20, "short text", ["Heading"])], "source_id string, chunk_id string, ord int, begin long, stop long, text string, path array<string>")
    for page, path, want in ((1, True, (2, 3)), (None, False, (1, 2))):
        found = spark.createDataFrame([(*row, page)], schema)
        got = sc.scored(found, chunks if path else chunks.withColumn("path", F.array().cast("array<string>")), keys, entries, mt.synonyms(spark)).first()
        assert (got.evidence_quality, got.reusability) == want


def test_bibliography(spark):
    rows = [
        ("a", "x.pdf", "Studies of the Record\nby Jane Roe\ntranslated by Ann Lee\nNorthern University Press 1994"),
        ("b", "The_Old-Book 1901 (3).pdf", "12\n34"),
        ("c", "y.md", "contents\n저자: 김철수\n역자: 이영희\n출판사: 한빛"),
        ("d", "z.md", ""),
    ]
    got = {r.source_id: r for r in rp.bibliography(spark.createDataFrame(rows, "source_id string, filename string, text string")).collect()}
    assert (got["a"].title, got["a"].author, got["a"].translator, got["a"].publisher, got["a"].year) == ("Studies of the Record", "Jane Roe", "Ann Lee", "Northern University Press 1994", "1994")
    assert got["a"].display_title == "Studies of the Record — Jane Roe · 역자 Ann Lee · Northern University Press 1994 · 1994"
    assert (got["b"].title, got["b"].confidence, got["b"].year) == ("The Old Book 1901", "filename_fallback", "1901")
    assert (got["c"].author, got["c"].translator, got["c"].publisher, got["d"].title) == ("김철수", "이영희", "한빛", "z")


def test_prompts(spark):
    cards = spark.createDataFrame([("c", "s", 0, 5, "argument", "Title")], "candidate_id string, source_id string, begin long, stop long, type string, title string")
    chunks = spark.createDataFrame([("s", f"k{i}", i, 10 * i, 10 * i + 9, f"text {i}\nend", i + 1) for i in range(4)], "source_id string, chunk_id string, ord int, begin long, stop long, text string, page int")
    prompt = ho.card_prompts(cards, chunks).first().prompt
    assert "- chunk_id: k0\n  source_id: s\n  page: 1\n  text:\n    text 0\n    end" in prompt and "k1" in prompt and "k2" not in prompt and ho.NO_SCHEMA in prompt
    ranked = cards.withColumn("rank", F.lit(1)).withColumn("action", F.lit("create_new")).withColumn("summary", F.lit("Sum")).withColumn("evidence_text", F.lit("a\n b")).withColumn("related", F.lit(None).cast("string"))
    got = ho.batch_prompt(ranked, chunks, ["One"]).first()
    assert (got.n_cards, got.n_chunks) == (1, 2) and "  evidence_preview: a b" in got.prompt and "related_existing_entry" not in got.prompt and "[SCHEMA]\n- One" in got.prompt
    assert ho.batch_prompt(ranked.limit(0), chunks, []).first().prompt == ""


def test_purity_and_signature(spark):
    evidence = spark.createDataFrame([("r", 0, "k0"), ("r", 0, "k1"), ("r", 1, "k0"), ("r", 1, "k9"), ("r", 2, "none")], "source_id string, idx int, chunk_id string")
    chunks = spark.createDataFrame([("a", "k0"), ("a", "k1"), ("b", "k9")], "source_id string, chunk_id string")
    assert {(r.idx, r.n_sources, r.owner) for r in ho.pure_source(evidence, chunks).collect()} == {(0, 1, "a"), (1, 2, None), (2, 0, None)}
    nodes = [("s", 1, 1, None, "A  b"), ("s", 2, 2, "1.1", "C")]
    one = ho.outline_signature(spark.createDataFrame(nodes, "source_id string, ord int, level int, label string, title string")).first().signature
    other = ho.outline_signature(spark.createDataFrame(nodes[:1], "source_id string, ord int, level int, label string, title string")).first().signature
    assert one.startswith("outline:") and len(one) == 16 and one != other


def test_redaction_and_failures(spark):
    report = spark.createDataFrame([("s", "raw text", 3)], "source_id string, raw string, batch int")
    assert rp.redacted(report).columns == ["source_id"] and rp.redacted(report, debug=True).columns == report.columns
    found = rs.parsed(spark.createDataFrame([("a", ""), ("b", "none"), ("c", "{}"), ("d", '{"wiki_candidates":[]}')], "source_id string, raw string"))
    assert {(r.source_id, r.reason) for r in rs.failures(found).collect()} == {("a", "empty"), ("b", "error"), ("c", "shape")}


def test_store_by_source(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    store.write_by_source(spark.createDataFrame([("a", "x"), ("b", "y")], "source_id string, text string"), path)
    store.write_by_source(spark.createDataFrame([("b", "z")], "source_id string, text string"), path)
    assert [r.text for r in store.read_source(spark, path, "text string", "a").collect()] == ["x"]
    assert [r.text for r in store.read_source(spark, path, "text string", "b").collect()] == ["z"]
    assert store.read_source(spark, path, "text string", "none").count() == 0
    (tmp_path / "one.txt").write_text("é")
    (tmp_path / "none.txt").write_text("")
    files = store.corpus_files(spark, f"{tmp_path}/*.txt")
    assert [(r.path.rsplit("/")[-1], r.accepted) for r in rp.sniffed(files).collect()] == [("one.txt", True)]


def test_incremental_jobs_resume(spark, tmp_path):
    docs, at = f"{tmp_path}/documents.parquet", f"{tmp_path}/job"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1).write.parquet(docs)
    assert sorted(r.first_id for r in jobs.source_stream(spark, docs, at).collect()) == [1, 2]
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
    assert sorted(r.first_id for r in jobs.source_stream(spark, docs, at).collect()) == [1, 2, 5]
    assert sorted(r.first_id for r in jobs.source_stream(spark, docs, at).collect()) == [1, 2, 5]
    events, at = f"{tmp_path}/events.parquet", f"{tmp_path}/decisions"
    day = lambda n: datetime.datetime(2024, 1, n)
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    spark.createDataFrame([(1, 7, day(3), "purchase"), (2, 8, day(1), "click")], schema).coalesce(1).write.parquet(events)
    assert {(r.source_id, r.decision) for r in jobs.decision_stream(spark, events, at).collect()} == {("7", "approved"), ("8", "held")}
    spark.createDataFrame([(3, 7, day(2), "error"), (4, 8, day(5), "error")], schema).coalesce(1).write.mode("append").parquet(events)
    assert {(r.source_id, r.decision) for r in jobs.decision_stream(spark, events, at).collect()} == {("7", "approved"), ("8", "discarded")}
