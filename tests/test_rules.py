"""Cases of the rules on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions import lexicon as lx
from gleanery.functions import text as tx
from gleanery.functions.rx import java
from gleanery.operators import candidates as cd
from gleanery.operators import entries as en
from gleanery.operators import markdown as md
from gleanery.operators import matching as mt
from gleanery.operators import reports as rp
from gleanery.operators import responses as rs
from gleanery.operators import scoring as sc
from gleanery.operators import segment as sg


def column(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_claim_verbs(spark):
    cases = {"The author argues that X.": 1, "He suggested and concluded.": 2, "The claim shows up again.": 0, "They claim this.": 1, "a well-defined term": 0, "the proposed plan": 0, "arguably": 0, "éargue argues": 2, "저자는 주장한다 그리고 결론내린다": 2, "": 0}
    assert column(spark, cases, tx.claim_count) == list(cases.values())


def test_demotion_kinds(spark):
    cases = {"12. Smith, p. 3": ["footnote"], "References": ["bibliography"], "Smith, J. (1999)": ["bibliography"], "Intro ........ 12": ["table_of_contents"], "grace, 12, 45, 78": ["index"], "Copyright 2001": ["copyright"], "plain words": []}
    assert column(spark, cases, tx.demotion_kinds) == list(cases.values())


def test_white_space_and_cuts(spark):
    assert column(spark, ["a  b\n c "], tx.one_line) == ["a b c"]
    assert column(spark, ["word " * 40], lambda c: tx.cut_at_word(c, 120)) == [("word " * 24).strip()]
    assert column(spark, ["x" * 310], lambda c: F.length(tx.truncated(c, 300))) == [300]
    assert column(spark, ["a \t b\n\n c "], tx.clean_evidence) == ["a b\nc"]


def test_white_space_of_all_kinds(spark):
    texts = ["", " ", "a b", "\ta\u00a0 b\n\nc\u3000", "é b", "é\u2003b", "a  b", "x\r\ny\ufeff", None]
    for new, old in ((tx.one_line, lambda c: F.trim(F.regexp_replace(c, java(r"\s+"), " "))), (tx.trimmed, lambda c: F.regexp_replace(c, java(r"\A\s+|\s+\z"), ""))):
        assert column(spark, texts, new) == column(spark, texts, old)
    assert column(spark, ["\ufeffa\r\nb\rc", "a\nb", None], tx.normalized) == ["a\nb\nc", "a\nb", None]


def test_lines_are_judged_once(spark):
    """The rules on lines stand in the plan once, and noise is tried only in texts with a cue."""
    docs = spark.createDataFrame([("s", "Concept: A - b")], "source_id string, text string")
    plan = cd.raw_plain_candidates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "Union" not in plan


def test_patterns_compile(spark):
    patterns = [lx.CLAIM_EN, lx.CLAIM_KO, *lx.CLAIM_GUARDS, *[p for ps in lx.DEMOTIONS.values() for p in ps], lx.METHOD_CUE, lx.GREEK, lx.HEBREW, lx.SECTION_MARKER, lx.SENTENCE_END, *lx.QUOTES]
    assert spark.range(1).select(*[F.lit("x").rlike(java(p)).alias(f"c{i}") for i, p in enumerate(patterns)]).count() == 1


def test_prose_types(spark):
    pad = " and the record that we keep in the house by the old river goes on"
    cases = {"The author argues it again and again.": "argument", "This method compares two old texts.": "method", "Nothing to see in here, only the trees.": None, f"However this is so{pad}{pad}.": "objection", f"An approach is told{pad}{pad}.": "method", "short": None, "x " * 600: None}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r.type for r in tx.typed(df, "t").orderBy("i").collect()] == list(cases.values())


@pytest.fixture(scope="module")
def sources(spark):
    text = "Concept: Source criticism - a way\nValidity refers to the degree of fit in tests.\n\"" + "quoted words of some length here" + "\"\n\nThe author argues that this is right.\nAnd it goes on\nwithout an end"
    return spark.createDataFrame([("s", text), ("e", "")], "source_id string, text string")


def test_lines_and_blocks(sources):
    rows = sg.lines(sources).where("source_id = 's'").orderBy("ln").collect()
    text = sources.where("source_id = 's'").first().text
    assert [text[r.begin : r.stop] for r in rows] == text.split("\n")
    blocks = sg.paragraphs(sources).collect()
    assert {text[b.begin : b.stop] for b in blocks} == {b.text for b in blocks} == set(text.split("\n\n"))


def test_candidates_are_typed_and_verbatim(sources):
    text = sources.where("source_id = 's'").first().text
    rows = cd.plain_candidates(sources).orderBy("begin").collect()
    assert [(r.type, r.title) for r in rows] == [("concept", "Source criticism"), ("concept", "Validity"), ("quotation", "quoted words of some length here"), ("argument", "this is right")]
    assert all(text[r.begin : r.stop] == r.source_text for r in rows)
    assert cd.violations(cd.plain_candidates(sources)).where("size(violations) > 0").count() == 0


def test_repeated_candidates_merge(spark):
    df = spark.createDataFrame([("s", "The author argues that this is right.\n\nThe author argues that this is right.")], "source_id string, text string")
    (row,) = cd.deduplicated(cd.plain_candidates(df)).collect()
    assert row.refs == ["s#line-1", "s#line-3"]


def test_repeated_lines_make_one_card(spark):
    line = "We argue that this claim shows how the method supports the evidence and therefore the theory holds in practice."
    texts = [("a", f"{line}\n\n{line.upper()}\n\n{line}"), ("b", line)]
    df = spark.createDataFrame(texts, "source_id string, text string")
    found = cd.plain_candidates(df)
    assert {r.source_id: r.refs for r in found.collect()} == {"a": ["a#line-1", "a#line-3", "a#line-5"], "b": ["b#line-1"]}
    chunks = sg.chunks(df.withColumn("kind", F.lit("plaintext")))
    entries = spark.createDataFrame([(1, "e1", "Harbour", "ships")], "ord int, id string, title string, summary string")
    scored = sc.scored(found, chunks, entries.select(F.col("title").alias("text")), entries, mt.synonyms(spark))
    points = {r.source_id: r.evidence_quality for r in scored.collect()}
    assert points == {"a": 2, "b": 1}
    (row,) = cd.markdown_candidates(spark.createDataFrame([("m", f"> {line}\n\nBetween.\n\n> {line}")], "source_id string, text string")).where("type = 'quotation'").collect()
    assert row.refs == ["m#md-block-0", "m#md-block-2"]


def test_long_blocks_split_at_newlines(spark):
    text = "\n".join(["a" * 700, "b" * 700, "c" * 700, "d" * 4000, "e" * 10])
    cut = sg.chunks(spark.createDataFrame([("s", text, "plaintext")], "source_id string, text string, kind string")).orderBy("ord").collect()
    assert all(text[r.begin : r.stop] == r.text and len(r.text) <= 1800 for r in cut)
    assert "".join(r.text for r in cut).replace("\n", "") == text.replace("\n", "")
    assert cut[0].text == "a" * 700 + "\n" + "b" * 700


def test_markdown_blocks_and_paths(spark):
    text = "# A\n\n## B\ntext **bold**\n\n> q1\n> q2\n\n- x\n- y\n---\n```\n# no\n\ncode\n```\n```\nopen"
    df = spark.createDataFrame([("s", text)], "source_id string, text string")
    assert [(r.kind, r.level) for r in sg.markdown_blocks(df).orderBy("first_line").collect()] == [("heading", 1), ("heading", 2), ("paragraph", None), ("blockquote", None), ("list", None), ("hr", None), ("code", None)]
    assert [r.path for r in sg.heading_paths(df).orderBy("begin").collect()][:1] == ["A > B"]


def test_outline(spark):
    text = "# Methods\n1. Source criticism\n1.1 Textual criticism\n1.2 Intertextuality\n제2장 해석학\n- Validity\n  - Measurement\n2 Closing"
    rows = sg.outline(spark.createDataFrame([("o", text)], "source_id string, text string")).orderBy("ord").collect()
    assert [(r.level, r.parent) for r in rows] == [(1, None), (1, None), (2, "n2"), (2, "n2"), (1, None), (1, None), (2, "n6"), (1, None)]
    assert rows[4].label == "제2장" and rows[2].title == "Textual criticism"


def test_similarity_and_nodes(spark):
    table = mt.synonyms(spark)
    nodes = spark.createDataFrame([("n1", 1, "Source criticism"), ("n2", 2, "Exile and covenant")], "node_id string, ord int, text string")
    asked = spark.createDataFrame([("a", "criticism of Source criticism", ""), ("b", "the 유배 story", "covenant"), ("c", "zzz", "")], "id string, primary string, context string")
    got = {r.id: r.node_id for r in mt.best_node(asked, nodes, table).collect()}
    assert got == {"a": "n1", "b": "n2", "c": None}


def test_structure_and_names(spark):
    rows = [("concept", "John A. Smith", "John A. Smith", "demo"), ("quotation", "short", "short", "demo"), ("concept", "Chapter IV", "Chapter IV", "demo"), ("concept", "Divine Kingship", "an idea of kings that the texts keep", "demo")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type string, title string, summary string, evidence string")
    got = [r.reason for r in tx.with_structural_reason(df, "type", "title", F.col("summary"), F.lit("")).orderBy("i").collect()]
    assert got == ["person_name", "short_quotation", "section_marker", None]


def test_responses(spark):
    good = '{"title":"A","type":"argument","confidence":"high","summary_ko":"this argues it","evidence":[{"chunk_id":"c1","quote":"the words","translation_ko":""},{"chunk_id":"x","quote":"q","translation_ko":""}]}'
    raws = [("1", f'Here:\n```json\n{{"wiki_candidates":[{good}]}}\n```'), ("2", f'{{"wiki_candidates":[{good},{{"title":"cut'), ("3", ""), ("4", "no json")]
    found = rs.parsed(spark.createDataFrame(raws, "source_id string, raw string"))
    assert {r.source_id: r.status for r in found.collect()} == {"1": "ok", "2": "recovered", "3": "empty", "4": "error"}
    chunks = spark.createDataFrame([("1", "c1", "all the words here"), ("2", "c1", "other")], "source_id string, chunk_id string, text string")
    asked = rs.response_candidates(found)
    gate = rs.evidence_gate(asked, chunks)
    assert {(r.source_id, r.ei): r.verdict for r in gate.collect()} == {("1", 0): "bound", ("1", 1): "forged", ("2", 0): "not_verbatim", ("2", 1): "forged"}
    assert rs.judged(asked, gate).where("importable").count() == 0


def test_term_rules_and_prefix(spark):
    fields = spark.createDataFrame([(1, "이신칭의 하나님"), (2, "은혜"), (3, "은혜 성경")], "id int, text string")
    assert {r.id: r.terms for r in rs.term_violations(fields).collect()} == {1: ["하나님", "이신칭의"], 2: [], 3: ["은혜"]}
    batches = spark.createDataFrame([("a", 0, "ok"), ("a", 1, "recovered"), ("a", 2, "ok"), ("b", 0, "ok")], "source string, batch int, status string")
    assert {r.source: (r.n_good, r.stopped_by) for r in rs.good_prefix(batches).collect()} == {"a": (1, "recovered"), "b": (1, "")}


def test_terms_make_candidates_unfit(spark):
    said = {
        "ok": {"title": "은총과 의화"},
        "title": {"title": "하나님 나라"},
        "context": {"title": "은혜의 뜻", "type": "religious_text"},
        "plain": {"title": "은혜의 뜻"},
        "excused": {"title": "이신칭의", "standard_terms": ["칭의"]},
        "list": {"title": "t", "boundary_note": "사사기", "standard_terms": "not a list"},
        "translation": {"title": "t", "translations": ["", "마가복음", "여호와"]},
    }
    rows = []
    for key, x in said.items():
        evidence = [{"chunk_id": "c", "quote": "the theory holds in practice", "translation_ko": t} for t in x.pop("translations", [""])]
        own = {"type": "concept", "summary_ko": "a summary that argues this shows how the theory holds", "reason": "", "evidence": evidence} | x
        rows.append((key, json.dumps({"wiki_candidates": [own]}, ensure_ascii=False)))
    asked = rs.response_candidates(rs.parsed(spark.createDataFrame(rows, "source_id string, raw string")))
    chunks = spark.createDataFrame([(k, "c", "so the theory holds in practice") for k in said], "source_id string, chunk_id string, text string")
    gate = rs.evidence_gate(asked, chunks)
    got = {r.source_id: r.violations for r in rs.judged(asked, gate).collect()}
    assert got == {
        "ok": [], "title": ["term title 하나님"], "context": ["term title 은혜"], "plain": [], "excused": ["term title 이신칭의", "term standard_terms 칭의"],
        "list": ["term boundary_note 사사기"], "translation": ["term translation_ko 마가복음"],
    }
    assert {r.source_id for r in rs.imported(rs.judged(asked, gate), gate).collect()} == {"ok", "plain"}
    apart = spark.createDataFrame([(1, "이신칭의"), (1, "칭의")], "id int, text string")
    assert rs.term_violations(apart).first().terms == ["이신칭의", "칭의"]


def test_markdown_round_trip(spark, sources):
    found = cd.plain_candidates(sources)
    built = en.build(found, found.select("candidate_id", F.lit(None).cast("string").alias("node_id")))
    (back,) = md.from_markdown(md.to_markdown(built).select(F.col("id").alias("key"), "markdown")).collect()
    (entry,) = built.collect()
    assert [c.original_text for c in back.claims] == [c.original_text for c in entry.claims] and back.id == entry.id
    assert [c.claim_id for c in back.claims] == entry.created_from_candidates == back.created_from_candidates


def test_markdown_of_texts_that_look_like_markdown(spark):
    odd = ["### no claim\n- claim_id: x", "<!-- /annotation -->", "\\<!-- annotation:original -->\n  <!-- annotation:translated -->  ", "## 주장 (claims)\nmore", "---\nid: y\n---", ""]
    claims = [(f"k{i}" if i else "", f"statement: {i}", t, odd[-1 - i], ["a", "b"], None) for i, t in enumerate(odd)]
    rows = [("e,1", "A title: of it", "summary\n## 주장\n# x", "verified", claims, ["t1", "t2"]), ("e2", "", "", "held", [], [])]
    df = spark.createDataFrame(rows, f"id string, title string, summary string, status string, claims array<struct<{md.CLAIM.replace(' string', ': string').replace(' array', ': array')}>>, tags array<string>")
    got = {r.id: r for r in md.from_markdown(md.to_markdown(df).select(F.col("id").alias("key"), "markdown")).collect()}
    one, two = got["e,1"], got["e2"]
    assert (one.title, one.summary, one.status, one.tags) == (*rows[0][1:4], ["t1", "t2"]) and (two.title, two.summary, two.status, two.claims) == ("", None, "draft", [])
    assert [tuple(c) for c in one.claims] == [(c[0] or "c1", c[1], c[2].strip(), c[3].strip(), c[4], c[5]) for c in claims]


def test_markdown_of_others(spark):
    texts = [("bare", "no front\nmatter"), ("crlf", "---\r\nid: a\r\nstatus: reviewed\r\n---\r\n\r\n# T\r\n\r\n## 주장 (claims)\r\n\r\n### one\r\n- evidence: x, , y\r\ntext between\r\n- claim_id: late\r\n### two\r\n"), ("open", "---\nid: b")]
    got = {r.key: r for r in md.from_markdown(spark.createDataFrame(texts, "key string, markdown string")).collect()}
    assert (got["bare"].id, got["bare"].summary, got["bare"].claims) == ("", "no front\nmatter", []) and got["open"].id == "b"
    assert (got["crlf"].id, got["crlf"].status, got["crlf"].summary) == ("a", "reviewed", None)
    assert [(c.claim_id, c.statement, c.evidence_refs) for c in got["crlf"].claims] == [("c1", "one", ["x", "y"]), ("c2", "two", [])]


def test_decisions_by_candidate_latest_first(spark):
    rows = [("s", c) for c in "abcd"] + [("r", "a")]
    found = spark.createDataFrame(rows, "source_id string, candidate_id string")
    log = [("s", "a", "held", 5, 1), ("s", "a", "approved", 9, 2), ("s", "a", "discarded", 7, 3), ("s", "b", "discarded", 4, 4), ("s", "b", "held", 4, 5), ("s", "c", "approved", 20, 6), ("x", "d", "held", 1, 7)]
    events = spark.createDataFrame(log, "source_id string, candidate_id string, decision string, updated_at int, event_id long")
    got = lambda as_of=None: {(r.source_id, r.candidate_id): (r.decision, r.decided_by, r.n_records) for r in en.with_decisions(found, events, as_of).collect()}
    none = ("pending", None, 0)
    assert got() == {("s", "a"): ("approved", 2, 3), ("s", "b"): ("held", 5, 2), ("s", "c"): ("approved", 6, 1), ("s", "d"): none, ("r", "a"): none}
    assert got(F.lit(8)) == {("s", "a"): ("discarded", 3, 2), ("s", "b"): ("held", 5, 2), ("s", "c"): none, ("s", "d"): none, ("r", "a"): none}


def test_quality_levels_and_sniffing(spark):
    pages = spark.createDataFrame([("good", 1, "word " * 60), ("bad", 1, ""), ("bad", 2, "x"), ("odd", 1, "word " * 60 + "�" * 40)], "source_id string, page int, text string")
    assert {r.source_id: r.level for r in rp.text_quality(pages).collect()} == {"good": "ok", "bad": "bad", "odd": "bad"}
    files = [("a.pdf", b"%PDF-1.7"), ("b.txt", b"hello"), ("c.txt", b"MZ\x90"), ("d.md", b"\xff\xfe"), ("e.md", b""), ("f.docx", b"PK\x03\x04")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files], "path string, length long, content binary")
    assert {r.path: (r.accepted, r.reason) for r in rp.sniffed(df).collect()} == {"a.pdf": (True, ""), "b.txt": (True, ""), "c.txt": (False, "content"), "d.md": (False, "content"), "e.md": (False, "empty"), "f.docx": (False, "type")}
