"""Patterns are tried where one look in RE2 lets them match, and chunks are dealt without texts that nobody reads."""

import re

from pyspark.sql import functions as F

from gleanery.functions import lexicon as lx
from gleanery.functions import text as tx
from gleanery.operators import segment as sg


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def executed(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_dot_may_meet_a_line_end_that_is_collapsed(spark):
    text = "1. a note\nof it, p. 12"
    given = spark.createDataFrame([(text,)], "text string")
    footnote = lx.DEMOTIONS["footnote"][0]
    assert given.select(tx.one_line("text").rlike(tx.java(footnote)), tx.may_have("text", footnote)).first() == (True, True)


def test_terms_are_found_once_and_by_sight(spark):
    texts = ["An intertextual reading, Intertextual and ad hoc, of MT and LXX2", "λόγος and דבר in form-critical well-known work", "plain words only", "", None, "A priori\nSITZ IM LEBEN API X9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = tx.with_terms(docs, "text").select("id", "terms")
    assert rows(found) == [
        (0, ["intertextual", "ad hoc", "MT", "LXX2"]), (1, ["λόγος", "דבר", "form-critical"]), (2, []), (3, []), (4, None), (5, ["a priori", "Sitz im Leben", "SITZ", "IM", "LEBEN"]),
    ]
    plan = executed(found)
    assert plan.count("ArrowEvalPython") and plan.count("regexp_extract_all(") == 4


def test_reasons_stay_with_looks_before_them(spark):
    given = [
        ("concept", "Copyright 2001", "", ""), ("concept", "Jane Roe", "Jane Roe", "Jane Roe"), ("quotation", "short one", "", "short one"), ("quotation", "long " * 10, "", "long " * 10),
        ("argument", "The author argues", "it shows", "Copyright 2001"), ("concept", "Chapter 3", "", ""), ("concept", "plain", "thing", None), ("concept", None, None, None),
    ]
    df = spark.createDataFrame(given, "type string, title string, summary string, evidence string")
    found = tx.with_structural_reason(df, "type", "title", F.col("summary"), F.col("evidence"))
    assert [r.reason for r in found.collect()] == ["demoted", "person_name", "short_quotation", "quotation_only", None, "section_marker", None, None]
    assert "ArrowEvalPython" in executed(found)


def test_chunks_are_dealt_without_texts_that_nobody_reads(spark):
    docs = spark.createDataFrame([("a", "one line\n\n \x0c two"), ("b", "x " * 2000), ("c", None)], "source_id string, text string")
    cut = sg.chunks(docs)
    assert all(r.n_text == len(r.text.strip()) > 0 for r in cut.collect())
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", executed(cut.select("source_id", "ord", "chunk_id", "n_text")))
    assert dealt and not any(re.search(r"\btext#", x) for x in dealt)
