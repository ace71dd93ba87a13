"""The look in RE2 that keeps texts from patterns: it may let more pass, never less."""

from pyspark.sql import functions as F

from gleanery.functions import lexicon as lx
from gleanery.functions import text as tx
from gleanery.operators import candidates as cd
from gleanery.operators import segment as sg

NOISE = tuple(p for ps in lx.DEMOTIONS.values() for p in ps)
TEXTS = [
    "Concept: Source criticism - a method", "  concept : abc", "신앙은 하나님의 은혜를 믿는 것이다.", "A factor is a variable that compares.", "Faith ARE　understood  as the well formed answer", "It refers to the degree",
    '"' + "x" * 40 + '"', "“" + "y" * 40 + "”", "「" + "z" * 20 + "」", "The author   argues that so", "This method\ncompares two of them in a longer line here", "they Do  not  see it", "as a\nresult of what was seen by all of them there",
    "1. a note, p. 12", "[12] see cf. there", "Smith, J. (1999)", "see Jones", "Title .......... 12", "index", "a, 1, 2, 3", "Copyright 2001", "ISBN 978-0123456789", "이 논문은 주장한다", "They claim no more; the claim shows up again", "x" * 50, "", None, "� is a �",
]


def test_no_match_is_overlooked(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for pattern in (*tx.PROSE_CUES, *NOISE, lx.CONCEPT_LINE, lx.KO_DEFINITION, lx.DEFINED_AS, lx.REFERS_TO, lx.IS_A, *lx.QUOTES):
        hit = F.col("text").rlike(tx.java(pattern)) | tx.one_line("text").rlike(tx.java(pattern))
        told = rows.withColumn("may", tx.may_have("text", pattern)).where(hit & ~F.col("may"))
        assert told.count() == 0, pattern
    plain = rows.where("text = repeat('x', 50)").select(tx.may_have("text", *tx.PROSE_CUES, *NOISE))
    assert not plain.first()[0]


def test_judged_lines_give_the_same_rules_and_blocks(spark):
    docs = spark.createDataFrame([("a", "\n".join(t for t in TEXTS if t is not None)), ("b", None)], "source_id string, text string")
    tell = cd.MAY_BE_RULED | sg.MAY_BE_NOISE

    def found(lines):
        ruled = cd.line_rules(lines).withColumn("consumed", F.col("rule").isNotNull())
        blocks = sg.line_blocks(ruled, F.first("rule").alias("rule"))
        return sorted(blocks.select("source_id", "first_line", "last_line", "consumed", "text", "rule").collect(), key=str)

    assert found(sg.lines(docs, tell=tell)) == found(sg.lines(docs))


def test_lines_are_dealt_by_source_once(spark):
    docs = spark.createDataFrame([("a", "Concept: abc")], "source_id string, text string").repartition(2)
    plan = cd.raw_plain_candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_id") == 1 and "ArrowEvalPython" in plan
