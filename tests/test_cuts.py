"""Lines and blocks cut in Arrow: the same as Spark's windows give, without dealing texts by source."""

from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import candidates as cd
from gleanery.operators import cuts
from gleanery.operators import segment as sg

TEXTS = {
    "a": "Concept: abc def\nplain line\nThe author argues that this line is long\nenough to be prose, and it goes on. \n\nno cue\nnone. \nHowever, the chapter challenges all of it and rejects what was said before\nover two lines.\n\n ",
    "b": "above\n" + '"' + "q" * 40 + '"' + "\nbelow\nThe author\nargues of é and 글 in a text that is long enough to be judged as prose by length.” \nThis method compares it with a second framework, in a line of prose that is long.",
    "c": "﻿one\r\ntwo\rthree\f\fsix\f seven \n\f\n \n　x\n\n\n",
    "d": "", "e": None, "f": "\n", "g": "index\nCopyright 2001 because it is so\nA factor is a variable that the well-formed model compares across groups.\nIndex",
}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def docs_of(spark):
    return spark.createDataFrame([*TEXTS.items(), *[(f"n{i}", "word " * 30 + f"\n{i}\n\n") for i in range(50)]], "source_id string, text string")


def test_lines_in_question_give_all_candidates(spark):
    docs = docs_of(spark)
    some = cuts.lines_in_question(docs, cd.RULES, tx.PROSE_CUES)
    columns = ["source_id", "ln", "begin", "stop", "line"]
    every = rows(sg.lines(docs).select(*columns))
    assert set(rows(some.select(*columns))) <= set(every) and 0 < some.count() < len(every) / 2

    def found(lines):
        blocks = sg.line_blocks(cd.line_rules(lines).withColumn("consumed", F.col("rule").isNotNull()), F.first("rule").alias("rule"))
        typed = tx.typed(blocks.withColumn("_prose", F.when(~F.col("consumed"), F.col("text"))), "_prose")
        return rows(typed.where("consumed or type is not null").select("source_id", "first_line", "last_line", "begin", "stop", "consumed", "text", "rule", "type"))

    assert found(some) == found(sg.lines(docs)) and len(found(some)) >= 6


def test_quotations_keep_neighbours_that_are_left_out(spark):
    quotes = [r.evidence_text for r in cd.raw_plain_candidates(docs_of(spark)).where("type = 'quotation'").collect()]
    assert quotes == ["above\n" + '"' + "q" * 40 + '"' + "\nbelow"]


def test_plain_blocks_are_those_of_windows_and_need_no_shuffle(spark):
    docs = docs_of(spark)
    columns = ["source_id", "begin", "stop", "text", "path"]
    assert rows(sg.semantic_blocks(docs).select(*columns)) == rows(sg._headed_blocks(docs.withColumn("kind", F.lit("plaintext"))).select(*columns))
    assert "Exchange" not in sg.semantic_blocks(docs)._jdf.queryExecution().executedPlan().toString()


def test_kinds_may_be_mixed(spark):
    docs = spark.createDataFrame([("a", "# head\nbody", "markdown"), ("b", "# head\nbody", "plaintext"), ("c", "x", None)], "source_id string, text string, kind string")
    got = rows(sg.semantic_blocks(docs).select("source_id", "begin", "stop", "text", F.array_join("path", ">")))
    assert got == [("a", 7, 11, "body", "head"), ("b", 0, 11, "# head\nbody", ""), ("c", 0, 1, "x", "")]
