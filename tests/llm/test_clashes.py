"""Columns with the operators' own names beside id and text change no row."""

import pytest

from gleanery.llm import decontaminate, fill_in_middle, lexical_search, lm_score, mixing, phrase_dedup, quality_rules, secret_scan, simhash, suffix_dedup, token_files

NAMES = ["key", "t", "i", "h", "w", "ids", "n", "size", "spans", "block", "shard", "term", "row", "k", "kept", "source_size", "bucket", "fp", "words", "item_id", "output", "form", "start", "rank", "score"]
SPARSE = ["op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"]


@pytest.fixture(scope="module")
def tables(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(words[(i * j) % 10] for j in range(1, 50)) for i in range(12)] + [None, "", "password=abcdefghijklmnop " * 3, "é 日本 " * 5000]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = spark.createDataFrame([(*r, *[7] * len(NAMES)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in NAMES))
    items = spark.createDataFrame([(1, texts[3]), (2, None)], "item_id long, text string")
    return plain, extra, items


@pytest.mark.parametrize("name", SPARSE)
def test_clashing_columns(tables, name):
    plain, extra, items = tables
    run = {
        "op2": secret_scan.op2_secret_scan, "op3": simhash.op3_simhash, "op4": suffix_dedup.op4_suffix_dedup, "op6": mixing.op6_mix, "op7": phrase_dedup.op7_phrase_dedup, "op8": quality_rules.op8_quality_rules,
        "op9": lambda d: decontaminate.op9_decontaminate(d, items), "op10": lm_score.op10_lm_score, "op11": token_files.op11_token_files, "op12": lambda d: lexical_search.op12_lexical_search(d, items), "op13": fill_in_middle.op13_fill_in_middle,
    }[name]
    rows = lambda df: sorted(map(repr, (tuple(r) for r in run(df).collect())))
    assert rows(extra) == rows(plain)
