"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

from . import decontaminate, fill_in_middle, language_id, lexical_search, line_dedup, lm_score, mixing, phrase_dedup, quality_rules, secret_scan, simhash, suffix_dedup, token_files
from .common import load

QUERIES = {
    "op1_line_dedup": lambda spark, sf: line_dedup.op1_line_dedup(load(spark, sf, "documents")),
    "op2_secret_scan": lambda spark, sf: secret_scan.op2_secret_scan(load(spark, sf, "documents")),
    "op3_simhash": lambda spark, sf: simhash.op3_simhash(load(spark, sf, "documents")),
    "op7_phrase_dedup": lambda spark, sf: phrase_dedup.op7_phrase_dedup(load(spark, sf, "documents")),
    "op4_suffix_dedup": lambda spark, sf: suffix_dedup.op4_suffix_dedup(load(spark, sf, "documents")),
    "op5_language_id": lambda spark, sf: language_id.op5_language_id(load(spark, sf, "pages"), load(spark, sf, "documents")),
    "op10_lm_score": lambda spark, sf: lm_score.op10_lm_score(load(spark, sf, "documents")),
    "op6_mix": lambda spark, sf: mixing.op6_mix(load(spark, sf, "documents")),
    "op9_decontaminate": lambda spark, sf: decontaminate.op9_decontaminate(load(spark, sf, "documents"), load(spark, sf, "benchmark")),
    "op8_quality_rules": lambda spark, sf: quality_rules.op8_quality_rules(load(spark, sf, "documents")),
    "policy_ablation": lambda spark, sf: quality_rules.policy_ablation(load(spark, sf, "documents")),
    "op11_token_files": lambda spark, sf: token_files.op11_token_files(load(spark, sf, "documents")),
    "op12_lexical_search": lambda spark, sf: lexical_search.op12_lexical_search(load(spark, sf, "documents"), load(spark, sf, "benchmark")),
    "op13_fill_in_middle": lambda spark, sf: fill_in_middle.op13_fill_in_middle(load(spark, sf, "documents")),
}
ORACLES = {
    "op2_secret_scan": secret_scan.OP2_SQL,
    "op7_phrase_dedup": phrase_dedup.OP7_SQL,
    "op6_mix": mixing.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "policy_ablation": quality_rules.ABLATION_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
