"""Untrusted model responses: parse, recover, gate evidence against chunks, merge, import."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx

# ---- fixed values: what a response may say ----
TYPES = ["concept", "argument", "method", "scholar", "religious_text", "objection", "quotation", "other"]
CONFIDENCES = ["high", "medium", "low"]
#: term, preferred form, a term whose presence excuses it, only in religious context
TERM_RULES = [
    ("하나님", "하느님", "", False), ("여호와", "주님/하느님", "", False), ("이신칭의", "의화", "", False), ("칭의", "의화", "이신칭의", False), ("은혜", "은총", "", True),
    ("사사기", "판관기", "", False), ("출애굽기", "탈출기", "", False), ("출애굽", "탈출", "출애굽기", False), ("마가복음", "마르코 복음", "", False), ("마가 복음", "마르코 복음", "", False),
    ("마태복음", "마태오 복음", "", False), ("마태 복음", "마태오 복음", "", False), ("누가복음", "루카 복음", "", False), ("누가 복음", "루카 복음", "", False), ("요한복음", "요한 복음", "", False),
]
CONTEXT_MARKERS = "religious_text 성서 성경 종교 신학 가톨릭 교회 하느님 하나님 예수 그리스도 구원 은총 의화 칭의 판관기 탈출기 마르코 마태오 루카 여호와 시편 복음".split()
SCHEMA = """wiki_candidates array<struct<title: string, type: string, confidence: string, summary_ko: string, reason: string,
  discipline_profile: string, discipline_unit: string, mapping_reason: string, reuse_reason: string, boundary_note: string, standard_terms: array<string>,
  evidence: array<struct<chunk_id: string, quote: string, translation_ko: string>>>>"""


def body(raw: Column) -> Column:
    """What stands in the first fence, or in all; from the first brace to the last."""
    raw = tx.trimmed(F.coalesce(raw, F.lit("")))
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)
    inner = F.when(raw.rlike(r"(?is)```(?:json)?\s*(.*?)```"), fenced).otherwise(raw)
    return tx.trimmed(F.when(inner.rlike(r"(?s)\{.*\}"), F.regexp_extract(inner, r"(?s)(\{.*\})", 1)).otherwise(inner))


#: What can change the scanner's state: an escaped character, a string's end, braces, and the list's end.
_TOKENS = re.compile(r'\\.|["{}\]]', re.S)


def complete_objects(text: str, begin: int) -> list[str]:
    """The balanced objects of a list that opens before ``begin``, up to its end or the text's.

    One pass: each place is looked at once, however often the text is broken.  An object whose end is missing ends the scan.
    """
    found, depth, quoted, at = [], 0, False, begin
    for token in _TOKENS.finditer(text, begin):
        mark = token.group()
        if quoted:
            quoted = mark != '"'
        elif mark == '"':
            quoted = depth > 0  # between objects a quotation mark is noise
        elif mark == "{":
            at, depth = (token.start() if not depth else at), depth + 1
        elif mark == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[at : token.end()])
        elif mark == "]" and not depth:
            break
    return found


def _recovered(text: str) -> str | None:
    """Complete candidate objects of a damaged body as a valid body; balanced ones that are no JSON are left out; null if none is left."""
    head = re.search(r'"wiki_candidates"\s*:', text)
    begin = text.find("[", head.end()) if head else -1
    found = []
    for piece in complete_objects(text, begin + 1) if begin >= 0 else ():
        try:
            found.append(json.loads(piece))
        except ValueError:
            continue
    return json.dumps({"wiki_candidates": found}, ensure_ascii=False) if found else None


def _recover(batches):
    for rows in batches:
        yield pd.DataFrame({"source_id": rows["source_id"], "recovered": [_recovered(t) for t in rows["body"]]})


def parsed(responses: DataFrame) -> DataFrame:
    """source_id, status (ok, recovered, empty, error), candidates. Only rows that don't parse go through Python."""
    rows = responses.select("source_id", body(F.col("raw")).alias("body"))
    rows = rows.withColumn("valid", F.try_parse_json("body").isNotNull())
    read = tx.only(rows, F.col("valid") | (F.col("body") == "")).select("source_id", F.when(F.col("body") == "", "empty").otherwise("ok").alias("status"), "body")
    broken = tx.only(rows, ~F.col("valid") & (F.col("body") != "")).select("source_id", "body").mapInPandas(_recover, "source_id string, recovered string")
    broken = broken.select("source_id", F.when(F.col("recovered").isNotNull(), "recovered").otherwise("error").alias("status"), F.col("recovered").alias("body"))
    return read.unionByName(broken).select("source_id", "status", F.from_json("body", SCHEMA)["wiki_candidates"].alias("candidates"))


def response_candidates(found: DataFrame) -> DataFrame:
    """source_id, idx from 0, and the fields of each candidate."""
    return found.select("source_id", "status", F.posexplode("candidates").alias("idx", "c")).select("source_id", "status", "idx", "c.*")


def evidence_gate(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, idx, ei, chunk_id, quote, translation, verdict: evidence must name a chunk of its source and quote it, verbatim and briefly."""
    rows = candidates.select("source_id", "idx", F.posexplode("evidence").alias("ei", "e"))
    rows = rows.select("source_id", "idx", "ei", tx.trimmed(F.coalesce("e.chunk_id", F.lit(""))).alias("chunk_id"), tx.trimmed(F.coalesce("e.quote", F.lit(""))).alias("quote"), F.coalesce("e.translation_ko", F.lit("")).alias("translation"))
    joined = rows.join(chunks.select("source_id", "chunk_id", F.col("text").alias("chunk_text"), F.lit(True).alias("known")), ["source_id", "chunk_id"], "left")
    verdict = (
        F.when(F.col("chunk_id") == "", "no_chunk")
        .when(F.col("known").isNull(), "forged")
        .when(F.col("quote") == "", "no_quote")
        .when(F.length("quote") > lx.QUOTE_CHARS, "long_quote")
        .when(~F.contains("chunk_text", "quote"), "not_verbatim")
        .otherwise("bound")
    )
    return joined.withColumn("verdict", verdict).drop("known")


def text_fields(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """source_id, idx, label, text: what the terminology policy reads of candidates with ``kind``; of bound evidence the first translation."""
    named = [F.struct(F.lit(c).alias("label"), F.col(c).alias("text")) for c in ("title", "discipline_profile", "discipline_unit", "summary_ko", "mapping_reason", "reuse_reason", "boundary_note", "reason")]
    kind = F.struct(F.lit("type").alias("label"), F.when(F.col("kind").isin(TYPES), F.col("kind")).alias("text"))
    terms = F.transform(F.coalesce("standard_terms", F.array().cast("array<string>")), lambda t: F.struct(F.lit("standard_terms").alias("label"), t.alias("text")))
    own = rows.select("source_id", "idx", F.explode(F.concat(F.array(*named, kind), terms)).alias("f")).select("source_id", "idx", "f.*")
    said = gate.where("verdict = 'bound'").groupBy("source_id", "idx", "chunk_id", "quote").agg(F.min(F.when(tx.trimmed(F.col("translation")) != "", F.struct("ei", "translation"))).alias("t"))
    return own.unionByName(said.select("source_id", "idx", F.lit("translation_ko").alias("label"), F.col("t.translation").alias("text")))


def judged(candidates: DataFrame, gate: DataFrame) -> DataFrame:
    """Candidates with ``violations`` and ``importable``."""
    bound = gate.groupBy("source_id", "idx").agg(
        F.array_sort(F.collect_set(F.when(F.col("verdict") != "bound", F.col("verdict")))).alias("faults"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("verdict") == "bound", F.col("quote")))), "\n").alias("quotes")
    )
    rows = candidates.join(bound, ["source_id", "idx"], "left").withColumn("kind", F.when(tx.trimmed(F.coalesce("type", F.lit(""))) == "", "other").otherwise(tx.trimmed(F.col("type"))))
    rows = tx.with_structural_reason(rows, "kind", "title", F.concat_ws("\n", F.when(F.col("summary_ko") != "", F.col("summary_ko")), F.when(F.col("reason") != "", F.col("reason"))), F.col("quotes"), "structure")
    fault = lambda test, name: F.when(test, F.lit(name))
    checks = F.array_compact(
        F.array(
            fault(tx.trimmed(F.coalesce("title", F.lit(""))) == "", "title"),
            fault(~F.col("kind").isin(TYPES), "type"),
            fault(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "evidence"),
            fault(F.col("confidence").isNotNull() & ~F.lower(tx.trimmed(F.col("confidence"))).isin(CONFIDENCES), "confidence"),
            fault(F.col("structure").isNotNull(), "structure"),
        )
    )
    terms = term_hits(text_fields(rows, gate), "source_id", "idx").select("source_id", "idx", F.transform("hits", lambda h: F.concat(F.lit("term "), h["label"], F.lit(" "), h["term"])).alias("terms"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("checks", checks).join(terms, ["source_id", "idx"], "left")
    rows = rows.withColumn("violations", F.concat("checks", F.coalesce("faults", none), F.array_distinct(F.coalesce("terms", none)))).drop("checks", "terms")
    return rows.withColumn("importable", F.size("violations") == 0)


def merged(candidates: DataFrame, gate: DataFrame) -> DataFrame:
    """One row for each (type, title, summary): bound evidence distinct by chunk and quote, with the first translation, how many rows, sources and rejected pieces it had, the first reason of each kind, and its terms, twelve at most."""
    reasons = ("mapping_reason", "reuse_reason", "boundary_note", "reason")
    at = F.struct("source_id", "idx")
    keys = candidates.select("source_id", "idx", F.col("kind").alias("type"), "title", F.col("summary_ko").alias("summary"), *reasons, F.coalesce("standard_terms", F.array().cast("array<string>")).alias("terms"))
    said = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c) for c in reasons]
    # a title may come in any number of responses: its terms are counted one by one, and only the first are gathered
    spread = keys.select("type", "title", "summary", "source_id", "idx", F.posexplode("terms").alias("pos", "term"))
    each = spread.groupBy("type", "title", "summary", "term").agg(F.min(F.struct("source_id", "idx", "pos")).alias("at"))
    few = each.withColumn("no", F.row_number().over(Window.partitionBy("type", "title", "summary").orderBy("at"))).where(F.col("no") <= lx.MAX_TERMS)
    terms = few.groupBy("type", "title", "summary").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "term"))), lambda x: x["term"]).alias("terms")).toDF("t_type", "t_title", "t_summary", "terms")
    own = keys.groupBy("type", "title", "summary").agg(F.count("*").alias("n_rows"), F.countDistinct("source_id").alias("n_sources"), *said)
    lost = keys.join(gate.where("verdict <> 'bound'"), ["source_id", "idx"]).groupBy("type", "title", "summary").agg(F.countDistinct("chunk_id", "verdict").alias("n_rejected")).toDF("l_type", "l_title", "l_summary", "n_rejected")
    kept = keys.join(gate.where("verdict = 'bound'"), ["source_id", "idx"]).groupBy("type", "title", "summary", "chunk_id", "quote").agg(F.min(F.struct("source_id", "idx", "ei")).alias("at"), F.max(F.nullif("translation", F.lit(""))).alias("translation"))
    evidence = kept.groupBy("type", "title", "summary").agg(F.count("*").alias("n_evidence")).toDF("e_type", "e_title", "e_summary", "n_evidence")

    same = lambda mark: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in ("type", "title", "summary")])
    joined = own.join(evidence, same("e"), "left").join(lost, same("l"), "left").join(terms, same("t"), "left")
    return joined.select("type", "title", "summary", "n_rows", "n_sources", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), *reasons)


def steps(judged_rows: DataFrame, gate: DataFrame) -> DataFrame:
    """source_id, idx, no, step, status: what became of each candidate of a response (rows of :func:`judged` with ``status``), in seven steps."""
    rejected = gate.where("verdict <> 'bound'").select("source_id", "idx").distinct().withColumn("lost", F.lit(True))
    rows = judged_rows.join(rejected, ["source_id", "idx"], "left")
    given = lambda *cols: reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) != "" for c in cols])
    tests = [
        ("discipline_profile", given("discipline_profile", "discipline_unit"), "warning"), ("reuse_reason", given("reuse_reason"), "warning"), ("mapping_reason", given("mapping_reason"), "warning"),
        ("parse", F.col("status").isin("ok", "recovered"), "blocked"), ("shape_validation", F.col("title").isNotNull(), "blocked"), ("chunk_id_binding", F.col("lost").isNull(), "blocked"), ("importable", F.col("importable"), "blocked"),
    ]
    found = F.array(*[F.struct(F.lit(n).alias("no"), F.lit(name).alias("step"), F.when(ok, "passed").otherwise(bad).alias("status")) for n, (name, ok, bad) in enumerate(tests, 1)])
    return rows.select("source_id", "idx", F.explode(found).alias("s")).select("source_id", "idx", "s.*")


def failures(found: DataFrame) -> DataFrame:
    """source_id, reason of responses that gave nothing to read: empty, not JSON, or without the list of candidates."""
    reason = F.when(F.col("status").isin("empty", "error"), F.col("status")).when(F.col("candidates").isNull(), "shape")
    return found.select("source_id", reason.alias("reason")).where("reason is not null")


def imported(judged_rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Entries of importable candidates: id from source, index and slug; each claim with the quote that its chunk holds."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9가-힣]+", "-"), r"\A-+|-+\z", "")
    ids = F.concat_ws("-", "source_id", F.lit("llm"), F.col("idx").cast("string"), F.when(slug == "", "entry").otherwise(slug))
    claims = gate.where("verdict = 'bound'").groupBy("source_id", "idx").agg(F.array_sort(F.collect_list(F.struct("ei", F.col("quote").alias("original_text"), F.col("translation").alias("translated_text"), "chunk_id"))).alias("claims"))
    return judged_rows.where("importable").join(claims, ["source_id", "idx"]).select(ids.alias("id"), "source_id", "title", F.lit("draft").alias("status"), "claims")


def good_prefix(batches: DataFrame) -> DataFrame:
    """source, n_good, stopped_by: batches (source, batch, status) before the first that failed or had to be recovered."""
    first = F.min(F.when(F.col("status") != "ok", F.struct("batch", "status")))
    found = batches.groupBy("source").agg(first.alias("bad"), F.count("*").alias("n"))
    return found.select("source", F.coalesce(F.col("bad.batch"), F.col("n")).cast("long").alias("n_good"), F.coalesce("bad.status", F.lit("")).alias("stopped_by"))


def term_hits(fields: DataFrame, *keys: str, rules=TERM_RULES) -> DataFrame:
    """``keys`` and hits (rule, label, term, religious): the policy terms in each field (label, text), unless the field excuses them; the context is that of all fields of a key."""
    text = F.coalesce("text", F.lit(""))
    hit = lambda r: F.contains(text, F.lit(r[0])) & (F.lit(True) if not r[2] else ~F.contains(text, F.lit(r[2])))
    one = lambda n, r: F.struct(F.lit(n).alias("rule"), F.col("label"), F.lit(r[0]).alias("term"), F.lit(r[3]).alias("religious"))
    context = F.max(F.lit(False) if not CONTEXT_MARKERS else text.rlike("|".join(CONTEXT_MARKERS)))
    found = fields.withColumn("hits", F.array_compact(F.array(*[F.when(hit(r), one(n, r)) for n, r in enumerate(rules)])))
    grouped = found.groupBy(*keys).agg(context.alias("context"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return grouped.select(*keys, F.expr("filter(hits, h -> context or not h.religious)").alias("hits"))


def term_violations(fields: DataFrame, rules=TERM_RULES) -> DataFrame:
    """id and the policy terms that its fields (id, text) use, unless excused in the same field or out of context."""
    hits = term_hits(fields.select("id", F.lit("").alias("label"), "text"), "id", rules=rules)
    return hits.select("id", F.array_distinct(F.transform("hits", lambda h: h["term"])).alias("terms"))


def prompts(batched: DataFrame) -> DataFrame:
    """One prompt for each batch of chunks (source_id, batch, ord, chunk_id, text): a header and the chunks, indented."""
    part = F.concat(F.lit("- chunk_id: "), "chunk_id", F.lit("\n    "), F.regexp_replace("text", "\n", "\n    "))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x["part"])
    return batched.groupBy("source_id", "batch").agg(F.concat_ws("\n", F.concat(F.lit("source: "), F.col("source_id")), F.array_join(parts, "\n"), F.lit("Answer with one JSON object: wiki_candidates.")).alias("prompt"))
