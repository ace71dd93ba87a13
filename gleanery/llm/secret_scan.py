"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
every match must contain, for each clause, all trigrams of one alternative.
The index holds, for the trigrams that any query names, one posting for each
document that contains it.  Postings are intersected by a grouped bitwise or,
and only documents that satisfy a rule's query are verified with its regular
expression.  Rules without a mandatory trigram scan every text.  Bits of the
candidates' keys (of bounded size) split the texts: those without a candidate
rule are never shuffled, the others meet their rules by a join.

Cases: a null or empty text has no spans; repeated rows each give their row;
documents of one key only share the candidate rules, which are verified row by
row; an empty table gives no rows; a text of any length is scanned whole, in its
row; other columns aren't read, whatever their names.  Offsets are code points,
ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, flagged, row_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


_KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
RULES: tuple[Rule, ...] = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # runs of 16 or more are the runs that last
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

_NONE = "cast(array() as array<struct<start:int,k:int,stop:int>>)"
#: At most so many strings are spelled out for a stretch of a pattern.
_MOST = 256


def _strings(parsed) -> set[str] | None:
    """All strings that a piece of a parsed pattern matches, in lower case, if they are few."""
    found = {""}
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg).lower()}
        elif name == "IN":
            more = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    more.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                    more |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
        elif name == "SUBPATTERN":
            more = _strings(arg[-1])
        elif name == "BRANCH":
            parts = [_strings(p) for p in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            more = _strings(arg[2])
            more = None if more is None else more | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(found) * len(more) > _MOST:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all must hold; of a clause's trigram sets one must be there whole. Empty: no mandatory trigram."""
    clauses, run = [], {""}

    def flush() -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            clauses.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    for piece in re._parser.parse(pattern):
        more = _strings([piece])
        if more is not None and len(run) * len(more) <= _MOST:
            run = {a + b for a, b in product(run, more)}
        else:
            flush()
            run = {""}
    flush()
    return clauses


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, key) for documents (key, text): each document once for each of ``grams`` in its lower-cased text."""
    there = [F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]
    return docs.select("key", F.lower("text").alias("low")).select(F.explode(F.array_compact(F.array(*there))).alias("gram"), "key")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, rules): the kinds whose trigram query a document's postings satisfy."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for clause in q for s in clause for g in s})
    word = {g: (i // 60, 1 << i % 60) for i, g in enumerate(grams)}
    n = 1 + max((w for w, _ in word.values()), default=0)
    bits = [reduce(lambda c, g: c.when(F.col("gram") == g, F.lit(word[g][1])), [g for g in grams if word[g][0] == k], F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0).cast("long")) for k in range(n)]
    met = index.groupBy("key").agg(*[F.bit_or(b).alias(f"b{k}") for k, b in enumerate(bits)])

    def whole(grams_of: frozenset[str]) -> Column:
        masks = [sum(word[g][1] for g in grams_of if word[g][0] == k) for k in range(n)]
        return reduce(lambda a, b: a & b, [F.col(f"b{k}").bitwiseAND(F.lit(m)) == F.lit(m) for k, m in enumerate(masks) if m])

    def holds(query) -> Column:
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(whole, clause)) for clause in query])

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return met.select("key", kinds.alias("rules")).where(F.size("rules") > 0)


def _spans(rule: Rule, order: int) -> str:
    """SQL for the spans of a rule in ``text``: matches in order, each placed by the lengths of the pieces between."""
    rx = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    whole, part, pieces = f"regexp_extract_all(text, '{rx}', 0)", f"regexp_extract_all(text, '{rx}', {rule.group})", f"split(text, '{rx}')"
    # x.`0`: the match, x.`1`: its group, x.`2`: the piece before it
    start, stop = "a.pos + length(x.`2`)", "a.pos + length(x.`2`) + length(x.`0`)"
    span = f"struct({start} as start, {order} as k, {stop} as stop)"
    return (
        f"aggregate(arrays_zip({whole}, {part}, slice({pieces}, 1, size({whole}))), struct(0 as pos, {_NONE} as got), "
        f"(a, x) -> struct({stop} as pos, if(length(x.`1`) >= {rule.least}, array_append(a.got, {span}), a.got) as got), a -> a.got)"
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: array of (start, k, stop), k the rule's place, by start and rule; one row for each row of ``docs``."""
    with_grams = [r for r in rules if trigram_query(r.pattern)]
    grams = sorted({g for r in with_grams for clause in trigram_query(r.pattern) for s in clause for g in s})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"))
    if not grams:
        return verify(keyed.withColumn("rules", F.lit(None).cast("array<string>")), rules)
    met = checkpoint(candidates(build_index(keyed.select("key", "text"), grams), with_grams))
    split = flagged(keyed, F.col("key"), met.select("key"), met.count(), "asked")
    rest = split.where("not asked").select("doc_id", "text", F.lit(None).cast("array<string>").alias("rules"))
    asked = split.where("asked").join(met, "key", "left").select("doc_id", "text", "rules")
    # a pattern without trigrams is the only one that the rest is asked
    return verify(asked, rules).unionByName(verify(rest, rules, only=[r for r in rules if r not in with_grams]))


def verify(texts: DataFrame, rules: tuple[Rule, ...], only: list[Rule] | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` of rows (doc_id, text, rules): a rule with trigrams is tried only where ``rules`` has its kind."""
    found = []
    for k, rule in enumerate(rules):
        if only is not None and rule not in only:
            continue
        spans = F.when(F.col("text").rlike(rule.pattern), F.expr(_spans(rule, k))).otherwise(F.expr(_NONE))
        found.append(F.when(F.array_contains("rules", rule.kind), spans).otherwise(F.expr(_NONE)) if trigram_query(rule.pattern) else spans)
    return texts.select("doc_id", F.sort_array(F.concat(F.expr(_NONE), *found)).alias("spans"))


def render(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_secret_scan(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    n_base = sum(r.base for r in RULES)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.k = {k})) as bigint)").alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base]
    base = render(F.expr(f"filter(spans, s -> s.k < {n_base})"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(
            f"select rid, {k} as k, '{r.kind}' as kind, s, s + length(m[i]) as e, g[i] as g, {r.least} as least from (select rid, i, m, g, "
            f"cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as bigint) as s "
            f"from (select rid, regexp_extract_all(t, '{rx}') as m, regexp_extract_all(t, '{rx}', {r.group}) as g, string_split_regex(t, '{rx}') as p from d where regexp_matches(t, '{rx}')) x, unnest(range(1, len(m) + 1)) as u(i)) y"
        )
    n_base = sum(r.base for r in RULES)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
f as (select * from ({" union all ".join(parts)}) z where length(g) >= least),
a as (select rid, {", ".join(f"count(*) filter (where k = {k}) as n_{r.kind}" for k, r in enumerate(RULES) if r.base)},
  coalesce(string_agg(concat(kind, ':', s, ':', e), ',' order by s, k) filter (where k < {n_base}), '') as base, string_agg(concat(kind, ':', s, ':', e), ',' order by s, k) as spans from f group by rid)
select doc_id, {", ".join(f"cast(coalesce(n_{r.kind}, 0) as bigint) as n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)
"""


OP2_SQL = _oracle()
