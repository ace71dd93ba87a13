"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once a document; its failure is a bit of ``fail_bits``
beside the measurements it used.  A policy is a versioned mask over those bits,
so a new policy, or an ablation of one, reads the ledger and never the texts.
All of it is per-row expressions: nothing is shuffled but the ablation counts.

Cases: a null or empty text has no words and fails ``few_words``; repeated rows
give repeated rows; an empty table gives an empty ledger; a text of any
length is judged whole; other columns aren't read, whatever their names.  Repeats inside a
document are found by 64-bit hashes of its own 5-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Rule name -> SQL over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "few_letters": "100 * n_letter_words < 58 * n_words",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(RULES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits``, one row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", words("t").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = "xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])"
    measured = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("t", F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        lines.alias("lines"),
        F.expr(f"if(size(w) < 5, array(), transform(sequence(0, size(w) - 5), i -> {window}))").alias("h"),
    ).select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # windows by hash, then position: only where some hash comes twice
        F.expr("if(size(array_distinct(h)) = size(h), null, sort_array(transform(h, (x, i) -> struct(x as h, i as i))))").alias("s"),
    )
    # starts of repeated windows, in order; each covers up to five words, or as far as the next start
    starts = "sort_array(transform(filter(transform(s, (x, k) -> if((k > 0 and s[k - 1].h = x.h) or (k + 1 < size(s) and s[k + 1].h = x.h), x.i, -1)), p -> p >= 0), p -> p))"
    measured = measured.withColumn("p", F.expr(f"if(s is null, null, {starts})"))
    covered = "aggregate(p, struct(0L as n, -5 as last), (a, x) -> struct(a.n + least(5, x - a.last) as n, x as last), a -> a.n)"
    measured = measured.withColumn("n_repeat_words", F.expr(f"if(p is null, 0L, {covered})"))
    bits = " | ".join(f"if({sql}, {BIT[name]}L, 0L)" for name, sql in RULES.items())
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", F.expr(bits).alias("fail_bits"))


def apply_policy(kept_ledger: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return kept_ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(kept_ledger: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.

    Masks are counted first, so that at most one row for each mask is expanded.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    masks = kept_ledger.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in policy.rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        masks.select("bits", "n", rules)
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
    )


def keep(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Judged in place, without a join."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    judged = ledger(packed.select(F.col("row").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text")))
    # a filter on ``kept`` itself would be moved below the measurements, with all of them written out in it; one behind a generator isn't
    passed = apply_policy(judged, policy).select(F.explode_outer(F.when(F.col("kept"), F.array("doc_id"))).alias("row"))
    return passed.where("row is not null").select("row.*")


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    judged = apply_policy(ledger(docs))
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def policy_ablation(docs: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail it, and those that only it rejects."""
    kept_ledger = ledger(docs)
    return ablation(kept_ledger, BASE).unionByName(ablation(kept_ledger, STRICT))


OP8_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
win as (select rid, i, array_to_string(list_slice(w, i, i + 4), ' ') as g from w, unnest(range(1, len(w) - 3)) as u(i) where len(w) >= 5),
rep as (select rid, i from win qualify count(*) over (partition by rid, g) > 1),
cov as (select rid, count(distinct i + k) as n from rep, unnest(range(0, 5)) as u(k) group by rid),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) as bigint) as n_letter_words, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
  from w left join cov using (rid)),
b as (select *, {" + ".join(f"case when {sql} then {BIT[name]} else 0 end" for name, sql in RULES.items())} as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {BASE.mask}) <> 0 as base_failed, (bits & {STRICT.mask}) = 0 as kept, cast(bits as bigint) as fail_bits from b
"""

_POLICIES = ", ".join(f"('{p.version}', '{r}', {BIT[r]}, {p.mask})" for p in (BASE, STRICT) for r in p.rules)
ABLATION_SQL = OP8_SQL.rsplit("select doc_id, n_words", 1)[0] + f"""select policy, rule, cast(count(*) filter (where (bits & bit) <> 0) as bigint) as n_failed, cast(count(*) filter (where (bits & mask) = bit) as bigint) as n_only
from b, (values {_POLICIES}) v(policy, rule, bit, mask) group by policy, rule
"""
