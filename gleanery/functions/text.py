"""Per-row text rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import lexicon as lx
from .rx import SPACE, glance, java, needles


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` behind a generator: what reads the column is not moved into the projection that computes it, where it would be written out for each reader."""
    return F.explode_outer(F.array(value))


def only(df: DataFrame, test: Column) -> DataFrame:
    """The rows for which ``test`` holds. It is judged behind a generator: a plain filter would be moved below the columns that it reads, with all their expressions written out in it, several times over."""
    return df.withColumn("_holds", F.explode_outer(F.array(F.coalesce(test, F.lit(False))))).where("_holds").drop("_holds")


def has(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether ``pattern`` matches. It is tried only in texts that hold one of its needles when lower-cased (``low``, if that is at hand)."""
    wanted = needles(pattern)
    if not wanted:
        return text.rlike(java(pattern))
    held = let(F.lower(text), lambda x: holding(x, wanted)) if low is None else holding(low, wanted)
    return F.when(~held, F.lit(False)).otherwise(text.rlike(java(pattern)))


def holding(low: Column, wanted: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, wanted)), lambda n: F.contains(low, n))


def may_have(text: Column | str, *patterns: str) -> Column:
    """Whether one of the patterns may match a text or its collapsed form: false only if none does. One pass over the text in RE2, whatever their number; not to be named in a lambda."""
    return seen(text, "|".join(map(glance, patterns)))


def seen(text: Column | str, one: str) -> Column:
    """Whether an RE2 expression matches; not to be named in a lambda."""

    @F.arrow_udf(returnType=BooleanType())
    def found(texts):
        import pyarrow.compute as pc

        return pc.match_substring_regex(texts, one)

    return found(col(text))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, java(pattern), n)


def normalized(text: Column | str) -> Column:
    """Without a byte order mark, lines ended by \\n."""
    text = col(text)
    bare = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(bare, "\r\n?", "\n")).otherwise(bare)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def one_line(text: Column | str) -> Column:
    """White space collapsed and trimmed. The expression is tried only in texts that have more than single blanks between words."""

    def collapsed(t: Column) -> Column:
        wide = (F.octet_length(t) != F.length(t)) & holding(t, tuple(c for c in SPACE if not c.isascii()))
        return F.trim(F.when(wide | holding(t, ("  ", "\t", "\x0b", "\f", "\r")), F.regexp_replace(t, java(r"\s+"), " ")).otherwise(t))

    return let(F.replace(col(text), F.lit("\n"), F.lit(" ")), collapsed)


def cut(clean: Column, most: int) -> Column:
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 1), F.lit("…"))).otherwise(clean)


def truncated(text: Column | str, most: int) -> Column:
    return let(one_line(text), lambda clean: cut(clean, most))


def clean_evidence(text: Column | str) -> Column:
    """Blanks collapsed line by line, empty lines dropped, cut at the evidence limit."""
    lines = F.transform(F.split(col(text), "\r?\n"), lambda x: trimmed(F.regexp_replace(x, "[ \t]+", " ")))
    return let(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), lambda clean: cut(clean, lx.EVIDENCE_CHARS))


def cut_at_word(text: Column | str, most: int) -> Column:
    """At most ``most`` characters, up to the last blank if that is beyond 65 % of them."""

    def shortened(clean: Column) -> Column:
        head = F.substring(clean, 1, most + 1)
        last = most + 1 - F.instr(F.reverse(head), " ")  # characters before the last blank
        kept = F.when((F.instr(head, " ") > 0) & (last >= int(most * 0.65)), F.substring(head, F.lit(1), last)).otherwise(F.substring(clean, 1, most))
        return F.when(F.length(clean) <= most, clean).otherwise(F.trim(kept))

    return let(one_line(text), shortened)


def claim_count(text: Column | str, low: Column | None = None) -> Column:
    """Verbs that make a claim: English ones less those that only look it, and Korean ones."""
    text = col(text)
    guards = reduce(lambda a, b: a + b, [count(text, g) for g in lx.CLAIM_GUARDS])
    # tried only in texts that have such a verb
    english = F.when(has(text, lx.CLAIM_EN, low), count(text, lx.CLAIM_EN) - guards).otherwise(0)
    return english + F.when(has(text, lx.CLAIM_KO, low), count(text, lx.CLAIM_KO)).otherwise(0)


def demotions(text: Column | str, low: Column | None = None) -> dict[str, Column]:
    """For each kind of structural noise whether the text shows it."""
    text = col(text)
    return {kind: reduce(lambda a, b: a | b, [has(text, p, low) for p in patterns]) for kind, patterns in lx.DEMOTIONS.items()}


#: A text shows noise by one of these, or none; it makes claims by one of those, or none.
NOISE = tuple(p for ps in lx.DEMOTIONS.values() for p in ps)
CLAIMS = (lx.CLAIM_EN, lx.CLAIM_KO)


def demotion_kinds(text: Column | str) -> Column:
    return F.array_compact(F.array(*[F.when(flag, F.lit(kind)) for kind, flag in demotions(text).items()]))


def demoted(text: Column | str, low: Column | None = None) -> Column:
    return reduce(lambda a, b: a | b, demotions(text, low).values())


def prose_type(clean: Column, low: Column, claims: Column) -> Column:
    """argument, method or objection, or null, of a text collapsed to one line, by its cues and claims. ``low``: the text lower-cased."""
    size, cue = F.length(clean), lambda pattern: has(clean, pattern, low)
    short = F.when(cue(lx.ARGUMENT_AGENT), "argument").when(cue(lx.METHOD_AGENT), "method")
    long = (
        F.when(cue(lx.OBJECTION_CUE), "objection")
        .when(cue(lx.ARGUMENT_AGENT), "argument")
        .when(cue(lx.METHOD_CUE) | cue(lx.BOUNDARY_CUE), "method")
        .when((claims > 0) | cue(lx.ARGUMENT_CUE), "argument")
    )
    return F.when(~size.between(lx.SHORT_PROSE, lx.LONG_PROSE), F.lit(None)).when(size < lx.PROSE, short).otherwise(long)


#: A text has a type by one of these, or by none.
PROSE_CUES = (lx.ARGUMENT_AGENT, lx.METHOD_AGENT, lx.OBJECTION_CUE, lx.METHOD_CUE, lx.BOUNDARY_CUE, lx.ARGUMENT_CUE, lx.CLAIM_EN, lx.CLAIM_KO)


def typed(df: DataFrame, text: str, out: str = "type") -> DataFrame:
    """``df`` with the prose type of a column; step by step, so that nothing is computed twice, and noise is looked for only in texts that have a type and no claim."""
    # a text without any cue or verb has no type: it isn't even collapsed
    df = df.withColumn("_cue", may_have(text, *PROSE_CUES)).withColumn("_noisy", may_have(text, *NOISE))
    df = df.withColumn("_clean", one_line(F.when(F.col("_cue"), col(text)))).withColumn("_low", F.lower("_clean"))
    # other lengths have no type: they meet no pattern
    fits = F.length("_clean").between(lx.SHORT_PROSE, lx.LONG_PROSE)
    df = df.withColumn("_claims", F.when(fits, claim_count("_clean", F.col("_low"))).otherwise(0))
    df = df.withColumn("_cued", prose_type(F.col("_clean"), F.col("_low"), F.col("_claims")))
    noise = F.col("_cued").isNotNull() & (F.col("_claims") == 0) & F.col("_noisy") & demoted("_clean", F.col("_low"))
    return df.withColumn(out, F.when(~noise, F.col("_cued"))).drop("_cue", "_noisy", "_clean", "_low", "_claims", "_cued")


def prose_title(text: Column | str) -> Column:
    """The first sentence without its connector or reporting verb, cut at 120 characters."""

    def dropped(title: Column) -> Column:
        for pattern in lx.TITLE_DROPS:
            title = F.regexp_replace(title, java(pattern), "")
        return title

    or_else = lambda a, b: let(a, lambda x: F.when(x == "", b).otherwise(x))
    return cut_at_word(let(one_line(text), lambda clean: or_else(dropped(or_else(group(clean, lx.SENTENCE_HEAD, 0), clean)), clean)), 120)


def with_definition(df: DataFrame, line: str, out: str = "definition") -> DataFrame:
    """``df`` with struct(title, summary) of an English definition line, or null."""
    strip = lambda x: one_line(F.regexp_replace(x, "\\A[\"“”'‘’]+|[\"“”'‘’]+\\z", ""))
    ended = lambda x: one_line(F.regexp_replace(one_line(x), java(r"[.!?]\s*\z"), ""))
    text = F.col(line)
    form = F.when(has(text, lx.DEFINED_AS), 1).when(has(text, lx.REFERS_TO), 2).when(has(text, lx.IS_A), 3)
    part = lambda n: F.when(F.col("_form") == 1, group(text, lx.DEFINED_AS, n)).when(F.col("_form") == 2, group(text, lx.REFERS_TO, n)).when(F.col("_form") == 3, group(text, lx.IS_A, n))
    df = df.withColumn("_form", form).withColumn("_title", strip(part(1))).withColumn("_body", ended(part(2)))
    title, body = F.col("_title"), F.col("_body")
    subject = F.length(title).between(2, 80) & ~has(title, lx.SUBJECT_STOP) & ~has(title, lx.SUBJECT_VERB) & ~title.rlike(r"[,;:()\[\]{}]") & (F.size(F.split(title, " ")) <= 6)
    predicate = F.length(body).between(8, 260) & (has(body, lx.PREDICATE_NOUN) | has(body, r"\b[A-Za-z0-9_]+-[A-Za-z0-9_]+\b"))
    fits = subject & F.when(F.col("_form") == 3, predicate).otherwise(F.length(body) >= 8)
    return df.withColumn(out, F.when(fits, F.struct(title.alias("title"), body.alias("summary")))).drop("_form", "_title", "_body")


def quotation(line: Column | str) -> Column:
    """What the line quotes: straight, then curly, then corner quotes; null if none is long enough."""
    line = col(line)
    return F.coalesce(*[F.when(has(line, q), group(line, q, 1)) for q in lx.QUOTES])


def compact(text: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", "")


def near_duplicate(a: Column, b: Column) -> Column:
    a, b = compact(a), compact(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def tokens(text: Column | str) -> Column:
    """Tokens as an array, repeats included: no numbers, single ASCII characters or stop words."""
    parts = F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, is_token)


def is_token(t: Column) -> Column:
    return ~t.rlike(r"\A(?:[0-9]*|[a-z])\z") & ~t.isin(lx.STOP_WORDS)


#: What stands in each Greek or Hebrew run, abbreviation and hyphenation.
TERM_SIGNS = (r"\p{Greek}", r"\p{Hebrew}", "[A-Z][A-Z0-9]", "[A-Za-z]-[A-Za-z]")


def with_terms(df: DataFrame, text: Column | str, out: str = "terms") -> DataFrame:
    """``df`` with method terms, Greek and Hebrew runs, abbreviations and technical hyphenations of a text: unique without case, at most twelve."""
    df = df.withColumn("_t", col(text))
    # each kind is looked for only in texts that RE2 lets it be in
    whole = [rf"(?i)\b{t}\b" for t in lx.METHOD_TERMS]
    df = df.withColumn("_fixed", may_have("_t", *whole)).withColumns({f"_run{i}": seen("_t", one) for i, one in enumerate(TERM_SIGNS)})
    none = F.array().cast("array<string>")
    df = df.withColumn("_low", F.when(F.col("_fixed"), F.lower("_t")))
    fixed = F.when(F.col("_fixed"), F.array_compact(F.array(*[F.when(has(F.col("_t"), p, F.col("_low")), F.lit(t)) for p, t in zip(whole, lx.METHOD_TERMS)]))).otherwise(none)
    runs = [F.when(F.col(f"_run{i}"), F.regexp_extract_all("_t", F.lit(java(p)), F.lit(0))).otherwise(none) for i, p in enumerate((lx.GREEK, lx.HEBREW, lx.ABBREVIATION, lx.HYPHEN_TERM))]
    found = F.concat(fixed, *runs[:3], F.filter(runs[3], _technical))
    df = df.withColumn("_all", once(F.when(F.col("_t").isNotNull(), F.filter(found, lambda t: F.length(t).between(2, 80) & ~t.isin(lx.NOISY_ABBREVIATIONS)))))
    df = df.withColumn("_low", once(F.transform("_all", F.lower)))
    first = F.filter("_all", lambda t, i: F.array_position("_low", F.lower(t)) == i + 1)
    return df.withColumn(out, F.slice(first, 1, lx.MAX_TERMS)).drop("_t", "_fixed", *[f"_run{i}" for i in range(len(TERM_SIGNS))], "_all", "_low")


def _technical(term: Column) -> Column:
    t = F.lower(term)
    parts = F.split(t, "-")
    known = t.isin([m.lower() for m in lx.METHOD_TERMS]) | (F.forall(parts, lambda p: F.length(p) >= 3) & F.exists(parts, lambda p: p.isin(lx.HYPHEN_PARTS)))
    return ~t.isin(lx.NOISY_HYPHENS) & known


def person_name(title: Column | str) -> Column:
    """Two to five words, all of them names, initials or particles."""
    clean = F.regexp_replace(trimmed(col(title)), r"[,:;]+\z", "")
    words = F.transform(F.filter(F.split(clean, java(r"\s+")), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[.,:;]+\z", ""))
    particle = lambda w: F.lower(w).isin(lx.NAME_PARTICLES)
    initial = lambda w: w.rlike(r"\A[A-Z]\z")
    name = lambda w: w.rlike(r"\A[A-Z][a-zA-Z.'-]+\z") & ~particle(w)
    stop = lambda w: F.lower(w).isin(lx.PERSON_STOP_WORDS + lx.CONCEPT_WORDS)
    n = lambda test: F.size(F.filter(words, test))
    fits = F.forall(words, lambda w: particle(w) | (~stop(w) & (initial(w) | name(w))))
    return F.size(words).between(2, 5) & fits & ((n(name) >= 2) | ((n(name) >= 1) & ((n(initial) >= 1) | (n(particle) >= 1))))


def short_labels(text: Column | str) -> Column:
    """One to four non-blank lines, none over 150 characters."""
    kept = lines_of(text)
    return F.size(kept).between(1, 4) & F.forall(kept, lambda x: F.length(x) <= 150)


def lines_of(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "\r?\n"), trimmed), lambda x: x != "")


def with_structural_reason(df: DataFrame, type_: str, title: str, summary: Column, evidence: Column, out: str = "reason") -> DataFrame:
    """``df`` with the first rule that makes a candidate structure instead of knowledge, or null."""
    body = F.array_join(F.filter(F.array(F.coalesce(summary, F.lit("")), F.coalesce(evidence, F.lit(""))), lambda x: x != ""), "\n")
    df = df.withColumn("_title", trimmed(F.coalesce(F.col(title), F.lit("")))).withColumn("_body", body)
    df = df.withColumn("_all", F.array_join(F.filter(F.array("_title", "_body"), lambda x: x != ""), "\n"))
    # claims and noise are looked for only in texts that RE2 lets them be in, all else only in silent ones
    df = df.withColumn("_claiming", may_have("_all", *CLAIMS)).withColumn("_noisy", may_have("_all", *NOISE))
    df = df.withColumn("_silent", F.when(F.col("_claiming"), claim_count("_all") == 0).otherwise(True))
    df = df.withColumn("_title", F.when(F.col("_silent"), F.col("_title"))).withColumn("_body", F.when(F.col("_silent"), F.col("_body")))
    df = df.withColumn("_noise", F.when(F.col("_silent") & F.col("_noisy"), demoted("_all")).otherwise(False)).withColumn("_lines", lines_of("_body"))
    df = df.withColumn("_labels", short_labels(F.when(F.col("_body") == "", F.col("_title")).otherwise(F.col("_body")))).withColumn("_person", person_name("_title"))
    head = F.coalesce(F.get("_lines", F.lit(0)), F.lit(""))
    caps = (F.size("_lines") > 0) & F.forall(F.slice("_lines", 1, 4), lambda x: has(x, lx.CAPS_NAMES))
    quoted, silent = F.col(type_) == "quotation", F.col("_silent")
    alike = caps | near_duplicate(F.col("_title"), F.col("_body")) | short_labels("_body")
    reason = (
        F.when(silent & F.col("_noise"), "demoted")
        .when(silent & F.col("_noisy") & has(F.col("_all"), lx.CITATION), "citation")
        .when(silent & quoted & F.length(compact("_title")).between(1, 31) & F.col("_labels"), "short_quotation")
        .when(silent & quoted, "quotation_only")
        .when(silent & (has(F.col("_title"), lx.SECTION_MARKER) | has(head, lx.SECTION_MARKER)) & F.col("_labels"), "section_marker")
        .when(silent & ~quoted & F.col("_person") & alike, "person_name")
    )
    return df.withColumn(out, reason).drop("_title", "_body", "_all", "_claiming", "_noisy", "_silent", "_noise", "_lines", "_labels", "_person")
