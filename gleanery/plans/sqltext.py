"""Pieces of oracle SQL (DuckDB)."""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions.rx import re2
from ..sources import views


def with_views(*names: str) -> str:
    """``with`` clauses for input views; DuckDB spells string types otherwise."""
    return ", ".join(f"{n} as ({getattr(views, n.upper()).replace(' as string)', ' as varchar)')})" for n in names)


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{re2(pattern)}')"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{re2(pattern)}'))"


def group(text: str, pattern: str, n: int) -> str:
    return f"regexp_extract({text}, '{re2(pattern)}', {n})"


def replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{re2(pattern)}', '{by}', 'g')"


def one_line(text: str) -> str:
    return f"trim({replace(text, chr(92) + 's+', ' ')})"


def trimmed(text: str) -> str:
    return replace(text, r"\A\s+|\s+\z")


def claims(text: str) -> str:
    return f"({count(text, lx.CLAIM_EN)} - " + " - ".join(count(text, g) for g in lx.CLAIM_GUARDS) + f" + {count(text, lx.CLAIM_KO)})"


def demotions(text: str) -> dict[str, str]:
    return {k: "(" + " or ".join(has(text, p) for p in ps) + ")" for k, ps in lx.DEMOTIONS.items()}


def demoted(text: str) -> str:
    return "(" + " or ".join(demotions(text).values()) + ")"


def prose_type(clean: str) -> str:
    """Of a text that is one line already."""
    n = f"length({clean})"
    return f"""case when {n} < 35 or {n} > 900 then null when {demoted(clean)} and {claims(clean)} = 0 then null
      when {n} < 80 then case when {has(clean, lx.ARGUMENT_AGENT)} then 'argument' when {has(clean, lx.METHOD_AGENT)} then 'method' end
      when {has(clean, lx.OBJECTION_CUE)} then 'objection' when {has(clean, lx.ARGUMENT_AGENT)} then 'argument'
      when {has(clean, lx.METHOD_CUE)} or {has(clean, lx.BOUNDARY_CUE)} then 'method'
      when {claims(clean)} > 0 or {has(clean, lx.ARGUMENT_CUE)} then 'argument' end"""


def lines(table: str) -> str:
    """source_id, ln, line, begin, stop of a table (source_id, text)."""
    return f"""(select source_id, ln, line, cast(coalesce(sum(length(line) + 1) over (partition by source_id order by ln rows between unbounded preceding and 1 preceding), 0) as bigint) as begin,
      cast(coalesce(sum(length(line) + 1) over (partition by source_id order by ln rows between unbounded preceding and 1 preceding), 0) + length(line) as bigint) as stop
      from (select source_id, cast(i - 1 as int) as ln, l[i] as line from (select source_id, string_split(text, chr(10)) as l from {table}) a, unnest(range(1, len(l) + 1)) as u(i)) b)"""


def clean_evidence(text: str) -> str:
    kept = f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {trimmed('regexp_replace(x, ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), lambda x: x <> ''), chr(10))"
    return f"(select case when length(k) > 900 then concat(substr(k, 1, 899), '…') else k end from (select {kept} as k))"


def tokens(text: str) -> str:
    """The distinct tokens of a text, as a list."""
    stop = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\pL\\pN]+'), lambda t: not regexp_full_match(t, '[0-9]*|[a-z]') and t not in ({stop})))"


def compact(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^\\pL\\pN]+', '', 'g')"
