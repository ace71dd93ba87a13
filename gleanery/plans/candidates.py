"""Queries: line rules, candidates, and their merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import segment as sg
from . import segments as sgp
from . import sqltext as q


def definition_lines(spark, sf_dir):
    lines = tx.only(tx.with_definition(sg.lines(sgp.cue_docs(spark, sf_dir)), "line", "d"), F.col("d").isNotNull())
    return lines.select("source_id", "ln", "d.title", F.md5("d.summary").alias("summary_md5"))


def quotation_lines(spark, sf_dir):
    lines = tx.only(sg.lines(sgp.cue_docs(spark, sf_dir)).withColumn("quote", tx.quotation("line")), F.col("quote").isNotNull())
    return lines.select("source_id", "ln", "quote")


def original_terms(spark, sf_dir):
    docs = tx.with_terms(sgp.cue_docs(spark, sf_dir), "text")
    return docs.select("source_id", F.array_join(F.array_sort(F.transform("terms", F.lower)), ",").alias("terms"), F.size("terms").cast("long").alias("n_terms"))


def candidates(spark, sf_dir):
    found = cd.plain_candidates(sgp.cue_docs(spark, sf_dir))
    return found.select("candidate_id", "source_id", "type", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), "begin", "stop", F.array_join("refs", ",").alias("refs"), F.md5("evidence_text").alias("evidence_md5"))


def candidate_dedup(spark, sf_dir):
    """Candidates of a text and of the same text after it: the second half's repeat the first's."""
    docs = sgp.cue_docs(spark, sf_dir)
    twice = docs.withColumn("text", F.concat("text", F.lit("\n\n"), "text"))
    merged = cd.deduplicated(cd.plain_candidates(twice))
    return merged.select("source_id", "type", F.md5(F.lower("title")).alias("title_md5"), F.size("refs").cast("long").alias("n_refs"), F.get("refs", F.lit(0)).alias("first_ref"), "begin")


def md_candidates(spark, sf_dir):
    found = cd.markdown_candidates(sgp.md_docs(spark, sf_dir))
    return found.select("candidate_id", "source_id", "type", F.md5("title").alias("title_md5"), F.md5("summary").alias("summary_md5"), "begin", "stop", F.size("refs").cast("long").alias("n_refs"))


def schema_conformance(spark, sf_dir):
    checked = cd.violations(cd.plain_candidates(sgp.cue_docs(spark, sf_dir)))
    return checked.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.size("violations") == 0).alias("n_valid"))


QUERIES = {f.__name__: f for f in (definition_lines, quotation_lines, original_terms, candidates, candidate_dedup, md_candidates, schema_conformance)}


def _strip(x: str) -> str:
    return q.one_line(f"regexp_replace({x}, '^[\"“”''‘’]+|[\"“”''‘’]+$', '', 'g')")


def _ended(x: str) -> str:
    return q.one_line(q.replace(q.one_line(x), r"[.!?]\s*\z"))


def _subject(t: str) -> str:
    return f"(length({t}) between 2 and 80 and not {q.has(t, lx.SUBJECT_STOP)} and not {q.has(t, lx.SUBJECT_VERB)} and not regexp_matches({t}, '[,;:()\\[\\]{{}}]') and len(string_split({t}, ' ')) <= 6)".replace("{{", "{").replace("}}", "}")


def definitions(lines: str) -> str:
    """source_id, ln, title, summary of the definition lines of a relation (source_id, ln, line, ...)."""
    return f"""(select *, case when explicit and {_subject('et')} and length(eb) >= 8 then et when not explicit and is_a and {_subject('it')} and length(ib) between 8 and 260
        and ({q.has('ib', lx.PREDICATE_NOUN)} or {q.has('ib', chr(92) + 'b[A-Za-z0-9_]+-[A-Za-z0-9_]+' + chr(92) + 'b')}) then it end as d_title, case when explicit then eb else ib end as d_summary
      from (select *, das or ref as explicit, {_strip(f"case when das then {q.group('line', lx.DEFINED_AS, 1)} else {q.group('line', lx.REFERS_TO, 1)} end")} as et,
          {_ended(f"case when das then {q.group('line', lx.DEFINED_AS, 2)} else {q.group('line', lx.REFERS_TO, 2)} end")} as eb, {_strip(q.group('line', lx.IS_A, 1))} as it, {_ended(q.group('line', lx.IS_A, 2))} as ib
        from (select *, {q.has('line', lx.DEFINED_AS)} as das, {q.has('line', lx.REFERS_TO)} as ref, {q.has('line', lx.IS_A)} as is_a from {lines}) a) b)"""


QUOTE = "case " + " ".join(f"when {q.has('line', p)} then {q.group('line', p, 1)}" for p in lx.QUOTES) + " end"


def truncated(clean: str, n: int) -> str:
    return f"case when length({clean}) > {n} then concat(substr({clean}, 1, {n - 1}), '…') else {clean} end"


def title_sql(clean: str) -> str:
    sentence = q.group(clean, lx.SENTENCE_HEAD, 0)
    t = f"case when {sentence} = '' then {clean} else {sentence} end"
    for p in lx.TITLE_DROPS:
        t = q.replace(t, p)
    return f"(select case when length(t) <= 120 then t when strpos(reverse(substr(t, 1, 121)), ' ') > 0 and 121 - strpos(reverse(substr(t, 1, 121)), ' ') >= 78 then trim(substr(t, 1, 121 - strpos(reverse(substr(t, 1, 121)), ' '))) else trim(substr(t, 1, 120)) end from (select {q.one_line(t)} as t))"


def plain_sql(docs: str) -> str:
    """``with`` clauses up to ``candr``, the candidates of a table (source_id, text), and ``cand``, with repeated ones merged."""
    concept, ko = q.group("line", lx.CONCEPT_LINE, 1), lx.KO_DEFINITION
    return f"""lr as (select *, {q.has('line', lx.CONCEPT_LINE)} as is_c, {q.has('line', ko)} as is_k, {q.trimmed(f"string_split_regex({concept}, '[—–-]|:')[1]")} as c_head, {q.trimmed(concept)} as c_body, {QUOTE} as quote,
    lag({q.trimmed('line')}) over (partition by source_id order by ln) as pl, lead({q.trimmed('line')}) over (partition by source_id order by ln) as nl from {definitions(q.lines(docs) + ' l')} x),
  rl as (select *, case when is_c or is_k or d_title is not null then 'concept' when quote is not null then 'quotation' end as rtype,
    substr(case when is_c then case when c_head = '' then c_body else c_head end when is_k then {q.trimmed(q.group('line', ko, 1))} when d_title is not null then d_title else {q.trimmed('quote')} end, 1, 80) as rtitle,
    substr(case when is_c then c_body when is_k then {q.trimmed(q.group('line', ko, 2))} when d_title is not null then d_summary else {q.trimmed('quote')} end, 1, 240) as rsummary from lr),
  ap as (select *, rtype is not null or {q.trimmed('line')} = '' or (length({q.trimmed('line')}) < 80 and {q.demoted(q.trimmed('line'))}) as apart, {q.has(q.trimmed('line'), lx.SENTENCE_END)} as ends from rl),
  isl as (select *, sum(case when apart or coalesce(pe, false) then 1 else 0 end) over (partition by source_id order by ln) as island from (select *, lag(ends) over (partition by source_id order by ln) as pe from ap) y),
  pb as (select source_id, min(ln) as fl, max(ln) as ll, min(begin) as begin, max(stop) as stop, string_agg(line, chr(10) order by ln) as raw from isl where not apart group by source_id, island),
  pt as (select *, {q.one_line('raw')} as clean from pb),
  pc as (select *, {q.prose_type('clean')} as type from pt),
  cand0 as (select source_id, rtype as type, rtitle as title, rsummary as summary, begin, stop, concat(source_id, '#line-', ln + 1) as refs, case when rtype = 'concept' then line else
      regexp_replace(concat_ws(chr(10), case when length(pl) between 1 and 260 then pl end, {q.trimmed('line')}, case when length(nl) between 1 and 260 then nl end), '[ \\t]+', ' ', 'g') end as ev, rtype = 'concept' as whole from rl where rtype is not null
    union all select source_id, type, {title_sql('clean')}, {truncated('clean', 300)}, begin, stop, case when fl = ll then concat(source_id, '#line-', fl + 1) else concat(source_id, '#lines-', fl + 1, '-', ll + 1) end,
      array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: {q.trimmed("regexp_replace(x, '[ " + chr(92) + "t]+', ' ', 'g')")}), lambda x: x <> ''), chr(10)), false from pc where type is not null),
  candr as (select substr(sha256(concat(source_id, ':', type, ':', begin, ':', stop)), 1, 16) as candidate_id, source_id, type, title, summary, begin, stop, refs, case when not whole and length(ev) > 900 then concat(substr(ev, 1, 899), '…') else ev end as evidence_text from cand0),
  candl as (select *, first_value(candidate_id) over same as lead_id, row_number() over same as no from candr window same as (partition by source_id, type, lower({q.one_line('title')}), lower({q.one_line('summary')}) order by begin, stop, candidate_id)),
  candg as (select lead_id, string_agg(refs, ',' order by k) as refs, count(*) as n_refs from (select lead_id, refs, min(no) as k from candl group by 1, 2 qualify row_number() over (partition by lead_id order by min(no)) <= 12) z group by 1),
  cand as (select candidate_id, source_id, type, title, summary, begin, stop, g.refs, evidence_text, n_refs from candl l join candg g on g.lead_id = l.candidate_id where no = 1)"""


def markdown_sql() -> str:
    """``with`` clauses up to ``mz``, the candidates of Markdown sources, repeated ones merged."""
    concept = r"(?i)\A(?:(?:Concept|Definition)\b|(?:개념|정의)\B)"  # CONCEPT_HEADING without its lookahead
    ref = lambda n: f"concat(source_id, '#md-block-', {n})"
    return f"""with {q.with_views('md_docs')}, {sgp._MD_BLOCKS},
  ma as (select source_id, k3 as kind, min(ln) as ln, min(begin) as begin, max(stop) as stop, string_agg(line, chr(10) order by ln) as raw from t group by source_id, island, k3),
  mb as (select *, row_number() over (partition by source_id order by ln) - 1 as no, case when kind = 'paragraph' then regexp_replace(regexp_replace(raw, '\\*\\*|__', '', 'g'), '[*_]', '', 'g') else raw end as plain from ma),
  mc as (select *, first_value(case when kind = 'paragraph' then struct_pack(no := no, stop := stop, plain := plain, raw := raw) end ignore nulls) over (partition by source_id order by ln rows between 1 following and unbounded following) as nx,
    {q.trimmed(f"regexp_replace(raw, '^#{{1,6}}{chr(92)}s+', '')")} as heading, {q.group('raw', lx.BOLD_DEFINITION, 1)} as bold, {q.one_line(q.group('raw', lx.BOLD_DEFINITION, 2))} as clean, {q.one_line('plain')} as whole, {q.trimmed(f"regexp_replace(raw, '(?m)^>{chr(92)}s?', '', 'g')")} as quote from mb),
  md as (select *, regexp_matches(heading, '{concept}') as is_concept, {q.trimmed(f"regexp_replace(regexp_replace(heading, '{concept}', ''), '^[{chr(92)}s:—–-]+', '')")} as name, {q.trimmed(q.group('clean', lx.BOLD_SENTENCE, 1))} as first, {q.one_line(q.group('clean', lx.BOLD_SENTENCE, 2))} as rest from mc),
  me as (select *, {q.prose_type('rest')} as rest_type, {q.prose_type('whole')} as whole_type from md),
  mf as (select *, case when rest_type is not null then {q.one_line('first')} else clean end as lead from me),
  mg as (select source_id, 'concept' as type, case when name = '' then heading else name end as title, coalesce(substr(replace(nx.plain, chr(10), ' '), 1, 240), heading) as summary, begin, coalesce(nx.stop, stop) as stop, case when nx is null then [{ref('no')}] else [{ref('no')}, {ref('nx.no')}] end as refs from mf where kind = 'heading' and is_concept
    union all select source_id, 'concept', {q.trimmed('bold')}, {truncated('lead', 240)}, begin, stop, [{ref('no')}] from mf where kind = 'paragraph' and bold <> ''
    union all select source_id, rest_type, {title_sql('rest')}, {truncated('rest', 300)}, begin, stop, [{ref('no')}] from mf where kind = 'paragraph' and bold <> '' and rest_type is not null
    union all select source_id, whole_type, {title_sql('whole')}, {truncated('whole', 300)}, begin, stop, [{ref('no')}] from mf where kind = 'paragraph' and bold = '' and whole_type is not null
    union all select source_id, 'quotation', substr(string_split(quote, chr(10))[1], 1, 80), case when length(quote) > 240 then concat(substr(quote, 1, 237), '…') else quote end, begin, stop, [{ref('no')}] from mf where kind = 'blockquote' and length(quote) >= 8),
  mh as (select *, substr(sha256(concat(source_id, ':', type, ':', begin, ':', stop)), 1, 16) as candidate_id, lower({q.one_line('title')}) as kt, lower({q.one_line('summary')}) as ks from mg),
  my as (select *, row_number() over same as nth, list(refs) over (partition by source_id, type, kt, ks) as all_refs from mh window same as (partition by source_id, type, kt, ks order by begin, stop, candidate_id)),
  mz as (select candidate_id, source_id, type, title, summary, begin, stop, cast(least(len(list_distinct(flatten(all_refs))), 12) as bigint) as n_refs from my where nth = 1)"""


def _all(p: str) -> str:
    return f"regexp_extract_all(text, '{q.re2(p)}')"


_TERMS = (
    "list_filter([" + ", ".join(f"case when {q.has('text', f'(?i){chr(92)}b{t}{chr(92)}b')} then '{t}' end" for t in lx.METHOD_TERMS) + "], lambda t: t is not null)"
)
_TECH = ", ".join(f"'{m.lower()}'" for m in lx.METHOD_TERMS)
_PARTS = ", ".join(f"'{m}'" for m in lx.HYPHEN_PARTS)
_NOISE_H = ", ".join(f"'{m}'" for m in lx.NOISY_HYPHENS)
_NOISE_A = ", ".join(f"'{m}'" for m in lx.NOISY_ABBREVIATIONS)
_W = f"with {q.with_views('cue_docs')}"

ORACLES = {
    "definition_lines": f"{_W} select source_id, ln, d_title as title, md5(d_summary) as summary_md5 from {definitions(q.lines('cue_docs') + ' l')} x where d_title is not null",
    "quotation_lines": f"{_W} select source_id, ln, {QUOTE} as quote from {q.lines('cue_docs')} l where {QUOTE} is not null",
    "original_terms": f"""{_W}, a as (select source_id, list_concat({_TERMS}, {_all(lx.GREEK)}, {_all(lx.HEBREW)}, {_all(lx.ABBREVIATION)},
        list_filter({_all(lx.HYPHEN_TERM)}, lambda t: lower(t) not in ({_NOISE_H}) and (lower(t) in ({_TECH}) or (len(list_filter(string_split(lower(t), '-'), lambda p: length(p) < 3)) = 0 and len(list_filter(string_split(lower(t), '-'), lambda p: p in ({_PARTS}))) > 0)))) as terms from cue_docs),
      e as (select source_id, i, lower(terms[i]) as term from (select source_id, list_filter(terms, lambda t: length(t) between 2 and 80 and t not in ({_NOISE_A})) as terms from a) b, unnest(range(1, len(terms) + 1)) as u(i)),
      f as (select source_id, term, min(i) as i from e group by 1, 2), g as (select * from f qualify row_number() over (partition by source_id order by i) <= 12)
      select d.source_id, coalesce(string_agg(term, ',' order by term), '') as terms, count(term) as n_terms from cue_docs d left join g on g.source_id = d.source_id group by 1""",
    "candidates": f"{_W}, {plain_sql('cue_docs')} select candidate_id, source_id, type, md5(title) as title_md5, md5(summary) as summary_md5, begin, stop, refs, md5(evidence_text) as evidence_md5 from cand",
    "md_candidates": f"""{markdown_sql()} select candidate_id, source_id, type, md5(title) as title_md5, md5(summary) as summary_md5, begin, stop, n_refs from mz""",
    "candidate_dedup": f"""{_W}, twice as (select source_id, concat(text, chr(10), chr(10), text) as text from cue_docs), {plain_sql('twice')}
      select source_id, type, md5(lower(arg_min(title, begin))) as title_md5, least(count(distinct refs), 12) as n_refs, arg_min(refs, begin) as first_ref, min(begin) as begin from candr group by source_id, type, lower({q.one_line('title')}), lower({q.one_line('summary')})""",
    "schema_conformance": f"{_W}, {plain_sql('cue_docs')} select source_id, count(*) as n, count(*) filter (where length(title) > 0 and length(summary) > 0 and length(refs) > 0 and begin >= 0 and stop >= begin and length(evidence_text) > 0) as n_valid from cand group by 1",
}
