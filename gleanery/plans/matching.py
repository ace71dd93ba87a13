"""Queries: tokens, similarity joins, span joins, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import matching as mt
from ..operators import scoring as sc
from ..operators import segment as sg
from ..sources import views
from ..sources.store import persisted
from . import candidates as cdp
from . import segments as sgp
from . import sqltext as q


def parts(spark, sf_dir):
    """Candidates and chunks of the cue documents, the existing entries, and their titles as outline."""
    docs = sgp.cue_docs(spark, sf_dir)
    return persisted(cd.plain_candidates(docs)), sg.chunks(docs), views.view(spark, sf_dir, views.EXISTING)


def nodes(entries):
    return entries.select(F.concat(F.lit("n"), F.col("ord")).alias("node_id"), "ord", F.col("title").alias("text"))


def token_table(spark, sf_dir):
    rows = mt.token_rows(sgp.cue_docs(spark, sf_dir).select(F.col("source_id").alias("id"), "text"))
    return rows.groupBy("token").agg(F.count("*").alias("n_docs"))


def synonym_expand(spark, sf_dir):
    rows = mt.token_rows(sgp.cue_docs(spark, sf_dir).select(F.col("source_id").alias("id"), "text"))
    return mt.expanded(rows, mt.synonyms(spark), 2).groupBy("id").agg(F.count("*").alias("n_tokens"))


def candidate_chunk_join(spark, sf_dir):
    found, chunks, _ = parts(spark, sf_dir)
    return mt.anchored(found, chunks).select("candidate_id", "source_id", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "how")


def chunk_neighbours(spark, sf_dir):
    found, chunks, _ = parts(spark, sf_dir)
    return mt.neighbours(found, chunks).select("candidate_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def jaccard_best_entry(spark, sf_dir):
    found, _, entries = parts(spark, sf_dir)
    return mt.best_entry(found, entries, mt.synonyms(spark)).select("candidate_id", F.coalesce("target", F.lit("")).alias("target"), F.round("sim", 6).alias("sim"))


def bigram_outline_map(spark, sf_dir):
    found, _, entries = parts(spark, sf_dir)
    asked = found.select(F.col("candidate_id").alias("id"), F.col("title").alias("primary"), F.col("summary").alias("context"))
    return mt.best_node(asked, nodes(entries), mt.synonyms(spark)).select(F.col("id").alias("candidate_id"), F.coalesce("node_id", F.lit("")).alias("node_id"), F.round("score", 6).alias("score"))


def schema_fit(spark, sf_dir):
    found, _, entries = parts(spark, sf_dir)
    return mt.schema_fit(found, entries.select(F.col("title").alias("text")), mt.synonyms(spark)).select("candidate_id", F.col("n_matched").cast("long").alias("n_matched"))


def structural_reasons(spark, sf_dir):
    found = cd.plain_candidates(sgp.cue_docs(spark, sf_dir))  # one branch reads them: no intermediate table
    judged = tx.with_structural_reason(found, "type", "title", F.col("summary"), F.col("evidence_text"))
    return judged.select("candidate_id", F.coalesce("reason", F.lit("")).alias("reason"))


def _scored(spark, sf_dir):
    return scored_of(spark, *parts(spark, sf_dir))


def scored_of(spark, found, chunks, entries):
    return sc.scored(found, chunks, entries.select(F.col("title").alias("text")), entries, mt.synonyms(spark))


def scored_candidates(spark, sf_dir):
    subs = [F.col(c).cast("long").alias(c) for c in ("schema_fit", "claim_strength", "evidence_quality", "reusability", "novelty", "boundary", "penalty", "total")]
    return _scored(spark, sf_dir).select("candidate_id", "type", *subs, "action", F.coalesce("target", F.lit("")).alias("target"))


def action_tally(spark, sf_dir):
    """Candidates by type, by action, and by both, in one pass."""
    rows = _scored(spark, sf_dir).groupingSets([["type"], ["action"], ["type", "action"]], "type", "action").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("action", F.lit("all")).alias("action"), "n")


def card_groups(spark, sf_dir):
    """Cards by the outline node that their words fit best (0.24 for any shared keyword), with the range of their places."""
    found, _, entries = parts(spark, sf_dir)
    words = F.concat_ws("\n", "title", "summary", "evidence_text", F.array_join("original_terms", "\n"))
    best = mt.best_group(found.select(F.col("candidate_id").alias("id"), words.alias("text")), nodes(entries), mt.synonyms(spark))
    joined = found.join(best, F.col("candidate_id") == F.col("id"), "left")
    return joined.groupBy(F.coalesce("ord", F.lit(9999)).alias("node_ord")).agg(F.count("*").alias("n_cards"), F.min("begin").alias("first_begin"), F.max("begin").alias("last_begin"))


QUERIES = {f.__name__: f for f in (token_table, synonym_expand, candidate_chunk_join, chunk_neighbours, jaccard_best_entry, bigram_outline_map, schema_fit, structural_reasons, scored_candidates, action_tally, card_groups)}

_SYN = "syn as (select * from (values " + ", ".join(f"('{k}', '{s}')" for k, v in lx.SYNONYMS.items() for s in v.split(", ")) + ") v(token, synonym))"
_BASE = f"with recursive {q.with_views('cue_docs', 'existing')}, {_SYN}"
_TERMS = cdp.ORACLES["original_terms"].split(", a as (select source_id, list_concat(")[1].split(") as terms from cue_docs)")[0]


_STRIPPED = "regexp_replace(title, '^[\\s\"''“”‘’.,;:()\\[\\]{}]+|[\\s\"''“”‘’.,;:()\\[\\]{}]+$', '', 'g')"
#: Candidates with their original terms as one string ``terms``.
_CAND = f"""{cdp.plain_sql('cue_docs')},
  ct as (select candidate_id, source_id, type, title, summary, begin, stop, refs, evidence_text, {q.one_line(_STRIPPED)} as tt,
    (select string_agg(l.line, chr(10) order by l.ln) from {q.lines('cue_docs')} l where l.source_id = candr.source_id and l.begin >= candr.begin and l.stop <= candr.stop) as source_text from candr),
  ta as (select *, concat(title, chr(10), summary, chr(10), source_text) as text from ct),
  tb as (select * exclude (text), text, list_concat({_TERMS}) as raw_terms from ta),
  tc as (select candidate_id, i, raw_terms[i] as term from (select candidate_id, list_filter(raw_terms, lambda t: length(t) between 2 and 80 and t not in ({cdp._NOISE_A})) as raw_terms from tb) a, unnest(range(1, len(raw_terms) + 1)) as u(i)),
  td as (select candidate_id, arg_min(term, i) as term, min(i) as i from tc group by candidate_id, lower(term) qualify row_number() over (partition by candidate_id order by min(i)) <= 12),
  te as (select candidate_id, term, i from td union all select candidate_id, tt, 0 from ct where type = 'concept' and length(tt) between 2 and 80 and len(string_split(tt, ' ')) <= 6 and not {q.demoted('tt')}),
  tf as (select candidate_id, term, min(i) as i from te group by 1, 2 qualify row_number() over (partition by candidate_id order by min(i)) <= 12),
  tg as (select lead_id as candidate_id, term, min(no * 1000000 + i) as i from tf join candl using (candidate_id) group by 1, 2 qualify row_number() over (partition by lead_id order by min(no * 1000000 + i)) <= 12),
  c1 as (select cand.candidate_id, source_id, type, title, summary, begin, stop, refs, n_refs, evidence_text, coalesce(string_agg(term, ' ' order by i), '') as terms from cand left join tg on tg.candidate_id = cand.candidate_id group by all)"""


def _tok(name: str, table: str, key: str, text: str, hops: int = 0) -> str:
    out = f"{name}_0 as (select {key} as id, unnest({q.tokens(text)}) as token from {table})"
    for h in range(hops):
        out += f", {name}_{h + 1} as (select id, token from {name}_{h} union select id, synonym from {name}_{h} join syn using (token))"
    return out + f", {name} as (select distinct id, token from {name}_{hops})"


def _pairs(name: str, a: str, b: str, sim: str) -> str:
    return f"{name} as (select l, r, {sim} as sim from (select x.id as l, y.id as r, count(*) as n_both from {a} x join {b} y using (token) group by 1, 2) p join (select id as l, count(*) as nl from {a} group by 1) using (l) join (select id as r, count(*) as nr from {b} group by 1) using (r))"


_J = "cast(n_both as double) / (nl + nr - n_both)"
_BEST = f"""{_tok('en', 'existing', 'ord', "concat_ws(' ', title, tags, original_terms, related, summary)", 1)}, {_tok('et', 'existing', 'ord', "concat_ws(' ', title, tags, original_terms, related)")}, {_tok('ca', 'c1', 'candidate_id', "concat_ws(' ', title, summary, terms)", 1)}, {_tok('cb', 'c1', 'candidate_id', 'terms', 1)}, {_tok('cc', 'c1', 'candidate_id', "concat_ws(' ', title, terms)")},
  {_pairs('m1', 'ca', 'en', _J)}, {_pairs('m2', 'cb', 'en', _J)}, {_pairs('m3', 'cc', 'et', "case when n_both = 1 then 0.25 else cast(n_both as double) / least(nl, nr) end")},
  mm as (select * from m1 union all select * from m2 union all select * from m3), mb as (select l, r, sim from mm qualify row_number() over (partition by l order by sim desc, r) = 1),
  be as (select c1.candidate_id, coalesce(e.id, '') as target, coalesce(sim, 0.0) as sim from c1 left join mb on l = candidate_id and sim >= {lx.SIM_LINK} left join existing e on e.ord = r)"""
_FIT = f"""{_tok('kw', 'existing', '0', 'title', 2)}, {_tok('hy', 'c1', 'candidate_id', "concat_ws(chr(10), title, summary, evidence_text, terms)")}, sf as (select c1.candidate_id, count(k.token) as n_matched from c1 left join hy on hy.id = c1.candidate_id left join (select distinct token from kw) k on k.token = hy.token group by 1)"""
_ANCHOR = f"""{sgp._CHUNKS}, an as (select d.candidate_id, d.source_id, c.chunk_id, c.ord, length({q.trimmed('c.text')}) as n_text, d.begin < c.begin or d.begin >= c.stop as later from c1 d join c on c.source_id = d.source_id and d.begin < c.stop and d.stop > c.begin or c.source_id = d.source_id and d.begin >= c.begin and d.begin < c.stop
    qualify row_number() over (partition by d.candidate_id order by d.begin < c.begin or d.begin >= c.stop, c.ord) = 1)"""


_WORDS_OF = "concat_ws(chr(10), title, summary, evidence_text, terms)"
_GROUPS = f"""{_tok('gw', 'c1', 'candidate_id', _WORDS_OF)}, {_tok('gx', 'c1', 'candidate_id', _WORDS_OF, 1)}, {_tok('gn', 'existing', 'ord', 'title', 1)}, {_pairs('g1', 'gx', 'gn', _J)}, {_pairs('g2', 'gw', 'gn', '0.24')},
  gb as (select l, r from (select * from g1 union all select * from g2) where sim >= {lx.OUTLINE_LEAST} qualify row_number() over (partition by l order by sim desc, r) = 1)"""


def _labels(t: str) -> str:
    ls = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {q.trimmed('x')}), lambda x: x <> '')"
    return f"(len({ls}) between 1 and 4 and len(list_filter({ls}, lambda x: length(x) > 150)) = 0)"


_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_WORDS = f"list_transform(list_filter(string_split_regex(regexp_replace(t, '[,:;]+$', ''), '{q.re2(chr(92) + 's+')}'), lambda w: w <> ''), lambda w: regexp_replace(w, '[.,:;]+$', ''))"
_REASON = f"""ra as (select *, {q.trimmed('title')} as t, array_to_string(list_filter([summary, evidence_text], lambda x: x <> ''), chr(10)) as body from c1),
  rb as (select *, array_to_string(list_filter([t, body], lambda x: x <> ''), chr(10)) as combined, {_WORDS} as ws, list_filter(list_transform(string_split(body, chr(10)), lambda x: {q.trimmed('x')}), lambda x: x <> '') as bl from ra),
  rc as (select *, {q.claims('combined')} = 0 as silent, {q.demoted('combined')} as noise, {_labels("case when body = '' then t else body end")} as labels,
    len(list_filter(ws, lambda w: lower(w) in ({_IN(lx.NAME_PARTICLES)}))) as np, len(list_filter(ws, lambda w: regexp_full_match(w, '[A-Z]'))) as ni,
    len(list_filter(ws, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z.''-]+') and lower(w) not in ({_IN(lx.NAME_PARTICLES)}))) as nn,
    len(list_filter(ws, lambda w: lower(w) in ({_IN(lx.PERSON_STOP_WORDS + lx.CONCEPT_WORDS)}))) as ns from rb),
  rs as (select candidate_id, case when silent and noise then 'demoted' when silent and {q.has('combined', lx.CITATION)} then 'citation'
    when silent and type = 'quotation' and length({q.compact('t')}) between 1 and 31 and labels then 'short_quotation' when silent and type = 'quotation' then 'quotation_only'
    when silent and labels and ({q.has('t', lx.SECTION_MARKER)} or {q.has("coalesce(bl[1], '')", lx.SECTION_MARKER)}) then 'section_marker'
    when silent and type <> 'quotation' and len(ws) between 2 and 5 and np + ni + nn = len(ws) and ns = 0 and (nn >= 2 or (nn >= 1 and (ni >= 1 or np >= 1)))
      and ((len(bl) > 0 and len(list_filter(bl[1:4], lambda x: not {q.has('x', lx.CAPS_NAMES)})) = 0) or ({q.compact('t')} <> '' and {q.compact('body')} <> '' and (contains({q.compact('t')}, {q.compact('body')}) or contains({q.compact('body')}, {q.compact('t')}))) or {_labels('body')}) then 'person_name' end as reason from rc)"""
_SCORED = f"""{_BASE}, {_CAND}, {_BEST}, {_FIT}, {_ANCHOR}, {_REASON},
  sa as (select d.candidate_id, type, reason, sim, target, concat_ws(chr(10), title, summary, evidence_text) as hay, least(n_matched, 3) as schema_fit, coalesce(not later, false) as held, coalesce(not later, false) and n_text >= 200 as long_text, n_refs >= 2 as many, title from c1 d join be using (candidate_id) join sf using (candidate_id) join rs using (candidate_id) left join an using (candidate_id)),
  sb as (select candidate_id, type, reason, sim, target, schema_fit, least({q.claims('hay')}, 3) as claim_strength, least(held::int + long_text::int + many::int, 3) as evidence_quality,
    (type in ('concept', 'argument', 'method', 'objection'))::int + (length({q.trimmed('title')}) >= 6)::int as reusability, case when sim >= 0.5 then 0 when sim >= 0.2 then 1 else 2 end as novelty,
    least({q.has('hay', lx.BOUNDARY_SCORE_CUE)}::int + 1 + (type = 'quotation')::int, 3) as boundary, {' + '.join(f'{s}::int' for s in q.demotions('hay').values())} as kinds from sa),
  sd as (select *, case when reason is not null then -99 else -3 * kinds end as penalty from sb),
  se as (select *, schema_fit + claim_strength + evidence_quality + reusability + novelty + boundary + penalty as total from sd),
  sg as (select *, case when kinds > 0 or reason is not null or total <= 1 then 'ignore' when sim >= 0.5 then 'update_existing' when sim >= 0.2 then 'link_only' else 'create_new' end as action from se)"""

ORACLES = {
    "token_table": f"with {q.with_views('cue_docs')} select token, count(*) as n_docs from (select source_id, unnest({q.tokens('text')}) as token from cue_docs) x group by 1",
    "synonym_expand": f"with {q.with_views('cue_docs')}, {_SYN}, {_tok('t', 'cue_docs', 'source_id', 'text', 2)} select id, count(*) as n_tokens from t group by 1",
    "candidate_chunk_join": f"{_BASE}, {_CAND}, {_ANCHOR} select c1.candidate_id, c1.source_id, coalesce(chunk_id, '') as chunk_id, case when later then 'overlap' when not later then 'inside' else 'none' end as how from c1 left join an using (candidate_id)",
    "chunk_neighbours": f"{_BASE}, {_CAND}, {_ANCHOR} select c1.candidate_id, coalesce(string_agg(c.chunk_id, ',' order by c.ord), '') as chunk_ids from c1 left join an using (candidate_id) left join c on c.source_id = c1.source_id and (an.ord is null or c.ord in (select ord from c o where o.source_id = c1.source_id and (o.ord = an.ord or o.ord = (select max(ord) from c b where b.source_id = c1.source_id and b.ord < an.ord) or o.ord = (select min(ord) from c b where b.source_id = c1.source_id and b.ord > an.ord)))) group by 1",
    "jaccard_best_entry": f"{_BASE}, {_CAND}, {_BEST} select candidate_id, target, round(sim, 6) as sim from be",
    "schema_fit": f"{_BASE}, {_CAND}, {_FIT} select candidate_id, n_matched from sf",
    "structural_reasons": f"{_BASE}, {_CAND}, {_REASON} select candidate_id, coalesce(reason, '') as reason from rs",
    "scored_candidates": f"{_SCORED} select candidate_id, type, schema_fit, claim_strength, evidence_quality, reusability, novelty, boundary, penalty, total, action, case when action in ('update_existing', 'link_only') then target else '' end as target from sg",
    "card_groups": f"{_BASE}, {_CAND}, {_GROUPS} select coalesce(r, 9999) as node_ord, count(*) as n_cards, min(begin) as first_begin, max(begin) as last_begin from c1 left join gb on l = candidate_id group by 1",
    "action_tally": f"{_SCORED} select coalesce(type, 'all') as type, coalesce(action, 'all') as action, count(*) as n from sg group by grouping sets ((type), (action), (type, action))",
}
