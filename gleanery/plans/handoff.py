"""Queries: ranked cards, prompts, excerpts, locators, page documents, bibliographies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import candidates as cd
from ..operators import entries as en
from ..operators import handoff as ho
from ..operators import reports as rp
from ..operators import segment as sg
from ..sources import views
from ..sources.store import persisted
from . import knowledge as kn
from . import matching as mtp
from . import segments as sgp
from . import sqltext as q


def _cards(spark, sf_dir):
    """Scored candidates with their decisions and texts, and the chunks."""
    found, chunks, entries = mtp.parts(spark, sf_dir)
    scored = en.with_decisions(mtp.scored_of(spark, found, chunks, entries), kn.decision_log(spark, sf_dir, found))
    cards = scored.join(found.select("candidate_id", "title", "summary", "evidence_text", "stop"), "candidate_id")
    return cards, chunks.withColumn("page", F.lit(None).cast("int")), entries


def topn_cards(spark, sf_dir):
    cards, _, _ = _cards(spark, sf_dir)
    return ho.top_cards(cards).select("candidate_id", "decision", "action", F.col("total").cast("long").alias("total"), "rank")


def action_order(spark, sf_dir):
    return ho.tally(mtp._scored(spark, sf_dir))


def card_prompts(spark, sf_dir):
    found, chunks, _ = mtp.parts(spark, sf_dir)
    asked = ho.card_prompts(found, chunks.withColumn("page", F.lit(None).cast("int")))
    return asked.select("candidate_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


def batch_handoff(spark, sf_dir):
    """One prompt for the best open cards, with the titles of the first benchmark items as outline."""
    cards, chunks, entries = _cards(spark, sf_dir)
    top = ho.top_cards(cards).join(entries.select(F.col("id").alias("target"), F.col("title").alias("related")), "target", "left")
    keywords = [r["title"] for r in entries.orderBy("ord").limit(20).select("title").collect()]  # an outline is a parameter
    return ho.batch_prompt(top, chunks, keywords).select("n_cards", "n_chunks", F.md5("prompt").alias("prompt_md5"))


def outline_signature(spark, sf_dir):
    return ho.outline_signature(sg.outline(sgp.md_docs(spark, sf_dir)))


def evidence_excerpts(spark, sf_dir):
    """What stands around each quote of a response in its chunk."""
    from ..operators import responses as rs

    found, chunks = kn._responses(spark, sf_dir)
    gate = rs.evidence_gate(rs.response_candidates(found), chunks).where("chunk_text is not null")
    return gate.select("source_id", "idx", "ei", F.md5(ho.context(F.col("chunk_text"), F.col("quote"))).alias("context_md5"))


def source_purity(spark, sf_dir):
    found, chunks = kn._responses(spark, sf_dir)
    from ..operators import responses as rs

    rows = rs.response_candidates(found).select("source_id", "idx", F.explode_outer("evidence").alias("e")).select("source_id", "idx", F.trim("e.chunk_id").alias("chunk_id"))
    return ho.pure_source(rows, chunks).select("source_id", "idx", "n_sources", F.coalesce("owner", F.lit("")).alias("owner"))


def ref_locators(spark, sf_dir):
    found = cd.plain_candidates(sgp.cue_docs(spark, sf_dir)).select("candidate_id", ho.locator(F.col("refs")).alias("at"))
    return found.select("candidate_id", F.coalesce("at.page", F.lit(0)).alias("page"), F.coalesce("at.line", F.lit(0)).alias("line"))


def _volumes(spark, sf_dir):
    return sg.page_documents(views.view(spark, sf_dir, views.PAGE_ROWS))


def page_documents(spark, sf_dir):
    docs = _volumes(spark, sf_dir)
    return docs.select("source_id", F.md5("text").alias("text_md5"), F.array_join(F.transform("page_starts", lambda x: x.cast("string")), ",").alias("page_starts"))


def page_chunks(spark, sf_dir):
    """Chunks of paged documents, with the page that each begins on."""
    docs = _volumes(spark, sf_dir)
    cut = sg.with_page(sg.chunks(docs.select("source_id", "text")), docs)
    return cut.select("source_id", F.col("ord").cast("long").alias("ord"), "page", "begin", "stop", "content_hash")


def chunk_reading_order(spark, sf_dir):
    """Chunks as cards, in their source's order by page and begin."""
    docs = _volumes(spark, sf_dir)
    cut = sg.with_page(sg.chunks(docs.select("source_id", "text")), docs)
    return ho.reading_order(cut.withColumnRenamed("chunk_id", "candidate_id")).groupBy("source_id", "page").agg(F.min("place").cast("long").alias("first_place"), F.max("place").cast("long").alias("last_place"))


def bibliography(spark, sf_dir):
    rows = rp.bibliography(views.view(spark, sf_dir, views.BIB_DOCS))
    return rows.select("source_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author", "translator", "publisher", "year", "confidence", "display_title")])


def entry_summary(spark, sf_dir):
    return rp.entry_summary(kn._by_source(spark, sf_dir)).select("source_id", "id", "title", "status", F.coalesce("node", F.lit("")).alias("node"), "n_claims")


def hidden_entries(spark, sf_dir):
    """Entries of one source each, titled by their first claim, that are structure; of all candidates, as the save gate would keep them from being entries."""
    found = persisted(cd.plain_candidates(sgp.cue_docs(spark, sf_dir)))
    built = en.build(found, found.select("candidate_id", F.lit(None).cast("string").alias("node_id")))
    return rp.hidden_entries(built.withColumn("title", F.get("claims", F.lit(0))["statement"]))


QUERIES = {f.__name__: f for f in (topn_cards, action_order, card_prompts, batch_handoff, outline_signature, evidence_excerpts, source_purity, ref_locators, page_documents, page_chunks, chunk_reading_order, bibliography, entry_summary, hidden_entries)}

_ACTION = "case action when 'create_new' then 0 when 'update_existing' then 1 when 'link_only' then 2 else 3 end"
_TOP = f"""{mtp._SCORED}, {q.with_views('decision_log')}, {kn._dec('c1')},
  crd as (select sg.*, c1.source_id, c1.title, c1.summary, c1.evidence_text, coalesce(d.decision, 'pending') as decision from sg join c1 using (candidate_id) left join dec d on d.candidate_id = c1.candidate_id),
  top as (select *, row_number() over (order by case decision when 'approved' then 0 else 1 end, total desc, {_ACTION}, source_id, candidate_id) as rank from crd where action <> 'ignore' and decision not in ('held', 'discarded') qualify rank <= 8)"""
_NEAR = """(an.ord is null or c.ord in (select ord from c o where o.source_id = c1.source_id and (o.ord = an.ord or o.ord = (select max(ord) from c b where b.source_id = c1.source_id and b.ord < an.ord) or o.ord = (select min(ord) from c b where b.source_id = c1.source_id and b.ord > an.ord))))"""
_BLOCK = "concat('- chunk_id: ', c.chunk_id, chr(10), '  source_id: ', c.source_id, chr(10), '  page: (none)', chr(10), '  text:', chr(10), '    ', replace(c.text, chr(10), concat(chr(10), '    ')))"
_EXCERPT = lambda x: f"(select case when length(z) > 360 then concat(substr(z, 1, 359), '…') else z end from (select {q.one_line(x)} as z))"


def _clamp(x: str, n: int) -> str:
    clean = q.replace(q.one_line(f"regexp_replace({x}, '[\\x00-\\x1f]+', ' ', 'g')"), lx.BIB_TRIM)
    return f"(select case when length(z) > {n} then concat({q.trimmed(f'substr(z, 1, {n - 1})')}, '…') else z end from (select {clean} as z))"


def _noisy(x: str) -> str:
    return "(" + " or ".join(q.has(x, p) for p in lx.BIB_NOISE) + ")"


def _fits(x: str) -> str:
    return f"(length({x}) between 6 and 150 and not {_noisy(x)} and " + " and ".join(f"not {q.has(x, p)}" for p in lx.BIB_NOT_TITLE) + f" and len(regexp_extract_all({x}, '[0-9]')) <= 0.35 * length({x}))"


def _first(name: str, value: str, test: str) -> str:
    return f"arg_min({value}, no) filter (where {test}) as {name}"


_AUTHOR = q.group("line", lx.BIB_AUTHOR, 1)
for _p in lx.BIB_AUTHOR_DROPS:
    _AUTHOR = q.replace(_AUTHOR, _p)
_PAGED = sgp._CHUNKS.replace("cue_docs", "pg")

_NODES = sgp.ORACLES["outline_tree"].split(" select source_id, concat('n', ord)")[0].rstrip()
_LABEL = r"""case when regexp_matches(t, '^#{1,6}\s+.+$') then '' when regexp_matches(t, '^제\s*\d+\s*[장절항]') then regexp_extract(t, '^(제\s*\d+\s*[장절항])', 1) when regexp_matches(t, '^\d+(\.\d+)*[.)]?\s+.+$') then regexp_extract(t, '^(\d+(\.\d+)*)', 1) else '' end as label,"""
_LABELLED = _NODES.replace("n as (select source_id, row_number()", f"n as (select source_id, {_LABEL} row_number()")

ORACLES = {
    "entry_summary": f"{kn._SAVED} select source_id, concat(source_id, '-unclassified') as id, 'unclassified' as title, 'draft' as status, '' as node, count(*) as n_claims from c9 group by 1",
    "hidden_entries": f"""{mtp._BASE}, {mtp._CAND.replace('c1 as (', 'c0 as (')}, c1 as (select concat(c0.source_id, '-unclassified') as candidate_id, 'other' as type, arg_min(c0.title, (c0.begin, c0.stop)) as title, '' as summary,
      string_agg(concat_ws(chr(10), nullif(c0.title, ''), nullif(ct.source_text, '')), chr(10) order by c0.begin, c0.stop, c0.candidate_id) as evidence_text from c0 join ct on ct.candidate_id = c0.candidate_id group by c0.source_id), {mtp._REASON} select candidate_id as id, reason from rs where reason is not null""",
    "topn_cards": f"{_TOP} select candidate_id, decision, action, total, cast(rank as int) as rank from top",
    "action_order": f"{mtp._SCORED} select {_ACTION} as place, action, count(*) as n from sg group by 1, 2",
    "card_prompts": f"""{mtp._BASE}, {mtp._CAND}, {mtp._ANCHOR}, bl as (select c1.candidate_id, string_agg({_BLOCK}, chr(10) order by c.ord) as blocks from c1 left join an using (candidate_id) join c on c.source_id = c1.source_id and {_NEAR} group by 1),
      pr as (select c1.candidate_id, concat('[CANDIDATE]', chr(10), '- title: ', title, chr(10), '- type: ', type, chr(10), chr(10), '[SCHEMA]', chr(10), '(no outline given)', chr(10), chr(10), '[CANDIDATE_CHUNKS]', chr(10), coalesce(blocks, '(no chunk)'), chr(10), chr(10), 'Answer with one JSON object: wiki_candidates.') as prompt from c1 left join bl using (candidate_id))
      select candidate_id, md5(prompt) as prompt_md5, length(prompt) as n_chars from pr""",
    "batch_handoff": f"""{_TOP}, tc1 as (select c1.* from c1 join top using (candidate_id)), nr as (select top.rank, c.chunk_id, c.source_id, c.text, row_number() over (partition by top.rank order by c.ord) as place from top join c1 using (candidate_id) left join an using (candidate_id) join c on c.source_id = c1.source_id and {_NEAR} qualify place <= 4),
      fs as (select *, row_number() over (partition by source_id, chunk_id order by rank, place) as k from nr qualify k = 1),
      bl as (select count(*) as n_chunks, string_agg({_BLOCK}, chr(10) order by rank, place) as blocks from fs c),
      cbk as (select count(*) as n_cards, string_agg(concat('- batch_index: ', rank, chr(10), '  source_id: ', source_id, chr(10), '  local_candidate_id: ', candidate_id, chr(10), '  title: ', title, chr(10), '  type: ', type, chr(10), '  recommended_action: ', action,
        case when action in ('update_existing', 'link_only') and target <> '' then concat(chr(10), '  related_existing_entry: ', (select e.title from existing e where e.id = top.target)) else '' end,
        case when summary <> '' and summary <> title then concat(chr(10), '  summary: ', summary) else '' end, case when evidence_text <> '' then concat(chr(10), '  evidence_preview: ', {q.one_line('evidence_text')}) else '' end), chr(10) order by rank) as cards from top),
      kwd as (select string_agg(concat('- ', title), chr(10) order by ord) as keywords from (select * from existing order by ord limit 20) z)
      select n_cards, n_chunks, md5(concat('[CANDIDATES]', chr(10), cards, chr(10), chr(10), '[SCHEMA]', chr(10), keywords, chr(10), chr(10), '[CANDIDATE_CHUNKS]', chr(10), blocks, chr(10), chr(10), 'Answer with one JSON object: wiki_candidates.')) as prompt_md5 from cbk, bl, kwd""",
    "evidence_excerpts": f"""{kn._R}, nd as (select source_id, idx, ei, chunk_text, {q.one_line('quote')} as needle from gate where chunk_text is not null), ps as (select *, case when needle = '' then 0 else strpos(lower(chunk_text), lower(substr(needle, 1, 80))) end as pos from nd)
      select source_id, idx, ei, md5(case when pos = 0 then {_EXCERPT('chunk_text')} else {_EXCERPT('substr(chunk_text, cast(greatest(pos - 161, 0) + 1 as int), cast(least(pos - 1 + length(needle) + 160, length(chunk_text)) - greatest(pos - 161, 0) as int))')} end) as context_md5 from ps""",
    "source_purity": f"{kn._R} select cand.source_id, cand.idx, count(distinct k.source_id) as n_sources, coalesce(case when count(distinct k.source_id) = 1 then min(k.source_id) end, '') as owner from cand left join ev on ev.source_id = cand.source_id and ev.idx = cand.idx left join resp_chunks k on k.chunk_id = ev.chunk_id group by 1, 2",
    "ref_locators": f"{kn._C} select candidate_id, 0 as page, coalesce(try_cast(nullif(regexp_extract(refs, '#line-([0-9]+)', 1), '') as int), 0) as line from cand",
    "page_documents": f"with {q.with_views('page_rows')}, s as (select *, coalesce(sum(length(text) + 1) over (partition by source_id order by page rows between unbounded preceding and 1 preceding), 0) as start from page_rows) select source_id, md5(string_agg(text, chr(12) order by page)) as text_md5, string_agg(cast(start as bigint), ',' order by page) as page_starts from s group by 1",
    "page_chunks": f"""with recursive {q.with_views('page_rows')}, ps as (select *, coalesce(sum(length(text) + 1) over (partition by source_id order by page rows between unbounded preceding and 1 preceding), 0) as base from page_rows), pg as (select concat(source_id, '|', page) as source_id, text from page_rows), {_PAGED},
      a as (select split_part(k.source_id, '|', 1) as source_id, cast(split_part(k.source_id, '|', 2) as int) as page, k.begin, k.stop, k.text from k),
      b as (select a.source_id, a.page, cast(a.begin + base as bigint) as begin, cast(a.stop + base as bigint) as stop, a.text, row_number() over (partition by a.source_id order by a.begin + base) - 1 as ord from a join ps on ps.source_id = a.source_id and ps.page = a.page)
      select source_id, ord, page, begin, stop, substr(sha256(text), 1, 16) as content_hash from b where {q.trimmed('text')} <> ''""",
    "chunk_reading_order": f"""with recursive {q.with_views('page_rows')}, pg as (select concat(source_id, '|', page) as source_id, text from page_rows), {_PAGED}, a as (select split_part(source_id, '|', 1) as source_id, cast(split_part(source_id, '|', 2) as int) as page, begin from c),
      b as (select *, row_number() over (partition by source_id order by page, begin) as place from a) select source_id, page, min(place) as first_place, max(place) as last_place from b group by 1, 2""",
    "bibliography": f"""with {q.with_views('bib_docs')}, bd as (select source_id, substr(replace(text, chr(12), chr(10)), 1, 16000) as text from bib_docs),
      l0 as (select source_id, ln, {q.one_line("regexp_replace(line, '[" + chr(92) + "x00-" + chr(92) + "x1f]+', ' ', 'g')")} as line from {q.lines('bd')} x), l1 as (select *, row_number() over (partition by source_id order by ln) as no from l0 where line <> '' qualify no <= 90),
      l2 as (select *, {_fits('line')} as fits, {_noisy('line')} as noise, {q.has('line', lx.BIB_AUTHOR)} as by_, {q.trimmed(q.replace('line', lx.BIB_AUTHOR))} as rest, {_clamp(_AUTHOR, 120)} as au from l1),
      l3 as (select *, case when by_ then coalesce(case when {_fits('rest')} then rest end, (select arg_max(p.line, p.no) from l2 p where p.source_id = l2.source_id and p.no between l2.no - 5 and l2.no - 1 and p.fits)) end as bt from l2),
      f as (select source_id, {_first('first_title', _clamp('line', 150), 'fits and no <= 40')}, min(no) filter (where by_) as bn, {_first('ako', _clamp(q.group('line', lx.BIB_AUTHOR_KO, 1), 120), q.has('line', lx.BIB_AUTHOR_KO))}, {_first('aen', 'au', f"by_ and au <> '' and not {_noisy('au')}")},
        {_first('tko', _clamp(q.group('line', lx.BIB_TRANSLATOR_KO, 1), 120), q.has('line', lx.BIB_TRANSLATOR_KO))}, {_first('ten', _clamp(q.group('line', lx.BIB_TRANSLATOR, 1), 120), q.has('line', lx.BIB_TRANSLATOR))},
        {_first('pko', _clamp(q.group('line', lx.BIB_PUBLISHER_KO, 1), 120), q.has('line', lx.BIB_PUBLISHER_KO))}, {_first('pen', _clamp('line', 120), f"not noise and {q.has('line', lx.BIB_PUBLISHER)}")}, {_first('yr', q.group('line', lx.BIB_YEAR, 1), q.has('line', lx.BIB_YEAR))} from l3 group by 1),
      g as (select b.source_id, b.filename, coalesce(case when l3.bt is not null then {_clamp('l3.bt', 150)} end, f.first_title) as t, coalesce(nullif(ako, ''), aen, '') as author, coalesce(nullif(tko, ''), ten, '') as translator, coalesce(nullif(pko, ''), pen, '') as publisher, coalesce(yr, nullif({q.group('b.filename', lx.BIB_YEAR, 1)}, ''), '') as year
        from bib_docs b left join f on f.source_id = b.source_id left join l3 on l3.source_id = b.source_id and l3.no = f.bn),
      h as (select *, coalesce(t, nullif({_clamp("regexp_replace(regexp_replace(regexp_replace(filename, '" + chr(92) + ".[^.]+$', ''), '[_" + chr(92) + "-]+', ' ', 'g'), '" + chr(92) + "s*" + chr(92) + "([0-9]+" + chr(92) + ")" + chr(92) + "s*$', '')", 140)}, ''), filename) as title, case when t is null then 'filename_fallback' else 'heuristic' end as confidence from g),
      j as (select *, concat_ws(' · ', nullif(author, ''), '역자 ' || nullif(translator, ''), nullif(publisher, ''), nullif(year, '')) as parts from h)
      select source_id, title, author, translator, publisher, year, confidence, case when parts = '' then title else {_clamp("concat(title, ' — ', parts)", 220)} end as display_title from j""",
    "outline_signature": _LABELLED + f" select source_id, concat('outline:', substr(sha256(string_agg(concat(level, chr(9), label, chr(9), {q.one_line('title')}), chr(10) order by ord)), 1, 8)) as signature from n group by 1",
}
