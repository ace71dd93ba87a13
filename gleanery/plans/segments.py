"""Queries: cues by line, and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import segment as sg
from ..sources import views
from . import sqltext as q


def cue_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.CUE_DOCS)


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.view(spark, sf_dir, views.MD_DOCS)


def claim_verb_counts(spark, sf_dir):
    return cue_docs(spark, sf_dir).select("source_id", tx.claim_count("text").cast("long").alias("n_claims"))


def demotion_flags(spark, sf_dir):
    lines = sg.lines(cue_docs(spark, sf_dir))
    return lines.groupBy("source_id").agg(*[F.count_if(flag).alias(kind) for kind, flag in tx.demotions("line").items()])


def prose_type_counts(spark, sf_dir):
    docs = cue_docs(spark, sf_dir)
    typed = tx.typed(docs.select("lang", F.explode(F.split("text", "\n")).alias("line")), "line")
    return typed.groupBy("lang", F.coalesce("type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


def line_spans(spark, sf_dir):
    return sg.lines(cue_docs(spark, sf_dir)).select("source_id", "ln", "begin", "stop", F.md5("line").alias("line_md5"))


def line_context(spark, sf_dir):
    return sg.line_context(cue_docs(spark, sf_dir)).select("source_id", "ln", F.md5("context").alias("context_md5"))


def paragraphs(spark, sf_dir):
    return sg.paragraphs(cue_docs(spark, sf_dir)).select("source_id", "first_line", "last_line", "begin", "stop", F.md5("text").alias("text_md5"))


def prose_blocks(spark, sf_dir):
    marked = sg.lines(cue_docs(spark, sf_dir)).withColumn("consumed", F.lit(False))
    return sg.prose_blocks(marked).select("source_id", "first_line", "last_line", "begin", "stop", F.md5("text").alias("text_md5"))


def chunks(spark, sf_dir):
    cut = sg.chunks(cue_docs(spark, sf_dir))
    return cut.select("source_id", F.col("ord").cast("long").alias("ord"), "chunk_id", "begin", "stop", "content_hash")


def chunk_batches(spark, sf_dir):
    cut = sg.chunk_batches(sg.chunks(cue_docs(spark, sf_dir)))
    return cut.groupBy("source_id", "batch").agg(F.count("*").alias("n_chunks"), F.sum(F.col("stop") - F.col("begin")).alias("n_chars"), F.min("ord").cast("long").alias("first_ord"))


def md_blocks(spark, sf_dir):
    return sg.markdown_blocks(md_docs(spark, sf_dir)).select("source_id", "kind", F.coalesce("level", F.lit(0)).alias("level"), "first_line", "last_line", F.md5("raw").alias("raw_md5"))


def heading_paths(spark, sf_dir):
    return sg.heading_paths(md_docs(spark, sf_dir))


def outline_tree(spark, sf_dir):
    """Markdown texts read as outlines: nodes with their parents."""
    tree = sg.outline(md_docs(spark, sf_dir))
    return tree.select("source_id", "node_id", "level", F.coalesce("parent", F.lit("")).alias("parent"), F.md5("title").alias("title_md5"))


QUERIES = {f.__name__: f for f in (claim_verb_counts, demotion_flags, prose_type_counts, line_spans, line_context, paragraphs, prose_blocks, chunks, chunk_batches, md_blocks, heading_paths, outline_tree)}

_CUE = f"with recursive {q.with_views('cue_docs')}"
_PARAGRAPHS = f"""p as (select source_id, min(ln) as first_line, max(ln) as last_line, min(begin) as begin, max(stop) as stop, string_agg(line, chr(10) order by ln) as text
  from (select *, sum(case when {q.trimmed('line')} = '' then 1 else 0 end) over (partition by source_id order by ln) as island from {q.lines('cue_docs')} l) m where {q.trimmed('line')} <> '' group by source_id, island)"""
_CHUNKS = f"""{_PARAGRAPHS},
w as (select source_id, begin, text, 0 as s, 0 as e from p
  union all
  select source_id, begin, text, case when e = 0 and s = 0 then 0 when substr(text, cast(e + 1 as int), 1) = chr(10) then e + 1 else e end as s,
    (select case when c + 1800 >= length(text) then length(text) when r > 0 and c + 1801 - r > c then c + 1801 - r else c + 1800 end
      from (select c, strpos(reverse(substr(text, cast(c + 1 as int), 1801)), chr(10)) as r from (select case when e = 0 and s = 0 then 0 when substr(text, cast(e + 1 as int), 1) = chr(10) then e + 1 else e end as c) a) b) as e
  from w where e < length(text) and not (e = length(text) - 1 and substr(text, length(text), 1) = chr(10))),
k as (select source_id, begin + s as begin, begin + e as stop, substr(text, cast(s + 1 as int), cast(e - s as int)) as text, row_number() over (partition by source_id order by begin + s) - 1 as ord from w where e > 0),
c as (select source_id, ord, substr(sha256(concat(source_id, ':', ord, ':', begin, ':', stop)), 1, 16) as chunk_id, begin, stop, text, substr(sha256(text), 1, 16) as content_hash from k where {q.trimmed('text')} <> '')"""
_MD_LINES = f"""l as (select *, starts_with(line, '```') as fence, sum(case when starts_with(line, '```') then 1 else 0 end) over (partition by source_id order by ln) as nf from {q.lines('md_docs')} x)"""
#: Lines of Markdown blocks as ``t`` (source_id, island, k3: their kind, ln, line, begin, stop).
_MD_BLOCKS = f"""{_MD_LINES},
      k as (select *, case when (nf % 2 = 1) or fence then 'code' when {q.trimmed('line')} = '' then 'blank' when regexp_full_match(line, '\\s*(-{{3,}}|\\*{{3,}}|_{{3,}})\\s*') then 'hr' when {q.has('line', chr(92) + 'A#{1,6}' + chr(92) + 's+[^' + chr(92) + 'n]*' + chr(92) + 'z')} then 'heading' when starts_with(line, '>') then 'blockquote' else 'run' end as kind0,
        nf = max(nf) over (partition by source_id) and max(nf) over (partition by source_id) % 2 = 1 as open from l),
      k2 as (select *, case when kind0 = 'code' and open then 'dropped' else kind0 end as kind, case when kind0 = 'code' then floor((nf + case when fence and nf % 2 = 0 then -1 else 0 end) / 2) end as fno from k),
      i as (select *, sum(case when kind is distinct from pk or kind in ('heading', 'hr') or fno is distinct from pf then 1 else 0 end) over (partition by source_id order by ln) as island from (select *, lag(kind) over (partition by source_id order by ln) as pk, lag(fno) over (partition by source_id order by ln) as pf from k2) z),
      r as (select *, regexp_matches(line, '^\\s*([-*+]|\\d+\\.)\\s+') as item, regexp_matches(line, '^\\s{{2,}}\\S') as indented from i where kind not in ('blank', 'dropped')),
      s as (select *, arg_min(item, ln) over (partition by source_id, island) as fi, min(case when not item and not indented then ln end) over (partition by source_id, island) as nl from r),
      t as (select *, case when kind = 'run' then case when fi and ln < coalesce(nl, 2147483647) then 'list' else 'paragraph' end else kind end as k3 from s)"""

ORACLES = {
    "claim_verb_counts": f"{_CUE} select source_id, cast({q.claims('text')} as bigint) as n_claims from cue_docs",
    "demotion_flags": f"{_CUE} select source_id, {', '.join(f'count(*) filter (where {s}) as {k}' for k, s in q.demotions('line').items())} from {q.lines('cue_docs')} l group by source_id",
    "prose_type_counts": f"{_CUE}, t as (select lang, {q.one_line('line')} as c from (select lang, unnest(string_split(text, chr(10))) as line from cue_docs) x) select lang, coalesce({q.prose_type('c')}, 'none') as type, count(*) as n from t group by 1, 2",
    "line_spans": f"{_CUE} select source_id, ln, begin, stop, md5(line) as line_md5 from {q.lines('cue_docs')} l",
    "line_context": f"""{_CUE}, n as (select source_id, ln, {q.trimmed('line')} as t from {q.lines('cue_docs')} l),
      m as (select *, lag(t) over (partition by source_id order by ln) as a, lead(t) over (partition by source_id order by ln) as b from n),
      j as (select source_id, ln, concat_ws(chr(10), case when length(a) between 1 and 260 then a end, case when t <> '' then t end, case when length(b) between 1 and 260 then b end) as j from m)
      select source_id, ln, md5(case when length(k) > 900 then concat(substr(k, 1, 899), '…') else k end) as context_md5 from (select source_id, ln, regexp_replace(j, '[ \\t]+', ' ', 'g') as k from j) y""",
    "paragraphs": f"{_CUE}, {_PARAGRAPHS} select source_id, first_line, last_line, begin, stop, md5(text) as text_md5 from p",
    "prose_blocks": f"""{_CUE}, f as (select *, {q.trimmed('line')} as t from {q.lines('cue_docs')} l),
      g as (select *, t = '' or (length(t) < 80 and {q.demoted('t')}) as apart, {q.has('t', lx.SENTENCE_END)} as ends from f),
      h as (select *, sum(case when apart or coalesce(prev, false) then 1 else 0 end) over (partition by source_id order by ln) as island from (select *, lag(ends) over (partition by source_id order by ln) as prev from g) x)
      select source_id, min(ln) as first_line, max(ln) as last_line, min(begin) as begin, max(stop) as stop, md5(string_agg(line, chr(10) order by ln)) as text_md5 from h where not apart group by source_id, island""",
    "chunks": f"{_CUE}, {_CHUNKS} select source_id, ord, chunk_id, begin, stop, content_hash from c",
    "chunk_batches": f"{_CUE}, {_CHUNKS}, b as (select *, cast(floor((row_number() over (partition by source_id order by ord) - 1) / 8) as int) as batch from c) select source_id, batch, count(*) as n_chunks, cast(sum(stop - begin) as bigint) as n_chars, min(ord) as first_ord from b group by 1, 2",
    "md_blocks": f"""with {q.with_views('md_docs')}, {_MD_BLOCKS}
      select source_id, k3 as kind, max(case when k3 = 'heading' then length(regexp_extract(line, '^(#{{1,6}})', 1)) else 0 end) as level, min(ln) as first_line, max(ln) as last_line, md5(string_agg(line, chr(10) order by ln)) as raw_md5 from t group by source_id, island, k3""",
    "heading_paths": f"""with {q.with_views('md_docs')}, l as (select *, case when regexp_full_match(line, '#{{1,6}}\\s+.*') then length(regexp_extract(line, '^(#{{1,6}})', 1)) end as level, {q.trimmed(q.group('line', chr(92) + 'A#{1,6}' + chr(92) + 's+([^' + chr(92) + 'n]*)' + chr(92) + 'z', 1))} as title from {q.lines('md_docs')} x),
      b as (select *, level is not null or {q.trimmed('line')} = '' as apart, sum(case when level is not null or {q.trimmed('line')} = '' then 1 else 0 end) over (partition by source_id order by ln) as island from l),
      p as (select source_id, min(ln) as ln, min(begin) as begin, max(stop) as stop from b where not apart group by source_id, island),
      h as (select p.source_id, p.ln, h.ln as hl, h.level, h.title from p join l h on h.source_id = p.source_id and h.ln < p.ln and h.level is not null
        where not exists (select 1 from l o where o.source_id = h.source_id and o.ln > h.ln and o.ln < p.ln and o.level <= h.level))
      select p.source_id, begin, stop, coalesce(path, '') as path from p left join (select source_id, ln, string_agg(title, ' > ' order by hl) as path from h group by 1, 2) g using (source_id, ln)""",
    "outline_tree": f"""with {q.with_views('md_docs')}, l as (select source_id, ln, {q.trimmed('line')} as t, length(replace(regexp_extract(line, '^([ \\t]*)', 1), chr(9), '  ')) as depth from {q.lines('md_docs')} x where {q.trimmed('line')} <> ''),
      n as (select source_id, row_number() over (partition by source_id order by ln) as ord,
        least(9, case when regexp_matches(t, '^#{{1,6}}\\s+.+$') then length(regexp_extract(t, '^(#{{1,6}})', 1)) when regexp_matches(t, '^제\\s*\\d+\\s*장') then 1 when regexp_matches(t, '^제\\s*\\d+\\s*절') then 2 when regexp_matches(t, '^제\\s*\\d+\\s*항') then 3
          when regexp_matches(t, '^\\d+(\\.\\d+)*[.)]?\\s+.+$') then len(string_split(regexp_extract(t, '^(\\d+(\\.\\d+)*)', 1), '.')) else cast(floor(depth / 2) as int) + 1 end) as level,
        case when regexp_matches(t, '^#{{1,6}}\\s+.+$') then regexp_extract(t, '^#{{1,6}}\\s+(.+)$', 1) when regexp_matches(t, '^\\d+(\\.\\d+)*[.)]?\\s+.+$') then regexp_extract(t, '^\\d+(\\.\\d+)*[.)]?\\s+(.+)$', 1)
          when regexp_matches(t, '^[-*+•]\\s+.+$') then regexp_extract(t, '^[-*+•]\\s+(.+)$', 1) else t end as title from l)
      select source_id, concat('n', ord) as node_id, level, coalesce('n' || cast((select max(p.ord) from n p where p.source_id = n.source_id and p.ord < n.ord and p.level < n.level) as varchar), '') as parent, md5(title) as title_md5 from n""",
}
