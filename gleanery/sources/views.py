"""Input views: the given tables in the roles that the operators need.

Raw documents rarely trigger a cue, so each gets a cue line before its whole
text.  The same SQL runs in Spark and as a ``with`` prefix of an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "pages", "benchmark", "labels", "events", "conversations")

CUE_DOCS = """
select cast(doc_id as string) as source_id, doc_id, lang, source,
  concat(case doc_id % 13
    when 0 then concat('The author argues that ', l, ' because the record supports it.')
    when 1 then concat('This method compares ', l, ' with a second framework.')
    when 2 then concat('However, the chapter challenges ', l, ' and rejects it.')
    when 3 then concat('Validity refers to the degree to which ', l)
    when 4 then concat(chr(34), l, chr(34))
    when 5 then concat('Smith, J. (1999). ', l)
    when 6 then concat(l, ' .......... 12')
    when 7 then concat('Copyright 2001 ', l)
    when 8 then concat('Concept: Source criticism - ', l)
    when 9 then concat('They claim no more; the claim shows up again: ', l)
    when 10 then concat('Intertextuality and socio-rhetorical reading in MT suggest ', l)
    when 11 then 'A factor is a variable that the well-formed model compares across form-critical groups.'
    else l end, chr(10), chr(10), text) as text
from (select doc_id, lang, source, coalesce(text, '') as text, split_part(coalesce(text, ''), chr(10), 1) as l from documents) x
"""

BIB_DOCS = """
select cast(doc_id as string) as source_id, concat(case doc_id % 9 when 1 then 'The_Collected-Essays 1987 (2).pdf' when 2 then '2004.txt' else concat('file-', cast(doc_id as string), '.md') end) as filename,
  concat(case doc_id % 11
    when 0 then concat('Studies of the Record', chr(10), 'by Jane Roe translated by Ann Lee', chr(10), 'Northern University Press, 1994', chr(10))
    when 1 then concat('저자: 김철수', chr(10), '역자: 이영희', chr(10), '출판사: 한빛', chr(10))
    when 2 then concat('Essays on Method by John Doe', chr(10), 'Copyright 2001', chr(10))
    when 3 then concat('123', chr(10), 'Contents', chr(10), 'Chapter 1', chr(10), 'Some Verlag', chr(12))
    when 4 then concat('Short', chr(10), 'A First Line of Title', chr(10), 'second line here', chr(10), 'Edited work', chr(10), 'by', chr(9), 'Max Mustermann, edited by B.', chr(10), 'printed in 1850', chr(10))
    when 5 then concat('1234567 890', chr(10), 'page 12', chr(10), '— ; A title between marks: —', chr(10), 'City Books', chr(10))
    else '' end, case when doc_id % 13 = 0 then '12' else text end) as text
from (select doc_id, coalesce(text, '') as text from documents) x
"""

MD_DOCS = """
select cast(doc_id as string) as source_id, doc_id, concat('# ', split_part(l, ' ', 1), chr(10), chr(10), '## Concept ', split_part(l, ' ', 2), chr(10), chr(10),
  '**', split_part(l, ' ', 3), '** - ', l, chr(10), chr(10), '> ', l, chr(10), '> ', split_part(l, ' ', 1), chr(10), chr(10),
  '- ', split_part(l, ' ', 2), chr(10), '- ', split_part(l, ' ', 3), chr(10), '---', chr(10), '### Closing', chr(10), chr(96), chr(96), chr(96), chr(10), '# fenced', chr(10), chr(10), 'code', chr(10), chr(96), chr(96), chr(96), chr(10), t) as text
from (select doc_id, translate(split_part(coalesce(text, ''), chr(10), 1), '*#>_-', '     ') as l, translate(coalesce(text, ''), '*#>_-', '     ') as t from documents) x
"""

PAGE_ROWS = """
select concat('v', cast(cast(floor(doc_id / 4) as int) as string)) as source_id, cast(doc_id % 4 + 1 as int) as page, coalesce(text, '') as text from documents
"""

#: All texts of a document source as its pages, with blank pages and title pages of a word between them.
VOLUME_PAGES = """
select source as source_id, cast(doc_id as bigint) * 2 as page, coalesce(text, '') as text from documents
union all select source, cast(doc_id as bigint) * 2 + 1, case when doc_id % 9 = 0 then '' else split_part(coalesce(text, ''), ' ', 1) end from documents where doc_id % 9 < 2
"""

EXISTING = """
select item_id as ord, concat('e-', cast(item_id as string)) as id, split_part(text, '.', 1) as title, text as summary,
  concat_ws(' ', split_part(text, ' ', 3), case when item_id % 3 = 0 then 'criticism' else 'record' end) as tags, case when item_id % 4 = 0 then concat(split_part(text, ' ', 2), ' intertextuality') else '' end as original_terms,
  case when item_id % 5 = 0 then split_part(text, '.', 2) else '' end as related from benchmark
"""

DECISION_EVENTS = """
select event_id, cast(user_id as string) as source_id, ts as updated_at,
  case event_type when 'purchase' then 'approved' when 'signup' then 'approved' when 'click' then 'held' when 'error' then 'discarded' else 'pending' end as decision
from events
"""

#: Records on all candidates of a source (turn -1), and on those whose begin leaves ``turn`` when divided by 3; not in order of time.
DECISION_LOG = f"""
select cast(doc_id as string) as source_id, cast('2023-12-31 00:00:00' as timestamp) as updated_at, cast(-1 as bigint) as event_id, cast(-1 as bigint) as turn, case when toxic = 1 then 'discarded' when quality = 1 then 'approved' else 'held' end as decision from labels
union all select source_id, cast(updated_at as timestamp) as updated_at, cast(event_id as bigint) as event_id, cast(event_id % 3 as bigint) as turn, decision from ({DECISION_EVENTS}) y
"""

#: Five documents an entry; texts with lines that look like structure.
ENTRY_CLAIMS = """
select concat('e-', cast(cast(floor(doc_id / 5) as bigint) as string)) as id, doc_id, case when doc_id % 7 = 0 then '' else concat('k', cast(doc_id as string)) end as claim_id, split_part(text, chr(10), 1) as statement,
  case when doc_id % 3 = 0 then concat('translated ', substr(text, 1, 80), chr(10), '### not a claim', chr(10), '<!-- /annotation -->', chr(10), 'end') else '' end as translated_text,
  case doc_id % 4 when 0 then concat(text, chr(10), '<!-- annotation:original -->', chr(10), '### inside', chr(10), chr(92), '<!-- /annotation -->', chr(10), 'last') when 1 then concat('- claim_id: zz', chr(10), text) else text end as original_text,
  concat(text, chr(10), '## 주장 in a summary', chr(10), '### neither') as summary, case cast(floor(doc_id / 5) as bigint) % 4 when 0 then 'draft' when 1 then 'verified' when 2 then 'unknown' else 'superseded' end as status
from (select doc_id, coalesce(text, '') as text from documents) x
"""

#: Entries with the ids that they link to, some of which are none, and what is said of the links.
LINKED_ENTRIES = """
select cast(item_id as string) as id, concat_ws(',', cast(item_id + 1 as string), cast((item_id * 7 + 3) % 60 as string), case when item_id % 3 = 0 then cast(item_id - 1 as string) end, case when item_id % 4 = 1 then ' lost ' end, cast(item_id + 1 as string)) as related,
  case item_id % 5 when 0 then '{"relation":"broader","rationale":"same record"}' when 1 then '{"relation":"supports"}' when 2 then '{broken' when 3 then '' else '["no object"]' end as payload from benchmark
"""

RESP_CHUNKS = """
select cast(doc_id as string) as source_id, doc_id, concat('c', cast(doc_id as string)) as chunk_id,
  translate(coalesce(text, ''), concat(chr(34), chr(92), chr(13), chr(9)), '    ') as text
from documents
"""

#: One or two candidates a response; evidence from the begin and the middle of the chunk, over line ends, from another source's chunk, or none.
RESPONSES = f"""
select source_id, doc_id, case when doc_id % 29 = 3 then '' when doc_id % 31 = 4 then 'There is nothing to report.' when doc_id % 37 = 5 then '{{"answer":"no list"}}' else concat(
  case when doc_id % 4 = 0 then concat('Here is the result:', chr(10), chr(96), chr(96), chr(96), 'json', chr(10)) else '' end,
  '{{"wiki_candidates":[{{"title":"', case when doc_id % 11 = 0 then '' else replace(substr(text, 1, 30), chr(10), ' ') end,
  '","type":"', case doc_id % 13 when 0 then 'essay' when 1 then 'method' else 'argument' end,
  '","confidence":"', case when doc_id % 17 = 0 then 'certain' else 'high' end,
  '","summary_ko":"', case doc_id % 6 when 0 then 'a note' when 1 then '하나님의 은혜' when 2 then '은혜' else 'the text argues this' end, '","reuse_reason":"', case when doc_id % 5 = 1 then 'again' else '' end, '","evidence":[{{"chunk_id":"',
  case when doc_id % 5 = 0 then concat('forged', cast(doc_id as string)) when doc_id % 23 = 1 then '' else chunk_id end, '","quote":"',
  case doc_id % 7 when 1 then '' when 2 then concat(replace(substr(text, 1, 40), chr(10), concat(chr(92), 'n')), ' paraphrased') when 3 then replace(substr(text, 1, 700), chr(10), concat(chr(92), 'n')) else replace(substr(text, 1, 60), chr(10), concat(chr(92), 'n')) end,
  '","translation_ko":"t"}}', case when doc_id % 3 = 0 then concat(',{{"chunk_id":"', chunk_id, '","quote":"', replace(substr(text, 20 + cast(doc_id % 40 as int), 150), chr(10), concat(chr(92), 'n')), '"}}') else '' end,
  case when doc_id % 9 = 0 then concat(',{{"chunk_id":"c', cast(doc_id + 1 as string), '","quote":"elsewhere"}}') else '' end, ']}}',
  case when doc_id % 4 = 1 then concat(',{{', case when doc_id % 12 = 1 then '' else concat('"title":"second ', replace(substr(text, 1, 20), chr(10), ' '), '",') end, '"type":"concept","summary_ko":"it claims what follows","discipline_profile":"history","mapping_reason":"fits","evidence":[',
    case when doc_id % 8 = 5 then '' else concat('{{"chunk_id":" ', chunk_id, ' ","quote":" ', replace(substr(text, 30, 200), chr(10), concat(chr(92), 'n')), '"}}') end, ']}}') else '' end,
  case when doc_id % 19 = 0 then ',{{"title":"cut' else ']}}' end,
  case when doc_id % 4 = 0 then concat(chr(10), chr(96), chr(96), chr(96)) else '' end) end as raw
from ({RESP_CHUNKS}) x
"""

#: Three candidates a response, the second with braces, brackets and escapes in its text, and six kinds of damage.
DAMAGED = """
select cast(doc_id as string) as source_id, doc_id, t, concat('{"note":"a {brace","wiki_candidates" : [', a, case doc_id % 6 when 2 then concat(', {"title":', b) when 3 then concat(', "stray" ', b) else concat(', ', b) end,
  case doc_id % 6 when 0 then concat(', ', substr(c, 1, 25)) when 1 then concat(', {"title": broken}, ', c) when 2 then '' when 3 then concat(' , ', c, '] trailing } ] {') when 4 then concat(', ', c, ']') else concat(', {"title":"cut ', chr(92)) end) as raw
from (select doc_id, t, concat('{"title":"', t, '","type":"argument","evidence":[{"chunk_id":"c","quote":"q"}]}') as a, concat('{"title":"two ', chr(92), '"]}{[', chr(92), chr(92), '","type":"method","summary_ko":"', t, '"}') as b, concat('{"title":"three","type":"concept","summary_ko":"', t, '"}') as c
  from (select doc_id, translate(split_part(coalesce(text, ''), chr(10), 1), concat(chr(34), chr(92), chr(13), chr(9), chr(8), chr(12)), '      ') as t from documents) x) y
"""

def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables of ``sf_dir``, which are bound by name in it."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"from {t}" in sql}
    for table in used:
        sql = sql.replace(f"from {table}", f"from {{{table}}}")
    return spark.sql(_escaped(sql, used), **used)


def _escaped(sql: str, used: dict) -> str:
    """Braces other than those of table names are doubled for the formatter."""
    for table in used:
        sql = sql.replace(f"{{{table}}}", f"\0{table}\1")
    return sql.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
