"""Inputs that give the test tables the shape of postings, feeds, targets and runs.

The SQL is shared: Spark gets the tables as frames for the ``{names}``, the check SQL
gets the same text with the names of its views.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from gleaner.functions.phrases import Taxonomy

AS_OF = "2026-06-28 12:00:00"
WEEK = "1998-W20"

FIXTURE_TAXONOMY = Taxonomy.of({
    "articles": ["the", "der", "la", "le"],
    "connectives": ["and", "und", "que"],
    "prepositions": ["of", "in", "de", "the"],
    "phrases": ["of the", "in the", "and the"],
    "rare": ["rest", "zzzz"],
})

# Phrases that overlap in part: "in the of the", "that and the", …
OVERLAP_TAXONOMY = Taxonomy.of({
    "articles": ["the", "der", "la", "a"],
    "pairs": ["of the", "in the", "and the", "the of", "the in", "that and", "de la", "la de"],
    "chains": ["and of the", "de la le"],
    "single": ["in", "que"],
})

def large_phrases() -> dict[str, list[str]]:
    """Hundreds of phrases out of the syllables the tables' texts are made of."""
    syllables = "an ar at en er es ha he in is it nd nt on or ou re st th ti".split()
    words = [a + b for a in syllables for b in syllables]
    return {
        "words": words[::2],
        "pairs": [f"{w} {v}" for w, v in zip(["the", "of", "in", "and", "to"] * 12, [*words[:30], "the", "of", "in", "and", "to"] * 2, strict=False)],
        "dotted": [f"{w}. {v}" for w, v in zip(words[:40], ["the", "of", "and", "in"] * 10, strict=True)],
        "marked": ["the%%%", "of***", "of,", "the |", "and!!", "is ***", "to###"],
        "chains": ["of the", "in the", "the of", "and the", "the and", "and of the", "is of"],
    }


def large_taxonomy() -> Taxonomy:
    return Taxonomy.of(large_phrases(), edge="token")


# A taxonomy out of the documents: the first word, two words and three words of each.
OPENINGS = """
select skill, category, ord from (
  select lower(split_part(text, ' ', 1)) as skill, source as category, doc_id * 3 as ord from {documents}
  union all
  select lower(concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2))) as skill, source as category, doc_id * 3 + 1 as ord from {documents}
  union all
  select lower(concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))) as skill, source as category,
         doc_id * 3 + 2 as ord from {documents})
where length(skill) between 2 and 60 and skill not like '% ' and skill not like '%\n%'
"""

#: Keys that are looked up in the store; not all are there.
KEYS = [
    "http://therha.example.com/en/676", "https://therha.example.com/en/676", "https://m.tionsh.example.net/en/98",
    "https://therhe.example.org/en/8423", "http://nobody.example.org/en/1",
]

POSTINGS = """
select o_orderkey as posting_id, c_name as company,
       case when o_orderkey % 11 = 0 then '' else n_name end as location,
       case when o_orderkey % 13 = 0 then '' else cast(cast(o_orderdate as date) as string) end as date_posted,
       o_orderdate as scraped_at, o_orderpriority as source_site,
       case when o_orderstatus = 'F' then 0 else 1 end as is_active
from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

DOC_POSTINGS = """
select doc_id, source as title, c_name as company, n_name as location, text as raw_html,
       cast(cast(o_orderdate as date) as string) as date_posted, o_orderdate as scraped_at,
       case when o_orderstatus = 'F' then 0 else 1 end as is_active
from {documents} join {orders} on doc_id = o_orderkey
     join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
"""

# Three copies of every page's URL: as it is, with a tracking parameter, as it is again.
BATCH = """
select page_id * 3 as batch_pos, case when page_id % 17 = 0 then '' else url end as job_url,
       split_part(split_part(url, '//', 2), '/', 1) as source_site, 1 + page_id % 7 as page_no
from {pages}
union all
select page_id * 3 + 1 as batch_pos,
       case when url like '%?%' then concat(url, '&utm_medium=x') else concat(url, '?gclid=1') end as job_url,
       split_part(split_part(url, '//', 2), '/', 1) as source_site, 1 + page_id % 5 as page_no
from {pages}
union all
select page_id * 3 + 2 as batch_pos, url as job_url,
       split_part(split_part(url, '//', 2), '/', 1) as source_site, 1 + page_id % 3 as page_no
from {pages}
"""

# What an earlier run has stored: the English pages.
STORE = "select page_id, url as job_url from {pages} where url like '%/en/%'"

FEED = """
select p_partkey as part_key,
       case when p_partkey % 19 = 0 then '' else p_name end as position,
       p_brand as company,
       case when p_partkey % 2 = 0 then '' else concat(p_type, ', ') end as location,
       case p_partkey % 3 when 0 then concat('Pay: $', cast(p_size * 1000 as string), ' - $', cast(p_size * 1500 as string), ' gross')
                          when 1 then concat('about ', cast(p_size * 1000 as string), ' EUR')
                          else 'not disclosed' end as description,
       case p_partkey % 4 when 0 then '2026-06-23T23:30:00-05:00' when 1 then '2026-06-23' when 2 then 'yesterday or so' else '' end as date,
       case p_partkey % 5 when 0 then 'Ukraine' when 1 then 'Remote' when 2 then 'USA only' else lower(p_type) end as tag1,
       case p_partkey % 7 when 0 then 'europe' else p_brand end as tag2,
       case when p_partkey % 23 = 0 then '' else concat(replace(p_name, ' ', '-'), '-', cast(p_partkey as string)) end as slug,
       p_type as kind
from {part}
"""

RELDATE = """
select event_id,
       case event_id % 9 when 0 then concat(cast(event_id % 40 as string), ' days ago')
            when 1 then concat(' ', cast(event_id % 5 as string), ' Week ago')
            when 2 then concat(cast(event_id % 6 as string), ' months ago')
            when 3 then concat(cast(event_id % 50 as string), ' hours ago')
            when 4 then 'Posted TODAY' when 5 then 'yesterday'
            when 6 then concat('on ', cast(cast(ts as date) as string))
            when 7 then '02/30/2024' else 'Soon' end as txt
from {events}
"""

TARGETS = """
select s_name as name,
       concat('https://jobs', cast(s_nationkey as string), '.example.com/list',
              case s_nationkey % 3 when 0 then '?q=dev' when 1 then '/{{page}}' else '' end) as base_url,
       case when s_nationkey % 3 = 1 then 'path' when s_acctbal < 2000 then 'cursor' else 'query_param' end as page_strategy,
       case when s_acctbal < 5000 then 'page' else 'p' end as page_param,
       1 + s_nationkey % 5 as max_pages,
       case when s_acctbal < 1000 then 0 else 1 end as enabled
from {supplier}
"""

YIELD = """
select user_id as source_site, cast(extract(day from ts) as bigint) as page_no,
       cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as n_jobs
from {events} group by user_id, extract(day from ts)
"""

RUNS = """
select cast(floor(event_id / 10) as bigint) as run_id, min(ts) as started_at, max(ts) as completed_at,
       count(*) as pages_scraped,
       cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as jobs_found,
       cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as jobs_inserted,
       cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as jobs_deduplicated,
       cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as errors_encountered,
       case when sum(case when event_type = 'error' then 1 else 0 end) > 3 then 'failed' else 'completed' end as status
from {events} group by cast(floor(event_id / 10) as bigint)
"""

# Customers as postings in the markup of a board: a page holds those of a nation among 2,500 in turn, so that pages
# grow in number and not in length.
CARDS = """
select cast(c_nationkey + 25 * floor(c_custkey / 2500) as bigint) as page_id, c_custkey as k, c_name as name, c_mktsegment as segment, c_custkey % 3 as kind,
       cast(c_custkey % 9 as string) as days
from {customer}
"""
# The same text is valid in both engines: two kinds of containers, which a page holds in turn.
GENERIC_CARD = """
case when kind = 0 then concat('<div data-job="', cast(k as string), '"><h3>', name, '</h3><span class="employer">', segment,
       '</span><span class="region">R', days, '</span><a href="/j/', cast(k as string), '">go</a><time>', days, ' days ago</time></div>')
     when kind = 1 then concat('<div class="job new"><p class="title">', name, '</p><p class="company">', segment,
       '</p><p class="salary">$', days, 'k</p><a class="x" href="j/', cast(k as string), '">go</a><i class="posted">today</i></div>')
     else concat('<div class="jobless"><p class="title">', name, '</p></div>') end
"""
TABLE_CARD = """
concat('<table><tr class="job', case when kind = 0 then ' placeholder' else '' end, '"><td class="position"><a href="/p/', cast(k as string),
       '"><h2>', name, '</h2></a></td><td class="company">', segment, '</td><td class="location">L', days, '</td><td class="time">',
       days, ' days ago</td></tr></table>')
"""
PLAIN_CARD = """
concat('<ul><li', case when kind = 0 then ' class="view-all"' else '' end, '><a href="/c/', cast(k as string), '">c</a><a href="/listings/',
       cast(k as string), '"><span class="title">', name, '</span></a><span class="company">', segment, '</span></li></ul>')
"""
STAMP_CARD = """
case when kind = 0 then concat('<section class="jobs"><article><ul><li class="feature"><a href="/remote-jobs/', cast(k as string),
       '"><span class="title">', name, '</span></a><time datetime="2026-06-0', cast(1 + k % 9 as string), 'T10:00:00Z">x</time></li></ul></article></section>')
     when kind = 1 then concat('<ol class="jobs-list"><li><a href="/o/', cast(k as string), '"><span class="title">', name,
       '</span></a><span class="date">', days, ' days ago</span></li></ol>')
     else concat('<div class="job"><h4>', name, '</h4><a href="/d/', cast(k as string), '">d</a><time>', days, ' days ago</time></div>') end
"""

# URLs with parameters to sort, drop and re-encode.
PARAM_URLS = """
select o_orderkey,
       concat('HTTP://WWW.Shop', cast(o_custkey as string), '.Example.com/Item/', case when o_orderstatus = 'F' then '/' else '' end,
              '?size=', o_orderpriority, '&UTM_Source=x&blank=&Color=', o_orderstatus, '%2', case when o_orderstatus = 'O' then 'C' else 'x' end,
              '&ref=7#top') as url
from {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(sql: str) -> list[str]:
    return sorted({field for _, field, _, _ in string.Formatter().parse(sql) if field})


def frame(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    return spark.sql(sql, **{n: given[n] if n in given else table(spark, sf_dir, n) for n in _names(sql)})


def text(sql: str) -> str:
    """The same input for the check SQL."""
    return sql.format(**{n: n for n in _names(sql)})
