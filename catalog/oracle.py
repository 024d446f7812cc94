"""The check SQL: the same results in DuckDB's SQL, written without the library's code."""

from __future__ import annotations

from catalog import inputs
from catalog.inputs import AS_OF, KEYS, WEEK, text

P = text(inputs.POSTINGS)
D = text(inputs.DOC_POSTINGS)
BATCH = text(inputs.BATCH)
STORE = text(inputs.STORE)
FEED = text(inputs.FEED)
TARGETS = text(inputs.TARGETS)
YIELD = text(inputs.YIELD)
CARDS = text(inputs.CARDS)
RUNS = text(inputs.RUNS)

WEEK_OF = "strftime(case when date_posted = '' then cast(scraped_at as date) else cast(date_posted as date) end, '%Y-W%W')"
POSTINGS = f"select *, {WEEK_OF} as week_key from ({P})"
DOC_POSTINGS = f"select *, {WEEK_OF} as week_key from ({D})"


def _round(x: str, digits: int) -> str:
    """Round the binary value of a non-negative double, ties to even."""
    bits, scale = (57, 10) if digits == 1 else (56, 100)
    frac = f"(cast(floor(({x} - floor({x})) * {float(1 << bits):.1f}) as hugeint) * {scale})"
    digit, left, half = f"({frac} // {1 << bits})", f"({frac} % {1 << bits})", 1 << (bits - 1)
    up = f"(case when {left} > {half} or ({left} = {half} and {digit} % 2 = 1) then 1 else 0 end)"
    return f"(cast(cast(floor({x}) as hugeint) * {scale} + {digit} + {up} as double) / {float(scale)})"


def pct(part: str, whole: str) -> str:
    x = f"(cast({part} as double) / cast({whole} as double) * 100)"
    return f"(case when {whole} = 0 then 0.0 else {_round(x, 1)} end)"


def avg(total: str, n: str) -> str:
    x = f"(cast({total} as double) / cast({n} as double))"
    return f"(case when {n} = 0 then 0.0 else {_round(x, 2)} end)"


# Tracking and blank parameters out, names in order, host without www., one slash off.
_TRACKING = (
    "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','ttclid','msclkid',"
    "'ref','source','campaign','affiliate','aff_id','subid','clickid','wbraid','gbraid'"
)


def url_key(u: str) -> str:
    bare = f"split_part({u}, '#', 1)"
    head = f"split_part({bare}, '?', 1)"
    query = f"(case when contains({bare}, '?') then substr({bare}, strpos({bare}, '?') + 1) else '' end)"
    host = f"regexp_replace(lower(split_part(split_part({head}, '//', 2), '/', 1)), '^www\\.', '')"
    path = f"regexp_replace({head}, '^[^/]*//[^/]*', '')"
    path = f"(case when {path} <> '/' then regexp_replace({path}, '/$', '') else {path} end)"
    kept = (
        f"list_filter(string_split({query}, '&'), lambda p: contains(p, '=') and split_part(p, '=', 2) <> '' "
        f"and lower(split_part(p, '=', 1)) not in ({_TRACKING}))"
    )
    ordered = (
        f"list_transform(list_sort(list_transform({kept}, lambda p: {{'k': lower(split_part(p, '=', 1)), 'p': p}})), lambda s: s.p)"
    )
    params = f"array_to_string({ordered}, '&')"
    return (
        f"(case when {u} = '' then '' else lower(split_part({head}, ':', 1)) || '://' || {host} || {path} "
        f"|| (case when {params} = '' then '' else '?' || {params} end) end)"
    )


KEYED = f"select *, {url_key('job_url')} as url_key from ({BATCH})"
STORED = f"select {url_key('job_url')} as url_key from ({STORE})"
LABELLED = f"""
select b.*, case when b.url_key = '' then 'blank_url'
                 when b.rn > 1 then 'duplicate_batch'
                 when b.url_key in (select url_key from ({STORED})) then 'duplicate_store' else 'kept' end as status
from (select *, row_number() over (partition by url_key order by batch_pos) as rn from ({KEYED})) b
"""


# Fixed values: (phrase, category, place of the category), longest phrases first, then as they are listed.
FIXTURE_PHRASES = [
    ("and the", "phrases", 3), ("of the", "phrases", 3), ("in the", "phrases", 3), ("rest", "rare", 4), ("zzzz", "rare", 4),
    ("the", "articles", 0), ("der", "articles", 0), ("and", "connectives", 1), ("und", "connectives", 1), ("que", "connectives", 1),
    ("la", "articles", 0), ("le", "articles", 0), ("of", "prepositions", 2), ("in", "prepositions", 2), ("de", "prepositions", 2),
]
OVERLAP_PHRASES = [
    ("and of the", "chains", 2), ("that and", "pairs", 1), ("de la le", "chains", 2), ("and the", "pairs", 1), ("of the", "pairs", 1),
    ("in the", "pairs", 1), ("the of", "pairs", 1), ("the in", "pairs", 1), ("de la", "pairs", 1), ("la de", "pairs", 1),
    ("the", "articles", 0), ("der", "articles", 0), ("que", "single", 3), ("la", "articles", 0), ("in", "single", 3), ("a", "articles", 0),
]
N_CATEGORIES = 5


# Every phrase in turn, longest first: its places between word boundaries that do not
# start inside a span some earlier phrase has taken.
def mentions(base: str, key: str, body: str, phrases: list[tuple[str, str, int]]) -> str:
    word = r"[\p{L}\p{N}_]"
    ctes = [f"txt as (select {key} as id, lower({body}) as l from ({base}))"]
    taken = []
    for k, (phrase, _, _) in enumerate(phrases):
        parts = f"string_split(l, '{phrase}')"
        ctes.append(f"""
raw{k} as (
  select id, i, n, piece, lead(piece) over w as following, lead(i) over w = n as last_next,
         cast(sum(length(piece)) over w + (i - 1) * {len(phrase)} as bigint) as s
  from (select id, unnest({parts}) as piece, generate_subscripts({parts}, 1) as i, len({parts}) as n
        from txt where contains(l, '{phrase}'))
  window w as (partition by id order by i rows between unbounded preceding and current row)
)""".replace("lead(piece) over w", "lead(piece) over (partition by id order by i)").replace(
            "lead(i) over w", "lead(i) over (partition by id order by i)"))
        free = ""
        if taken:
            spans = " union all ".join(f"select * from span{j}" for j in taken)
            free = f"and not exists (select 1 from ({spans}) t where t.id = r.id and r.s >= t.b and r.s < t.e)"
        ctes.append(f"""
span{k} as (
  select id, s as b, s + {len(phrase)} as e from raw{k} r
  where i < n
    and (case when piece = '' then i = 1 else not regexp_matches(right(piece, 1), '{word}') end)
    and (case when following = '' then last_next else not regexp_matches(left(following, 1), '{word}') end)
    {free}
)""")
        taken.append(k)
    found = " union all ".join(
        f"select distinct id, '{p}' as skill, '{category}' as category, {place} as category_ord from span{k}"
        for k, (p, category, place) in enumerate(phrases)
    )
    return "with " + ",".join(ctes) + f" select id as {key}, skill, category, category_ord from ({found})"


# Phrases as a table (skill, category, ord): every place where one stands between token edges; places that overlap
# form an island, in which the longest phrase and then the first listed takes its span, and a place that starts
# inside a taken span is out.
def mentions_of(base: str, key: str, body: str, phrases: str, most_tokens: int = 9) -> str:
    word = r"[\p{L}\p{N}_]"
    return f"""
with ph as (
  select skill, arg_min(category, ord) as category, length(skill) as n, row_number() over (order by length(skill) desc, min(ord)) as prio
  from ({phrases}) group by skill),
tok as (
  select id, t, i, string_agg(t, '') over (partition by id order by i rows between current row and {most_tokens} following) as tail,
         sum(length(t)) over (partition by id order by i) - length(t) as s, lag(t) over (partition by id order by i) as before
  from (select id, unnest(ts) as t, generate_subscripts(ts, 1) as i
        from (select {key} as id, regexp_extract_all(lower({body}), '{word}+|[^\\p{{L}}\\p{{N}}_]') as ts from ({base})))),
hit as (
  select id, s, s + n as e, prio, skill, category from tok join ph on left(tail, 2) = left(skill, 2) and starts_with(tail, skill)
  where (before is null or not regexp_matches(right(before, 1), '{word}')) and not regexp_matches(substr(tail, n + 1, 1), '{word}')),
isl as (
  select *, sum(case when s < reach then 0 else 1 end) over (partition by id order by s, e rows unbounded preceding) as island
  from (select *, max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) as reach from hit)),
folded as (
  select id, list_reduce(list_transform(list({{'p': prio, 's': s, 'e': e, 'skill': skill, 'category': category}} order by prio, s), lambda x: [x]),
    lambda acc, x: case when len(list_filter(acc, lambda y: x[1].s >= y.s and x[1].s < y.e)) > 0 then acc else list_concat(acc, x) end) as taken
  from isl group by id, island)
select distinct id as {key}, m.skill as skill, m.category as category from (select id, unnest(taken) as m from folded)
"""


def listed(categories: dict[str, list[str]]) -> str:
    rows = [(p, c) for c, phrases in categories.items() for p in phrases]
    return "select * from (values " + ", ".join(f"('{p}', '{c}', {i})" for i, (p, c) in enumerate(rows)) + ") as v(skill, category, ord)"


DOC_MENTIONS = mentions("select doc_id, text from documents", "doc_id", "text", FIXTURE_PHRASES)
ACTIVE_DOCS = f"select * from ({DOC_POSTINGS}) where is_active = 1"
POST_MENTIONS = mentions(DOC_POSTINGS, "doc_id", "title || ' ' || company || ' ' || raw_html", FIXTURE_PHRASES)
ACTIVE_MENTIONS = mentions(ACTIVE_DOCS, "doc_id", "title || ' ' || company || ' ' || raw_html", FIXTURE_PHRASES)

FREQ = f"""
select skill, any_value(category) as category, any_value(category_ord) as category_ord, count(*) as n,
       (select count(*) from documents) as jobs
from ({DOC_MENTIONS}) group by skill
"""
ACTIVE_FREQ = f"""
select skill, any_value(category) as category, any_value(category_ord) as category_ord, count(*) as n,
       (select count(*) from ({ACTIVE_DOCS})) as jobs
from ({ACTIVE_MENTIONS}) group by skill
"""


def top(freq: str, k: int) -> str:
    return f"""
select row_number() over (order by n desc, skill) as rank, skill, n, {pct('n', 'jobs')} as pct, category
from ({freq}) qualify rank <= {k}
"""


def by_category(freq: str, k: int) -> str:
    return f"""
select category, category_ord, row_number() over (partition by category order by n desc, skill) as rank, skill, n,
       {pct('n', 'jobs')} as pct
from ({freq}) qualify rank <= {k}
"""


def cat_stats(freq: str) -> str:
    return f"""
select category, category_ord, cast(sum(n) as bigint) as total_mentions, count(*) as unique_skills
from ({freq}) group by category, category_ord
"""


def summary(jobs: str, found: str) -> str:
    return f"""
select jobs, mentions, unique_skills, {avg('mentions', 'jobs')} as avg_skills
from (select (select count(*) from ({jobs})) as jobs, count(*) as mentions, count(distinct skill) as unique_skills
      from ({found}))
"""


FEED_ROWS = f"""
select f.*, e.pos, e.url from ({FEED}) f, lateral (
  select * from (values (0, slug, 'ECONOMY'), (1, slug, ''), (2, cast(part_key as string), '')) v(pos, url, only_kind)
  where (f.kind = 'ECONOMY') = (only_kind = 'ECONOMY')) e
"""
FEED_LOCATION = """
case when location <> '' then location else coalesce(nullif(array_to_string(list_filter([tag1, tag2],
     lambda t: regexp_matches(lower(t), 'remote|usa|europe|asia|americas|worldwide|uk|canada|germany|france|australia')), ', '), ''), 'Remote') end
"""
SALARY = (
    r"regexp_extract(description, '[$€£]\s*[\d,]+\s*[–-]\s*[$€£]?\s*[\d,]+|\$\d+[kK][\s–-]+\$?\d+[kK]|"
    r"[\d,]+\s*(USD|EUR|GBP|per year|per month|/yr|/month)', 0)"
)
FEED_URL = "case when url = '' then '' else 'https://remoteok.com/remote-jobs/' || url end"
FEED_POSTINGS = f"""
select part_key, cast(pos as bigint) as pos, trim(position) as title, trim(company) as company, {FEED_LOCATION} as location,
       {SALARY} as salary_range, substr(date, 1, 10) as date_posted, {FEED_URL} as job_url, 'remoteok' as source_site
from ({FEED_ROWS})
"""
FEED_ERRORS = f"""
select company, (length(trim(title)) < 2) as bad_title, (job_url = '') as no_url from ({FEED_POSTINGS})
"""

SCRIPTLESS = "regexp_replace(regexp_replace(html, '<script\\b.*?</script>', '', 'gs'), '<style\\b.*?</style>', '', 'gs')"
ORIGIN = "split_part(url, '//', 1) || '//' || split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '#', 1)"
HOST = "regexp_replace(lower(split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '#', 1)), '^www\\.', '')"
HOST_ALL = "lower(split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '#', 1))"
ENTITIES = (
    "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)

AS = f"cast('{AS_OF}' as timestamp)"


def markdown(freq: str, jobs: str, found: str, rows: str) -> str:
    """Report lines, section by section; headings are fixed values."""
    def num(x):
        return f"format('{{:,}}', cast({x} as bigint))"

    def title(x, sep="-"):
        return (
            f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
        )

    def const(section, start, lines, source="", o="0"):
        body = ", ".join("'" + x.replace("'", "''") + "'" if not x.startswith("=") else x[1:] for x in lines)
        return (
            f"select {section} as section, cast(({o}) * 1000 + i - 1 + {start} as bigint) as ord, l as line from "
            f"(select {'*,' if source else ''} unnest([{body}]) as l, generate_subscripts([{body}], 1) as i {source})"
        )

    s = f"({summary(jobs, found)})"
    top10 = f"({top(freq, 10)})"
    cats = f"({cat_stats(freq)})"
    per = f"({by_category(freq, 5)})"
    unions = [
        const(1, 0, [
            "# Weekly Skills Report", "", f"**Generated:** {AS_OF}", f"='**Total Jobs Analyzed:** ' || {num('jobs')}", "",
            "## Executive Summary", "",
            f"='**' || {num('jobs')} || ' job postings** mention **' || unique_skills || ' different skills** in "
            f"{N_CATEGORIES} categories, on average **' || cast(avg_skills as varchar) || ' skills** each.'",
        ], f"from {s}"),
        f"select 2, 0, '**Period:** ' || strftime(max(cast(date_posted as date)), '%Y-W%W') from ({jobs})",
        const(3, 0, ["## Top 10 Most In-Demand Skills", "", "| Rank | Skill | Mentions | % of Jobs | Category |",
                     "|------|-------|----------|-----------|----------|"]),
        f"select 3, rank * 1000, '| ' || rank || ' | **' || {title('skill')} || '** | ' || {num('n')} || ' | ' || cast(pct as varchar) "
        f"|| '% | ' || {title('category')} || ' |' from {top10}",
        const(4, 0, ["## Skills by Category", ""]),
        const(4, 0, [f"='### ' || {title('category')}", "", f"='- **Total Mentions:** ' || {num('total_mentions')}",
                     "='- **Unique Skills:** ' || unique_skills", "", "| Skill | Mentions | % of Jobs |",
                     "|-------|----------|-----------|"], f"from {cats}", "category_ord * 10 + 10"),
        f"select 4, (category_ord * 10 + 10 + rank) * 1000, '| ' || {title('skill')} || ' | ' || {num('n')} || ' | ' "
        f"|| cast(pct as varchar) || '% |' from {per}",
    ]
    for section, column, head in (
        (5, "location", ["## Job Count by Location", "", "| Location | Job Count |", "|----------|-----------|"]),
        (6, "company", ["## Top Hiring Companies", "", "| Company | Job Postings |", "|---------|-------------|"]),
    ):
        unions.append(const(section, 0, head))
        unions.append(
            f"select {section}, rank * 1000, '| ' || name || ' | ' || {num('n')} || ' |' from (select {column} as name, count(*) as n, "
            f"row_number() over (order by count(*) desc, {column}) as rank from ({rows}) where {column} <> '' group by {column} qualify rank <= 15)"
        )
    unions.append(const(7, 0, ["## Methodology", "", (
        "Skills are phrases of a taxonomy, matched as whole words without regard to case. "
        "A posting counts once for each skill it mentions; postings are unique by URL.")]))
    body = " union all ".join(f"({u})" for u in unions)
    return f"select cast(section as bigint) as section, cast(ord as bigint) as ord, line from ({body}) t(section, ord, line)"


def json_rows(freq: str, jobs: str, found: str, rows: str, period: str) -> str:
    skills = "list({'skill': skill, 'count': n, 'percentage': pct} order by rank)"
    dist = "to_json({{'name': {c}, 'count': count(*)}})"
    return f"""
select 'summary' as section, cast(to_json({{'generated_at': '{AS_OF}', 'total_jobs_analyzed': jobs,
  'total_skill_mentions': mentions, 'unique_skills_found': unique_skills, 'avg_skills_per_job': avg_skills}}) as varchar) as json
from ({summary(jobs, found)})
union all
select 'period', cast(to_json(p) as varchar) from ({period}) p
union all
select 'top_10_skills', cast(to_json({{'rank': rank, 'skill': skill, 'count': n, 'percentage_of_jobs': pct, 'category': category}}) as varchar)
from ({top(freq, 10)})
union all
select 'skills_by_category', cast(to_json({{'category': category, 'total_mentions': total_mentions, 'unique_skills': unique_skills,
  'top_skills': top_skills}}) as varchar)
from ({cat_stats(freq)}) join (select category, {skills} as top_skills from ({by_category(freq, 5)}) group by category) using (category)
union all
select 'location_distribution', cast({dist.format(c='location')} as varchar) from ({rows}) where location <> '' group by location
union all
select 'company_distribution', json from (select cast({dist.format(c='company')} as varchar) as json, count(*) as n, company
  from ({rows}) where company <> '' group by company order by n desc, company limit 20)
"""


RELDATE = f"""
select event_id, case event_id % 9
  when 0 then strftime({AS} - to_days(cast(event_id % 40 as int)), '%Y-%m-%d')
  when 1 then strftime({AS} - to_days(cast(event_id % 5 * 7 as int)), '%Y-%m-%d')
  when 2 then strftime({AS} - to_days(cast(event_id % 6 * 30 as int)), '%Y-%m-%d')
  when 3 then strftime({AS} - to_hours(cast(event_id % 50 as int)), '%Y-%m-%d')
  when 4 then strftime({AS}, '%Y-%m-%d') when 5 then strftime({AS} - to_days(1), '%Y-%m-%d')
  when 6 then strftime(ts, '%Y-%m-%d') when 7 then '02/30/2024' else 'soon' end as parsed
from events
"""

PERIOD = """
select strftime(max(d), '%Y-W%W') as week_key, strftime(min(d), '%Y-%m-%d') as start_date, strftime(max(d), '%Y-%m-%d') as end_date
from (select try_cast(date_posted as date) as d from ({}))
"""

STOPS = f"""
select source_site, min(page_no) as stop_page
from (select *, lag(page_no) over w as before_no, lag(n_jobs) over w as before from ({YIELD}) window w as (partition by source_site order by page_no))
where n_jobs = 0 and before = 0 and before_no = page_no - 1 group by source_site
"""

# Pages to stored rows: list items of the pages that are no blogs; a link counts once per target on its first
# page, rows need a title of two letters, and the first row of a key is stored. No page of the tables is empty.
BOARD_PAGES = f"""
select page_id, url, html, regexp_extract({HOST_ALL}, '[^.]*$') as target, page_id % 20 + 1 as page_no from pages
"""
BOARD = f"""
select *, row_number() over (partition by key order by target, page_id, pos) = 1 as is_first, page_id || '-' || pos as id
from (select *, {url_key('job_url')} as key from (
  select *, min(page_no) over (partition by target, job_url) as first_page from (
    select page_id, target, page_no, i as pos, li, trim(regexp_extract(li, '<a[^>]*>(.*?)</a>', 1)) as title,
           {ORIGIN} || regexp_extract(li, 'href="([^"]*)"', 1) as job_url
    from (select page_id, url, target, page_no, unnest(lis) as li, generate_subscripts(lis, 1) as i
          from (select *, regexp_extract_all({SCRIPTLESS}, '(?s)<li>.*?</li>') as lis from ({BOARD_PAGES}) where {HOST} not like 'blog.%'))))
  where page_no = first_page and length(title) >= 2)
"""

ORACLE: dict[str, str] = {
    "q_feed_scan": f"select part_key, cast(pos as bigint) as pos, position from ({FEED_ROWS})",
    "q_feed_landed": f"select company, count(*) as n, count(distinct job_url) as urls from ({FEED_POSTINGS}) group by company",
    "q_feed_postings": FEED_POSTINGS,
    "q_feed_raw": f"""
select part_key, cast(pos as bigint) as pos, tag1 || ', ' || tag2 as tags, part_key % 5 = 0 as late,
       case when part_key % 5 = 0 then repeat('filler ', 900) || description || ' late' else description end as description
from ({FEED_ROWS})""",
    "q_feed_unknown": f"""
select field, kind, count(*) as n, count(distinct value) as values, max(value) as last from (
  select 'pay_from' as field, 'BIGINT' as kind, cast(part_key as varchar) as value from ({FEED})
  union all select 'verified', 'BOOLEAN', case when part_key % 2 = 0 then 'true' else 'false' end from ({FEED})
  union all select 'staff', 'OBJECT<lead: STRING, team: ARRAY<STRING>>', company from ({FEED})
  union all select 'logo', 'STRING', tag2 from ({FEED}) where part_key % 3 = 0)
group by field, kind""",
    "q_feed_broken": f"""
select case part_key % 4 when 0 then 'whole' when 1 then 'cut' when 2 then 'markup' else 'object' end as kind,
       cast(sum(case when part_key % 4 = 0 and kind <> 'ECONOMY' then 2 else 1 end) as bigint) as n, count(*) filter (where part_key % 4 <> 0) as unparsed
from ({FEED}) group by 1""",
    "q_location_infer": f"select part_key, {FEED_LOCATION} as value from ({FEED})",
    "q_salary_extract": f"select part_key, {SALARY} as value from ({FEED})",
    "q_posted_date": f"select part_key, substr(date, 1, 10) as value from ({FEED})",
    "q_relative_date": RELDATE,
    "q_validity": f"""
select 'Missing or invalid title' as reason, count(*) as n from ({FEED_ERRORS}) where bad_title having count(*) > 0
union all select 'Missing job URL', count(*) from ({FEED_ERRORS}) where no_url having count(*) > 0""",
    "q_quarantine": f"""
select company, count(*) filter (where not bad_title and not no_url) as valid,
       count(*) filter (where bad_title or no_url) as rejected from ({FEED_ERRORS}) group by company""",
    "q_page_listings": f"""
select page_id, cast(0 as bigint) as pos, {ENTITIES.format("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")} as title,
       '' as job_url, 'blog' as source_site
from pages where {HOST} like 'blog.%'
union all
select page_id, cast(i - 1 as bigint), trim(regexp_extract(li, '<a[^>]*>(.*?)</a>', 1)),
       {ORIGIN} || regexp_extract(li, 'href="([^"]*)"', 1), 'list'
from (select page_id, url, unnest(lis) as li, generate_subscripts(lis, 1) as i
      from (select page_id, url, regexp_extract_all({SCRIPTLESS}, '(?s)<li>.*?</li>') as lis from pages where {HOST} not like 'blog.%'))""",
    "q_page_links": f"""
select page_id, cast(i - 1 as bigint) as pos, href, {ORIGIN} || href as job_url
from (select page_id, url, unnest(hrefs) as href, generate_subscripts(hrefs, 1) as i
      from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hrefs from pages))""",
    "q_source_detect": f"""
select case when contains(h, 'blog.') then 'blog' when contains(h, 'spam') then 'spam' when contains(h, 'm.') then 'mobile'
            else 'generic' end as source_site, count(*) as n
from (select lower(split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '#', 1)) as h from pages) group by 1""",
    "q_target_filter": f"select name, base_url from ({TARGETS}) where enabled = 1 and contains(lower(name), 'pplier#0000000')",
    "q_page_plan": f"""
select name, page_no, case page_strategy
  when 'query_param' then base_url || (case when contains(base_url, '?') then '&' else '?' end) || page_param || '=' || page_no
  when 'path' then replace(base_url, '{{page}}', cast(page_no as varchar)) else base_url end as page_url
from (select *, cast(unnest(range(1, max_pages + 1)) as bigint) as page_no from ({TARGETS}) where enabled = 1)""",
    "q_pagination_stop": f"""
select y.source_site, coalesce(any_value(s.stop_page), max(y.page_no)) as last_page
from ({YIELD}) y left join ({STOPS}) s on y.source_site = s.source_site group by y.source_site""",
    "q_fetched_pages": f"""
select y.* from ({YIELD}) y left join ({STOPS}) s on y.source_site = s.source_site
where s.stop_page is null or y.page_no <= s.stop_page""",
    "q_url_normalize": f"select batch_pos, url_key from ({KEYED})",
    "q_url_normalize_params": """
select o_orderkey, 'http://shop' || o_custkey || '.example.com/Item' || (case when o_orderstatus = 'F' then '/' else '' end)
       || '?Color=' || o_orderstatus || (case when o_orderstatus = 'O' then '%2C' else '%252x' end)
       || '&size=' || replace(o_orderpriority, ' ', '+') as url_key
from orders""",
    "q_tracking_params": f"""
select param, count(*) as n from (
  select lower(split_part(unnest(string_split(regexp_extract(split_part(job_url, '#', 1), '\\?(.*)', 1), '&')), '=', 1)) as param from ({BATCH}))
where param in ({_TRACKING}) group by param""",
    "q_week_key": """
select strftime(d, '%Y-W%W') as week_key, count(*) as n
from (select o_orderdate as d from orders union all select ts from events) group by 1""",
    "q_posting_scan": f"select posting_id, company, location, week_key from ({POSTINGS}) where is_active = 1 and source_site = '1-URGENT'",
    "q_posting_scan_latest": f"""
select posting_id, company, location, week_key from ({POSTINGS}) where is_active = 1 order by scraped_at desc, posting_id limit 50""",
    "q_weekly_scan": f"select posting_id, company, location, week_key from ({POSTINGS}) where is_active = 1 and week_key = '{WEEK}'",
    "q_store_stats": f"""
select count(*) as total, count(*) filter (where week_key = '{WEEK}') as this_week,
       count(distinct nullif(company, '')) as companies, count(distinct nullif(location, '')) as locations from ({POSTINGS})""",
    "q_by_source": f"select source_site, count(*) as n from ({POSTINGS}) group by source_site",
    "q_location_dist": f"""
select location as name, count(*) as n from ({POSTINGS}) where week_key = '{WEEK}' and location <> '' group by location""",
    "q_company_dist": f"""
select company as name, count(*) as n from ({POSTINGS}) where week_key = '{WEEK}' and company <> ''
group by company order by n desc, name limit 20""",
    "q_company_dist_all": f"""
select company as name, count(*) as n from ({POSTINGS}) where company <> '' group by company order by n desc, name limit 20""",
    "q_period": PERIOD.format(P),
    "q_existing_keys": f"select distinct url_key from ({KEYED}) where url_key <> '' and url_key in (select url_key from ({STORED}))",
    "q_url_stored": f"""
select k as url_key, cast(k in (select {url_key('url')} from pages) as bigint) as stored
from (select unnest([{', '.join(repr(k) for k in KEYS)}]) as k)""",
    "q_dedup_positions": f"""
select url_key, count(*) as n, count(distinct batch_pos) as rows, cast(case when url_key = '' then 0 else 1 end as bigint) as kept,
       case when url_key <> '' then coalesce(min(place), -1) end as place
from (select *, case when batch_pos % 4 <> 0 then batch_pos % 5 end as place from ({KEYED})) group by url_key""",
    "q_dedup_batch": f"select url_key, min(batch_pos) as batch_pos from ({KEYED}) where url_key <> '' group by url_key",
    "q_dedup_against_store": f"select batch_pos from ({LABELLED}) where status = 'kept'",
    "q_dedup_status": f"select batch_pos, url_key, status from ({LABELLED})",
    "q_dedup_summary": f"""
select kept_count, removed_count, blank_count, {pct('removed_count', '(kept_count + removed_count)')} as dedup_rate
from (select count(*) filter (where status = 'kept') as kept_count, count(*) filter (where status like 'duplicate%') as removed_count,
             count(*) filter (where status = 'blank_url') as blank_count from ({LABELLED}))""",
    "q_dedup_audit": f"select job_url, status as reason from ({LABELLED}) where status like 'duplicate%'",
    "q_cross_page_dedup": f"""
select batch_pos, page_no, job_url from (
  select *, min(page_no) over (partition by source_site, job_url) as first_page from ({BATCH})) where page_no = first_page""",
    "q_union_sources": f"""
select 'pages' as source_site, count(*) as n, count(*) as with_url, cast(0 as bigint) as with_location from pages
union all select source_site, count(*), 0, count(location) from ({POSTINGS}) group by source_site""",
    "q_idempotent_append": f"""
select r.run_no, case when r.run_no = 1 then s.kept else 0 end as inserted,
       case when r.run_no = 1 then s.dup else s.dup + s.kept end as skipped, s.blank
from (select unnest([cast(1 as bigint), 2]) as run_no) r,
     (select count(*) filter (where status = 'kept') as kept, count(*) filter (where status like 'duplicate%') as dup,
             count(*) filter (where status = 'blank_url') as blank from ({LABELLED})) s""",
    "q_stored_postings": f"""
select k.url_key, k.job_url, '2026-W25' as week_key, trim(regexp_extract(p.html, '<h1>(.*?)</h1>', 1)) as title, {HOST} as company,
       length(p.html) as size
from (select url_key, arg_min(job_url, batch_pos) as job_url, min(batch_pos) // 3 as page_id from ({KEYED}) where url_key <> '' group by url_key) k
join pages p using (page_id)""",
    "q_run_log": f"""
select cast(case when blog then 1 else 2 end as bigint) as run_id, case when blog then 'blogs' else 'others' end as source_site,
       'completed' as status, count(distinct page_no) as pages_scraped, count(*) filter (where ok) as jobs_found,
       count(distinct url_key) filter (where ok) as jobs_inserted,
       count(*) filter (where ok) - count(distinct url_key) filter (where ok) as jobs_deduplicated, cast(0 as bigint) as errors_encountered
from (select *, source_site like 'blog.%' as blog, job_url <> '' as ok from ({KEYED})) group by blog""",
    "q_run_counters": f"""
select source_site, count(distinct page_no) as pages_scraped, count(*) as jobs_found, count(*) filter (where status = 'kept') as jobs_inserted,
       count(*) filter (where status like 'duplicate%') as jobs_deduplicated, cast(0 as bigint) as errors_encountered
from ({LABELLED}) group by source_site""",
    "q_run_totals": f"""
select count(*) filter (where status = 'completed') as targets_processed,
       cast(sum(pages_scraped) filter (where status = 'completed') as bigint) as pages_scraped,
       cast(sum(jobs_found) filter (where status = 'completed') as bigint) as jobs_found,
       cast(sum(jobs_inserted) filter (where status = 'completed') as bigint) as jobs_inserted,
       cast(sum(jobs_deduplicated) filter (where status = 'completed') as bigint) as jobs_deduplicated,
       cast(sum(errors_encountered) filter (where status = 'completed') + count(*) filter (where status = 'failed') as bigint) as errors_encountered
from ({RUNS})""",
    "q_run_latest": f"""
select run_id, case when status = 'completed' then status else 'running' end as status,
       case when status = 'completed' then pages_scraped else 0 end as pages_scraped,
       case when status = 'completed' then jobs_inserted else 0 end as jobs_inserted from ({RUNS})""",
    "q_recent_runs": f"""
select run_id, case when status = 'completed' then '✓' else '✗' end as mark, jobs_inserted, pages_scraped, status
from ({RUNS}) order by started_at desc, run_id desc limit 10""",
    "q_run_retention": f"""
select status, count(*) filter (where started_at >= timestamp '2024-01-22') as kept,
       count(*) filter (where started_at < timestamp '2024-01-22') as removed from ({RUNS}) group by status""",
    "q_skill_mentions": f"select doc_id, skill, category from ({DOC_MENTIONS})",
    "q_skill_mentions_large": mentions_of("select doc_id, text from documents", "doc_id", "text", listed(inputs.large_phrases())),
    "q_skill_mentions_table": mentions_of("select doc_id, text from documents", "doc_id", "text", text(inputs.OPENINGS), 24),
    "q_skill_mentions_overlap": f"""
select doc_id, skill, category from ({mentions('select doc_id, text from documents', 'doc_id', 'text', OVERLAP_PHRASES)})""",
    "q_skill_freq": f"select skill, n from ({FREQ})",
    "q_top_skills": top(FREQ, 10),
    "q_top_skills_by_category": f"select category, rank, skill, n, pct from ({by_category(FREQ, 2)})",
    "q_category_stats": f"select category, total_mentions, unique_skills from ({cat_stats(FREQ)})",
    "q_corpus_summary": summary("select * from documents", DOC_MENTIONS),
    "q_skill_trend": f"""
with d as (select doc_id, case when doc_id % 29 <> 0 then week_key end as week_key from ({ACTIVE_DOCS})),
days as (select cast(unnest(generate_series(date '1990-01-01', date '2030-01-01', interval 1 day)) as date) as day),
calendar as (select strftime(day, '%Y-W%W') as w, min(day) as start from days group by 1),
weeks as (select w, lag(w) over (order by start) as before from calendar),
span as (select min(week_key) as first, max(week_key) as last from d),
counted as (select week_key, skill, count(*) as n from ({ACTIVE_MENTIONS}) m join d using (doc_id) group by week_key, skill),
grid as (select w, before, skill from weeks, (select distinct skill from counted where week_key is not null), span where w between first and last)
select g.w as week_key, g.skill, coalesce(c.n, 0) as n, case when g.w <> first then coalesce(c.n, 0) - coalesce(b.n, 0) end as delta
from grid g left join counted c on c.week_key = g.w and c.skill = g.skill
            left join counted b on b.week_key = g.before and b.skill = g.skill, span
where c.n is not null or b.n is not null
union all
select null, skill, n, null from counted where week_key is null""",
    "q_report_markdown": markdown(ACTIVE_FREQ, ACTIVE_DOCS, ACTIVE_MENTIONS, DOC_POSTINGS),
    "q_report_json": json_rows(ACTIVE_FREQ, ACTIVE_DOCS, ACTIVE_MENTIONS, DOC_POSTINGS, PERIOD.format(ACTIVE_DOCS)),
    "q_empty_analysis": f"""
select 'summary' as section, '{{"generated_at":"{AS_OF}","total_jobs_analyzed":' || count(*) || ',"total_skill_mentions":0,"unique_skills_found":0,"avg_skills_per_job":0.0}}' as json
from ({DOC_POSTINGS}) where week_key = '1900-W01'
union all
select 'period', '{{"week_key":"2026-W25","start_date":"2026-06-21","end_date":"2026-06-28"}}'""",
    "q_stream_ingest": f"select distinct {url_key('url')} as url_key, '2026-W25' as week_key from pages",
    "q_stream_weekly": """
select strftime(w, '%Y-%m-%d') as week_start, strftime(w, '%Y-W%W') as week_key, event_type, count(*) as n
from (select date_trunc('week', ts) as w, event_type from events) group by w, event_type""",
    "q_source_label": f"""
select case when contains(h, 'blog.') then 'blog' when contains(h, 'spam') then 'spam' when contains(h, 'm.') then 'mobile'
            when page_id % 2 = 0 then 'given' else 'generic' end as source_site, count(*) as n
from (select page_id, {HOST_ALL} as h from pages) group by 1""",
    "q_page_fields": f"""
select page_id, row_number() over (partition by page_id order by k) - 1 as pos, name as title, segment as company,
       case when kind = 0 then 'R' || days else '' end as location, case when kind = 1 then '$' || days || 'k' else '' end as salary_range,
       strftime({AS} - to_days(case when kind = 0 then cast(days as int) else 0 end), '%Y-%m-%d') as date_posted,
       case when kind = 0 then 'https://cards.example.org/j/' else 'https://cards.example.org/j/' end || k as job_url, 'generic' as source_site
from ({CARDS}) where kind <> 2""",
    "q_page_placeholder": f"""
select page_id, row_number() over (partition by page_id order by k) - 1 as pos, name as title, segment as company, 'L' || days as location,
       '' as salary_range, strftime({AS} - to_days(cast(days as int)), '%Y-%m-%d') as date_posted, 'https://remoteok.com/p/' || k as job_url,
       'remoteok' as source_site
from ({CARDS}) where kind <> 0""",
    "q_page_fallback": f"""
select page_id, row_number() over (partition by page_id order by k) - 1 as pos, name as title, segment as company, '' as location,
       '' as salary_range, '' as date_posted, 'https://weworkremotely.com/listings/' || k as job_url, 'weworkremotely' as source_site
from ({CARDS}) where kind <> 0""",
    "q_page_stamp": f"""
select page_id, row_number() over (partition by page_id order by k) - 1 as pos, name as title, '' as company, '' as location, '' as salary_range,
       case when kind = 0 then '2026-06-0' || (1 + k % 9) else strftime({AS} - to_days(cast(days as int)), '%Y-%m-%d') end as date_posted,
       'https://weworkremotely.com/' || (case kind when 0 then 'remote-jobs/' when 1 then 'o/' else 'd/' end) || k as job_url,
       'weworkremotely' as source_site
from ({CARDS})""",
    "q_pipeline": f"""
select cast(list_position(['com', 'net', 'org'], target) as bigint) as run_id, target as source_site, 'completed' as status, pages as pages_scraped,
       coalesce(found, 0) as jobs_found, coalesce(kept, 0) as jobs_inserted, coalesce(found - kept, 0) as jobs_deduplicated,
       cast(0 as bigint) as errors_encountered
from (select target, count(distinct page_no) as pages from ({BOARD_PAGES}) group by target)
left join (select target, count(*) as found, count(*) filter (where is_first) as kept from ({BOARD}) group by target) using (target)""",
    "q_pipeline_skills": top(f"""
select skill, any_value(category) as category, any_value(category_ord) as category_ord, count(*) as n,
       (select count(*) from ({BOARD}) where is_first) as jobs
from ({mentions(f"select * from ({BOARD}) where is_first", 'id', "title || ' ' || '' || ' ' || li", FIXTURE_PHRASES)}) group by skill""", 10),
}

# The same answers from statistics kept by week, from partitions read newest first, and from events that come late.
for _name, _same in {
    "q_rollup_stats": "q_store_stats", "q_rollup_by_source": "q_by_source", "q_rollup_location_dist": "q_location_dist",
    "q_rollup_company_dist": "q_company_dist_all", "q_rollup_period": "q_period", "q_posting_scan_newest": "q_posting_scan_latest",
    "q_stream_weekly_late": "q_stream_weekly",
}.items():
    ORACLE[_name] = ORACLE[_same]
ORACLE["q_posting_scan_newest_source"] = f"""
select posting_id, company, location, week_key from ({POSTINGS}) where is_active = 1 and source_site = '1-URGENT'
order by scraped_at desc, posting_id limit 50"""
ORACLE["q_run_purge"] = f"""
select status, count(*) as kept, (select count(*) from ({RUNS}) where started_at < timestamp '2024-01-22') as removed
from ({RUNS}) where started_at >= timestamp '2024-01-22' group by status"""
