"""Feeds, listing pages, targets, validity."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import quality, urls
from gleaner.sources import feeds, pages, postings, targets

AS_OF = "2026-06-28 12:00:00"


def feed(spark, *entries, meta=True):
    body = json.dumps(([{"legal": "x"}] if meta else []) + list(entries))
    return feeds.feed_postings(feeds.feed_entries(spark.createDataFrame([(body,)], "body string")))


def test_feed_skips_metadata_only_with_company(spark):
    e = {"position": "Dev", "company": "A", "slug": "dev-1"}
    assert feed(spark, e).count() == 1
    alone = feed(spark, e, meta=False).collect()
    assert [r.title for r in alone] == ["Dev"]
    assert feed(spark, e, e, meta=False).count() == 1
    empty = spark.createDataFrame([("[]",), ("not json",), ("{}",)], "body string")
    assert feeds.feed_postings(feeds.feed_entries(empty)).filter("title <> ''").count() == 0


def test_feed_fields(spark):
    row = feed(
        spark,
        {"position": " Dev ", "company": "A & B", "location": "", "tags": ["Python", "USA only", "Remote"],
         "description": "line one\nPython, pay $80k-$100k", "date": "2026-06-23T23:30:00-05:00", "id": 7},
    ).first()
    assert (row.title, row.company, row.location) == ("Dev", "A & B", "USA only, Remote")
    assert (row.salary_range, row.date_posted) == ("$80k", "2026-06-23") or row.salary_range == "$80k-$100k"
    assert row.job_url.endswith("/7")
    assert row.raw_html.endswith("\n<!-- TAGS: Python, USA only, Remote -->")
    assert not row.unparsed


def test_feed_tells_nulls_from_absences(spark):
    whole = {"position": "Dev", "company": "A", "slug": "s"}
    inside = {**whole, "meta": {"company": None, "tags": None}, "description": 'says "company": null'}
    entries = [whole, inside, {**whole, "company": None}, {**whole, "tags": None}, {**whole, "tags": None, "location": "X"}, {**whole, "description": None}]
    assert [r.unparsed for r in feed(spark, *entries).orderBy("pos").collect()] == [False, False, True, True, False, True]
    twice = spark.createDataFrame([('[{}, {"position": "One", "position": "Two", "company": "A", "id": 7}, "text", [1], 5, null]',)], "body string")
    rows = feeds.feed_postings(feeds.feed_entries(twice)).orderBy("pos").collect()
    assert [(r.title, r.unparsed) for r in rows] == [("Two", False), ("", True), ("", True), ("", True), ("", True)]


def test_unknown_fields_keep_their_type(spark):
    body = '[{"legal": "x"}, {"position": "Dev", "n": 5, "x": 1.5, "on": true, "o": {"a": [1]}, "z": null}, {"id": 1}, "text"]'
    found = feeds.unknown_fields(feeds.feed_entries(spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "k int, body string")))
    kinds = {r.field: (r.k, r.pos, r.kind) for r in found.select("k", "pos", "field", "kind").collect()}
    assert kinds == {
        "n": (1, 1, "BIGINT"), "x": (1, 1, "DECIMAL(2,1)"), "on": (1, 1, "BOOLEAN"), "o": (1, 1, "OBJECT<a: ARRAY<BIGINT>>"), "z": (1, 1, "VOID"),
    }
    assert found.filter("field = 'o'").select(F.try_variant_get("value", "$.a[0]", "int")).first()[0] == 1


def test_feed_keeps_the_whole_entry(spark):
    row = feed(spark, {"position": "Dev", "company": "A", "tags": ["go"], "description": "x" * 9000 + " kubernetes", "slug": "s"}).first()
    assert "kubernetes" in row.raw_html and row.raw_html.endswith("\n<!-- TAGS: go -->")


def test_broken_bodies_are_entries_of_their_own(spark):
    good = json.dumps([{}, {"position": "Dev", "company": "A", "slug": "s"}])
    bodies = [good, good[:-1], "<html>busy</html>", '{"position": "Dev", "company": "A", "slug": "s"}', "", None, "[]"]
    rows = feeds.feed_postings(feeds.feed_entries(spark.createDataFrame(list(enumerate(bodies)), "k int, body string"))).collect()
    assert sorted((r.k, r.unparsed) for r in rows) == [(0, False), (1, True), (2, True), (3, True), (4, True), (5, True)]
    checked = quality.with_errors(feeds.feed_postings(feeds.feed_entries(spark.createDataFrame([(b,) for b in bodies], "body string"))))
    assert quality.rejected_rows(checked).count() == 5


@pytest.mark.parametrize(
    ("words", "pay"),
    [("€1,000 – 2,000 net", "€1,000 – 2,000"), ("about 50,000 EUR", "50,000 EUR"), ("10/yr", "10/yr"), ("none", "")],
)
def test_salary(spark, words, pay):
    df = spark.createDataFrame([(words,)], "t string")
    assert df.select(feeds.extract_salary(F.col("t"))).first()[0] == pay


def test_quarantine(spark):
    rows = feed(
        spark,
        {"position": "Dev", "company": "A", "slug": "s"}, {"position": "D", "company": "A", "slug": "s"},
        {"position": "Dev", "company": "A"}, {"position": "", "company": "A"}, {"position": "Dev", "company": None, "slug": "s"},
    )
    checked = quality.with_errors(rows)
    reasons = {r.reason: r.n for r in quality.rejects_by_reason(checked).collect()}
    assert reasons == {quality.BAD_TITLE: 2, quality.NO_URL: 2, quality.UNPARSED: 1}
    assert quality.valid_rows(checked).count() == 1
    assert quality.rejected_rows(checked).count() == 4
    bad = spark.createDataFrame([("Dev", "ftp://x")], "title string, job_url string")
    assert quality.with_errors(bad).first().errors == [quality.BAD_URL]


TABLE = """<table><tr class="job new" id=1><td class="position"><a href="/remote-jobs/1?a=1&amp;b=2"><h2> Dev <b>Ops</b> </h2></a></td>
<td class="company"><h3>Acme &amp; Co</h3></td><td class="location">Berlin</td><td class="time">3 days ago</td></tr>
<tr class="job placeholder"><td class="position"><h2>No</h2></td></tr><tr class="other"><td>x</td></tr>
<tr class="job"><td class="position"><h2>QA</h2></td><td class="source"><a href="x/y">apply</a></td><td class="salary">$1</td></tr></table>"""
NESTED = """<script>var t='<div class="job">no</div>'</script><div class="list"><div class="job-listing"><div class="in"><div>
<h3 class="title">T1</h3></div></div><div class="employer">E1</div><a class="job-link" href="/j/1">go</a></div>
<div class="job-listing"><h3>T2</h3><span class="posted">today</span><a href="j2">x</a></div></div>"""
LIST = """<ul><li class="featured"><a href="/c/x">c</a><a href="/remote-jobs/9"><span class="title">W1</span>
<span class="company">C1</span><time datetime="2026-06-01T10:00:00Z">3d</time></a></li><li class="view-all"><a href="/all">All</a></li></ul>"""
CARDS = '<p class="job">one <a href="/1"><span class="title">J1</span></a><p class="job"><span class="title">J2</span><a href="/2">'


def listings(spark, *rows):
    df = spark.createDataFrame(list(rows), "url string, html string")
    layout = urls.detect_source(F.col("url"))
    return pages.page_listings(df, layout, F.lit(AS_OF).cast("timestamp")).orderBy("url", "pos").collect()


def test_table_layout(spark):
    one, two = listings(spark, ("https://remoteok.com/l", TABLE))
    assert (one.title, one.company, one.location, one.date_posted) == ("DevOps", "Acme & Co", "Berlin", "2026-06-25")
    assert one.job_url == "https://remoteok.com/remote-jobs/1?a=1&b=2"
    assert (two.title, two.salary_range, two.job_url, two.date_posted) == ("QA", "$1", "https://remoteok.com/x/y", "")


def test_list_layout_falls_back_and_prefers_stamp(spark):
    (one,) = listings(spark, ("https://weworkremotely.com/s", LIST))
    assert (one.title, one.company, one.date_posted) == ("W1", "C1", "2026-06-01")
    assert one.job_url == "https://weworkremotely.com/remote-jobs/9"
    assert one.source_site == "weworkremotely"


def test_generic_layout_handles_nesting_and_scripts(spark):
    one, two = listings(spark, ("https://x.org/a/b", NESTED), ("https://x.org/none", "<p>nothing</p>"))
    assert (one.title, one.company, one.job_url) == ("T1", "E1", "https://x.org/j/1")
    assert (two.title, two.date_posted, two.job_url) == ("T2", "2026-06-28", "https://x.org/a/j2")


def test_unions_keep_document_order(spark):
    cards = '<div data-job="1"><h3>D1</h3></div><p class="job"><b class="title">J1</b></p><div data-job="2"><h3>D2</h3></div>'
    assert [r.title for r in listings(spark, ("https://z.org/", cards))] == ["D1", "J1", "D2"]
    both = '<ul class="jobs-list"><li class="job"><h4>L1</h4></li><li class="view-all"><h4>All</h4></li></ul><div class="job"><h4>J1</h4></div>'
    assert [r.title for r in listings(spark, ("https://weworkremotely.com/", both))] == ["L1", "All", "J1"]
    path = '<section class="jobs"><article><ul><li><h4>P1</h4></li></ul></article></section><ul><li><h4>no</h4></li></ul>'
    assert [r.title for r in listings(spark, ("https://weworkremotely.com/", path))] == ["P1"]


def test_unclosed_containers(spark):
    one, two = listings(spark, ("https://y.org/", CARDS))
    assert (one.title, one.job_url, two.title, two.job_url) == ("J1", "https://y.org/1", "J2", "https://y.org/2")


def slow_containers(html):
    """Containers <div class="job"> and <p class="job"> by walking the tags: to the end tag or to the next one of its name."""
    found = []
    for name in ("div", "p"):
        tags = list(re.finditer(rf"(?i)<(/?){name}(?=[\s>/])[^>]*>", html))
        starts = [i for i, t in enumerate(tags) if not t[1] and "job" in t[0]]
        for k, i in enumerate(starts):
            end = tags[starts[k + 1]].start() if k + 1 < len(starts) else len(html)
            depth = 0
            for t in tags[i:]:
                depth += -1 if t[1] else 1
                if t.start() >= end or depth == 0:
                    end = min(end, t.end())
                    break
            found.append((tags[i].start(), html[tags[i].start():end]))
    return [text for _, text in sorted(found)]


def test_containers_of_tag_soup(spark):
    draw = random.Random(5)
    parts = ["<div>", "</div>", "</DIV >", '<div class="job">', '<p class="job x">', "<p>", "</p>", "\u00e9t\u00e9 ", "<b>x</b>", "<divx>", "</px>", "\n"]
    soups = ["".join(draw.choices(parts, k=draw.randrange(60))) for _ in range(300)] + ["".join(draw.choices(parts, k=5000)), "", "<div", '<p class="job">']
    rules = {"x": pages.ListingRules(container=pages.start_tag("div|p", "job"), title=pages.element("b"))}
    df = spark.createDataFrame(list(enumerate(soups)), "n int, html string").withColumn("url", F.lit("http://a.com/"))
    rows = pages.page_listings(df, F.lit("x"), F.lit(AS_OF).cast("timestamp"), rules).orderBy("n", "pos").collect()
    for n, soup in enumerate(soups):
        assert [r.raw_html for r in rows if r.n == n] == slow_containers(soup)


def test_long_pages_take_time_by_their_length(spark):
    card = '<div class="job"><div><h3>Post</h3></div><div></div><span class="company">A</span><a href="/j">go</a></div>\n'
    took = []
    for n in (5_000, 5_000, 40_000):  # 0.5 MB, again when warm, and 4 MB
        df = spark.createDataFrame([("https://cards.example.org/l", card * n)], "url string, html string")
        begin = time.perf_counter()
        rows = pages.page_listings(df, F.lit("generic"), F.lit(AS_OF).cast("timestamp"))
        assert rows.agg(F.count("*"), F.max("pos"), F.count_if(F.col("title") == "Post")).first()[:] == (n, n - 1, n)
        took.append(time.perf_counter() - begin)
    assert took[2] < 8 * 2.5 * max(took[1], 0.5)


def test_rules_from_config(spark):
    rules = pages.rules_from_config({"x": {"container": pages.start_tag("li"), "title": pages.element("b")}})
    df = spark.createDataFrame([("http://a.com/", "<li><b>one</b></li><li><b>two</b></li>")], "url string, html string")
    rows = pages.page_listings(df, F.lit("x"), F.lit(AS_OF).cast("timestamp"), rules).collect()
    assert [(r.pos, r.title, r.source_site) for r in rows] == [(0, "one", "generic"), (1, "two", "generic")]
    with pytest.raises(ValueError):
        pages.rules_from_config({"x": {"box": ""}})


def test_landed_files(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    body = json.dumps([{}, {"position": "Dev", "company": "A", "slug": "s"}], indent=1)
    (tmp_path / "feed" / "a.json").write_text(body)
    rows = feeds.feed_postings(feeds.feed_entries(feeds.read_feed(spark, str(tmp_path / "feed"))))
    assert [r.title for r in rows.collect()] == ["Dev"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_text(NESTED)
    assert pages.read_page_files(spark, str(tmp_path / "p")).first().html == NESTED


def test_targets(spark):
    df = spark.createDataFrame(
        [("BoardA", "https://a.com/jobs?q=dev", "query_param", "page", 2, True), ("BoardB", "https://b.com/j", None, "p", 1, None),
         ("BoardC", "https://c.com/{page}", "path", "page", 2, True), ("BoardD", "https://d.com", "cursor", "page", 2, False)],
        "name string, base_url string, page_strategy string, page_param string, max_pages int, enabled boolean",
    )
    plan = targets.page_plan(targets.select_targets(df)).orderBy("name", "page_no").collect()
    assert [r.page_url for r in plan] == [
        "https://a.com/jobs?q=dev&page=1", "https://a.com/jobs?q=dev&page=2", "https://b.com/j?p=1", "https://c.com/1", "https://c.com/2",
    ]
    assert [r.name for r in targets.select_targets(df, "arda").collect()] == ["BoardA"]


def test_posting_scan_order_and_limit(spark):
    df = spark.createDataFrame(
        [("a", "s", "w", 1, 1), ("b", "s", "w", 2, 1), ("c", "t", "w", 2, 1), ("d", "s", "v", 3, 0)],
        "url_key string, source_site string, week_key string, scraped_at int, is_active int",
    )
    def keys(**kw):
        return [r.url_key for r in postings.posting_scan(df, **kw).collect()]

    assert keys() == ["b", "c", "a"]
    assert keys(limit=0) == ["b", "c", "a"]
    assert keys(limit=1) == ["b"]
    assert keys(source_site="s") == ["b", "a"]
    assert keys(week_key="v") == []
