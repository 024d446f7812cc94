"""Scalar functions against Python's own urllib, re, round, strftime and sqlite3."""

import datetime
import random
import re
import sqlite3
import time
import urllib.parse as up

import pytest
from pyspark.sql import functions as F

from catalog.inputs import OVERLAP_TAXONOMY, large_taxonomy
from gleaner.functions import dates, text, urls
from gleaner.functions.phrases import Taxonomy, extract_skills
from gleaner.functions.text import unescape_entities
from gleaner.operators.dedup import with_url_key

EDGE_URLS = [
    "HTTPS://WWW.Ex.com/A/?b=2&a=1&utm_source=x#f", "http://a.com", "http://a.com/", "http://a.com//",
    "http://a.com/x?B=1&a=2&b=0&A=9", "http://a.com/x?k=%zz&m=1=2", "http://a.com/x?a=%E9", "http://a.com/x?&&k&=v&k=",
    "", "  ", "mailto:x@y", "http://u:P@a.com:80/", "http://www.", "http://www./x", "HTTP://[::1/x", "//a.com/b/", "a/b/?c=d#e",
    "http://a.com/x/;p", "http://a.com/x;p?y=1", "http://a.com/?utm_source=1&REF=2", "http://a.com/?a=b%20c&d=e+f&g=ü",
]


def python_key(url):
    """The reference behaviour in the words of urllib."""
    tracking = set(urls.TRACKING_PARAMS)
    if not url:
        return ""
    try:
        p = up.urlparse(url.strip())
        host = p.netloc.lower().removeprefix("www.")
        pairs = sorted(
            ((k, v) for k, v in up.parse_qsl(p.query) if k.lower() not in tracking), key=lambda kv: kv[0].lower()
        )
        path = p.path[:-1] if p.path.endswith("/") and p.path != "/" else p.path
        return up.urlunparse((p.scheme.lower(), host, path, p.params, up.urlencode(pairs), ""))
    except ValueError:
        return url.lower().strip()


def random_urls(n, seed):
    pieces = [
        "http://", "https://", "HTTP://", "www.", "Ex.com", "a.b", "/", "//", "/A", "/x/", "?", "&", "=", "a", "B",
        "utm_source=1", "Ref=z", "ref", "%41", "%zz", "%E9", "%e2%82%ac", "+", " ", "#f", "~", "*", "-", "_", ".", "ü",
        "mailto:", ":80", "u:P@", ";p", ";", "q=1", "q=", "k=v=w", "[", "\t", "%", "ftp:", "/..",
    ]
    rnd = random.Random(seed)
    heads = ["", "http://", "https://www.Ex.com/"]
    return [rnd.choice(heads) + "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) for _ in range(n)]


def test_url_key_equals_urllib(spark):
    samples = EDGE_URLS + [None] + random_urls(15000, 7)
    df = spark.createDataFrame(list(enumerate(samples)), "i int, url string").repartition(8)
    both = with_url_key(df, "url").withColumn("again", urls.normalize_url(F.col("url")))
    for r in both.collect():
        assert r.url_key == python_key(r.url), repr(r.url)
        assert r.again == r.url_key, repr(r.url)


def test_url_key_is_stable_on_ordinary_urls(spark):
    df = spark.createDataFrame([(u,) for u in EDGE_URLS if "//" not in u[8:]], "url string")
    once = urls.normalize_url(F.col("url"))
    rows = df.select(once.alias("a"), urls.normalize_url(once).alias("b")).collect()
    assert [r for r in rows if r.a != r.b] == []


def test_links_equal_urljoin(spark):
    rnd = random.Random(11)
    bases = ["http://a.com", "http://a.com/", "https://www.x.org/a/b.html?q=1#z", "http://a.com/d/e/"]
    bits = ["a", "b.html", "../", "./", "x/", "y"]
    hrefs = ["/x", "/x/../y", "?p=2", "#f", "//h.com/z", "https://q.com/r", "mailto:x@y", "", "..", ".", "/"]
    hrefs += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    for r in df.select("b", "h", urls.absolute_link(F.col("b"), F.col("h")).alias("got")).collect():
        assert r.got == up.urljoin(r.b, r.h), (r.b, r.h)


def test_tracking_params_and_source(spark):
    df = spark.createDataFrame(
        [("http://a.com/?UTM_source=1&ref=&x=2&gclid=7#ref=1", None), ("https://remoteok.com/api", "mine"), ("http://b.org", "mine")],
        "url string, conf string",
    )
    rows = df.select(
        urls.tracking_params(F.col("url")).alias("t"), urls.detect_source(F.col("url"), F.col("conf")).alias("s")
    ).collect()
    assert [r.t for r in rows] == [["utm_source", "gclid"], [], []]
    assert [r.s for r in rows] == ["generic", "remoteok", "mine"]


def test_week_label_equals_strftime(spark):
    days = [(datetime.date(1995, 1, 1) + datetime.timedelta(days=i),) for i in range(13000)]
    rows = spark.createDataFrame(days, "d date").select("d", dates.week_label(F.col("d")).alias("w")).collect()
    assert [r for r in rows if r.w != r.d.strftime("%Y-W%W")] == []
    assert dates.week_label_of(datetime.date(2026, 6, 28)) == "2026-W25"


def test_week_key_equals_sqlite(spark):
    samples = [
        "1995-01-01", "2026-06-28", "2024-13-45", "", "2024-02-30", "2024-02-32", "soon", "06/01/2024", "2026-6-1",
        "2026-06-28T23:30:00-05:00", "2026-06-28 23:30", "2026-06-28T23:30:00Z", "2026-06-29T00:10:00.5+02:00", "2024-12-31",
    ]
    seen = datetime.datetime(2026, 6, 22, 8, 0)
    df = spark.createDataFrame([(s, seen) for s in samples], "t string, seen timestamp")
    con = sqlite3.connect(":memory:")
    for r in df.select("t", dates.week_key(F.col("t"), F.col("seen")).alias("w")).collect():
        want = con.execute("select strftime('%Y-W%W', coalesce(nullif(?, ''), ?))", (r.t, seen.isoformat())).fetchone()[0]
        assert r.w == want, r.t


@pytest.mark.parametrize(
    ("written", "want"),
    [
        ("3 days ago", "2026-06-25"), ("Posted 1 Day ago", "2026-06-27"), ("2 weeks ago", "2026-06-14"),
        ("2months ago", "2026-04-29"), ("13 hours ago", "2026-06-27"), ("11 hours ago", "2026-06-28"), ("Today!", "2026-06-28"),
        (" yesterday ", "2026-06-27"), ("on 2024-02-29", "2024-02-29"), ("2024-02-30", "2024-02-30"),
        ("06/01/2024", "2024-06-01"), ("13/01/2024", "13/01/2024"), ("Soon", "soon"), ("", ""),
        ("2024-13-01 or 06/01/2024", "2024-06-01"), ("99999999999 days ago today", "2026-06-28"),
        ("1 week ago, 2 days ago", "2026-06-26"),
    ],
)
def test_relative_date(spark, written, want):
    now = F.lit("2026-06-28 12:00:00").cast("timestamp")
    df = spark.createDataFrame([(written,)], "t string")
    assert df.select(dates.relative_date(F.col("t"), now)).first()[0] == want


def test_rounding_equals_python(spark):
    pairs = [(c, n) for n in range(1, 301) for c in range(0, n + 1)]
    df = spark.createDataFrame(pairs, "c long, n long")
    rows = df.select(
        "c", "n", text.percent(F.col("c"), F.col("n")).alias("p"), text.average(F.col("c"), F.col("n")).alias("a"),
        text.average(F.col("n") * 7, F.col("c") + 1).alias("b"),
    ).collect()
    assert [r for r in rows if r.p != round(r.c / r.n * 100, 1)] == []
    assert [r for r in rows if r.a != round(r.c / r.n, 2) or r.b != round(r.n * 7 / (r.c + 1), 2)] == []
    zero = spark.createDataFrame([(0, 0)], "c long, n long").select(text.percent(F.col("c"), F.col("n"))).first()[0]
    assert zero == 0.0


def test_title_case_equals_python(spark):
    words = ["next.js", "cross-functional", "k8s", "ruby on rails", "o'neil", "élan vital", "", "x", "C++", "ASP.net"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", text.title_case(F.col("w")).alias("t")).collect():
        assert r.t == r.w.title()


def test_markup_text(spark):
    df = spark.createDataFrame([("<p> a <b> b&amp;c </b><!-- <i>x</i> --> &#68;&#x45; &lt;</p>",)], "h string")
    assert df.select(text.markup_text(F.col("h"))).first()[0] == "ab&cDE <"


TECH = Taxonomy.of({
    "languages": ["go", "c++", "c#", "r", "swift", "ruby", "asp.net core", "asp.net", ".net"],
    "frameworks": ["ruby on rails", "rails", "vue", "vue.js", "next.js", "node.js", "rest api", "api gateway", "api"],
    "data": ["core data", "data science", "data", "science of rest", "gateway rest", "go go", "x x"],
    "mobile": ["swift", "f#", "core"],
})


def python_skills(body, taxonomy):
    """The reference behaviour, phrase by phrase with re."""
    low, spans, found = body.lower(), [], set()
    for phrase, _ in sorted(taxonomy.entries, key=lambda e: len(e[0]), reverse=True):
        for m in re.finditer(r"\b" + re.escape(phrase) + r"\b", low):
            if not any(b <= m.start() < e for b, e in spans):
                spans.append((m.start(), m.start() + len(phrase)))
                found.add(phrase)
    return sorted(found)


def test_skills_equal_python_model(spark):
    rnd = random.Random(5)
    words = [
        "rest", "api", "gateway", "core", "data", "science", "go", "c++", "c#", "r", "vue", "vue.js", "ruby", "on",
        "rails", "swift", "node.js", "asp.net", "x", "of", ".net", "f#", "Goö", "näh", "C++x", "_go", "9r",
    ]
    seps = [" "] * 6 + ["  ", ". ", ", ", "-", "\n", "/", ""]
    bodies = ["".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    bodies += ["rest api gateway", "core data science", "C++ dev", "c++x", "Node.jsx", "goö go", "swift", ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, t string").repartition(8)
    got = df.select("t", extract_skills(F.col("t"), TECH).alias("s")).collect()
    for r in got:
        assert sorted(r.s) == python_skills(r.t, TECH), repr(r.t)


def test_skills_edges(spark):
    token = Taxonomy(TECH.entries, edge="token")
    df = spark.createDataFrame([("C++ dev, C#.",), (None,)], "t string")
    rows = df.select(extract_skills(F.col("t"), TECH).alias("b"), extract_skills(F.col("t"), token).alias("t")).collect()
    assert [sorted(r.b) for r in rows] == [[], []]
    assert [sorted(r.t) for r in rows] == [["c#", "c++"], []]
    assert TECH.skills["swift"] == "languages"
    assert "rest api gateway" in TECH.overlaps and "go go go" in TECH.overlaps
    assert Taxonomy.of({"x": ["go", "r"]}, exclude=["r"]).skills == {"go": "x"}
    with pytest.raises(ValueError):
        Taxonomy.of({"x": ["a"]}, edge="none")


def test_taxonomy_from_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ord,skill,category\n2,rust,b\n1,go,a\n3,go,b\n")
    taxonomy = Taxonomy.read(spark, str(tmp_path / "t.csv"))
    assert taxonomy.entries == (("go", "a"), ("rust", "b"), ("go", "b"))
    assert taxonomy.skills == {"go": "a", "rust": "b"}


def test_large_taxonomy_equals_python_model(spark):
    taxonomy = large_taxonomy()
    assert len(taxonomy.skills) >= 250 and taxonomy.overlaps
    rnd = random.Random(7)
    parts = ["of", "the", "in", "and", "is", "that", "an", "%%%", "***", ",", "|", "!!", ".", "#", *list(taxonomy.skills)[:60]]
    texts = [rnd.choice(["", " "]).join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def model(body):
        found, spans, low = set(), [], body.lower()
        for phrase in taxonomy.by_priority:
            for m in re.finditer(r"(?<!\w)" + re.escape(phrase) + r"(?!\w)", low):
                if not any(b <= m.start() < e for b, e in spans):
                    spans.append((m.start(), m.end()))
                    found.add(phrase)
        return sorted(found)

    for r in df.select("t", extract_skills(F.col("t"), taxonomy).alias("s")).collect():
        assert sorted(r.s) == model(r.t), repr(r.t)


def test_tangled_text_costs_the_same_per_word(spark):
    words = "of the in the of the and of the that and the in de la de la le a"
    seconds = {}
    for n in (100, 100, 2000):
        df = spark.createDataFrame([(" ".join([words] * n),)] * 4, "t string").repartition(4)
        begin = time.perf_counter()
        df.select(F.size(extract_skills(F.col("t"), OVERLAP_TAXONOMY)).alias("n")).collect()
        seconds[n] = time.perf_counter() - begin
    assert seconds[2000] < 30 * max(seconds[100], 0.3)


def test_entities(spark):
    rows = [("&eacute;&amp;lt;&#0000233;&#x00E9;&nope;&amp;&copy;x", "é&lt;éé&nope;&©x"), ("a & b &; &#; &#x; &#99999999;", "a & b &; &#; &#x; &#99999999;")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.v for r in df.select(unescape_entities(F.col("a")).alias("v")).collect()] == [b for _, b in rows]
