"""URL rules, legacy archives, the pipeline and the registered queries."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import urlparse
from urllib.request import url2pathname

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gleaner.llm import archives, decontaminate, url_rules
from gleaner.llm.catalog import HOST_RULES, ORACLE, PATTERNS, QUERIES
from gleaner.session import work_path
from tests.compare import compare, connect
from tests.llm import helpers

SF_DIR = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, page string, host string, row long, verdict string"


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [(h + p, v) for v, h, p in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


@pytest.mark.parametrize("few, sent", [(500, 50_000), (0, 50_000), (0, 0)])
def test_urls_equal_brute_force(spark, monkeypatch, few, sent):
    monkeypatch.setattr(url_rules, "FEW_RULES", few)
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", sent)
    rng = random.Random(6)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "notexample.org", "org", "com", "b.com:80", "x.spam-farm.net", "spam-farm.net", "u@c.com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/148", "/en/2", "/fr/x", "/de/", "/ES/", "/docs/login", "/login", "/a/login/b", "/mylogin", "/tag/x/page"]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/de/", "#/es/")]
    urls = rng.sample(urls, 300) + [None, "", "nothing", "://", "http://", "://x", "a://b://c", "http://é.com/fr/ü", "http://a.com/fr/" + "x" * 50_000]
    pages = spark.createDataFrame([(i, u, "", "p", "h", 1, "v") for i, u in enumerate(urls)] + [(None, urls[0], "", "", "", 2, "")], PAGE)
    rules = [url_rules.host_rule(*r) for r in HOST_RULES] + [url_rules.pattern_rule(*p) for p in PATTERNS]
    out = url_rules.judge(pages, rules, carry=["page_id", "url"]).select("page.*", "host", "path", "rule", "pattern", "verdict").collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r.host, r.path) == slow_parts(r.url)
        name, verdict = slow_rule(r.host, r.path)
        assert r.rule == name
        if name:
            assert r.verdict == verdict and r.pattern is None
        else:
            address = f"//{r.host}{r.path}"
            fits = [(len(n), v == "block", n, v) for v, n in PATTERNS if re.search(url_rules.pattern_rule(v, n).regex, address)]
            assert (r.pattern, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))
    assert url_rules.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_rules.judge(pages, []).collect()} == {"allow"}
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (few == 0)


def test_only_whole_tokens_index_a_rule():
    assert url_rules.host_rule("block", "example.org", "/en/1").tokens == ("example", "org", "en")
    assert url_rules.pattern_rule("block", "||spam-farm.*^").tokens == ("spam", "farm")
    assert url_rules.pattern_rule("block", "login").tokens == ()


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    tricky = "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nhttp://x 0.0.0.0 20240101000000 text/html 5\n"
    rows = [(5, "http://a b/x\n", tricky), (3, None, tricky), (None, "u", None), (7, "u", ""), (9, "http://x", "\r\n\r\n"), (2, "x", "q"),
            (2, "y", "q"), (4, "", "q"), (8, "z", "long " * 300_000), (None, "n", "only"), (None, "m", "only")]
    pages = spark.createDataFrame([(*r, "p", "h", 1, "v") for r in rows], PAGE)
    out = archives.archive(pages, work_path(spark, "warc")).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in out)
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(least.get(h or "", 10**9), 10**9 if i is None else i)
    want = sorted(
        (i or -1, len((h or "").encode()), digest(h), *(("response", -1) if (i or 10**9) == least[h or ""] else ("revisit", least[h or ""])))
        for i, _, h in rows
    )
    assert got == want and len({r.record_id for r in out}) == len(rows)
    assert archives.archive(pages.limit(0), work_path(spark, "warc")).collect() == []
    small = archives.archive(pages, work_path(spark, "warc"), least_bytes=5).filter("payload_bytes < 5 and record_type = 'revisit'")
    assert small.count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    rows = [(1, "http://a/", "<p>\nhttp://b 1.2.3.4 20240101000000 text/html 3\nabc"), (None, "dns:x", "é")]
    data = archives.arc_segment(rows, version, "20240102030405", "x.arc")
    about, one, two = archives.arc_records(data)
    assert about["kind"] == "warcinfo" and archives.ARC_FIELDS[version].encode() in about["payload"]
    assert (one["page_id"], one["kind"], one["date"], one["payload"].decode()) == (1, "response", "2024-01-02T03:04:05Z", rows[0][2])
    assert two["page_id"] is None and one["payload_digest"] == digest(rows[0][2]) and not one["truncated"]
    broken = data[:-3]
    assert list(archives.arc_records(broken))[-1]["truncated"]
    assert [r["url"] for r in archives.arc_records(b"junk\n\nmore junk 5\n" + data)] == ["", "filedesc://x.arc", "http://a/", "dns:x"]
    assert list(archives.arc_records(b"")) == []


def test_arc_body_that_is_no_http_response():
    old = b"http://a/x y 1.2.3.4 199704 text/html 5\nhello\nftp://b 1.2.3.4 19970404 application/x 3\n\x00\xff\x01\n"
    records = list(archives.arc_records(old))
    assert [(r["url"], r["kind"], r["payload"]) for r in records] == [("", "unread", b""), ("ftp://b", "resource", b"\x00\xff\x01")]
    assert records[0]["head"].endswith(b"199704 text/html 5") and records[1]["date"] == "1997-04-04T00:00:00Z"


def arc_of(version, *records):
    about = f"{version} 0 x\n{archives.ARC_FIELDS[version]}\n".encode()
    out = b"filedesc://x.arc 0.0.0.0 20240101000000 text/plain %d\n" % len(about) + about + b"\n"
    return out + b"".join(head + b" %d\n" % len(body) + body + b"\n" for head, body in records)


SPOOF = b"hello\nhttp://spoof/ 1.2.3.4 20240101000000 text/html 3\nabc\n"


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_headers_as_they_occur(version):
    more = b"" if version == "1" else b" 200 ABC - 17 x.arc"
    heads = [b"http://a/ 2001:db8::1 20240101000000 text/html", b"http://b/ - 20240101000000 text/html",
             b"http://c/ 1.2.3.4 20240101000000 text/html; charset=utf-8", b"http://d e/ 1.2.3.4 5.6.7.8 20240101000000 no-type"]
    read = list(archives.arc_records(arc_of(version, *[(h + more, SPOOF) for h in heads])))
    assert [r["url"] for r in read[1:]] == ["http://a/", "http://b/", "http://c/", "http://d e/ 1.2.3.4"]
    assert [r["mime"] for r in read[1:]] == ["text/html", "text/html", "text/html; charset=utf-8", "no-type"]
    assert all(r["payload"] == SPOOF and not r["truncated"] for r in read[1:])


def test_odd_records_are_counted_and_never_searched():
    good = (b"http://z/ 1.2.3.4 20240101000000 text/html", b"ok")
    odd = [(b"http://y/ nowhere 20240101000000 text/html", SPOOF), (b"http://x/ 1.2.3.4 never text/html", SPOOF)]
    read = list(archives.arc_records(arc_of("1", *odd, good)))
    assert [(r["kind"], r["url"]) for r in read[1:]] == [("unread", ""), ("unread", ""), ("resource", "http://z/")]
    broken = arc_of("1", good) + b"http://w/ 1.2.3.4 20240101000000 text/html many\n" + SPOOF + arc_of("2", (b"http://v/ - 20240101000000 t 200 - - 0 f", b"x"))
    read = list(archives.arc_records(broken))
    assert [(r["kind"], r["url"]) for r in read] == [
        ("warcinfo", "filedesc://x.arc"), ("resource", "http://z/"), ("unread", ""), ("warcinfo", "filedesc://x.arc"), ("resource", "http://v/")]
    # the fields of version 1 do not read a header of version 2 as a longer type
    assert [r["mime"] for r in read if r["kind"] == "resource"] == ["text/html", "t"]


def test_record_ids_are_distinct_over_tasks(spark):
    pages = spark.range(400).select(F.lit(7).cast("long").alias("page_id"), F.lit("http://a/").alias("url"), F.lit("x").alias("html"))
    records = archives.convert(archives.pack(pages.repartition(16)))
    ids = [r.record_id for r in records.select("record_id").collect()]
    assert len(ids) == len(set(ids)) == 416
    assert sorted(ids) == sorted(r.record_id for r in records.select("record_id").collect())


def test_files_are_bounded_and_records_can_be_sought(spark):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 20_000).alias("html"))
    path = work_path(spark, "warc")
    archives.write_warc(archives.mark_revisits(archives.convert(archives.pack(pages))), path, file_bytes=200_000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) >= 8
    for data in files:
        assert len(gzip.decompress(data)) <= 200_000 + 4 * 12 or len(list(archives.parse_warc(data))) == 1
        second = zlib.decompressobj(31)
        second.decompress(data)
        rest = second.unused_data
        if rest.strip(b"\0"):
            assert next(archives.parse_warc(rest))["warc-type"] in ("response", "warcinfo")
    plain = work_path(spark, "warc")
    archives.write_warc(archives.convert(archives.pack(pages)).withColumns({"refers_to": F.lit(None).cast("long"), "refers_to_id": F.lit(None).cast("string")}), plain, "none")
    assert archives.read_warc(spark, plain).count() == archives.read_warc(spark, path).count() == 60


def test_segments_are_read_one_at_a_time(spark):
    pages = spark.range(12).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 1_000_000).alias("html"))
    records = archives.convert(archives.pack(pages.coalesce(1)))
    parts = [pq.ParquetFile(url2pathname(urlparse(f).path)).metadata for f in records.inputFiles()]
    groups = [m.row_group(i) for m in parts for i in range(m.num_row_groups)]
    assert len(groups) >= 3 and all(g.num_rows == 1 for g in groups)
    assert records.filter("kind = 'response'").count() == 12


def test_binary_payloads_survive(spark):
    payload = bytes(range(256)) * 50 + b"\r\n\r\n"
    body = b"HTTP/1.0 200 OK\r\nX-Page-Id: 6\r\n\r\n" + payload
    arc = b"http://a/ 1.2.3.4 20240101000000 image/png %d\n" % len(body) + body + b"\n"
    path = work_path(spark, "warc")
    archives.write_warc(archives.mark_revisits(archives.convert(spark.createDataFrame([(bytearray(arc),), (None,)], "arc binary"))), path)
    row = archives.read_warc(spark, path).first()
    assert (row.page_id, row.payload_bytes) == (6, len(payload))
    assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_beside_its_sql(spark, con, name):
    ok, note, _, _ = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert ok, note


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages_keep_columns_on_odd_rows(spark, tmp_path):
    docs, sf_dir = helpers.table(spark), str(tmp_path)
    duckdb.sql("select 1::bigint as doc_id, 1 as quality, null::int as toxic").write_parquet(f"{sf_dir}/labels.parquet")
    duckdb.sql("select 1::bigint as item_id, null::varchar as text").write_parquet(f"{sf_dir}/benchmark.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf_dir)
            rows = out.collect()
            assert len(rows) <= given.count()
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).count() == 9


def test_pipeline_takes_out_what_is_planted(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ner", "tus"], k=3))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    rows, toxic = [], {}
    for i in range(900):
        bad = i % 5 == 0
        rows.append((i, text(60) + (" idiot scum " if bad else " ") + text(60), "en", f"s{i % 3}"))
        toxic[i] = int(bad)
    clean = [r for r in rows if not toxic[r[0]]]
    rows += [(2000 + i, "  " + r[1].replace(" ", "\n"), "en", "s0") for i, r in enumerate(clean[:50])]
    rows += [(4000 + i, text(80) + " " + item + " " + text(80), "en", "s1") for i in range(20)]
    sf_dir = str(tmp_path)
    helpers.table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {r[0] for r in clean}
    assert kept[0] == good | {2000 + i for i in range(50)} | {4000 + i for i in range(20)}
    assert len(kept[1]) == len(good) + 20 and len(kept[2]) == len(kept[1])
    assert kept[3] == kept[2] - {4000 + i for i in range(20)}
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.collect()} <= kept[3]


def test_decontaminated_stage_equals_its_operator(spark):
    items = spark.createDataFrame([(1, "over the lazy dog again and again")], "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.drop_contaminated(helpers.table(spark), items).collect()}
    assert kept == {4, 5, 6, None, 7, 8, 9, 10, 11}
