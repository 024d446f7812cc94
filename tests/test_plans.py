"""Ingest, analysis, reports and streaming end to end."""

import datetime
import json
import os
import re

import pytest
from pyspark.sql import functions as F, types as T

from gleaner import schema
from gleaner.functions.phrases import Taxonomy
from gleaner.operators import mining, rollup, runs, stats
from gleaner.plans import analysis, ingest, report, upkeep
from gleaner.session import drop_path, path_exists, read_text, shared_root, work_path
from gleaner.sources import merging, postings
from gleaner.streaming import incremental

TS = datetime.datetime(2026, 6, 28, 12, 0)
AS_OF = "2026-06-28 12:00:00"
TAX = Taxonomy.of({"lang": ["go", "rust", "sql"], "soft_skills": ["remote work", "next.js"]})


def rows(spark, *urls, title="Go dev"):
    data = [(i, title, " Acme ", "Berlin", "", "2026-06-26", u, "board", f"needs rust {i}") for i, u in enumerate(urls)]
    return spark.createDataFrame(
        data, "pos long, title string, company string, location string, salary_range string, date_posted string, job_url string, "
        "source_site string, raw_html string",
    )


def tables(spark):
    return ingest.Tables.below(work_path(spark, "t"))


def test_second_ingest_adds_nothing(spark):
    t = tables(spark)
    batch = rows(spark, "http://a.com/1", "http://www.a.com/1/", "http://a.com/2?utm_source=x", "", "http://a.com/3")
    first = ingest.ingest_batch(batch, t, TS, ["pos"])
    assert (first.inserted, first.skipped, first.blank) == (3, 1, 1)
    again = ingest.ingest_batch(batch, t, TS, ["pos"])
    assert (again.inserted, again.skipped, again.blank) == (0, 4, 1)
    more = ingest.ingest_batch(rows(spark, "http://a.com/2", "http://a.com/4"), t, TS, ["pos"])
    assert (more.inserted, more.skipped) == (1, 1)
    store = postings.read_store(spark, t.postings)
    assert sorted(r.url_key for r in store.collect()) == [f"http://a.com/{i}" for i in range(1, 5)]
    row = store.filter("url_key = 'http://a.com/2'").first()
    assert (row.job_url, row.company, row.week_key, row.is_active) == ("http://a.com/2?utm_source=x", "Acme", "2026-W25", True)
    audit = ingest.audit_table(t).read(spark)
    assert {(r.reason, r["count"]) for r in audit.groupBy("reason").count().collect()} == {("duplicate_batch", 2), ("duplicate_store", 4)}
    assert postings.url_stored(store, "http://a.com/4").first().stored
    assert not postings.url_stored(store, "http://a.com/5").first().stored


def test_week_scan_prunes_partitions_and_columns(spark):
    t = tables(spark)
    ingest.ingest_batch(rows(spark, "http://a.com/1"), t, TS, ["pos"])
    scan = postings.weekly_scan(postings.read_store(spark, t.postings), "2026-W25", ["title", "raw_html"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_key" in plan
    assert "ReadSchema: struct<title:string,raw_html:string,is_active:boolean>" in plan
    assert scan.count() == 1
    one = postings.url_stored(postings.read_store(spark, t.postings), "http://a.com/1")
    assert "EqualTo(url_key,http://a.com/1)" in one._jdf.queryExecution().executedPlan().toString()


def test_failed_target_does_not_stop_the_rest(spark):
    t = tables(spark)

    def broken():
        raise OSError("no feed")

    def checked():
        return rows(spark, "http://a.com/1", "ftp://a.com/2", "http://a.com/3")

    out = ingest.run_ingest(spark, {"bad": broken, "good": checked}, t, lambda: TS, 10, ["pos"], page=None)
    got = {r.source_site: r for r in out.collect()}
    assert (got["bad"].run_id, got["bad"].status, got["bad"].error_message) == (10, "failed", "no feed")
    good = got["good"]
    assert (good.status, good.jobs_found, good.jobs_inserted, good.errors_encountered) == ("completed", 2, 2, 0)
    totals = runs.run_totals(out).first()
    assert (totals.targets_processed, totals.errors_encountered) == (1, 1)


def test_runs_count_failures_and_pages(spark):
    t = tables(spark)
    base = rows(spark, "http://a.com/1", "ftp://a.com/2", "http://a.com/3").withColumn("unparsed", F.col("pos") == 2)
    yields = spark.createDataFrame([("one", p, n) for p, n in [(1, 2), (2, 0), (3, 0)]], "source_site string, page_no long, n_jobs long")
    sources = {"one": lambda: base, "two": lambda: base}
    out = {r.source_site: r for r in ingest.run_ingest(spark, sources, t, lambda: TS, 5, ["pos"], yields=yields).collect()}
    one, two = out["one"], out["two"]
    assert (one.run_id, one.pages_scraped, one.jobs_found, one.jobs_inserted, one.jobs_deduplicated, one.errors_encountered) == (5, 3, 1, 1, 0, 1)
    assert (two.run_id, two.pages_scraped, two.jobs_found, two.jobs_inserted, two.jobs_deduplicated, two.errors_encountered) == (6, 0, 1, 0, 1, 1)


def test_a_batch_that_failed_between_writes_ends_as_one_clean_run(spark, monkeypatch):
    batch = rows(spark, "http://a.com/1", "http://a.com/2", "http://www.a.com/1", "")
    clean, broken = tables(spark), tables(spark)
    for t in (clean, broken):
        ingest.ingest_batch(rows(spark, "http://a.com/2", "http://a.com/9"), t, TS, ["pos"])
    ingest.ingest_batch(batch, clean, TS, ["pos"], "b-1")
    ingest.finish_batch(spark, "b-1")
    append = merging.MergingTable.append
    for stop_at in (1, 2):
        calls = []

        def stop(self, *args):
            calls.append(self.path)
            if len(calls) == stop_at:
                raise OSError("executor lost")
            append(self, *args)

        monkeypatch.setattr(merging.MergingTable, "append", stop)
        with pytest.raises(OSError):
            ingest.ingest_batch(batch, broken, TS, ["pos"], "b-2")
    monkeypatch.setattr(merging.MergingTable, "append", append)
    for _ in range(2):  # run again after all was written, it answers the same and writes nothing
        result = ingest.ingest_batch(batch, broken, TS, ["pos"], "b-2")
        assert (result.inserted, result.skipped, result.blank) == (1, 2, 1)

    def state(t):
        stored = sorted(r.url_key for r in postings.read_store(spark, t.postings).collect())
        audit = sorted((r.job_url, r.reason) for r in ingest.audit_table(t).read(spark).collect())
        keys = sorted(r.url_key for r in ingest.key_table(t).read(spark).collect())
        return stored, audit, keys

    assert state(clean) == state(broken)
    staged = os.path.join(shared_root(spark).removeprefix("file:"), "staged")
    assert not [f for f in os.listdir(staged) if f.startswith("b-")]


def test_scans_do_not_depend_on_the_number_of_targets(spark):
    listed = spark.createDataFrame([(i, f"t{i % 30}", f"http://a.com/{i}") for i in range(60)], "pos long, target string, job_url string")
    path = work_path(spark, "listed")
    listed.write.parquet(path)

    def scans(n):
        frame = ingest.tagged(spark.read.parquet(path).withColumn("errors", F.array().cast("array<string>")), [f"t{i}" for i in range(n)])
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return plan.count("Scan parquet"), plan.count("Union"), frame.select("_target").distinct().count()

    assert scans(3) == (1, 0, 3) and scans(30) == (1, 0, 30)


def test_tagged_targets_fail_alone(spark):
    t = tables(spark)
    batch = rows(spark, *[f"http://a.com/{i}" for i in range(6)], "http://a.com/0").withColumn("target", F.concat(F.lit("t"), F.col("pos") % 3))
    failures = spark.createDataFrame([("t1", "no answer"), ("t1", "timed out"), ("t2", None), ("other", "x")], "source_site string, failure string")
    yields = spark.createDataFrame([("t0", p, 1) for p in (1, 2, 3)], "source_site string, page_no long, n_jobs long")
    out = ingest.run_tagged(spark, batch, ["t2", "t1", "t0", "none"], t, lambda: TS, 7, ["pos"], yields=yields, failures=failures)
    got = {r.source_site: (r.run_id, r.status, r.error_message, r.pages_scraped, r.jobs_found, r.jobs_inserted, r.jobs_deduplicated) for r in out.collect()}
    assert got == {
        "t2": (7, "completed", None, 0, 2, 2, 0), "t1": (8, "failed", "no answer", 0, 0, 0, 0),
        "t0": (9, "completed", None, 3, 3, 2, 1), "none": (10, "completed", None, 0, 0, 0, 0),
    }
    assert sorted(r.url_key[-1] for r in postings.read_store(spark, t.postings).collect()) == ["0", "2", "3", "5"]


def test_an_ingest_leaves_no_work_tables(spark):
    root = shared_root(spark).removeprefix("file:")

    def work():
        return {os.path.join(d, f) for top in (spark.sparkContext.applicationId, "staged") for d in [os.path.join(root, top)]
                if os.path.isdir(d) for f in os.listdir(d)}

    t, before = tables(spark), work()
    ingest.ingest_batch(rows(spark, "http://a.com/1", "http://a.com/2"), t, TS, ["pos"])
    ingest.run_ingest(spark, {"a": lambda: rows(spark, "http://a.com/3")}, t, lambda: TS, 1, ["pos"])
    assert {os.path.basename(f) for f in work() - before} == {os.path.basename(os.path.dirname(t.postings))}


def test_work_can_be_dropped(spark):
    other = spark.newSession()
    path = work_path(spark, "x")
    other.range(3).write.parquet(path)
    assert path_exists(spark, path)
    drop_path(spark, path)
    assert not path_exists(spark, path)


def test_mentions_join_only_a_broadcast_taxonomy(spark):
    df = spark.createDataFrame([(1, "go sql")], "id long, t string")
    plan = mining.skill_mentions(df, F.col("t"), TAX, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastExchange") == 1 and "BuildRight" in plan


def posting_frame(spark):
    data = [
        ("k1", "Go dev", "Acme", "Berlin", "go rust", "2026-06-22", TS, 1, "2026-W25"),
        ("k2", "SQL", "Acme", "", "remote work", "2026-06-26", TS, 1, "2026-W25"),
        ("k3", "Go", "Beta", "Paris", "go", "2026-06-26", TS, 0, "2026-W25"),
        ("k4", "Rust", "Beta", "Paris", "next.js", "2026-06-10", TS, 1, "2026-W23"),
    ]
    return spark.createDataFrame(
        data, "url_key string, title string, company string, location string, raw_html string, date_posted string, "
        "scraped_at timestamp, is_active int, week_key string",
    )


def test_reports(spark):
    now = F.lit(AS_OF).cast("timestamp")
    a = analysis.analyze(posting_frame(spark), TAX, now, "2026-W25")
    s = a.summary.first()
    assert tuple(s) == (2, 4, 4, 2.0)
    cats = a.categories.collect()
    assert sum(c.total_mentions for c in cats) == s.mentions and sum(c.unique_skills for c in cats) == s.unique_skills
    assert {(r.name, r.n) for r in a.companies.collect()} == {("Acme", 2), ("Beta", 1)}

    path = work_path(spark, "md")
    report.write_markdown(report.markdown_lines(a, AS_OF, len(TAX.categories)), path)
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "**Period:** 2026-W25" in text
    assert "| 1 | **Go** | 1 | 50.0% | Lang |" in text
    assert "### Soft Skills" in text and "| Remote Work | 1 | 50.0% |" in text
    assert text.index("| Rank |") < text.index("### Lang") < text.index("| Location |") < text.index("| Acme | 2 |")

    path = work_path(spark, "json")
    report.write_json(report.json_lines(a, AS_OF), path)
    by_section = {}
    for r in spark.read.text(path).collect():
        by_section.setdefault(r.section, []).append(json.loads(r.value))
    assert by_section["summary"][0]["total_jobs_analyzed"] == 2
    assert by_section["period"] == [{"week_key": "2026-W25", "start_date": "2026-06-22", "end_date": "2026-06-26"}]
    lang = next(c for c in by_section["skills_by_category"] if c["category"] == "lang")
    assert [x["skill"] for x in lang["top_skills"]] == ["go", "rust", "sql"]
    assert {x["name"] for x in by_section["location_distribution"]} == {"Berlin", "Paris"}


def test_empty_report_leaves_sections_out(spark):
    now = F.lit(AS_OF).cast("timestamp")
    a = analysis.analyze(posting_frame(spark), TAX, now, "1900-W01")
    lines = {r.line for r in report.markdown_lines(a, AS_OF, 2).collect()}
    assert "## Skills by Category" not in lines and "## Job Count by Location" not in lines
    assert "**Total Jobs Analyzed:** 0" in lines


def test_stream_equals_batch(spark):
    t = tables(spark)
    landing = work_path(spark, "landing")
    pages = [(i, f"http://a.com/{i % 7}", "<h1>x</h1>") for i in range(20)]
    spark.createDataFrame(pages, schema.PAGE).repartition(4, "page_id").write.parquet(landing)

    def parse(df):
        return df.select(
            F.col("page_id").alias("pos"), F.lit("a title").alias("title"), F.lit("").alias("company"), F.lit("").alias("location"),
            F.lit("").alias("salary_range"), F.lit("2026-06-26").alias("date_posted"), F.col("url").alias("job_url"),
            F.lit("s").alias("source_site"), F.col("html").alias("raw_html"),
        )

    def run():
        stream = incremental.stream_files(spark, landing, schema.PAGE, bytes_per_batch=1)
        incremental.ingest_stream(stream, parse, t, checkpoint, lambda: TS, ["pos"]).awaitTermination()

    checkpoint = work_path(spark, "cp")
    run()
    batch = tables(spark)
    ingest.ingest_batch(parse(spark.read.parquet(landing)), batch, TS, ["pos"])
    keys = [sorted(r.url_key for r in postings.read_store(spark, x.postings).collect()) for x in (t, batch)]
    assert keys[0] == keys[1] == [f"http://a.com/{i}" for i in range(7)]
    # New files go on where the checkpoint stopped; the same files under a new checkpoint add nothing.
    spark.createDataFrame([(99, "http://a.com/new", ""), (98, "http://a.com/1", "")], schema.PAGE).write.mode("append").parquet(landing)
    run()
    checkpoint = work_path(spark, "cp")
    run()
    assert postings.read_store(spark, t.postings).count() == 8


def test_repeats_within_the_horizon_do_not_reach_a_micro_batch(spark):
    landing, checkpoint, t, batch = work_path(spark, "landing"), work_path(spark, "cp"), tables(spark), tables(spark)
    kind = "pos long, url string, seen timestamp"

    def parse(df):
        return df.select(
            "pos", F.lit("a title").alias("title"), *[F.lit("").alias(c) for c in ("company", "location", "salary_range", "date_posted", "raw_html")],
            F.col("url").alias("job_url"), F.lit("s").alias("source_site"), "seen",
        )

    reached, states, position = [], [], 0
    for day in range(6):  # each day ten new addresses, those of the day before, and one of the first day, each spelt twice; blank ones all stay
        urls = [f"http://a.com/{d}/{i}" for d in {day, max(day - 1, 0)} for i in range(10)] + ["http://a.com/0/0"]
        urls = urls + [u + "#x" for u in urls] + ["", ""]
        rows = [(position + i, u, datetime.datetime(2026, 6, 1 + day, 12)) for i, u in enumerate(urls)]
        position += len(rows)
        spark.createDataFrame(rows, kind).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(kind).parquet(landing)
        query = incremental.ingest_stream(stream, parse, t, checkpoint, lambda: TS, ["pos"], seen="seen", horizon="36 hours")
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
        assert sum(p["numInputRows"] for p in progress) == len(rows)
        audit = ingest.audit_table(t).manifest(spark).note
        reached.append(sum(audit))
    ingest.ingest_batch(parse(spark.read.parquet(landing)), batch, TS, ["pos"])
    stored = [sorted(r.url_key for r in postings.read_store(spark, x.postings).collect()) for x in (t, batch)]
    assert stored[0] == stored[1] == sorted(f"http://a.com/{d}/{i}" for d in range(6) for i in range(10))
    assert max(reached) <= 10 + 1 + 2 and max(states) <= 3 * 13 + 10  # the address of the first day comes once more when its time has passed


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_report_is_published_under_its_week_and_as_the_latest(spark):
    a = analysis.analyze(posting_frame(spark), TAX, F.lit(AS_OF).cast("timestamp"), "2026-W25")
    folder = work_path(spark, "reports")
    first = report.publish(report.markdown_lines(a, AS_OF, 2), folder, "2026-W25", TS)
    second = report.publish(report.markdown_lines(a, AS_OF, 2, title="Another"), folder, "2026-W26", datetime.datetime(2026, 7, 5, 1, 2, 3))
    assert [os.path.basename(p) for p in (first, second)] == ["skills_report_2026-W25_20260628_120000.md", "skills_report_2026-W26_20260705_010203.md"]
    latest, before = read_text(spark, f"{folder}/LATEST_SKILLS_REPORT.md"), read_text(spark, first)
    assert latest == read_text(spark, second) != before and before.startswith("# ") and "| 1 | **Go** | 1 | 50.0% | Lang |" in before
    assert sorted(n for n in os.listdir(folder.removeprefix("file:")) if not n.startswith(".")) == sorted(
        ["LATEST_SKILLS_REPORT.md", os.path.basename(first), os.path.basename(second)])
    path = report.publish_json(report.json_lines(a, AS_OF), folder, "2026-W25", TS)
    assert spark.read.text(path).filter("section = 'summary'").count() == 1


def test_expired_runs_leave_the_disk(spark):
    t = tables(spark)
    day = datetime.datetime(2026, 6, 1, 6)
    started = [day + datetime.timedelta(days=d, hours=h) for d in range(12) for h in (0, 12)]
    log = spark.createDataFrame([(i, s, "completed") for i, s in enumerate(started)], "run_id long, started_at timestamp, status string")
    ingest.log_runs(log.withColumn("status", F.lit("running")), t)
    ingest.log_runs(log, t)
    ingest.log_runs(spark.createDataFrame([(99, None, "failed")], log.schema), t)
    border = datetime.datetime(2026, 6, 5, 12)
    want = sum(s < border for s in started)
    assert upkeep.drop_expired(spark, t.runs, border + datetime.timedelta(days=30)) == want
    left = runs.latest_runs(runs.read_events(spark, t.runs)).collect()
    assert {r.run_id for r in left} == {i for i, s in enumerate(started) if s >= border} | {99}
    assert all(r.status in ("completed", "failed") for r in left)
    kept = [n for n in os.listdir(t.runs.removeprefix("file:")) if n.startswith("start_day=2")]
    assert min(kept) == "start_day=2026-06-05" and len(kept) == 8
    assert upkeep.drop_expired(spark, t.runs, border + datetime.timedelta(days=30)) == 0
    assert upkeep.drop_expired(spark, t.runs, datetime.datetime(2027, 1, 1)) == len(started) - want
    assert [r.run_id for r in runs.read_events(spark, t.runs).collect()] == [99]


def rollup_rows(spark):
    data = [(f"k{i}", ["a", "b", None][i % 3], ["Acme", "", None, "Beta"][i % 4], f"L{i % 5}", f"2026-06-{1 + i % 28:02d}",
             TS - datetime.timedelta(days=28 - i % 28, minutes=i), i % 7 > 0, [None, "2026-W21", "2026-W22", "2026-W23"][i % 28 // 7]) for i in range(300)]
    return spark.createDataFrame(data, "url_key string, source_site string, company string, location string, date_posted string, "
                                       "scraped_at timestamp, is_active boolean, week_key string")


def test_rollup_equals_full_scans_and_a_week_rewrites_its_partition(spark):
    store, path = rollup_rows(spark), work_path(spark, "rollup")
    rollup.refresh(store, path)

    def files():
        top = path.removeprefix("file:")
        return {d: set(os.listdir(os.path.join(top, d))) for d in os.listdir(top) if d.startswith("week_key")}

    def same():
        kept, now = spark.read.parquet(path), F.lit(AS_OF).cast("timestamp")
        for one, two in (
            (rollup.store_stats(kept, "2026-W22"), stats.store_stats(store, "2026-W22")), (rollup.rows_by_source(kept), stats.rows_by_source(store)),
            (rollup.distribution(kept, "location"), stats.distribution(store, "location")), (rollup.period(kept, now), stats.period(store, now)),
            (rollup.distribution(kept, "company", "2026-W23", 3), stats.distribution(store, "company", "2026-W23", 3)),
        ):
            assert one.columns == two.columns and sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)

    same()
    before = files()
    more = [("new", "a", "Gamma", "L9", "2026-06-27", TS, True, "2026-W23"), ("new2", "c", "Gamma", "L9", "2026-06-28", TS, True, "2026-W25")]
    store = store.union(spark.createDataFrame(more, store.schema))
    rollup.refresh(store, path, ["2026-W23", "2026-W25"])
    after = files()
    assert {d for d in after if after[d] != before.get(d)} == {"week_key=2026-W23", "week_key=2026-W25"}
    same()
    rollup.refresh(store.limit(0), work_path(spark, "rollup"))
    empty = rollup.weekly_rollup(store.limit(0))
    assert tuple(rollup.store_stats(empty, "w").first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("limit", [1, 9, 100, 1000])
@pytest.mark.parametrize("source", [None, "b"])
def test_newest_postings_come_from_few_partitions(spark, limit, source):
    path = work_path(spark, "postings")
    rollup_rows(spark).write.partitionBy("week_key").parquet(path)
    store = spark.read.parquet(path)
    kept = rollup.weekly_rollup(store)
    got = rollup.newest(store, kept, limit, source)
    want = [r.url_key for r in postings.posting_scan(rollup_rows(spark), source, limit=limit).collect()]
    assert [r.url_key for r in got.collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    if limit == 1:
        assert set(re.findall("2026-W..", re.search(r"PartitionFilters: \[(.*?)\], Pushed", plan).group(1))) == {"2026-W23"}


def test_late_events_are_counted_and_repeated_batches_are_not(spark):
    root = work_path(spark, "late")
    weeks = incremental.week_table(f"{root}/out", T.StructField("kind", T.StringType()))
    landing, now = f"{root}/landing", datetime.datetime(2026, 6, 24, 10)
    batches = [[(now, "a"), (now, "b")], [(now + datetime.timedelta(days=7), "a")], [(now - datetime.timedelta(days=60), "a"), (now, "a"), (None, "a")]]

    def run(checkpoint):
        stream = incremental.stream_files(spark, landing, T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType())]))
        incremental.count_weeks(stream, "ts", weeks, checkpoint).awaitTermination()

    def counted():
        return {(str(r.week_start), r.week_key, r.kind): r.n for r in incremental.counted_weeks(spark, weeks).collect()}

    for rows_of in batches:
        spark.createDataFrame(rows_of, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(landing)
        run(f"{root}/checkpoint")
    want = {("2026-06-22", "2026-W25", "a"): 2, ("2026-06-22", "2026-W25", "b"): 1, ("2026-06-29", "2026-W26", "a"): 1, ("2026-04-20", "2026-W16", "a"): 1}
    assert counted() == want
    last = weeks.manifest(spark)
    again = spark.createDataFrame([(datetime.date(2026, 4, 20), "2026-W16", "a", 1), (datetime.date(2026, 6, 22), "2026-W25", "a", 1)], weeks.columns)
    weeks.append(again, last.batch, 2)
    assert counted() == want
