"""The registered queries: one per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField

from catalog import inputs
from catalog.inputs import AS_OF, FIXTURE_TAXONOMY, OVERLAP_TAXONOMY, WEEK, frame, table
from gleaner import schema
from gleaner.functions import dates, quality, urls
from gleaner.functions.text import mining_text, strip
from gleaner.operators import dedup, mining, pagination, phrase_join, rollup, runs, stats
from gleaner.plans import analysis, board, ingest, report, upkeep
from gleaner.session import work_path
from gleaner.sources import feeds, pages, postings, targets
from gleaner.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_STORED: dict[tuple[str, str], str] = {}
RUN_TS = datetime(2026, 6, 28, 12, 0)

# Layouts of the page table: blogs carry one article, the other hosts a list of links.
LAYOUTS = {
    "blog": pages.ListingRules(container=pages.start_tag("article"), title=pages.element("h1"), source_site="blog"),
    "list": pages.ListingRules(container=pages.start_tag("li"), title=pages.element("a"), source_site="list"),
}
HOST_LABELS = [("blog.", "blog"), ("spam", "spam"), ("m.", "mobile")]


def _now():
    return F.lit(AS_OF).cast("timestamp")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- inputs shaped by the library ------------------------------------------


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.with_week_key(frame(spark, sf_dir, inputs.POSTINGS))


def _doc_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.with_week_key(frame(spark, sf_dir, inputs.DOC_POSTINGS))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_url_key(frame(spark, sf_dir, inputs.BATCH))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_url_key(frame(spark, sf_dir, inputs.STORE))


def _feed_bodies(spark: SparkSession, sf_dir: str, **changed) -> DataFrame:
    rows = frame(spark, sf_dir, inputs.FEED).withColumns({"tags": F.array("tag1", "tag2"), **changed})
    fields = ["position", "company", "location", "tags", "description", "date"]
    by_slug = F.to_json(F.struct(*fields, "slug"))
    by_id = F.to_json(F.struct(*fields, F.col("part_key").cast("string").alias("id")))
    meta = F.lit('{"legal":"metadata, not a posting"}')
    alone = F.concat(F.lit("["), by_slug, F.lit("]"))
    listed = F.concat(F.lit("["), meta, F.lit(","), by_slug, F.lit(","), by_id, F.lit("]"))
    return rows.select("part_key", F.when(F.col("kind") == "ECONOMY", alone).otherwise(listed).alias("body"))


def _feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.feed_postings(feeds.feed_entries(_feed_bodies(spark, sf_dir)))


def _doc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.skill_counts(_documents(spark, sf_dir), F.col("text"), FIXTURE_TAXONOMY)


def _doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.skill_frequency(_doc_counts(spark, sf_dir), FIXTURE_TAXONOMY)


# -- sources and parsing -----------------------------------------------------


@query
def q_feed_scan(spark, sf_dir):
    entries = feeds.feed_entries(_feed_bodies(spark, sf_dir))
    position = F.from_json("entry", schema.FEED_ENTRY)["position"]
    return entries.select("part_key", F.col("pos").cast("long").alias("pos"), position.alias("position"))


@query
def q_feed_landed(spark, sf_dir):
    path = work_path(spark, "feed")
    _feed_bodies(spark, sf_dir).select("body").write.text(path)
    landed = feeds.read_feed(spark, path, one_body_per_file=False)
    rows = feeds.feed_postings(feeds.feed_entries(landed))
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_url").alias("urls"))


@query
def q_feed_postings(spark, sf_dir):
    return _feed_rows(spark, sf_dir).select(
        "part_key", F.col("pos").cast("long").alias("pos"), "title", "company", "location", "salary_range",
        "date_posted", "job_url", "source_site",
    )


@query
def q_feed_unknown(spark, sf_dir):
    """Fields that postings have no column for, by name and type: numbers, flags, objects and texts."""
    more = [
        F.col("part_key").alias("pay_from"), (F.col("part_key") % 2 == 0).alias("verified"),
        F.struct(F.col("tag1").alias("lead"), F.array("tag2", "company").alias("team")).alias("staff"),
        F.when(F.col("part_key") % 3 == 0, F.col("tag2")).alias("logo"),
    ]
    one = F.to_json(F.struct("position", "company", "description", *more))
    bodies = frame(spark, sf_dir, inputs.FEED).select("part_key", F.concat(F.lit("["), one, F.lit("]")).alias("body"))
    found = feeds.unknown_fields(feeds.feed_entries(bodies))
    value = F.coalesce(F.try_variant_get("value", "$.team[1]", "string"), F.try_variant_get("value", "$", "string"))
    return found.groupBy("field", "kind").agg(F.count("*").alias("n"), F.countDistinct(value).alias("values"), F.max(value).alias("last"))


@query
def q_feed_raw(spark, sf_dir):
    raw = F.col("raw_html")
    long = F.when(F.col("part_key") % 5 == 0, F.concat(F.lit("filler " * 900), "description", F.lit(" late"))).otherwise(F.col("description"))
    bodies = _feed_bodies(spark, sf_dir, description=long)
    return feeds.feed_postings(feeds.feed_entries(bodies)).select(
        "part_key", F.col("pos").cast("long").alias("pos"), F.endswith(F.substring_index(F.substring_index(raw, '","date"', 1), '"', -1), F.lit("late")).alias("late"),
        F.regexp_extract(raw, "<!-- TAGS: (.*) -->$", 1).alias("tags"),
        F.get_json_object(F.substring_index(raw, "\n<!--", 1), "$.description").alias("description"),
    )


@query
def q_location_infer(spark, sf_dir):
    rows = frame(spark, sf_dir, inputs.FEED)
    return rows.select("part_key", feeds.infer_location(F.col("location"), F.array("tag1", "tag2")).alias("value"))


@query
def q_salary_extract(spark, sf_dir):
    return frame(spark, sf_dir, inputs.FEED).select("part_key", feeds.extract_salary(F.col("description")).alias("value"))


@query
def q_posted_date(spark, sf_dir):
    return frame(spark, sf_dir, inputs.FEED).select("part_key", dates.feed_date(F.col("date")).alias("value"))


@query
def q_relative_date(spark, sf_dir):
    rows = frame(spark, sf_dir, inputs.RELDATE)
    return rows.select("event_id", dates.relative_date(F.col("txt"), _now()).alias("parsed"))


@query
def q_validity(spark, sf_dir):
    return quality.rejects_by_reason(quality.with_errors(_feed_rows(spark, sf_dir)))


@query
def q_quarantine(spark, sf_dir):
    ok = F.size("errors") == 0
    checked = quality.with_errors(_feed_rows(spark, sf_dir))
    return checked.groupBy("company").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"))


@query
def q_feed_broken(spark, sf_dir):
    """Bodies that are whole, cut off, markup, or a single object: rows and broken bodies of each kind."""
    kind = F.element_at(F.array(F.lit("whole"), F.lit("cut"), F.lit("markup"), F.lit("object")), (F.col("part_key") % 4 + 1).cast("int"))
    body = F.col("body")
    broken = (
        F.when(F.col("kind") == "whole", body).when(F.col("kind") == "cut", F.expr("left(body, length(body) - 3)"))
        .when(F.col("kind") == "markup", F.concat(F.lit("<html>"), body, F.lit("</html>"))).otherwise(F.expr("substr(body, 2, length(body) - 2)"))
    )
    alone = _feed_bodies(spark, sf_dir).withColumn("kind", kind)
    bodies = alone.select("part_key", "kind", F.when(F.col("kind") == "object", F.lit('{"position": "x", "company": "y"}')).otherwise(broken).alias("body"))
    rows = feeds.feed_postings(feeds.feed_entries(bodies))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("unparsed").alias("unparsed"))


@query
def q_page_listings(spark, sf_dir):
    raw = table(spark, sf_dir, "pages")
    layout = F.when(F.startswith(urls.host_of(F.col("url")), F.lit("blog.")), "blog").otherwise("list")
    rows = pages.page_listings(raw, layout, _now(), LAYOUTS)
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "job_url", "source_site")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, inputs.CARDS)


def _card_rows(spark: SparkSession, sf_dir: str, host: str, markup: str) -> DataFrame:
    """Cards laid out on pages of a board, 2,500 on one at most, through the built-in layout of that board."""
    cards = _cards(spark, sf_dir).withColumn("card", F.expr(markup))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "\n")
    raw = cards.groupBy("page_id").agg(body.alias("html"))
    raw = raw.select("page_id", F.lit(f"https://{host}/list").alias("url"), F.concat(F.lit("<html><body>"), "html", F.lit("</body></html>")).alias("html"))
    rows = pages.page_listings(raw, urls.detect_source(F.col("url")), _now())
    return rows.select(
        "page_id", F.col("pos").cast("long").alias("pos"), "title", "company", "location", "salary_range", "date_posted", "job_url", "source_site"
    )


@query
def q_page_fields(spark, sf_dir):
    """Every field of the generic layout, from two kinds of containers in turn."""
    return _card_rows(spark, sf_dir, "cards.example.org", inputs.GENERIC_CARD)


@query
def q_page_placeholder(spark, sf_dir):
    return _card_rows(spark, sf_dir, "remoteok.com", inputs.TABLE_CARD)


@query
def q_page_fallback(spark, sf_dir):
    return _card_rows(spark, sf_dir, "weworkremotely.com", inputs.PLAIN_CARD)


@query
def q_page_stamp(spark, sf_dir):
    return _card_rows(spark, sf_dir, "weworkremotely.com", inputs.STAMP_CARD)


@query
def q_source_label(spark, sf_dir):
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(
        F.when(F.col("page_id") % 2 == 0, urls.detect_source(url, configured=F.lit("given"), known=HOST_LABELS))
        .otherwise(urls.detect_source(url, known=HOST_LABELS)).alias("source_site")
    )
    return rows.groupBy("source_site").agg(F.count("*").alias("n"))


@query
def q_page_links(spark, sf_dir):
    links = pages.page_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "job_url")


@query
def q_source_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(urls.detect_source(F.col("url"), known=HOST_LABELS).alias("source_site"))
    return rows.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


@query
def q_target_filter(spark, sf_dir):
    chosen = targets.select_targets(frame(spark, sf_dir, inputs.TARGETS), "PPLIER#0000000")
    return chosen.select("name", "base_url")


@query
def q_page_plan(spark, sf_dir):
    plan = targets.page_plan(targets.select_targets(frame(spark, sf_dir, inputs.TARGETS)))
    return plan.select("name", F.col("page_no").cast("long").alias("page_no"), "page_url")


@query
def q_pagination_stop(spark, sf_dir):
    return pagination.last_pages(frame(spark, sf_dir, inputs.YIELD))


@query
def q_fetched_pages(spark, sf_dir):
    return pagination.fetched_pages(frame(spark, sf_dir, inputs.YIELD))


# -- scalar functions ----------------------------------------------------------


@query
def q_url_normalize(spark, sf_dir):
    return _batch(spark, sf_dir).select("batch_pos", "url_key")


@query
def q_url_normalize_params(spark, sf_dir):
    rows = frame(spark, sf_dir, inputs.PARAM_URLS)
    return dedup.with_url_key(rows, "url").select("o_orderkey", "url_key")


@query
def q_tracking_params(spark, sf_dir):
    rows = frame(spark, sf_dir, inputs.BATCH).select(F.explode(urls.tracking_params(F.col("job_url"))).alias("param"))
    return rows.groupBy("param").agg(F.count(F.lit(1)).alias("n"))


@query
def q_week_key(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"), F.col("o_orderdate").alias("seen")
    )
    events = table(spark, sf_dir, "events").select(F.lit("").alias("posted"), F.col("ts").alias("seen"))
    weeks = dates.with_week_key(dedup.union_sources(ordered, events), "posted", "seen")
    return weeks.groupBy("week_key").agg(F.count(F.lit(1)).alias("n"))


# -- posting table --------------------------------------------------------------


def _stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings as an ingest stores them, by week; stored once for all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = work_path(spark, "postings")
        ingest.write_postings(_postings(spark, sf_dir), path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


@query
def q_posting_scan(spark, sf_dir):
    rows = postings.posting_scan(_stored_postings(spark, sf_dir), source_site="1-URGENT", tie="posting_id")
    return rows.select("posting_id", "company", "location", "week_key")


@query
def q_posting_scan_latest(spark, sf_dir):
    rows = postings.posting_scan(_stored_postings(spark, sf_dir), limit=50, tie="posting_id")
    return rows.select("posting_id", "company", "location", "week_key")


@query
def q_weekly_scan(spark, sf_dir):
    return postings.weekly_scan(_stored_postings(spark, sf_dir), WEEK, ["posting_id", "company", "location", "week_key"])


@query
def q_store_stats(spark, sf_dir):
    return stats.store_stats(_postings(spark, sf_dir), WEEK)


@query
def q_by_source(spark, sf_dir):
    return stats.rows_by_source(_postings(spark, sf_dir))


@query
def q_location_dist(spark, sf_dir):
    return stats.location_distribution(_postings(spark, sf_dir), WEEK)


@query
def q_company_dist(spark, sf_dir):
    return stats.company_distribution(_postings(spark, sf_dir), WEEK)


@query
def q_company_dist_all(spark, sf_dir):
    return stats.company_distribution(_postings(spark, sf_dir), limit=20)


@query
def q_period(spark, sf_dir):
    return stats.period(_postings(spark, sf_dir), _now())


# -- statistics kept by week ---------------------------------------------------------


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of all stored weeks, and of one of them once more; kept for all queries of a session."""
    key = (spark.sparkContext.applicationId, f"rollup {sf_dir}")
    if key not in _STORED:
        path, stored = work_path(spark, "rollup"), _stored_postings(spark, sf_dir)
        rollup.refresh(stored, path)
        rollup.refresh(stored, path, [WEEK])
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


@query
def q_rollup_stats(spark, sf_dir):
    return rollup.store_stats(_rollup(spark, sf_dir), WEEK)


@query
def q_rollup_by_source(spark, sf_dir):
    return rollup.rows_by_source(_rollup(spark, sf_dir))


@query
def q_rollup_location_dist(spark, sf_dir):
    return rollup.distribution(_rollup(spark, sf_dir), "location", WEEK)


@query
def q_rollup_company_dist(spark, sf_dir):
    return rollup.distribution(_rollup(spark, sf_dir), "company", limit=20)


@query
def q_rollup_period(spark, sf_dir):
    return rollup.period(_rollup(spark, sf_dir), _now())


@query
def q_posting_scan_newest(spark, sf_dir):
    rows = rollup.newest(_stored_postings(spark, sf_dir), _rollup(spark, sf_dir), 50, tie="posting_id")
    return rows.select("posting_id", "company", "location", "week_key")


@query
def q_posting_scan_newest_source(spark, sf_dir):
    rows = rollup.newest(_stored_postings(spark, sf_dir), _rollup(spark, sf_dir), 50, "1-URGENT", "posting_id")
    return rows.select("posting_id", "company", "location", "week_key")


# -- deduplication and ingest ------------------------------------------------------


@query
def q_existing_keys(spark, sf_dir):
    return dedup.existing_keys(_batch(spark, sf_dir), _store(spark, sf_dir))


@query
def q_url_stored(spark, sf_dir):
    tables = ingest.Tables.below(work_path(spark, "stored"))
    ingest.ingest_batch(_page_rows(table(spark, sf_dir, "pages")), tables, RUN_TS, ["page_id"])
    store = postings.read_store(spark, tables.postings)
    found = [postings.url_stored(store, key).select(F.lit(key).alias("url_key"), F.col("stored").cast("long").alias("stored")) for key in inputs.KEYS]
    return dedup.union_sources(*found)


@query
def q_dedup_positions(spark, sf_dir):
    """Positions that are null or shared by several rows: every row once, one of each key kept."""
    batch = _batch(spark, sf_dir).withColumn("place", F.when(F.col("batch_pos") % 4 != 0, F.col("batch_pos") % 5))
    labelled = dedup.label_batch(batch, None, ["place"])
    return labelled.groupBy("url_key").agg(
        F.count("*").alias("n"), F.countDistinct("batch_pos").alias("rows"), F.count_if(F.col("status") == dedup.KEPT).alias("kept"),
        F.min(F.when(F.col("status") == dedup.KEPT, F.coalesce("place", F.lit(-1)))).alias("place"),
    )


@query
def q_dedup_batch(spark, sf_dir):
    return dedup.new_rows(_batch(spark, sf_dir), None, ["batch_pos"]).select("url_key", "batch_pos")


@query
def q_dedup_against_store(spark, sf_dir):
    return dedup.new_rows(_batch(spark, sf_dir), _store(spark, sf_dir), ["batch_pos"]).select("batch_pos")


@query
def q_dedup_status(spark, sf_dir):
    labelled = dedup.label_batch(_batch(spark, sf_dir), _store(spark, sf_dir), ["batch_pos"])
    return labelled.select("batch_pos", "url_key", "status")


@query
def q_dedup_summary(spark, sf_dir):
    return dedup.dedup_summary(dedup.label_batch(_batch(spark, sf_dir), _store(spark, sf_dir), ["batch_pos"]))


@query
def q_dedup_audit(spark, sf_dir):
    labelled = dedup.label_batch(_batch(spark, sf_dir), _store(spark, sf_dir), ["batch_pos"])
    return dedup.dedup_audit(labelled, _now()).select("job_url", "reason")


@query
def q_cross_page_dedup(spark, sf_dir):
    rows = frame(spark, sf_dir, inputs.BATCH)
    kept = dedup.first_page_only(rows, ["batch_pos"], within=["source_site"])
    return kept.select("batch_pos", "page_no", "job_url")


@query
def q_union_sources(spark, sf_dir):
    from_pages = table(spark, sf_dir, "pages").select(
        urls.host_of(F.col("url")).alias("company"), F.col("url").alias("job_url"), F.lit("pages").alias("source_site")
    )
    from_orders = _postings(spark, sf_dir).select("source_site", "company", "location")
    both = dedup.union_sources(from_pages, from_orders)
    return both.groupBy("source_site").agg(
        F.count(F.lit(1)).alias("n"), F.count("job_url").alias("with_url"), F.count("location").alias("with_location")
    )


def _page_rows(raw: DataFrame) -> DataFrame:
    """Pages as posting rows, one each."""
    heading = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    return raw.select(
        "page_id", strip(heading).alias("title"), urls.host_of(F.col("url")).alias("company"),
        F.lit("").alias("location"), F.lit("").alias("salary_range"), F.lit("2026-06-26").alias("date_posted"),
        F.col("url").alias("job_url"), F.lit("pages").alias("source_site"), F.col("html").alias("raw_html"),
    )


def _batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch with the title and markup of its pages."""
    rows = frame(spark, sf_dir, inputs.BATCH).withColumn("page_id", F.expr("batch_pos div 3"))
    payload = _page_rows(table(spark, sf_dir, "pages")).drop("job_url", "source_site")
    return rows.join(payload, "page_id").drop("page_id")


@query
def q_idempotent_append(spark, sf_dir):
    tables = ingest.Tables.below(work_path(spark, "append"))
    stored = frame(spark, sf_dir, inputs.STORE).withColumn("batch_pos", F.col("page_id"))
    first = _page_rows(table(spark, sf_dir, "pages").join(stored.select("page_id"), "page_id", "left_semi"))
    ingest.ingest_batch(first, tables, RUN_TS, ["page_id"])
    results = []
    for run_no in (1, 2):
        r = ingest.ingest_batch(_batch_rows(spark, sf_dir), tables, RUN_TS, ["batch_pos"])
        results.append((run_no, r.inserted, r.skipped, r.blank))
    return spark.createDataFrame(results, "run_no long, inserted long, skipped long, blank long")


@query
def q_stored_postings(spark, sf_dir):
    tables = ingest.Tables.below(work_path(spark, "stored"))
    ingest.ingest_batch(_batch_rows(spark, sf_dir), tables, RUN_TS, ["batch_pos"])
    return postings.read_store(spark, tables.postings).select(
        "url_key", "job_url", "week_key", "title", "company", F.length("raw_html").cast("long").alias("size")
    )


@query
def q_run_log(spark, sf_dir):
    tables = ingest.Tables.below(work_path(spark, "runs"))
    rows = _batch_rows(spark, sf_dir)
    blog = F.col("source_site").startswith("blog.")
    sources = {"blogs": lambda: rows.filter(blog), "others": lambda: rows.filter(~blog)}
    state = ingest.run_ingest(spark, sources, tables, lambda: RUN_TS, 1, ["batch_pos"], page="page_no")
    return state.select("run_id", "source_site", "status", *runs.COUNTERS)


@query
def q_run_counters(spark, sf_dir):
    labelled = dedup.label_batch(_batch(spark, sf_dir), _store(spark, sf_dir), ["batch_pos"])
    return runs.run_counters(labelled, "source_site", page="page_no")


@query
def q_run_totals(spark, sf_dir):
    return runs.run_totals(frame(spark, sf_dir, inputs.RUNS))


@query
def q_run_latest(spark, sf_dir):
    finished = frame(spark, sf_dir, inputs.RUNS)
    begun = finished.select("run_id", F.col("started_at").alias("event_ts"), "started_at", F.lit(runs.RUNNING).alias("status"))
    # The runs that failed have no closing event and stay open.
    closed = finished.filter(F.col("status") == runs.COMPLETED).withColumn("event_ts", F.col("completed_at"))
    events = dedup.union_sources(runs.as_events(begun), runs.as_events(closed))
    return runs.latest_runs(events).select("run_id", "status", "pages_scraped", "jobs_inserted")


@query
def q_recent_runs(spark, sf_dir):
    rows = runs.recent_runs(frame(spark, sf_dir, inputs.RUNS))
    mark = F.when(F.col("status") == runs.COMPLETED, "✓").otherwise("✗")
    return rows.select("run_id", mark.alias("mark"), "jobs_inserted", "pages_scraped", "status")


@query
def q_run_retention(spark, sf_dir):
    log = frame(spark, sf_dir, inputs.RUNS)
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    kept = runs.retained(log, as_of, 10).withColumn("stays", F.lit(True))
    both = kept.union(runs.expired(log, as_of, 10).withColumn("stays", F.lit(False)))
    return both.groupBy("status").agg(F.count_if("stays").alias("kept"), F.count_if(~F.col("stays")).alias("removed"))


@query
def q_run_purge(spark, sf_dir):
    """The run log as it is stored, after its expired runs were dropped; how many those were is in every row."""
    tables = ingest.Tables.below(work_path(spark, "purge"))
    ingest.log_runs(frame(spark, sf_dir, inputs.RUNS), tables)
    removed = upkeep.drop_expired(spark, tables.runs, datetime(2024, 2, 1), 10)
    left = runs.read_events(spark, tables.runs)
    return left.groupBy("status").agg(F.count("*").alias("kept"), F.lit(removed).cast("long").alias("removed"))


# -- mining ---------------------------------------------------------------------


@query
def q_skill_mentions(spark, sf_dir):
    return mining.skill_mentions(_documents(spark, sf_dir), F.col("text"), FIXTURE_TAXONOMY, "doc_id")


@query
def q_skill_mentions_overlap(spark, sf_dir):
    return mining.skill_mentions(_documents(spark, sf_dir), F.col("text"), OVERLAP_TAXONOMY, "doc_id")


@query
def q_skill_mentions_large(spark, sf_dir):
    """A taxonomy of hundreds of phrases with symbols, dots and overlaps, between token edges."""
    return mining.skill_mentions(_documents(spark, sf_dir), F.col("text"), inputs.large_taxonomy(), "doc_id")


@query
def q_skill_mentions_table(spark, sf_dir):
    """A taxonomy that grows with the data: the first words of all documents, under their sources."""
    docs = _documents(spark, sf_dir)
    # What precedes the third blank holds the first three words; each is then split off a short text and not off a whole one.
    opened = table(spark, sf_dir, "documents").withColumn("text", F.substring_index("text", " ", 3))
    openings = frame(spark, sf_dir, inputs.OPENINGS, documents=opened)
    return phrase_join.skill_mentions(docs, F.col("text"), openings, "doc_id", edge="token")


@query
def q_skill_freq(spark, sf_dir):
    return _doc_frequency(spark, sf_dir).select("skill", "n")


@query
def q_top_skills(spark, sf_dir):
    return mining.top_skills(_doc_frequency(spark, sf_dir))


@query
def q_top_skills_by_category(spark, sf_dir):
    return mining.top_skills_by_category(_doc_frequency(spark, sf_dir), 2).drop("category_ord")


@query
def q_category_stats(spark, sf_dir):
    return mining.category_stats(_doc_frequency(spark, sf_dir)).drop("category_ord")


@query
def q_corpus_summary(spark, sf_dir):
    return mining.corpus_summary(_doc_counts(spark, sf_dir))


@query
def q_skill_trend(spark, sf_dir):
    rows = _doc_postings(spark, sf_dir).filter("is_active = 1")
    rows = rows.withColumn("week_key", F.when(F.col("doc_id") % 29 != 0, F.col("week_key")))
    text = mining_text(F.col("title"), F.col("company"), F.col("raw_html"))
    return mining.skill_trend(mining.skill_counts(rows, text, FIXTURE_TAXONOMY, "week_key"))


# -- analysis and reports -----------------------------------------------------------


def _analysis(spark: SparkSession, sf_dir: str, week_key: str | None = None) -> analysis.Analysis:
    return analysis.analyze(_doc_postings(spark, sf_dir), FIXTURE_TAXONOMY, _now(), week_key)


@query
def q_report_markdown(spark, sf_dir):
    return report.markdown_lines(_analysis(spark, sf_dir), AS_OF, len(FIXTURE_TAXONOMY.categories))


@query
def q_report_json(spark, sf_dir):
    return report.json_lines(_analysis(spark, sf_dir), AS_OF)


@query
def q_empty_analysis(spark, sf_dir):
    nothing = _analysis(spark, sf_dir, week_key="1900-W01")
    return report.json_lines(nothing, AS_OF)


# -- pages to analysis ------------------------------------------------------------


def _board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ingest.Tables]:
    """The pages of three boards, by the end of their host, parsed and stored."""
    raw = pages.read_pages(spark, f"{sf_dir}/pages.parquet")
    host = urls.host_of(F.col("url"))
    raw = raw.select("page_id", "url", "html", F.substring_index(host, ".", -1).alias("target"), (F.col("page_id") % 20 + 1).alias("page_no"))
    layout = F.when(F.startswith(host, F.lit("blog.")), "blog").otherwise("list")
    tables = ingest.Tables.below(work_path(spark, "board"))
    state = board.run_board(spark, raw, ["com", "net", "org"], layout, _now(), tables, lambda: RUN_TS, layouts=LAYOUTS)
    return state, tables


@query
def q_pipeline(spark, sf_dir):
    """Landed pages to stored postings: the log of the runs."""
    state, _ = _board(spark, sf_dir)
    return state.select("run_id", "source_site", "status", *runs.COUNTERS)


@query
def q_pipeline_skills(spark, sf_dir):
    """Landed pages to stored postings to the analysis of their week."""
    _, tables = _board(spark, sf_dir)
    return board.weekly_analysis(spark, tables, FIXTURE_TAXONOMY, _now(), "2026-W25").top_skills


# -- streaming --------------------------------------------------------------------


@query
def q_stream_ingest(spark, sf_dir):
    root = work_path(spark, "stream")
    landing = f"{root}/landing"
    table(spark, sf_dir, "pages").select("page_id", "url", "html").write.option("maxRecordsPerFile", 1000).parquet(landing)
    tables = ingest.Tables.below(root)
    landed = incremental.stream_files(spark, landing, schema.PAGE, bytes_per_batch=64 << 20)
    incremental.ingest_stream(
        landed, _page_rows, tables, f"{root}/checkpoint", lambda: RUN_TS, ["page_id"]
    ).awaitTermination()
    return postings.read_store(spark, tables.postings).select("url_key", "week_key")


@query
def q_stream_weekly(spark, sf_dir):
    root = work_path(spark, "weekly")
    events = table(spark, sf_dir, "events")
    landing = f"{root}/landing"
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(landing)
    stream = incremental.stream_files(spark, landing, spark.read.parquet(landing).schema)
    counted = incremental.weekly_event_counts(stream, "ts", "event_type")
    incremental.write_weeks(counted, f"{root}/out", f"{root}/checkpoint", "event_type").awaitTermination()
    done = spark.read.schema("week_start date, week_key string, event_type string, n long").parquet(f"{root}/out")
    return done.select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "week_key", "event_type", "n")


@query
def q_stream_weekly_late(spark, sf_dir):
    """Events that land newest first, so that most are weeks late: each is counted."""
    root = work_path(spark, "late")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    by_part = StructField("event_type", StringType())
    weeks = incremental.week_table(f"{root}/out", by_part)
    for part in (2, 1, 0):
        events.filter((F.dayofmonth("ts") - 1) / 11 < part + 1).filter((F.dayofmonth("ts") - 1) / 11 >= part).coalesce(1).write.mode("append").parquet(f"{root}/landing")
        stream = incremental.stream_files(spark, f"{root}/landing", events.schema)
        incremental.count_weeks(stream, "ts", weeks, f"{root}/checkpoint").awaitTermination()
    return incremental.counted_weeks(spark, weeks).select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "week_key", "event_type", "n")
