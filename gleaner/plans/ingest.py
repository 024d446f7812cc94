"""Idempotent ingest: label a batch, append what is new, audit the rest."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import astuple, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleaner import schema
from gleaner.functions import dates, quality
from gleaner.operators import dedup, runs
from gleaner.session import Scratch, drop_path, path_exists, shared_root
from gleaner.sources import merging
from gleaner.sources.merging import MergingTable
from gleaner.sources.pages import storage_projection
from gleaner.sources.postings import read_store

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Tables:
    """Paths of the tables an ingest writes to, all on shared storage."""

    postings: str
    audit: str
    runs: str
    keys: str

    @classmethod
    def below(cls, root: str) -> Tables:
        return cls(f"{root}/postings", f"{root}/dedup_audit", f"{root}/runs", f"{root}/keys")


@dataclass(frozen=True)
class IngestResult:
    inserted: int
    skipped: int
    blank: int


def key_table(tables: Tables) -> MergingTable:
    """The keys of the store, ordered by their hash."""
    return MergingTable(tables.keys, schema.KEY, sort="h", fold=DataFrame.dropDuplicates)


def audit_table(tables: Tables) -> MergingTable:
    return MergingTable(tables.audit, schema.DEDUP_AUDIT)


def _hash() -> Column:
    return F.xxhash64("url_key").alias("h")


def stored_keys(spark: SparkSession, tables: Tables, keys: DataFrame) -> DataFrame:
    """Keys of the store that can be among ``keys``: those of a few are looked up, for more the key table is read."""
    table = key_table(tables)
    if not table.manifest(spark).runs:
        return spark.createDataFrame([], schema.KEY).select("url_key")
    asked = keys.filter(F.col("url_key") != "").select(_hash()).limit(merging.MOST_VALUES + 1).collect()
    found = table.among(spark, [r.h for r in asked]) if len(asked) <= merging.MOST_VALUES else table.read(spark)
    return found.select("url_key")


def _staged(spark: SparkSession, batch_id: str | None) -> str:
    return f"{shared_root(spark).rstrip('/')}/staged/{batch_id or uuid.uuid4().hex}"


def _stage(rows: DataFrame, path: str) -> DataFrame:
    """The batch, parsed and written once with row ids."""
    rows.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch")
    return rows.sparkSession.read.parquet(f"{path}/batch")


def _label(batch: DataFrame, tables: Tables, order_by: Sequence[str], path: str, valid: Column | None = None) -> DataFrame:
    """A status for each valid row of a staged batch, kept beside it until the batch is done."""
    spark = batch.sparkSession
    others = [c for c in ("errors", "source_site", *order_by) if c in batch.columns and c != "job_url"]
    if "errors" in batch.columns:
        valid = (F.size("errors") == 0) & (F.lit(True) if valid is None else valid)
    keys = (batch if valid is None else batch.filter(valid)).select("_row", *dict.fromkeys(others), "job_url", "url_key")
    labels = dedup.label_batch(keys, stored_keys(spark, tables, keys), order_by)
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    return spark.read.parquet(f"{path}/labels")


def _store(batch: DataFrame, labels: DataFrame, tables: Tables, stamp: Column, batch_id: str, again: bool) -> IngestResult:
    spark = batch.sparkSession
    counts = dedup.dedup_summary(labels).first()
    result = IngestResult(counts["kept_count"], counts["removed_count"], counts["blank_count"])
    kept = labels.filter(F.col("status") == dedup.KEPT)
    if result.inserted:
        wanted = batch.join(kept.select("_row"), "_row", "left_semi")
        with Scratch(spark) as scratch:
            if again:  # rows that the first attempt has stored are there already
                there = read_store(spark, tables.postings).select("url_key").join(kept.select("url_key"), "url_key", "left_semi")
                wanted = wanted.join(scratch.cut(there, "there"), "url_key", "left_anti")
            fresh = dates.with_week_key(wanted.withColumn("is_active", F.lit(True)))
            write_postings(fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.POSTING]), tables.postings)
    key_table(tables).append(kept.select(_hash(), "url_key"), batch_id, result.inserted)
    audit_table(tables).append(dedup.dedup_audit(labels, stamp), batch_id, result.skipped, list(astuple(result)))
    return result


def prepared(rows: DataFrame, stamp: Column) -> DataFrame:
    """Rows as they are stored, with their key."""
    return dedup.with_url_key(storage_projection(rows, stamp))


def ingest_batch(
    rows: DataFrame, tables: Tables, run_ts: datetime, order_by: Sequence[str], batch_id: str | None = None
) -> IngestResult:
    """Append the rows whose URL key is new; ``order_by`` says which of several copies is first.

    The batch is parsed and written once, with row ids; all verdicts are settled on its keys
    before anything is appended, against the keys that the key table can hold of them.
    Running the same batch again appends nothing. With a ``batch_id``, a batch that failed part
    of the way can be run again and ends as one clean run, since what was settled is staged
    under the id until all is written; the last batch that was written whole is known by its id and
    not run again. One writer per set of tables.
    """
    spark = rows.sparkSession
    stamp = F.lit(run_ts).cast("timestamp")
    path, name = _staged(spark, batch_id), batch_id or uuid.uuid4().hex
    done = audit_table(tables).manifest(spark)
    if done.batch == name:
        finish_batch(spark, name)
        return IngestResult(*done.note)
    again = path_exists(spark, f"{path}/labels/_SUCCESS")
    try:
        batch = spark.read.parquet(f"{path}/batch") if again else _stage(prepared(rows, stamp), path)
        labels = spark.read.parquet(f"{path}/labels") if again else _label(batch, tables, order_by, path)
        result = _store(batch, labels, tables, stamp, name, again)
    except Exception:
        if batch_id is None:
            drop_path(spark, path)
        raise
    drop_path(spark, path)
    return result


def finish_batch(spark: SparkSession, batch_id: str) -> None:
    """Drop what is staged for a batch that failed and will not be run again."""
    drop_path(spark, _staged(spark, batch_id))


def write_postings(fresh: DataFrame, path: str) -> None:
    """Append by week. Rebalancing splits a hot week over several files and joins small ones.

    The Bloom filter on the key serves single-key checks.
    """
    (
        fresh.hint("rebalance", "week_key")
        .write.mode("append")
        .partitionBy("week_key")
        .option("parquet.bloom.filter.enabled#url_key", "true")
        .parquet(path)
    )


def log_runs(events: DataFrame, tables: Tables) -> None:
    """Append run events by the day their run started, one file for a day and call."""
    by_day = runs.as_events(events).withColumn(runs.DAY, F.to_date("started_at"))
    by_day.coalesce(1).write.mode("append").partitionBy(runs.DAY).parquet(tables.runs)


def run_ingest(
    spark: SparkSession,
    sources: Mapping[str, Callable[[], DataFrame]],
    tables: Tables,
    clock: Callable[[], datetime],
    first_run_id: int,
    order_by: Sequence[str],
    page: str | None = None,
    yields: DataFrame | None = None,
) -> DataFrame:
    """Ingest targets that are sources of their own as one batch; one that cannot be opened does not stop the rest.

    ``sources`` gives each target's parsed rows (with ``errors`` where checked); of equal rows
    that of the earlier target is first. The rest is as in :func:`run_tagged`.
    """
    names = list(sources)

    def opened() -> tuple[DataFrame | None, dict[str, str]]:
        frames, failed = [], {}
        for i, name in enumerate(names):
            try:
                rows = sources[name]()
                checked = rows if "errors" in rows.columns else quality.with_errors(rows)
                frames.append(checked.drop("unparsed").withColumn("_target", F.lit(i)))
            except Exception as e:  # noqa: BLE001
                log.exception("target %s cannot be opened", name)
                failed[name] = str(e)
        return dedup.union_sources(*frames) if frames else None, failed

    return _run_all(spark, names, opened, tables, clock, first_run_id, order_by, page, yields)


def tagged(rows: DataFrame, targets: Sequence[str], target: str = "target") -> DataFrame:
    """Checked rows of the given targets, numbered in their order; one frame, however many targets there are."""
    checked = rows if "errors" in rows.columns else quality.with_errors(rows)
    place = F.create_map(*[F.lit(x) for i, t in enumerate(targets) for x in (t, i)])[F.col(target)] if targets else F.lit(None).cast("int")
    return checked.drop("unparsed").withColumn("_target", place).filter(F.col("_target").isNotNull())


def run_tagged(
    spark: SparkSession,
    rows: DataFrame,
    targets: Sequence[str],
    tables: Tables,
    clock: Callable[[], datetime],
    first_run_id: int,
    order_by: Sequence[str],
    target: str = "target",
    page: str | None = None,
    yields: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Ingest the rows of all targets as one batch and log a run for each.

    ``rows`` names its target in a column and is read once. ``failures (source_site, failure)``
    says which targets could not be scraped: their runs fail with the first message, none of
    their rows is stored, and the others go on. ``yields (source_site, page_no, n_jobs)`` counts
    the pages scraped, empty ones too; without it the distinct ``page`` of all rows are counted,
    rejected ones included. Only records that did not parse count as errors. If the batch fails,
    so do its runs. Returns the latest state of the runs of this call.
    """

    def opened() -> tuple[DataFrame, dict[str, str]]:
        failed = {}
        if failures is not None:
            wanted = failures.filter(F.col("source_site").isin(list(targets)) & F.col("failure").isNotNull())
            failed = {r.source_site: r.failure for r in wanted.groupBy("source_site").agg(F.min("failure").alias("failure")).collect()}
        return tagged(rows, targets, target), failed

    return _run_all(spark, list(targets), opened, tables, clock, first_run_id, order_by, page, yields)


def _run_all(spark, names, opened, tables, clock, first_run_id, order_by, page, yields) -> DataFrame:
    started, ids = clock(), {name: first_run_id + i for i, name in enumerate(names)}

    def event(name: str, status: str, **more) -> dict:
        return {"run_id": ids[name], "event_ts": clock(), "source_site": name, "started_at": started, "status": status, **more}

    def frame(events: list[dict]) -> DataFrame:
        kind = ["run_id", "event_ts", "source_site", "started_at", "status", "completed_at", "error_message"]
        fields = StructType([f for f in schema.RUN_EVENT if f.name in kind])
        return spark.createDataFrame([tuple(e.get(f.name) for f in fields) for e in events], fields)

    log_runs(frame([event(n, runs.RUNNING) for n in names]), tables)
    stamp, path, failed = F.lit(started).cast("timestamp"), _staged(spark, None), {}
    try:
        rows, failed = opened()
        if rows is not None:
            out = [i for i, n in enumerate(names) if n in failed]
            batch = _stage(prepared(rows, stamp), path)
            labels = _label(batch, tables, ["_target", *order_by], path, ~F.col("_target").isin(out) if out else None)
            _store(batch, labels, tables, stamp, uuid.uuid4().hex, False)
            _log_counts(batch, labels, names, tables, started, clock(), page, yields, ids, set(failed))
    except Exception as e:  # noqa: BLE001
        log.exception("ingest failed")
        failed |= {n: str(e) for n in names if n not in failed}
    finally:
        drop_path(spark, path)
    if failed:
        done = clock()
        log_runs(frame([event(n, runs.FAILED, completed_at=done, error_message=e) for n, e in failed.items()]), tables)
    events = runs.read_events(spark, tables.runs).drop(runs.DAY)
    return runs.latest_runs(events.filter(F.col("run_id").between(first_run_id, first_run_id + len(names) - 1)))


def _log_counts(batch, labels, names, tables, started, done, page, yields, ids, failed) -> None:
    """The closing events of all runs of a batch, counted in one frame."""
    spark = batch.sparkSession
    run = F.element_at(F.array(*[F.lit(i) for i in ids.values()]), F.col("_target") + 1).alias("run_id")
    pages = F.countDistinct(page) if page else F.lit(0).cast("long")
    seen = batch.groupBy("_target").agg(
        pages.alias("pages_scraped"), F.count_if(F.array_contains("errors", quality.UNPARSED)).alias("errors_encountered")
    )
    verdicts = labels.groupBy("_target").agg(
        F.count("*").alias("jobs_found"), F.count_if(F.col("status") == dedup.KEPT).alias("jobs_inserted"),
        F.count_if(F.col("status").startswith("duplicate")).alias("jobs_deduplicated"),
    )
    rows = [(i, n) for i, n in enumerate(names) if n not in failed]
    targets = spark.createDataFrame(rows, "_target int, source_site string")
    counted = targets.join(seen, "_target", "left").join(verdicts, "_target", "left")
    if yields is not None:
        fetched = yields.groupBy("source_site").agg(F.countDistinct("page_no").alias("fetched"))
        counted = counted.join(fetched, "source_site", "left").withColumn("pages_scraped", F.col("fetched")).drop("fetched")
    log_runs(
        counted.fillna(0, runs.COUNTERS).select(
            run, "source_site", *runs.COUNTERS, F.lit(done).alias("event_ts"), F.lit(done).alias("completed_at"),
            F.lit(started).alias("started_at"), F.lit(runs.COMPLETED).alias("status"),
        ),
        tables,
    )
