"""Run log: append-only events, latest state, totals, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from gleaner import schema
from gleaner.operators.dedup import KEPT

COUNTERS = ["pages_scraped", "jobs_found", "jobs_inserted", "jobs_deduplicated", "errors_encountered"]
# The states of a run.
RUNNING, COMPLETED, FAILED = "running", "completed", "failed"
#: The day a run started, by which its events are stored.
DAY = "start_day"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored events with their :data:`DAY`."""
    stored = StructType([*schema.RUN_EVENT, StructField(DAY, DateType())])
    return spark.read.schema(stored).parquet(path)


def run_counters(labelled: DataFrame, *by: str, page: str | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Counters per ``by`` from a labelled batch; ``errors`` holds ``(*by, n)`` rejected rows."""
    pages = F.countDistinct(page) if page else F.lit(0).cast("long")
    counted = labelled.groupBy(*by).agg(
        pages.alias("pages_scraped"),
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if(F.col("status") == KEPT).alias("jobs_inserted"),
        F.count_if(F.col("status").startswith("duplicate")).alias("jobs_deduplicated"),
    )
    if errors is None:
        return counted.withColumn("errors_encountered", F.lit(0).cast("long"))
    per_key = errors.groupBy(*by).agg(F.sum("n").alias("errors_encountered"))
    return counted.join(per_key, list(by), "full").fillna(0, COUNTERS)


def latest_runs(events: DataFrame) -> DataFrame:
    """Current state of every run: its last event, a finished state before ``running`` at the same time."""
    others = [c for c in events.columns if c != "run_id"]
    order = F.struct("event_ts", (F.col("status") != RUNNING).alias("done"), "status")
    return events.groupBy("run_id").agg(F.max_by(F.struct(*others), order).alias("_last")).select("run_id", "_last.*")


def recent_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(k)


def run_totals(runs: DataFrame) -> DataFrame:
    """One row of sums; a failed run adds one error and nothing else."""
    ok = F.col("status") == COMPLETED

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))

    return runs.agg(
        F.count_if(ok).alias("targets_processed"),
        *[total(c).alias(c) for c in COUNTERS[:-1]],
        (total("errors_encountered") + F.count_if(F.col("status") == FAILED)).alias("errors_encountered"),
    )


def retained(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Runs that started within ``days`` before ``as_of``, to be written to a new path."""
    return runs.filter(F.col("started_at") >= as_of - F.make_dt_interval(days=F.lit(days)))


def expired(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The complement of :func:`retained`."""
    return runs.filter(F.col("started_at") < as_of - F.make_dt_interval(days=F.lit(days)))


def as_events(runs: DataFrame) -> DataFrame:
    """Bring run rows to the event schema; columns a caller leaves out become NULL or 0."""
    cols = []
    for field in schema.RUN_EVENT:
        if field.name in runs.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            empty = F.lit(0) if field.name in COUNTERS else F.lit(None)
            cols.append(empty.cast(field.dataType).alias(field.name))
    return runs.select(*cols)
