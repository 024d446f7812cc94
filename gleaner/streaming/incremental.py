"""Incremental ingest of landed files, and weekly counts of an event stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from gleaner.functions.dates import week_label
from gleaner.operators import dedup
from gleaner.plans.ingest import Tables, ingest_batch
from gleaner.session import Scratch
from gleaner.sources.merging import MergingTable
from gleaner.sources.postings import read_table


def stream_files(spark: SparkSession, path: str, columns: StructType, bytes_per_batch: int | None = None) -> DataFrame:
    """A landing folder of parquet files as a stream; micro-batches are sized by bytes."""
    reader = spark.readStream.schema(columns)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def without_repeats(rows: DataFrame, seen: str, horizon: str, place: Sequence[str]) -> DataFrame:
    """Streamed posting rows, less those whose URL key has come within ``horizon`` of event time ``seen`` before.

    The state holds the keys of the horizon and no more; older ones are known from the stored table only. Rows
    without a key are told apart by ``place``. Which of several copies in one micro-batch stays is open. Every row
    is shuffled by its key, so this pays where most rows are repeats; it does not replace the check of the stored table.
    """
    keyed = dedup.with_url_key(rows).withWatermark(seen, horizon)
    alone = F.when(F.col("url_key") == "", F.struct(*place))
    return keyed.withColumn("_alone", alone).dropDuplicatesWithinWatermark(["url_key", "_alone"]).drop("_alone", "url_key")


def ingest_stream(
    landed: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    tables: Tables,
    checkpoint: str,
    clock: Callable[[], datetime],
    order_by: Sequence[str],
    seen: str | None = None,
    horizon: str = "1 day",
) -> StreamingQuery:
    """Parse and ingest every micro-batch with the code of the batch path, then stop when all is read.

    Deduplication is against the stored table, so there is no state that grows. What a
    micro-batch has settled is staged under its number until all of it is written, and the last
    one that was is known by its number, so one that is run again ends as if it had run once.

    With ``seen``, a column of event times that ``parse`` keeps, repeats within ``horizon`` are dropped before
    they reach a micro-batch (:func:`without_repeats`): they are not staged, looked up or audited.
    """
    rows = without_repeats(parse(landed), seen, horizon, order_by) if seen else landed
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, number: int) -> None:
        ingest_batch(batch if seen else parse(batch), tables, clock(), order_by, f"{stream}-{number}")

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def weekly_event_counts(events: DataFrame, ts: str, *by: str, delay: str = "1 day") -> DataFrame:
    """Events per Monday-to-Sunday week (and ``by``), late rows accepted up to ``delay``.

    Weeks are tumbling windows shifted from the epoch's Thursday to Monday; the label
    is that of the week's first day.
    """
    week = F.window(ts, "7 days", startTime="4 days")
    counted = events.withWatermark(ts, delay).groupBy(week, *by).agg(F.count(F.lit(1)).alias("n"))
    start = F.to_date("window.start")
    return counted.select(start.alias("week_start"), week_label(start).alias("week_key"), *by, "n")


def write_weeks(counts: DataFrame, path: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Keep a table of the latest counts, open weeks included, then stop when all is read.

    Each micro-batch brings the new totals of the weeks it changed. Only their partitions are
    rewritten, with totals and not with increments, so a micro-batch that runs again changes nothing.
    """
    keys, kind = ["week_start", "week_key", *by], counts.schema

    def step(updates: DataFrame, _: int) -> None:
        spark = updates.sparkSession
        with Scratch(spark) as scratch:
            new = scratch.cut(updates, "weeks-new")
            on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
            old = read_table(spark, path, kind).join(new.select("week_key").distinct(), "week_key", "left_semi")
            rest = old.alias("o").join(new.alias("n"), on, "left_anti").select(*kind.names)
            merged = scratch.cut(rest.union(new.select(*kind.names)), "weeks-all")
            (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_key").parquet(path))

    return (
        counts.writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def week_table(path: str, *by: StructField) -> MergingTable:
    """Partial counts of micro-batches by week and ``by``, which add up."""
    columns = StructType([StructField("week_start", DateType()), StructField("week_key", StringType()), *by, StructField("n", LongType())])
    keys = columns.names[:-1]
    return MergingTable(path, columns, fold=lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n")))


def count_weeks(events: DataFrame, ts: str, table: MergingTable, checkpoint: str) -> StreamingQuery:
    """Count every event in its week, however late it comes, then stop when all is read.

    A micro-batch adds its own counts, a row per week and value at most, and no state is kept
    between them; :func:`counted_weeks` adds them up. One that is run again takes the place of
    its first run. Use :func:`weekly_event_counts` where late rows are to be left out instead.
    """
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]
    keys = table.columns.names[:-1]

    def step(batch: DataFrame, number: int) -> None:
        start = F.to_date(F.date_trunc("week", ts))
        dated = batch.filter(F.col(ts).isNotNull()).withColumns({"week_start": start, "week_key": week_label(start)})
        with Scratch(batch.sparkSession) as scratch:
            counted = scratch.cut(dated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "weeks")
            table.append(counted, f"{stream}-{number}", counted.count())

    return (
        events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def counted_weeks(spark: SparkSession, table: MergingTable) -> DataFrame:
    """The counts of all micro-batches."""
    return table.fold(table.read(spark))
