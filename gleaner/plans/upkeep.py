"""Retention of the run log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import SparkSession, functions as F

from gleaner.operators import runs
from gleaner.session import Scratch, drop_path, names_in


def drop_expired(spark: SparkSession, path: str, as_of: datetime, days: int = 30) -> int:
    """Drop the runs that started more than ``days`` before ``as_of`` from the log at ``path``; how many those were.

    Days that have expired as a whole are dropped with their folders, unread but for the ids
    that are counted; only the day the border falls in is written anew. A call that failed part
    of the way can be repeated. One writer at a time.
    """
    border = as_of - timedelta(days=days)
    events = runs.read_events(spark, path)
    old = F.col(runs.DAY) <= F.lit(border.date())
    gone = events.filter(old & (F.col("started_at") < F.lit(border))).select("run_id").distinct().count()
    today = f"{runs.DAY}={border.date()}"
    for name in names_in(spark, path):
        if name.startswith(f"{runs.DAY}=") and name < today and name[len(runs.DAY) + 1 :][:1].isdigit():
            drop_path(spark, f"{path}/{name}")
    if today in names_in(spark, path):
        with Scratch(spark) as scratch:
            left = events.filter((F.col(runs.DAY) == F.lit(border.date())) & (F.col("started_at") >= F.lit(border)))
            kept = scratch.cut(left, "runs")
            if kept.isEmpty():
                drop_path(spark, f"{path}/{today}")
            else:
                kept.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(runs.DAY).parquet(path)
    return gone
