"""Statistics of the store by week, kept beside it: exact, and merged when they are read.

A row says how many postings of a week have a value in a column. Counts over weeks are sums
of these, and distinct values are those that have a row, so no statistic needs the postings
again; a new week rewrites its own partition.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.dates import posted_day
from gleaner.operators import stats

#: Columns whose values are counted, and the name of the rows that count whole weeks.
COLUMNS, WHOLE = ("source_site", "company", "location"), "week"


def weekly_rollup(postings: DataFrame) -> DataFrame:
    """``(column, name, n, active, first_day, last_day, last_seen, week_key)`` in one pass; ``last_seen`` is of active postings."""
    is_active = F.col("is_active").cast("boolean")
    rows = postings.select("week_key", *COLUMNS, posted_day(F.col("date_posted")).alias("_day"), "scraped_at", is_active.alias("_active"))
    grouped = rows.groupingSets([["week_key"], *(["week_key", c] for c in COLUMNS)], "week_key", *COLUMNS).agg(
        *[F.grouping(c).alias(f"_{c}") for c in COLUMNS], F.count(F.lit(1)).alias("n"), F.count_if("_active").alias("active"),
        F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.max(F.when(F.col("_active"), F.col("scraped_at"))).alias("last_seen"),
    )
    which, name = F.lit(WHOLE), F.lit(None).cast("string")
    for c in COLUMNS:
        which, name = F.when(F.col(f"_{c}") == 0, c).otherwise(which), F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(name)
    return grouped.select(which.alias("column"), name.alias("name"), "n", "active", "first_day", "last_day", "last_seen", "week_key")


def refresh(postings: DataFrame, path: str, weeks: Iterable[str | None] | None = None) -> None:
    """Write the rows of some weeks, or of all, anew; other weeks' partitions are not touched and their postings not read.

    The store loses no rows, so a week that had some has some.
    """
    if weeks is not None:
        postings = postings.filter(_in_weeks(weeks))
    (
        weekly_rollup(postings).hint("rebalance", "week_key").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("week_key").parquet(path)
    )


def _in_weeks(weeks: Iterable[str | None]) -> Column:
    named = list(weeks)
    some = F.col("week_key").isin([w for w in named if w is not None])
    return some | F.col("week_key").isNull() if None in named else some


def _of(rollup: DataFrame, column: str) -> DataFrame:
    return rollup.filter(F.col("column") == column)


def store_stats(rollup: DataFrame, this_week: str) -> DataFrame:
    """As :func:`stats.store_stats`."""
    def count(column: str) -> Column:
        return F.countDistinct(F.when((F.col("column") == column) & (F.col("name") != ""), F.col("name")))

    def total(*also: Column) -> Column:
        here = F.col("column") == WHOLE
        for c in also:
            here &= c
        return F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0))

    return rollup.agg(
        total().alias("total"), total(F.col("week_key") == this_week).alias("this_week"), count("company").alias("companies"), count("location").alias("locations"),
    )


def rows_by_source(rollup: DataFrame) -> DataFrame:
    """As :func:`stats.rows_by_source`."""
    return _of(rollup, "source_site").groupBy(F.col("name").alias("source_site")).agg(F.sum("n").alias("n"))


def distribution(rollup: DataFrame, column: str, week_key: str | None = None, limit: int | None = None) -> DataFrame:
    """As :func:`stats.distribution`."""
    rows = _of(rollup, column).filter(F.col("name") != "")
    if week_key:
        rows = rows.filter(F.col("week_key") == week_key)
    counted = rows.groupBy("name").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "name").limit(limit) if limit else counted


def period(rollup: DataFrame, as_of: Column) -> DataFrame:
    """As :func:`stats.period`."""
    bounds = _of(rollup, WHOLE).agg(F.min("first_day").alias("_first"), F.max("last_day").alias("_last"))
    return stats.period_of(bounds, as_of)


def newest(postings: DataFrame, rollup: DataFrame, limit: int, source_site: str | None = None, tie: str = "url_key") -> DataFrame:
    """The newest active postings, from the partitions that can hold one and no others.

    Weeks are taken by their last capture until they hold ``limit`` rows; the oldest of those
    says which other weeks may hold a newer one. The driver gets a row per week.
    """
    rows = postings.filter(F.col("is_active").cast("boolean"))
    if source_site:
        rows = rows.filter(F.col("source_site") == source_site)
    seen = _of(rollup, WHOLE).filter("active > 0").select("week_key", "active", "last_seen").collect()
    weeks = sorted(seen, key=lambda r: (r.last_seen, r.week_key or ""), reverse=True)
    order = (F.desc("scraped_at"), F.asc(tie))
    taken = 1 + sum(held < limit for held in accumulate(w.active for w in weeks))
    while weeks:
        best = rows.filter(_in_weeks(w.week_key for w in weeks[:taken])).select("scraped_at").orderBy(F.desc("scraped_at")).limit(limit)
        found = best.agg(F.count("*").alias("n"), F.min("scraped_at").alias("oldest")).first()
        if found.n >= limit:
            rows = rows.filter(_in_weeks(w.week_key for w in weeks if w.last_seen >= found.oldest))
            break
        if taken >= len(weeks):
            break
        taken *= 2  # of one source there are fewer rows than the weeks hold
    return rows.orderBy(*order).limit(limit)
