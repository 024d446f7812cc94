"""Store statistics and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.dates import posted_day, week_label


def store_stats(postings: DataFrame, this_week: str) -> DataFrame:
    """One row: rows, rows of a week, distinct companies and locations that are not blank."""
    return postings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("week_key") == this_week).alias("this_week"),
        F.countDistinct(F.nullif(F.col("company"), F.lit(""))).alias("companies"),
        F.countDistinct(F.nullif(F.col("location"), F.lit(""))).alias("locations"),
    )


def rows_by_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


def distribution(
    postings: DataFrame, column: str, week_key: str | None = None, limit: int | None = None, active_only: bool = False
) -> DataFrame:
    """Postings per value that is not blank, as ``(name, n)``; with ``limit``, the most frequent."""
    rows = postings.filter(F.col(column) != "")
    if week_key:
        rows = rows.filter(F.col("week_key") == week_key)
    if active_only:
        rows = rows.filter(F.col("is_active").cast("boolean"))
    counted = rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "name").limit(limit) if limit else counted


def location_distribution(postings: DataFrame, week_key: str | None = None) -> DataFrame:
    return distribution(postings, "location", week_key)


def company_distribution(postings: DataFrame, week_key: str | None = None, limit: int = 20) -> DataFrame:
    return distribution(postings, "company", week_key, limit)


def period(postings: DataFrame, as_of: Column) -> DataFrame:
    """One row: first and last posting day and the week of the last; the week before ``as_of`` without any."""
    day = posted_day(F.col("date_posted"))
    return period_of(postings.agg(F.min(day).alias("_first"), F.max(day).alias("_last")), as_of)


def period_of(bounds: DataFrame, as_of: Column) -> DataFrame:
    """The period of one row of bounds ``(_first, _last)``."""
    today = F.to_date(as_of)
    last = F.coalesce("_last", today)
    return bounds.select(
        week_label(last).alias("week_key"),
        F.date_format(F.coalesce("_first", F.date_sub(today, 7)), "yyyy-MM-dd").alias("start_date"),
        F.date_format(last, "yyyy-MM-dd").alias("end_date"),
    )
