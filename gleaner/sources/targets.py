"""Crawl targets and the pages they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def select_targets(targets: DataFrame, name_filter: str | None = None) -> DataFrame:
    """Enabled targets (the default), optionally those whose name contains the filter."""
    kept = targets.filter(F.coalesce(F.col("enabled").cast("boolean"), F.lit(True)))
    if name_filter:
        kept = kept.filter(F.contains(F.lower("name"), F.lit(name_filter.lower())))
    return kept


def page_plan(targets: DataFrame, starts_at: int = 1) -> DataFrame:
    """One row per target and page number, with the URL to fetch."""
    base, page = F.col("base_url"), F.col("page_no").cast("string")
    separator = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    by_query = F.concat(base, separator, F.coalesce(F.col("page_param"), F.lit("page")), F.lit("="), page)
    by_path = F.replace(base, F.lit("{page}"), page)
    last = F.lit(starts_at - 1) + F.col("max_pages")
    strategy = F.coalesce(F.col("page_strategy"), F.lit("query_param"))
    return (
        targets.filter(F.col("max_pages") >= 1)
        .withColumn("page_no", F.explode(F.sequence(F.lit(starts_at), last)))
        .withColumn("page_url", F.when(strategy == "query_param", by_query).when(strategy == "path", by_path).otherwise(base))
    )
