"""The posting table: keys, scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleaner import schema

ANALYSIS_COLUMNS = [
    "title", "company", "location", "salary_range", "date_posted", "job_url", "source_site", "raw_html",
]


def read_table(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """A parquet table, empty when nothing has been written yet."""
    try:
        return spark.read.schema(columns).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema.POSTING)


def posting_scan(
    postings: DataFrame, source_site: str | None = None, week_key: str | None = None, limit: int | None = None,
    tie: str = "url_key",
) -> DataFrame:
    """Active postings, newest first; ``limit`` 0 or None means all."""
    rows = postings.filter(F.col("is_active").cast("boolean"))
    if source_site:
        rows = rows.filter(F.col("source_site") == source_site)
    if week_key:
        rows = rows.filter(F.col("week_key") == week_key)
    # The tie column also splits a hot capture time over the range partitions.
    rows = rows.orderBy(F.desc("scraped_at"), F.asc(tie))
    return rows.limit(int(limit)) if limit else rows


def weekly_scan(postings: DataFrame, week_key: str, columns: list[str] | None = None) -> DataFrame:
    """Active postings of one week, pruned to the columns the analysis reads.

    Unsorted: every use of the rows is an aggregate.
    """
    rows = postings.filter(F.col("is_active").cast("boolean") & (F.col("week_key") == week_key))
    return rows.select(*(columns or ANALYSIS_COLUMNS))


def url_stored(store: DataFrame, url_key: str) -> DataFrame:
    """One row ``(stored)``: is this key in the store? The equality reaches the scan."""
    hit = store.filter(F.col("url_key") == url_key).select("url_key").limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("stored"))
