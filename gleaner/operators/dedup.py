"""Deduplication by URL key, within a batch and against the store."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import percent, strip
from gleaner.functions.urls import key_of_trimmed
from gleaner.operators.skew import annotate_by_key
from gleaner.session import cut

KEPT = "kept"
DUPLICATE_BATCH = "duplicate_batch"
DUPLICATE_STORE = "duplicate_store"
BLANK_URL = "blank_url"


def with_url_key(rows: DataFrame, url: str = "job_url") -> DataFrame:
    """Add the key, step by step so that no step is computed twice.

    The generator at the end keeps later filters on the key from computing it again.
    """
    others = [c for c in rows.columns if c != "url_key"]
    trimmed = rows.select(*others, strip(F.col(url)).alias("_url"))
    opened = trimmed.select("*", F.substring_index("_url", "#", 1).alias("_open"))
    headed = opened.select("*", F.substring_index("_open", "?", 1).alias("_head"))
    return headed.select(*others, F.explode(F.array(_key(SparkContext._gateway))).alias("url_key"))


@lru_cache(maxsize=1)
def _key(_gateway) -> Column:
    """The key of the columns above. Putting it together takes longer than a small batch, so it is kept while the JVM lives."""
    return key_of_trimmed(F.col("_url"), opened=F.col("_open"), head=F.col("_head"))


def existing_keys(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct keys of the batch that the store already holds.

    The store is the streamed side and the keys of the batch are looked up in: while
    those are few Spark broadcasts them and the store is not shuffled, and beyond that
    a Bloom filter of them can thin the store out before its shuffle.
    """
    keys = batch.filter(F.col("url_key") != "").select("url_key").distinct()
    return _stored_among(keys, store, "url_key")


def _stored_among(keys: DataFrame, store: DataFrame, never_null: str) -> DataFrame:
    # Asking for a column that is never NULL keeps it in the plan of `keys`, so that Spark
    # sees the same exchange wherever `keys` is used and runs it once.
    k, s = keys.alias("_keys"), store.select("url_key").alias("_store")
    match = (F.col("_store.url_key") == F.col("_keys.url_key")) & F.col(f"_keys.{never_null}").isNotNull()
    return s.join(k, match, "left_semi").distinct()


def with_row(batch: DataFrame) -> DataFrame:
    """The batch with a unique ``_row``; written, so that the ids stay whatever runs again."""
    if "_row" in batch.columns:
        return batch
    return cut(batch.withColumn("_row", F.monotonically_increasing_id()), "batch")


def _place(order_by: Sequence[str]) -> Column:
    """What makes a copy the first: its position, unknown ones last, and of equal positions the first row."""
    parts = [x for i, c in enumerate(order_by) for x in (F.col(c).isNull().alias(f"u{i}"), F.col(c).alias(f"p{i}"))]
    return F.struct(*parts, F.col("_row").alias("row"))


def first_in_batch(batch: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The first row per key: ``(url_key, _row)``.

    The minimum is taken map-side first, so a key shared by much of the batch reaches
    its reducer as one row per task.
    """
    first = batch.filter(F.col("url_key") != "").groupBy("url_key").agg(F.min(_place(order_by)).alias("_first"))
    return first.select("url_key", F.col("_first.row").alias("_row"))


def label_batch(batch: DataFrame, store: DataFrame | None, order_by: Sequence[str]) -> DataFrame:
    """Add ``status`` to every row: kept, duplicate_batch, duplicate_store or blank_url.

    ``order_by`` says which copy is first; it may be null or repeated, since rows are told
    apart by a row id (``_row`` if the batch has one). A later copy is ``duplicate_batch``; a
    first copy whose key is stored is ``duplicate_store``. The keys are settled on one row
    each, and the verdict goes back to the rows by their id, so no join meets a hot key.
    """
    rows = with_row(batch)
    first = first_in_batch(rows, order_by)
    if store is None:
        verdict = first.withColumn("_stored", F.lit(False))
    else:
        stored = _stored_among(first, store, "_row").withColumn("_stored", F.lit(True))
        verdict = first.join(stored, "url_key", "left").withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    labelled = rows.join(verdict.drop("url_key"), "_row", "left")
    status = (
        F.when(F.coalesce("url_key", F.lit("")) == "", BLANK_URL)
        .when(F.col("_stored").isNull(), DUPLICATE_BATCH)
        .when(F.col("_stored"), DUPLICATE_STORE)
        .otherwise(KEPT)
    )
    return labelled.withColumn("status", status).select(*batch.columns, "status")


def new_rows(batch: DataFrame, store: DataFrame | None, order_by: Sequence[str]) -> DataFrame:
    """First copy of every key that is not stored."""
    return label_batch(batch, store, order_by).filter(F.col("status") == KEPT).drop("status")


def dedup_summary(labelled: DataFrame) -> DataFrame:
    """One row: kept, removed, blank, and removed as a percentage of kept and removed."""
    status = F.col("status")
    counts = labelled.agg(
        F.count_if(status == KEPT).alias("kept_count"),
        F.count_if(status.startswith("duplicate")).alias("removed_count"),
        F.count_if(status == BLANK_URL).alias("blank_count"),
    )
    removed, kept = F.col("removed_count"), F.col("kept_count")
    return counts.withColumn("dedup_rate", percent(removed, kept + removed))


def dedup_audit(labelled: DataFrame, checked_at) -> DataFrame:
    """Audit rows for the duplicates."""
    return labelled.filter(F.col("status").startswith("duplicate")).select(
        "job_url", F.col("status").alias("reason"), checked_at.alias("checked_at")
    )


def first_page_only(
    rows: DataFrame, row_id: Sequence[str], url: str = "job_url", page: str = "page_no", within: Sequence[str] = ()
) -> DataFrame:
    """Drop rows whose raw URL stood on an earlier page; repeats on one page stay."""
    marked = annotate_by_key(rows, [*within, url], row_id, _first_page=(F.min, F.col(page)))
    return marked.filter(F.col(page) == F.col("_first_page")).drop("_first_page")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources' rows in one frame, matched by column name."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
