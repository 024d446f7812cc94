"""Where a paginated crawl stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.skew import annotate_by_key


def _with_votes(yields: DataFrame, threshold: int, source: str) -> DataFrame:
    """Pages with the column ``stop``: the page number where a run of empty pages is complete.

    Each empty page votes for the pages at which a run that includes it would be
    complete; a page with ``threshold`` votes completes a run. No ordering of a
    source's pages is needed.
    """
    page = F.struct(F.col("page_no").alias("page_no"), F.col("n_jobs").alias("n_jobs"), F.lit(0).alias("vote"))
    votes = F.transform(
        F.sequence(F.col("page_no"), F.col("page_no") + threshold - 1),
        lambda p: F.struct(p.alias("page_no"), F.lit(None).cast("long").alias("n_jobs"), F.lit(1).alias("vote")),
    )
    marks = F.when(F.col("n_jobs") == 0, F.array_append(votes, page)).otherwise(F.array(page))
    counted = (
        yields.withColumns({c: F.col(c).cast("long") for c in ("page_no", "n_jobs")})
        .select(source, F.inline(marks))
        .groupBy(source, "page_no")
        .agg(F.max("n_jobs").alias("n_jobs"), F.sum("vote").alias("votes"))
        .filter(F.col("n_jobs").isNotNull())
    )
    return counted.select(source, "page_no", "n_jobs", F.when(F.col("votes") == threshold, F.col("page_no")).alias("stop"))


def last_pages(yields: DataFrame, threshold: int = 2, source: str = "source_site") -> DataFrame:
    """Last page fetched per source: the first complete run of empty pages, or its last page."""
    return (
        _with_votes(yields, threshold, source)
        .groupBy(source)
        .agg(F.coalesce(F.min("stop"), F.max("page_no")).alias("last_page"))
    )


def fetched_pages(yields: DataFrame, threshold: int = 2, source: str = "source_site") -> DataFrame:
    """The pages up to the stop, whichever source holds most of them."""
    pages = _with_votes(yields, threshold, source)
    limited = annotate_by_key(pages, [source], [source, "page_no"], _last=(F.min, F.col("stop")))
    keep = F.col("_last").isNull() | (F.col("page_no") <= F.col("_last"))
    return limited.filter(keep).select(source, "page_no", "n_jobs")
