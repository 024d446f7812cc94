"""Landed board pages to stored postings to the weekly analysis."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions import quality
from gleaner.functions.phrases import Taxonomy
from gleaner.operators.dedup import first_page_only
from gleaner.operators.pagination import fetched_pages
from gleaner.plans.analysis import Analysis, analyze
from gleaner.plans.ingest import Tables, run_tagged
from gleaner.session import cut
from gleaner.sources.pages import LAYOUTS, ListingRules, page_listings
from gleaner.sources.postings import read_store


def board_rows(
    pages: DataFrame, layout: Column, as_of: Column, layouts: Mapping[str, ListingRules] = LAYOUTS, empty_pages: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Checked posting rows of the pages a crawl would have fetched, and the yield of those pages.

    ``pages`` has target, page_no, page_id, url and html. A target's pages count up to the one that
    completes a run of ``empty_pages`` empty ones; a URL that stood on an earlier page of its
    target is dropped from later ones; ``errors`` says why a row cannot be stored. The listings
    are written once.
    """
    listed = cut(page_listings(pages, layout, as_of, layouts), "listings")
    found = listed.groupBy("target", "page_no").agg(F.count("*").alias("n_jobs"))
    landed = pages.select("target", "page_no").distinct().join(found, ["target", "page_no"], "left").fillna(0, ["n_jobs"])
    yields = cut(fetched_pages(landed, empty_pages, "target"), "yields")
    rows = listed.join(yields.select("target", "page_no"), ["target", "page_no"], "left_semi")
    return quality.with_errors(first_page_only(rows, ["page_id", "pos"], within=["target"])), yields


def run_board(
    spark: SparkSession, pages: DataFrame, targets: Sequence[str], layout: Column, as_of: Column, tables: Tables,
    clock: Callable[[], datetime], first_run_id: int = 1, layouts: Mapping[str, ListingRules] = LAYOUTS,
) -> DataFrame:
    """Parse, check and store the pages of all targets; the state of their runs.

    If ``pages`` has a column ``failure``, a target with a message in it fails as a whole.
    """
    rows, yields = board_rows(pages, layout, as_of, layouts)
    fetched = yields.withColumnRenamed("target", "source_site")
    failures = pages.select(F.col("target").alias("source_site"), "failure") if "failure" in pages.columns else None
    return run_tagged(spark, rows, targets, tables, clock, first_run_id, ["page_id", "pos"], yields=fetched, failures=failures)


def weekly_analysis(spark: SparkSession, tables: Tables, taxonomy: Taxonomy, as_of: Column, week_key: str) -> Analysis:
    """The analysis of one stored week; only that week's partition is read."""
    return analyze(read_store(spark, tables.postings), taxonomy, as_of, week_key)
