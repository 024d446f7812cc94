"""Validity of parsed postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import blank_if_null, strip

# The reasons a parsed row is rejected for.
BAD_TITLE = "Missing or invalid title"
NO_URL = "Missing job URL"
BAD_URL = "Invalid URL format"
UNPARSED = "Parse error"


def validation_errors(title: Column, job_url: Column, unparsed: Column | None = None) -> Column:
    """Reasons why a row cannot be stored; empty when it can."""
    url = blank_if_null(job_url)
    checks = [
        F.when(F.length(strip(title)) < 2, BAD_TITLE),
        F.when(url == "", NO_URL).when(~F.rlike(url, F.lit("^https?://")), BAD_URL),
    ]
    if unparsed is not None:
        checks = [F.when(unparsed, UNPARSED)] + [F.when(~unparsed, c) for c in checks]
    return F.array_compact(F.array(*checks))


def with_errors(rows: DataFrame) -> DataFrame:
    """Add ``errors``; a column ``unparsed`` marks rows whose record itself was broken.

    The generator keeps filters on ``errors`` from parsing the fields a second time.
    """
    unparsed = F.coalesce(F.col("unparsed"), F.lit(False)) if "unparsed" in rows.columns else None
    errors = validation_errors(F.col("title"), F.col("job_url"), unparsed)
    return rows.select("*", F.explode(F.array(errors)).alias("errors"))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors", "unparsed")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def rejects_by_reason(checked: DataFrame, *by: str) -> DataFrame:
    """Rejected rows per reason (and per ``by``); a row counts once for each of its reasons."""
    return (
        checked.select(*by, F.explode("errors").alias("reason"))
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
