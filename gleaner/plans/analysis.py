"""The weekly analysis as a set of small frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.phrases import Taxonomy
from gleaner.functions.text import mining_text
from gleaner.operators import mining, stats
from gleaner.session import cut
from gleaner.sources.postings import weekly_scan

TOP_SKILLS, TOP_PER_CATEGORY, TOP_COMPANIES = 10, 5, 20


@dataclass(frozen=True)
class Analysis:
    period: DataFrame
    summary: DataFrame
    top_skills: DataFrame
    categories: DataFrame
    top_by_category: DataFrame
    locations: DataFrame
    companies: DataFrame


def analyze(postings: DataFrame, taxonomy: Taxonomy, as_of: Column, week_key: str | None = None) -> Analysis:
    """Analyse the active postings of a week (of all weeks without one).

    The text is read and mined once; its counts, one row per skill, are kept in the
    shared folder for the frames that build on them. The distributions count inactive
    postings too.
    """
    columns = ["title", "company", "raw_html", "date_posted"]
    if week_key:
        rows = weekly_scan(postings, week_key, columns)
    else:
        rows = postings.filter(F.col("is_active").cast("boolean")).select(*columns)
    text = mining_text(F.col("title"), F.col("company"), F.col("raw_html"))
    counts = cut(mining.skill_counts(rows, text, taxonomy), "counts")
    frequency = mining.skill_frequency(counts, taxonomy)
    return Analysis(
        period=stats.period(rows, as_of),
        summary=mining.corpus_summary(counts),
        top_skills=mining.top_skills(frequency, TOP_SKILLS),
        categories=mining.category_stats(frequency),
        top_by_category=mining.top_skills_by_category(frequency, TOP_PER_CATEGORY),
        locations=stats.location_distribution(postings, week_key),
        companies=stats.company_distribution(postings, week_key, TOP_COMPANIES),
    )
