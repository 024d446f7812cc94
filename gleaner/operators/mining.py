"""Skill mining over postings: mentions, frequencies, rankings, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.dates import next_week
from gleaner.functions.phrases import Taxonomy, extract_skills
from gleaner.functions.text import average, percent
from gleaner.session import cut


def skill_mentions(postings: DataFrame, text: Column, taxonomy: Taxonomy, *ids: str) -> DataFrame:
    """One row per posting and skill it mentions, with the skill's category."""
    found = postings.select(*ids, F.explode(extract_skills(text, taxonomy)).alias("skill"))
    dim = taxonomy.frame(postings.sparkSession).drop("category_ord")
    # The taxonomy has checked its size; the mentions are never shuffled or sent anywhere.
    return found.join(F.broadcast(dim), "skill").select(*ids, "skill", "category")


def skill_counts(postings: DataFrame, text: Column, taxonomy: Taxonomy, *by: str) -> DataFrame:
    """Postings per skill (and ``by``); the row with a NULL skill counts all postings.

    One pass over the text and one shuffle, of at most one row per skill, ``by`` value
    and task. Every ranking and summary below reads this small frame.
    """
    marked = F.array_append(extract_skills(text, taxonomy), F.lit(None).cast("string"))
    return (
        postings.select(*by, F.explode(marked).alias("skill"))
        .groupBy(*by, "skill")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def skill_frequency(counts: DataFrame, taxonomy: Taxonomy, *by: str) -> DataFrame:
    """Counts with category and number of postings: ``(*by, skill, n, jobs, category, category_ord)``.

    The window spans no more rows than the taxonomy has skills.
    """
    jobs = F.max(F.when(F.col("skill").isNull(), F.col("n"))).over(Window.partitionBy(*by))
    dim = taxonomy.frame(counts.sparkSession)
    return counts.withColumn("jobs", jobs).filter(F.col("skill").isNotNull()).join(F.broadcast(dim), "skill")


def top_skills(frequency: DataFrame, k: int = 10) -> DataFrame:
    """The k most mentioned skills, ties by name."""
    best = frequency.orderBy(F.desc("n"), "skill").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "skill")).cast("long")
    return best.select(
        rank.alias("rank"), "skill", "n", percent(F.col("n"), F.col("jobs")).alias("pct"), "category"
    )


def top_skills_by_category(frequency: DataFrame, k: int = 5) -> DataFrame:
    """The k most mentioned skills of every category, ties by name."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "skill")).cast("long")
    return frequency.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "category", "category_ord", "rank", "skill", "n", percent(F.col("n"), F.col("jobs")).alias("pct")
    )


def category_stats(frequency: DataFrame) -> DataFrame:
    """Mentions and distinct skills per category; categories without a mention are absent."""
    return frequency.groupBy("category", "category_ord").agg(
        F.sum("n").alias("total_mentions"), F.count(F.lit(1)).alias("unique_skills")
    )


def corpus_summary(counts: DataFrame) -> DataFrame:
    """One row: postings, mentions, distinct skills, mentions per posting. Zeros without input."""
    is_skill = F.col("skill").isNotNull()
    totals = counts.agg(
        F.coalesce(F.sum(F.when(~is_skill, F.col("n"))), F.lit(0)).alias("jobs"),
        F.coalesce(F.sum(F.when(is_skill, F.col("n"))), F.lit(0)).alias("mentions"),
        F.countDistinct("skill").alias("unique_skills"),
    )
    return totals.withColumn("avg_skills", average(F.col("mentions"), F.col("jobs")))


def skill_trend(weekly: DataFrame, week: str = "week_key") -> DataFrame:
    """Change per skill against the calendar's week before, from ``skill_counts(…, week)``.

    A skill has a row in every week in which it, or the week before, has mentions, up to the
    last week with postings. ``delta`` counts a week without mentions as 0; it is NULL in the
    first week of all and for postings without a week, which have rows of their own. The
    frames hold a row per week and skill, whatever the number of postings; the counts are
    written once, since all sides read them and text is not to be mined again for each.
    """
    weekly = cut(weekly, "weekly-counts")
    spans = weekly.agg(F.min(week).alias("first"), F.max(week).alias("last"))
    counted = weekly.filter(F.col("skill").isNotNull()).select(F.col(week).alias("week"), "skill", "n")
    dated = counted.filter(F.col("week").isNotNull())
    no_count = F.lit(0).cast("long")
    now = dated.select("week", "skill", "n", no_count.alias("before"))
    after = dated.select(next_week(F.col("week")).alias("week"), "skill", no_count.alias("n"), F.col("n").alias("before"))
    sides = now.union(after).groupBy("week", "skill").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
    first, last = spans.select("first").scalar(), spans.select("last").scalar()
    delta = F.when(F.col("week") != first, F.col("n") - F.col("before"))
    rows = sides.filter(F.col("week") <= last).select("week", "skill", "n", delta.alias("delta"))
    undated = counted.filter(F.col("week").isNull()).select("week", "skill", "n", F.lit(None).cast("long").alias("delta"))
    return rows.union(undated).withColumnRenamed("week", week)
