"""Markdown and JSON reports as frames of lines, and their sinks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.functions.text import label_case, title_case
from gleaner.plans.analysis import Analysis
from gleaner.session import write_text

TITLE = "Weekly Skills Report"
TOP_LINES = 15

METHOD = (
    "Skills are phrases of a taxonomy, matched as whole words without regard to case. "
    "A posting counts once for each skill it mentions; postings are unique by URL."
)

# Section headings and table heads.
SUMMARY_HEAD = "## Executive Summary"
TOP_HEAD = ["## Top 10 Most In-Demand Skills", "", "| Rank | Skill | Mentions | % of Jobs | Category |",
            "|------|-------|----------|-----------|----------|"]
CATEGORY_HEAD = ["## Skills by Category", ""]
SKILL_TABLE = ["| Skill | Mentions | % of Jobs |", "|-------|----------|-----------|"]
LOCATION_HEAD = ["## Job Count by Location", "", "| Location | Job Count |", "|----------|-----------|"]
COMPANY_HEAD = ["## Top Hiring Companies", "", "| Company | Job Postings |", "|---------|-------------|"]
METHOD_HEAD = "## Methodology"


def _number(c: str | Column) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def _lines(frame: DataFrame, section: int, ords: Column, lines: list[Column | str]) -> DataFrame:
    """Rows ``(section, ord, line)``: the given lines for every row of a small frame."""
    texts = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return frame.select(
        F.lit(section).cast("long").alias("section"), ords.cast("long").alias("_o"), F.posexplode(texts).alias("_i", "line")
    ).select("section", (F.col("_o") * 1000 + F.col("_i")).alias("ord"), "line")


def _ranked(frame: DataFrame, k: int) -> DataFrame:
    best = frame.orderBy(F.desc("n"), "name").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "name")))


def _table(frame: DataFrame, section: int, head: list[str], k: int) -> DataFrame:
    ranked = _ranked(frame, k)
    line = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), _number("n"), F.lit(" |"))
    first = ranked.filter(F.col("rank") == 1)
    return _lines(first, section, F.lit(0), head).unionByName(_lines(ranked, section, F.col("rank"), [line]))


def markdown_lines(analysis: Analysis, generated_at: str, categories: int, title: str = TITLE) -> DataFrame:
    """The report as ``(section, ord, line)``, some tens of lines. Sections without data are absent."""
    jobs = _number("jobs")
    header = _lines(
        analysis.summary,
        1,
        F.lit(0),
        [
            f"# {title}", "", f"**Generated:** {generated_at}",
            F.concat(F.lit("**Total Jobs Analyzed:** "), jobs),
            "", SUMMARY_HEAD, "",
            F.concat(
                F.lit("**"), jobs, F.lit(" job postings** mention **"), F.col("unique_skills").cast("string"),
                F.lit(f" different skills** in {categories} categories, on average **"),
                F.col("avg_skills").cast("string"), F.lit(" skills** each."),
            ),
        ],
    )
    period = _lines(analysis.period, 2, F.lit(0), [F.concat(F.lit("**Period:** "), F.col("week_key"))])
    row = F.concat(
        F.lit("| "), F.col("rank").cast("string"), F.lit(" | **"), title_case(F.col("skill")), F.lit("** | "),
        _number("n"), F.lit(" | "), F.col("pct").cast("string"), F.lit("% | "), label_case(F.col("category")), F.lit(" |"),
    )
    top = _lines(analysis.summary, 3, F.lit(0), TOP_HEAD).unionByName(
        _lines(analysis.top_skills, 3, F.col("rank"), [row])
    )
    cats = analysis.categories
    cat_head = _lines(cats.agg(F.min("category_ord").alias("o")).filter("o is not null"), 4, F.lit(0), CATEGORY_HEAD)
    cat_block = _lines(
        cats, 4, F.col("category_ord") * 10 + 10,
        [
            F.concat(F.lit("### "), label_case(F.col("category"))), "",
            F.concat(F.lit("- **Total Mentions:** "), _number("total_mentions")),
            F.concat(F.lit("- **Unique Skills:** "), F.col("unique_skills").cast("string")), "", *SKILL_TABLE,
        ],
    )
    cat_row = F.concat(
        F.lit("| "), title_case(F.col("skill")), F.lit(" | "), _number("n"), F.lit(" | "), F.col("pct").cast("string"),
        F.lit("% |"),
    )
    cat_rows = _lines(analysis.top_by_category, 4, F.col("category_ord") * 10 + 10 + F.col("rank"), [cat_row])
    method = _lines(analysis.summary, 7, F.lit(0), [METHOD_HEAD, "", METHOD])
    return _union(
        header, period, top, cat_head, cat_block, cat_rows,
        _table(analysis.locations, 5, LOCATION_HEAD, TOP_LINES),
        _table(analysis.companies, 6, COMPANY_HEAD, TOP_LINES),
        method,
    )


def json_lines(analysis: Analysis, generated_at: str) -> DataFrame:
    """The report as ``(section, json)`` rows.

    Bounded sections are one JSON value each. The locations, whose number grows with
    the data, are one row per location and never one value.
    """
    summary = analysis.summary.select(
        F.lit("summary").alias("section"),
        F.to_json(
            F.struct(
                F.lit(generated_at).alias("generated_at"), F.col("jobs").alias("total_jobs_analyzed"),
                F.col("mentions").alias("total_skill_mentions"), F.col("unique_skills").alias("unique_skills_found"),
                F.col("avg_skills").alias("avg_skills_per_job"),
            )
        ).alias("json"),
    )
    period = analysis.period.select(
        F.lit("period").alias("section"), F.to_json(F.struct("week_key", "start_date", "end_date")).alias("json")
    )
    skill = F.struct("rank", "skill", F.col("n").alias("count"), F.col("pct").alias("percentage_of_jobs"), "category")
    top = analysis.top_skills.select(F.lit("top_10_skills").alias("section"), F.to_json(skill).alias("json"))
    in_category = F.struct("rank", "skill", F.col("n").alias("count"), F.col("pct").alias("percentage"))
    ranked = analysis.top_by_category.groupBy("category").agg(
        F.array_sort(F.collect_list(in_category)).alias("top_skills")
    )
    cats = analysis.categories.join(ranked, "category").select(
        F.lit("skills_by_category").alias("section"),
        F.to_json(
            F.struct(
                "category", "total_mentions", "unique_skills",
                F.transform("top_skills", lambda s: s.dropFields("rank")).alias("top_skills"),
            )
        ).alias("json"),
    )

    def entry(frame: DataFrame, section: str) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), F.to_json(F.struct("name", F.col("n").alias("count"))).alias("json"))

    return _union(
        summary, period, top, cats,
        entry(analysis.locations, "location_distribution"), entry(analysis.companies, "company_distribution"),
    )


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def write_markdown(lines: DataFrame, path: str) -> None:
    """One text file; a report has some tens of lines."""
    lines.coalesce(1).sortWithinPartitions("section", "ord").select("line").write.mode("overwrite").text(path)


def write_json(lines: DataFrame, path: str) -> None:
    """JSON lines, one folder per section."""
    lines.write.mode("overwrite").partitionBy("section").text(path)


# How published reports are named.
REPORT_NAME, LATEST_NAME = "skills_report_{week}_{stamp:%Y%m%d_%H%M%S}", "LATEST_SKILLS_REPORT.md"


def publish(lines: DataFrame, folder: str, week_key: str, stamp: datetime) -> str:
    """Write a Markdown report under its week and time and as the latest one; the path of the former.

    A report has some tens of lines, which the driver gets. Each file is written beside its
    place and renamed, so a reader finds the report before or this one, and never a part.
    """
    spark = lines.sparkSession
    text = "".join(f"{r.line}\n" for r in lines.orderBy("section", "ord").select("line").collect())
    path = f"{folder}/{REPORT_NAME.format(week=week_key, stamp=stamp)}.md"
    write_text(spark, path, text)
    write_text(spark, f"{folder}/{LATEST_NAME}", text)
    return path


def publish_json(lines: DataFrame, folder: str, week_key: str, stamp: datetime) -> str:
    """Write a JSON report into a folder named by its week and time; the path of that."""
    path = f"{folder}/{REPORT_NAME.format(week=week_key, stamp=stamp)}"
    write_json(lines, path)
    return path
