"""Dates: week keys, posting dates, relative dates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.text import blank_if_null, let, strip


def week_label(day: Column) -> Column:
    """``YYYY-Wnn`` of a date: weeks begin on Monday, days before the first Monday are ``W00``."""
    return let(day, _label)


def _label(d: Column) -> Column:
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("string")
    return F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lit("-W"), F.lpad(week, 2, "0"))


def next_week(label: Column) -> Column:
    """The label of the week that follows in the calendar; ``W00`` follows the last week of a year."""

    def of_label(x: Column) -> Column:
        year, week = F.substring(x, 1, 4).cast("int"), F.substring(x, 7, 2).cast("int")
        new_year = F.make_date(year, F.lit(1), F.lit(1))
        monday = F.date_add(new_year, F.pmod(7 - F.weekday(new_year), F.lit(7)) + 7 * week)
        # A week that runs into the new year goes on there as W00.
        return week_label(F.when(F.year(monday) == year, monday).otherwise(F.make_date(year + 1, F.lit(1), F.lit(1))))

    return let(label, of_label)


def week_label_of(d: date | datetime) -> str:
    """The same label for a parameter of the caller."""
    return d.strftime("%Y-W%W")


# A day, optionally a time of day, optionally an offset that moves it to UTC.
_STAMP = (
    r"^(\d{4})-(\d{2})-(\d{2})"
    r"(?:[ T](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?\s*(?:Z|z|([+-])(\d{2}):(\d{2}))?)?$"
)


def stored_day(text: Column) -> Column:
    """Day of a stored date text, NULL when it is not one.

    Days past the end of a month run on into the next (``2024-02-30`` is 1 March).
    """

    def of_text(t: Column) -> Column:
        def group(i: int) -> Column:
            return F.nullif(F.regexp_extract(t, _STAMP, i), F.lit("")).cast("int")

        offset = F.coalesce(group(7) * 60 + group(8), F.lit(0))
        to_utc = F.when(F.regexp_extract(t, _STAMP, 6) == "-", offset).otherwise(-offset)
        clock = F.coalesce(group(4) * 60 + group(5), F.lit(0))
        fields = F.struct(
            group(1).alias("year"), group(2).alias("month"), group(3).alias("day"), clock.alias("clock"),
            F.when(F.length(t) > 10, to_utc).otherwise(0).alias("to_utc"),
        )
        return let(fields, of_fields)

    def of_fields(f: Column) -> Column:
        carry = F.floor((f["clock"] + f["to_utc"]) / 1440).cast("int")
        ok = f["month"].between(1, 12) & f["day"].between(1, 31) & (f["clock"] <= 1440)
        return F.when(ok, F.date_add(F.make_date(f["year"], f["month"], F.lit(1)), f["day"] - 1 + carry))

    def part(start: int, size: int) -> Column:
        return F.substring(text, start, size).cast("int")

    # Nearly all texts are plain days, which need no closer look.
    plain = F.rlike(text, F.lit(r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$"))
    day = F.date_add(F.make_date(part(1, 4), part(6, 2), F.lit(1)), part(9, 2) - 1)
    return F.when(plain, day).otherwise(let(strip(text), of_text))


def posting_day(date_posted: Column, scraped_at: Column) -> Column:
    """The posting date, or the day of capture when no date is given."""
    return F.when(blank_if_null(date_posted) == "", F.to_date(scraped_at)).otherwise(stored_day(date_posted))


def week_key(date_posted: Column, scraped_at: Column) -> Column:
    """Week of the posting date, or of the capture time when no date is given."""
    return week_label(posting_day(date_posted, scraped_at))


def with_week_key(rows: DataFrame, date_posted: str = "date_posted", scraped_at: str = "scraped_at") -> DataFrame:
    """Add ``week_key``, computed once whatever is filtered by it later."""
    others = [c for c in rows.columns if c != "week_key"]
    dated = rows.select(*others, posting_day(F.col(date_posted), F.col(scraped_at)).alias("_day"))
    return dated.select(*others, F.explode(F.array(_label(F.col("_day")))).alias("week_key"))


def posted_day(text: Column) -> Column:
    """Calendar day in the first ten characters, NULL when there is none."""
    head = F.substring(blank_if_null(text), 1, 10)
    return F.when(F.rlike(head, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.try_to_date(head, "yyyy-M-d"))


def feed_date(text: Column) -> Column:
    """Date part of a feed time stamp, as written (no shift to another zone)."""
    return F.substring(blank_if_null(text), 1, 10)


def relative_date(text: Column, now: Column) -> Column:
    """ISO day for ``3 days ago``, ``today``, ``06/01/2024``…; unknown text is returned in lower case."""
    today = F.to_date(now)

    def back(days: Column) -> Column:
        return F.when(days < 700000, F.date_sub(today, days.cast("int")))

    def of_text(t: Column) -> Column:
        def ago(unit: str, build) -> Column:
            digits = F.regexp_extract(t, rf"(?U)([0-9]+)\s*{unit}s?\s*ago", 1)
            return let(F.when(F.length(digits).between(1, 9), digits.cast("long")), build)

        iso = F.regexp_extract(t, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
        us = F.regexp_extract(t, r"[0-9]{2}/[0-9]{2}/[0-9]{4}", 0)
        found = F.coalesce(
            ago("day", back),
            ago("week", lambda n: back(n * 7)),
            ago("month", lambda n: back(n * 30)),
            ago("hour", lambda n: F.when(n < 16800000, F.to_date(now - F.make_dt_interval(hours=n.cast("int"))))),
            F.when(F.contains(t, F.lit("today")), today),
            F.when(F.contains(t, F.lit("yesterday")), F.date_sub(today, 1)),
            F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"),
            F.try_to_date(F.nullif(us, F.lit("")), "MM/dd/yyyy"),
        )
        return F.when(t == "", "").otherwise(F.coalesce(F.date_format(found, "yyyy-MM-dd"), t))

    return let(strip(F.lower(blank_if_null(text))), of_text)
