"""Raw pages: rule-driven extraction of posting rows from listing markup.

A rule set says, with regular expressions, where the containers of a page are and
where each field stands inside one. Rule sets are settings: one per page layout.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner import schema
from gleaner.functions.dates import relative_date
from gleaner.functions.text import blank_if_null, drop_scripts, let, markup_text, strip, unescape_entities
from gleaner.functions.urls import absolute_link


def _needs(css_class: str | None, attr: str | None) -> str:
    need = ""
    if css_class:
        need += rf"(?=[^>]*\bclass\s*=\s*[\"'][^\"'>]*(?<![\w-])(?:{css_class})(?![\w-]))"
    if attr:
        need += rf"(?=[^>]*\s{attr}(?:\s|=|>))"
    return need


def start_tag(tag: str = r"\w+", css_class: str | None = None, attr: str | None = None) -> str:
    """Pattern of a start tag by name, class or attribute; group 1 is the tag name."""
    return rf"(?is)<({tag})(?=[\s>/]){_needs(css_class, attr)}[^>]*>"


def element(tag: str = r"\w+", css_class: str | None = None, attr: str | None = None) -> str:
    """Pattern of an element up to its first end tag; meant for the leaves of a container."""
    return rf"{start_tag(tag, css_class, attr)}.*?</\1\s*>"


def any_of(*patterns: str) -> str:
    """The first of several start tags or elements in document order."""
    parts = [p.removeprefix("(?is)").replace(r"\1", rf"\{i + 1}") for i, p in enumerate(patterns)]
    return "(?is)" + "|".join(parts)


HREF = r"""<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


@dataclass(frozen=True)
class ListingRules:
    """Patterns of one layout. Blank pattern: the field is not there.

    ``container`` matches the start tag of a container, and the container runs to its end
    tag or to the next one. Several patterns are matched together, in document order; a
    tuple among them is a path, each pattern inside what the one before it matches.
    ``fallback`` is used only on pages where ``container`` finds nothing. Containers that
    begin with ``skip`` are dropped, those of the fallback with ``fallback_skip``. A field is the text of the element its pattern matches, or of the element
    that the last of several patterns matches inside the one before. ``stamp`` and the
    links capture an attribute value in their last group.
    """

    container: str | tuple[str | tuple[str, ...], ...]
    title: str | tuple[str, ...]
    link: str = "(?is)" + HREF
    preferred_link: str = ""
    company: str | tuple[str, ...] = ""
    location: str | tuple[str, ...] = ""
    salary: str | tuple[str, ...] = ""
    date: str | tuple[str, ...] = ""
    stamp: str = ""
    fallback: str = ""
    skip: str = ""
    fallback_skip: str = ""
    source_site: str = "generic"


TABLE_LAYOUT = ListingRules(
    container=start_tag("tr", "job"),
    skip=start_tag("tr", "placeholder"),
    title=(element("td", "position"), element("h2")),
    company=element(css_class="company"),
    location=element(css_class="location"),
    salary=element(css_class="salary"),
    date=element(css_class="time"),
    link=start_tag("td", "source|position") + r"(?:(?!</td).)*?" + HREF,
    source_site="remoteok",
)

LIST_LAYOUT = ListingRules(
    container=(
        (start_tag("section", "jobs"), start_tag("article"), start_tag("li")),
        (start_tag(css_class="jobs-list"), start_tag("li")),
        start_tag(css_class="job"),
    ),
    fallback=start_tag("li"),
    fallback_skip=start_tag("li", "view-all"),
    title=any_of(element("span", "title"), element(css_class="job-title"), element("h4")),
    company=element(css_class="company|company-name"),
    location=element(css_class="region|location"),
    salary=element(css_class="salary"),
    date=any_of(element("span", "date"), element("time"), element(css_class="time-ago")),
    stamp=r"""(?is)<time\b[^>]*?\bdatetime\s*=\s*["']([^"']*)["']""",
    preferred_link=r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*(?:/remote-jobs/|/listings/)[^"']*)["']""",
    source_site="weworkremotely",
)

GENERIC_LAYOUT = ListingRules(
    container=(start_tag(css_class="job|job-listing"), start_tag(attr="data-job")),
    title=any_of(element(css_class="title"), element("h[234]")),
    company=element(css_class="company|employer"),
    location=element(css_class="location|region"),
    salary=element(css_class="salary"),
    date=any_of(element(css_class="date|posted"), element("time")),
)

LAYOUTS = {"remoteok": TABLE_LAYOUT, "weworkremotely": LIST_LAYOUT, "generic": GENERIC_LAYOUT}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages as ``(page_id, url, html)``."""
    return spark.read.schema(schema.PAGE).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """A landing folder with one page per file; the file path stands in for the URL."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def _by_layout(layouts: Mapping[str, ListingRules], layout: Column, build) -> Column:
    out = None
    for name, rules in layouts.items():
        value = build(rules)
        out = F.when(layout == name, value) if out is None else out.when(layout == name, value)
    return out


#: Pieces whose lengths are summed up one by one; sums of whole blocks are kept.
_BLOCK = 128


def _offsets(pieces: Column) -> Column:
    """Where each piece begins in what they make up together, with a bounded number of additions for each."""

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)

    def running(sizes: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
            lambda b: total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))),
        )

        def before(sums: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                block = F.floor(i / _BLOCK).cast("int")
                return total(F.slice(sums, F.lit(1), block)) + total(F.slice(sizes, block * _BLOCK + 1, i % _BLOCK))

            return F.transform(sizes, one)

        return let(blocks, before)

    return let(F.transform(pieces, F.length), running)


def _to_end_tag(part: Column, tag: Column) -> Column:
    """Markup from a start tag to its end tag, or all of it if that does not come."""
    tags = F.split(part, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s>/])")))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
        closed = (depth == 0) & (state["end"] < 0)
        end = state["pos"] + F.length(F.regexp_extract(piece, r"^</[^>]*>", 0))
        return F.struct(
            depth.alias("depth"), (state["pos"] + F.length(piece)).alias("pos"), F.when(closed, end).otherwise(state["end"]).alias("end")
        )

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(-1).alias("end"))
    end = F.aggregate(tags, begin, step, lambda state: state["end"])
    return let(end, lambda e: F.when(e < 0, part).otherwise(F.substring(part, F.lit(1), e)))


def _outer(html: Column, start: str) -> Column:
    """Place and markup ``(begin, text)`` of every container.

    The page is cut before each container, and each cut is read once on its own, with the depth of its
    tags as a running number, so that the time grows with the length of the page.
    """
    pattern = start.removeprefix("(?is)")
    found = F.regexp_extract_all(html, F.lit(start), F.lit(0))
    tags = F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_extract(t, r"^<(\w+)", 1))))
    at_start = F.lit(f"(?is)^(?:{pattern})")

    def of_tag(tag: Column) -> Column:
        here = F.concat(F.lit("(?i)^<"), tag, F.lit(r"[\s>/]"))
        cuts = F.split(html, F.concat(F.lit("(?is)(?=<"), tag, F.lit(rf"[\s>/])(?={pattern})")))

        def placed(pieces: Column) -> Column:
            return F.zip_with(pieces, _offsets(pieces), lambda p, b: F.struct(b.alias("begin"), p.alias("text")))

        starts = F.filter(let(cuts, placed), lambda x: F.rlike(x["text"], at_start) & F.rlike(x["text"], here))
        return F.transform(starts, lambda x: F.struct(x["begin"].alias("begin"), _to_end_tag(x["text"], tag).alias("text")))

    return F.flatten(F.transform(tags, of_tag))


def _path(html: Column, path: tuple[str, ...]) -> Column:
    """Containers that the last pattern of a path finds inside those of the one before."""
    found = _outer(html, path[0])
    for start in path[1:]:
        found = F.flatten(F.transform(found, _inside(start)))
    return found


def _inside(start: str):
    def within(outer: Column) -> Column:
        return F.transform(
            _outer(outer["text"], start), lambda x: F.struct((outer["begin"] + x["begin"]).alias("begin"), x["text"].alias("text"))
        )

    return within


def _all_of(html: Column, patterns: str | tuple[str | tuple[str, ...], ...]) -> Column:
    """Markup of the containers of all patterns in document order, each place once."""
    each = [_path(html, (p,) if isinstance(p, str) else p) for p in ((patterns,) if isinstance(patterns, str) else patterns)]
    found = F.array_sort(each[0] if len(each) == 1 else F.concat(*each))

    def once(ordered: Column) -> Column:
        first = F.filter(ordered, lambda x, i: (i == 0) | (x["begin"] != F.get(ordered, i - 1)["begin"]))
        return F.transform(first, lambda x: x["text"])

    return let(found, once)


def _without(containers: Column, skip: str) -> Column:
    if not skip:
        return containers
    return F.filter(containers, lambda c: ~F.rlike(c, F.lit("(?is)^(?:" + skip.removeprefix("(?is)") + ")")))


def _containers(html: Column, rules: ListingRules) -> Column:
    found = _all_of(html, rules.container)
    if not rules.fallback:
        return _without(found, rules.skip)
    other = _without(_all_of(html, rules.fallback), rules.fallback_skip)
    return let(found, lambda all_found: F.when(F.size(all_found) > 0, _without(all_found, rules.skip)).otherwise(other))


def _field(part: Column, pattern: str | tuple[str, ...]) -> Column:
    """Markup of a field."""
    if not pattern:
        return F.lit("")
    for step in (pattern,) if isinstance(pattern, str) else pattern:
        part = F.regexp_extract(part, step, 0)
    return part


def _attribute(part: Column, pattern: str) -> Column:
    return F.regexp_extract(part, pattern, _value_group(pattern)) if pattern else F.lit("")


def _value_group(pattern: str) -> int:
    # The attribute value is the last group of a link or stamp pattern.
    return re.compile(pattern).groups


def page_listings(
    pages: DataFrame,
    layout: Column,
    as_of: Column,
    layouts: Mapping[str, ListingRules] = LAYOUTS,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Posting rows of each page: one per container, with ``pos`` counting from 0."""
    others = [c for c in pages.columns if c != html]
    cleaned = pages.select(*others, layout.alias("_layout"), drop_scripts(F.col(html)).alias("_html"))
    split = cleaned.select(
        *others,
        "_layout",
        F.posexplode(_by_layout(layouts, F.col("_layout"), lambda r: _containers(F.col("_html"), r))).alias("pos", "_part"),
    )
    part, kind = F.col("_part"), F.col("_layout")

    def pick(build) -> Column:
        return _by_layout(layouts, kind, build)

    # Cut out by layout first, so that what is done to texts stands in the plan once.
    markup = pick(lambda r: F.array(*[_field(part, p) for p in (r.title, r.company, r.location, r.salary, r.date)]))
    values = pick(lambda r: F.array(*[_attribute(part, p) for p in (r.stamp, r.preferred_link, r.link)]))
    rows = split.select(
        *others, "pos", "_part", F.transform(markup, markup_text).alias("_t"), F.transform(values, unescape_entities).alias("_v"),
        pick(lambda r: F.lit(r.source_site)).alias("source_site"),
    )
    texts, (stamp, preferred, link) = F.col("_t"), [F.col("_v")[i] for i in range(3)]
    found = rows.select(
        *others,
        "pos",
        *[texts[i].alias(name) for i, name in enumerate(("title", "company", "location", "salary_range"))],
        F.when(stamp != "", F.substring(stamp, 1, 10)).otherwise(relative_date(texts[4], as_of)).alias("date_posted"),
        "source_site",
        part.alias("raw_html"),
        F.when(preferred != "", preferred).otherwise(link).alias("_href"),
    )
    job_url = F.when(F.col("_href") != "", absolute_link(F.col(url), F.col("_href"))).otherwise("")
    return found.withColumn("job_url", job_url).drop("_href")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Every link of a page, in order, resolved against the page's URL."""
    others = [c for c in pages.columns if c != html]
    hrefs = F.regexp_extract_all(
        drop_scripts(F.col(html)), F.lit("(?is)" + HREF), F.lit(1)
    )
    return pages.select(*others, F.posexplode(hrefs).alias("pos", "href")).withColumn(
        "job_url", absolute_link(F.col(url), unescape_entities(F.col("href")))
    )


def rules_from_config(config: Mapping[str, Mapping[str, str]]) -> dict[str, ListingRules]:
    """Rule sets from ``{layout: {field: pattern}}``, e.g. a parsed settings file."""
    known = {f.name for f in fields(ListingRules)}
    out = {}
    for name, rules in config.items():
        unknown = set(rules) - known
        if unknown:
            raise ValueError(f"unknown rule(s) for {name}: {sorted(unknown)}")
        out[name] = ListingRules(**rules)
    return out


def storage_projection(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Trim the fields and stamp the capture time."""
    trimmed = ["title", "company", "location", "salary_range", "date_posted", "job_url"]
    others = [c for c in rows.columns if c not in schema.PARSED_TEXT_COLUMNS and c != "scraped_at"]
    return rows.select(
        *others,
        *[strip(F.col(c)).alias(c) for c in trimmed],
        blank_if_null(F.col("source_site")).alias("source_site"),
        blank_if_null(F.col("raw_html")).alias("raw_html"),
        run_ts.alias("scraped_at"),
    )
