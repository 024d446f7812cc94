"""JSON feeds: an API body is an array of entries, the first of which is metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner import schema
from gleaner.functions.dates import feed_date
from gleaner.functions.text import blank_if_null, let, strip

# A tag that contains one of these names a place.
LOCATION_KEYWORDS = [
    "remote", "usa", "europe", "asia", "americas", "worldwide", "uk", "canada", "germany", "france", "australia",
]

# Fixed value: pay ranges and amounts in running text, leftmost match.
SALARY_PATTERN = (
    r"[$€£]\s*[\d,]+\s*[–-]\s*[$€£]?\s*[\d,]+"
    r"|\$\d+[kK][\s–-]+\$?\d+[kK]"
    r"|[\d,]+\s*(USD|EUR|GBP|per year|per month|/yr|/month)"
)

# The default board's detail address and source label.
DETAIL_URL = "https://remoteok.com/remote-jobs/"
FEED_SOURCE = "remoteok"


def read_feed(spark: SparkSession, path: str, one_body_per_file: bool = True) -> DataFrame:
    """Landed API bodies: one per file, or one per line; ``line`` tells the bodies of a file apart."""
    body = spark.read.text(path, wholetext=one_body_per_file)
    line = F.monotonically_increasing_id().alias("line")
    return body.select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"), line)


def feed_entries(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry with its position; position 0 is metadata unless it stands alone.

    A body that is no JSON array, truncated ones included, is one entry with ``broken``.
    """
    others = [c for c in bodies.columns if c != body]

    def item(entry: Column, size: Column, broken: bool) -> Column:
        return F.struct(entry.alias("entry"), size.alias("size"), F.lit(broken).alias("broken"))

    def sized(entries: Column) -> Column:
        whole = F.array(item(blank_if_null(F.col(body)), F.lit(1), True))
        is_list = entries.isNotNull() & F.rlike(F.col(body), F.lit(r"^\s*\["))
        return F.when(is_list, F.transform(entries, lambda e: item(e, F.size(entries), False))).otherwise(whole)

    # Parsed inside the generator, so that the body is parsed once.
    entries = let(F.from_json(F.col(body), "array<string>"), sized)
    return (
        bodies.select(*others, F.posexplode(entries).alias("pos", "_item"))
        .filter((F.col("pos") > 0) | (F.col("_item.size") == 1))
        .select(*others, "pos", F.col("_item.entry").alias("entry"), F.col("_item.broken").alias("broken"))
    )


def infer_location(location: Column, tags: Column) -> Column:
    """The location given, else the tags that name a place, else ``Remote``."""
    known = F.coalesce(tags, F.array().cast("array<string>"))
    keyword = F.lit("|".join(LOCATION_KEYWORDS))
    places = F.filter(known, lambda t: F.rlike(F.lower(t), keyword))
    guess = F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise("Remote")
    return F.when(blank_if_null(location) != "", location).otherwise(guess)


def extract_salary(text: Column) -> Column:
    return F.regexp_extract(blank_if_null(text), SALARY_PATTERN, 0)


def detail_url(slug: Column, entry_id: Column, base: str = DETAIL_URL) -> Column:
    return F.when(blank_if_null(slug) != "", F.concat(F.lit(base), slug)).when(
        blank_if_null(entry_id) != "", F.concat(F.lit(base), entry_id)
    ).otherwise("")


def pack_raw(entry: Column, tags: Column) -> Column:
    """The whole entry text, then the tags."""
    whole = F.regexp_replace(entry, r"\\[nrt]", " ")
    listed = F.concat(F.lit("\n<!-- TAGS: "), F.array_join(tags, ", "), F.lit(" -->"))
    return F.concat(whole, F.when(F.size(tags) > 0, listed).otherwise(""))


def _read_entries(entries: DataFrame, entry: str) -> DataFrame:
    """The rows with the entry as a tree ``_fields``, null if it is none. The generator lets it be read only once."""
    return entries.select(*entries.columns, F.explode(F.array(F.try_parse_json(F.col(entry)))).alias("_fields"))


def unknown_fields(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """A row for each field of an entry that posting rows have no column for: ``field``, its type ``kind``, and ``value``.

    The type is that of the value, ``VOID`` for a null; ``value`` keeps it as a VARIANT. Entries that are no
    record have no rows.
    """
    others = [c for c in entries.columns if c not in (entry, "broken")]
    records = _read_entries(entries.select(*others, entry).filter(F.startswith(entry, F.lit("{"))), entry).drop(entry)
    each = records.sparkSession.tvf.variant_explode(F.col("_fields").outer()).select(F.col("key").alias("field"), "value")
    unknown = records.lateralJoin(each).filter(~F.col("field").isin(schema.FEED_ENTRY.names))
    return unknown.select(*others, "field", F.schema_of_variant("value").alias("kind"), "value")


def feed_postings(
    entries: DataFrame, entry: str = "entry", base: str = DETAIL_URL, source_site: str = FEED_SOURCE
) -> DataFrame:
    """Feed entries as posting rows; ``unparsed`` marks broken bodies and entries without a usable record.

    An entry is read as a typed tree. One that names a field twice has no usable record, unless the session sets
    ``spark.sql.variant.allowDuplicateKeys``, as :func:`gleaner.session.build_session` does: then the last one counts.
    """
    others = [c for c in entries.columns if c not in (entry, "broken")]
    broken = F.col("broken") if "broken" in entries.columns else F.lit(False)
    parsed = _read_entries(entries.select(*others, entry, broken.alias("_broken")), entry)
    e = {f.name: F.try_variant_get("_fields", f"$.{f.name}", f.dataType.simpleString()) for f in schema.FEED_ENTRY}

    # A name given as an explicit null breaks the record; an absent one is blank.
    def null_given(name: str) -> Column:
        return F.coalesce(F.is_variant_null(F.try_variant_get("_fields", f"$.{name}", "variant")), F.lit(False))

    nulled = null_given("position") | null_given("company") | null_given("description")
    no_tags = null_given("tags") & (blank_if_null(e["location"]) == "")
    unparsed = F.col("_broken") | F.col("_fields").isNull() | ~F.startswith(entry, F.lit("{")) | nulled | no_tags
    return parsed.select(
        *others,
        strip(e["position"]).alias("title"),
        strip(e["company"]).alias("company"),
        infer_location(e["location"], e["tags"]).alias("location"),
        extract_salary(e["description"]).alias("salary_range"),
        feed_date(e["date"]).alias("date_posted"),
        detail_url(e["slug"], e["id"], base).alias("job_url"),
        F.lit(source_site).alias("source_site"),
        pack_raw(F.col(entry), e["tags"]).alias("raw_html"),
        F.coalesce(unparsed, F.lit(True)).alias("unparsed"),
    )
