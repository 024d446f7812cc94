"""Fixed schemas. Missing text is the empty string, never NULL."""

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


PARSED_TEXT_COLUMNS = [
    "title", "company", "location", "salary_range", "date_posted", "job_url", "source_site", "raw_html",
]

POSTING = _struct(
    title=_S, company=_S, location=_S, salary_range=_S, date_posted=_S, job_url=_S, url_key=_S,
    source_site=_S, raw_html=_S, scraped_at=T.TimestampType(), is_active=T.BooleanType(), week_key=_S,
)

#: A key of the store and its hash, by which the key table is ordered.
KEY = _struct(h=T.LongType(), url_key=_S)

DEDUP_AUDIT = _struct(job_url=_S, reason=_S, checked_at=T.TimestampType())

RUN_EVENT = _struct(
    run_id=T.LongType(), event_ts=T.TimestampType(), source_site=_S, pages_scraped=T.LongType(),
    jobs_found=T.LongType(), jobs_inserted=T.LongType(), jobs_deduplicated=T.LongType(),
    errors_encountered=T.LongType(), started_at=T.TimestampType(), completed_at=T.TimestampType(),
    status=_S, error_message=_S,
)

FEED_ENTRY = _struct(
    position=_S, company=_S, location=_S, tags=T.ArrayType(_S), description=_S, date=_S, slug=_S, id=_S,
)

PAGE = _struct(page_id=T.LongType(), url=_S, html=_S)
