"""Small helpers the operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.session import cut

#: The white space of the contracts, and a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(columns: list[str] | tuple[str, ...]) -> Column:
    """The columns in one struct, so that their names meet no other."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])


def unpacked(df: DataFrame, struct: str, *more: str) -> DataFrame:
    """The fields of a struct and then ``more`` columns, which take the place of fields of the same name."""
    taken = {m.lower() for m in more}
    fields = [f for f in df.schema[struct].dataType.names if f.lower() not in taken]
    return df.select(*[F.col(struct).getField(f).alias(f) for f in fields], *more)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of ids that no model may learn from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """True for rows a model may learn from; a null id is no such row."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def drawn(df: DataFrame, sample: int, *by: str) -> DataFrame:
    """At most ``sample`` rows, drawn by a hash of the columns ``by``.

    A count says which share of the hashes is wanted, so that the rows which are then put in
    order are few more than the sample, however many tasks there are.
    """
    share = min(1.0, 1.2 * sample / max(df.count(), 1))
    place = F.shiftrightunsigned(F.xxhash64(*by), 11) / float(1 << 53)
    return df.filter(place < share).orderBy(F.xxhash64(*by), *by).limit(sample)


def with_row_id(df: DataFrame, label: str, **options) -> DataFrame:
    """Add a ``row`` that is unique and, being written, the same wherever it is read."""
    return cut(df.withColumn("row", F.monotonically_increasing_id()), label, **options)


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that ``column`` has at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)


def blocks(data: bytes, gap: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """A text in blocks that end at a ``gap``, so that a long one is never held as a list of words."""
    start = 0
    while start < len(data):
        found = gap.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end
