"""Per-key lookups that stay spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def annotate_by_key(rows: DataFrame, keys: Sequence[str], row_id: Sequence[str], salts: int | None = None, **aggregates):
    """Add per-key aggregates to every row without bringing a key's rows together.

    ``aggregates`` maps a new column to ``(combine, value)``, where ``combine`` is an
    aggregate that may be applied to its own results (``F.min``, ``F.max``, ``F.sum``).
    Rows are first reduced per (key, salt) before the shuffle. A key has at most
    ``salts`` such partial rows, which a window then combines, and rows find their
    totals by (key, salt), so a hot key is spread over ``salts`` join partitions. Keys
    without repeats pay nothing for a large number of salts.
    """
    if salts is None:
        salts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    partial = salted.groupBy(*keys, "_salt").agg(*[f(v).alias(n) for n, (f, v) in aggregates.items()])
    whole_key = Window.partitionBy(*keys)
    totals = partial.select(*keys, "_salt", *[f(F.col(n)).over(whole_key).alias(n) for n, (f, _) in aggregates.items()])
    on: Column | None = None
    left, right = salted.alias("_rows"), totals.alias("_totals")
    for c in [*keys, "_salt"]:
        match = F.col(f"_rows.{c}").eqNullSafe(F.col(f"_totals.{c}"))
        on = match if on is None else on & match
    return left.join(right, on, "left").select(
        *[F.col(f"_rows.{c}") for c in rows.columns], *[F.col(f"_totals.{n}") for n in aggregates]
    )
