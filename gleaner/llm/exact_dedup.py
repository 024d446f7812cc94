"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.llm.common import BLANKS, packed, with_row_id
from gleaner.operators.skew import annotate_by_key
from gleaner.session import cut


def normal_text(text: Column) -> Column:
    """The text without white space; null is empty."""
    return reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame, carry: Sequence[str], prefix: int) -> DataFrame:
    normal = docs.select(packed(carry).alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("whole")).withColumn(
        "normal", normal_text(F.col("whole"))
    )
    return normal.select(
        "doc", "doc_id", F.length("whole").cast("long").alias("n_chars"), "normal",
        F.length("normal").alias("length"), F.xxhash64(F.substring("normal", 1, prefix)).alias("prefix"),
    )


def _sha256(normal: str) -> Column:
    return F.sha2(F.encode(normal, "UTF-8"), 256)


def refine(docs: DataFrame, carry: Sequence[str] = ("doc_id",), prefix: int = 512, digest: bool = False) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. One scan yields the size of each
    (length, prefix hash) group; lengths that stand alone go first, then prefixes that stand
    alone, and only rows of the groups that are left have their whole text hashed. Copies are
    counted per salt before they meet, so a group of any size stays spread out.

    Of equal texts the row with the most code points in the original stays, then the one with
    the smallest doc_id (null last), then one of the rows that are alike in both. Null counts as
    empty, and empty texts are equal to each other. ``text_sha256`` is null for rows that no
    stage had to hash, unless ``digest`` asks for all; those are then taken in the first scan,
    and the refinement goes on without the texts. An empty table gives an empty result.
    """
    keyed, full = _keyed(docs, carry, prefix), _sha256("normal")
    if digest:
        keyed, full = cut(keyed.withColumn("normal", full), "dedup-keyed"), F.col("normal")
    groups = cut(keyed.groupBy("length", "prefix").agg(F.count("*").alias("n")), "dedup-groups")
    lengths = groups.groupBy("length").agg(F.sum("n").alias("m")).filter("m > 1").select("length")
    open_groups = cut(groups.filter("n > 1").join(lengths, "length", "left_semi").select("length", "prefix"), "dedup-open")
    suspects = with_row_id(
        keyed.join(open_groups, ["length", "prefix"], "left_semi")
        .select("doc", "doc_id", "n_chars", "length", full.alias("text_sha256")),
        "dedup-suspects",
    )
    best = F.struct("n_chars", (-F.col("doc_id")).alias("i"), (-F.col("row")).alias("r"), "doc_id")
    found = annotate_by_key(
        suspects, ["length", "text_sha256"], ["row"], group_size=(F.sum, F.lit(1).cast("long")), best=(F.max, best)
    )
    settled = found.select(
        "doc", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.r") == -F.col("row")).alias("kept"), "text_sha256"
    )
    alone = keyed.join(open_groups, ["length", "prefix"], "left_anti").select(
        "doc", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        (full if digest else F.lit(None).cast("string")).alias("text_sha256"),
    )
    return settled.unionByName(alone)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return refine(docs, docs.columns).filter("kept").select("doc.*")
