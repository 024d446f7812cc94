"""Mixing sources to target weights by Pareto order sampling, in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.common import WORD, null_safe, packed, unpacked, with_row_id
from gleaner.session import cut

_BINS = 4096


def word_count(text: str = "text") -> Column:
    """Words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``(source, source_size)`` to the words each source is to give.

    The sources, by code point with null last, take the weights in turn and share the sum
    of all sizes. A target stops at ``most`` times its source's size and the excess goes to
    the others by weight: sorted by size over weight, the stopped sources are a prefix, so
    two running sums over one row per source settle it. A source without words has target 0.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.select("source", "source_size", F.element_at(cycle, (turn % len(weights) + 1)).alias("weight"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    ceiling = most * F.col("source_size")
    sums = weighed.select(
        "*",
        F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
        F.coalesce(F.sum(ceiling).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("given"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
    )
    stops = sums.withColumn("stops", ceiling * F.col("rest") <= (F.col("total") - F.col("given")) * F.col("weight"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = stops.select(
        "*",
        F.sum(F.when(F.col("stops"), ceiling).otherwise(0)).over(everything).alias("stopped"),
        F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything).alias("open"),
    )
    share = (F.col("total") - F.col("stopped")) * F.col("weight") / F.col("open")
    return shared.select(
        "source", "source_size", F.when(F.col("stops"), ceiling.cast("double")).otherwise(share).alias("target")
    )


def _crossing(rows: DataFrame, level: Column, before: DataFrame) -> DataFrame:
    """Per source the level in which the running sum of sizes passes what is wanted.

    ``rows`` are those of the level found last; ``before`` has ``(source, wanted, given)``.
    """
    sums = rows.groupBy("source", level.alias("level")).agg(F.sum("size").alias("level_size"))
    running = F.sum("level_size").over(Window.partitionBy("source").orderBy("level"))
    known = before.select("source", "wanted", "given").alias("b")
    found = (
        sums.withColumn("upto", running).alias("s")
        .join(known, null_safe("s", "b", ["source"]))
        .select("s.source", "s.level", "b.wanted", (F.col("given") + F.col("upto")).alias("upto"),
                (F.col("given") + F.col("upto") - F.col("level_size")).alias("given"))
    )
    return cut(found.filter((F.col("given") <= F.col("wanted")) & (F.col("upto") > F.col("wanted"))).drop("upto"), "mix-level")


def mixture(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 42, carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """One row per document: the ``carry`` columns in the struct ``doc``, size, source_size, target, copies, taken.

    A source's rate is its target over its size. Every document gets the whole part of the
    rate as certain copies. One more copy goes to a Pareto order sample: with inclusion
    probability p (the rate's fraction) and a uniform u hashed from the document, the
    documents are ranked by (u/(1-u)) / (p/(1-p)), and the sample is the longest prefix that
    does not pass the words still wanted. One closing document per source, that whose size is
    nearest to the words left over, follows if it brings the source nearer to its target.

    The prefix is found without sorting a source: sums over rank bins, finer from level to
    level, find the one bin where the sum passes the target; only its rows are ordered.
    Repeated rows share a rank and are told apart by their row number at the last levels.

    Null texts and blank texts have size 0 and nothing taken; a null source is a source; an
    empty table gives an empty result. The hash makes reruns agree.
    """
    hashes = [F.xxhash64(F.lit(seed + i), F.col("doc_id"), F.col("text")) for i in (0, 1)]
    units = with_row_id(
        docs.select(packed(carry).alias("doc"), "source", word_count().alias("size"),
                    hashes[0].alias("h"), hashes[1].alias("tie")),
        "mix-units",
    )
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, weights, most), "mix-targets")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    planned = units.alias("u").join(goals.alias("g"), null_safe("u", "g", ["source"]), "left").select(
        "u.*", "g.source_size", "g.target", rate.alias("rate")
    )
    p = F.col("rate") - F.floor("rate")
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    ranked = planned.select(
        "*", F.floor("rate").alias("certain"),
        F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p))).alias("rank"),
        F.pmod(F.xxhash64("row"), F.lit(_BINS)).alias("row_bin"),
    )
    place = F.col("rank") / (1 + F.col("rank"))
    levels = [
        F.struct(F.floor(place * _BINS).alias("b")),
        F.struct(F.floor(place * _BINS * _BINS).alias("b")),
        F.struct("rank", "tie"),
        F.struct("row_bin"),
        F.struct("row"),
    ]
    found = goals.select(
        "source", (F.col("target") - F.floor(rate) * F.col("source_size")).alias("wanted"), F.lit(0).alias("given")
    )
    rows = ranked.filter(F.col("rank").isNotNull())
    within = rows
    for level in levels:
        found = _crossing(within, level, found)
        within = within.alias("w").join(
            found.alias("f"), null_safe("w", "f", ["source"]) & (level == F.col("f.level")), "left_semi"
        )
    position = F.struct("rank", "tie", "row_bin", "row")
    edges = cut(
        within.select("source", position.alias("edge")).alias("w").join(found.alias("f"), null_safe("w", "f", ["source"]))
        .select("w.source", "w.edge", (F.col("wanted") - F.col("given")).alias("gap")),
        "mix-edges",
    )
    sampled = ranked.alias("r").join(edges.alias("e"), null_safe("r", "e", ["source"]), "left").select(
        "r.*", "e.gap", F.coalesce(position < F.col("e.edge"), F.lit(False)).alias("drawn")
    )
    off = F.abs(F.col("size") - F.col("gap"))
    spare = ~F.col("drawn") & F.col("rank").isNotNull() & (off < F.col("gap"))
    closing = cut(
        sampled.filter(spare).groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "tie", "row")).alias("c"))
        .select(F.col("c.row").alias("row")),
        "mix-closing",
    )
    closed = sampled.alias("s").join(closing.withColumn("closes", F.lit(1)).alias("c"), "row", "left")
    copies = (F.col("certain") + F.col("drawn").cast("long") + F.coalesce("closes", F.lit(0))).cast("long")
    return closed.select("doc", "source", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )



def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The documents of the mix with all their columns, size, source_size, target, and taken, the words of all copies."""
    mixed = mixture(docs, weights, carry=docs.columns).filter("copies > 0")
    return unpacked(mixed, "doc", "size", "source_size", "target", "copies", "taken")
