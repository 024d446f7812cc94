"""Skill mining with a taxonomy that is a table, of any size.

A text is cut into words and single signs, its pieces, and a phrase stands where its pieces do. The pieces
that a phrase begins with are looked up at every place, and only for the lengths found there the text is
joined with the phrases, as a whole: a place costs as much as there are lengths, however many phrases share a beginning.
Matches that overlap form islands, each resolved from left to right, as in :mod:`gleaner.functions.phrases`:
a match does not count if it starts inside one that counts and is longer, or as long and listed before.
Phrases of one word block no other, so their places do not matter: they are looked up among the distinct words
of a text that no other phrase covers.

Up to some millions of phrases are sent to the tasks as hashes, and each text is resolved within a task
(:mod:`gleaner.operators.phrase_scan`); with more, places and phrases are joined and meet again by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleaner.functions.text import blank_if_null
from gleaner.operators import phrase_scan
from gleaner.session import cut

#: Fixed value: a word or a single sign; the commonest characters are tried first.
_PIECE = r"[a-z\p{L}\p{N}_]+|(?s:.)"
_WORD = r"^[\p{L}\p{N}_]"
#: Phrases that a task holds as hashes, at most.
MOST_HELD = 6_000_000
#: Beyond that, phrases of one kind that are sent to every task, at most; a larger table is shuffled.
MOST_SENT = 200_000
#: Pieces that a phrase's beginning has, at most.
BEGIN = 3
#: Hashes that beginnings are told by, and the most phrases whose hashes are sent, so neither is ever longer than that.
SLOTS = 1 << 21


def _pieces(low: Column | str) -> Column:
    return F.regexp_extract_all(low, F.lit(_PIECE), F.lit(0))


def _is_word(piece: Column) -> Column:
    return F.coalesce((F.length(piece) > 1) | F.rlike(piece, F.lit(_WORD)), F.lit(False))


def _begin(pieces: Column, at: Column, size: Column | int) -> Column:
    """The hash of the pieces from ``at``, ``size`` in number; the hash skips those that are not there."""
    parts = [F.get(pieces, at + k) if isinstance(size, Column) or k < size else F.lit(None).cast("string") for k in range(BEGIN)]
    return F.pmod(F.xxhash64(*parts), F.lit(SLOTS)) * (BEGIN + 1) + size


def phrase_table(taxonomy: DataFrame) -> DataFrame:
    """Distinct phrases of ``(skill, category, ord)``, each with its first listed category, its length and beginning."""
    once = taxonomy.filter(F.col("skill") != "").groupBy("skill").agg(F.min_by("category", "ord").alias("category"), F.min("ord").alias("ord"))
    cut_up = once.withColumn("_pieces", _pieces("skill"))
    pieces, n = F.col("_pieces"), F.size("_pieces")
    size = F.least(n, F.lit(BEGIN))
    return cut_up.select(
        "skill", "category", F.col("ord").cast("long").alias("ord"), n.alias("pieces"), F.length("skill").alias("size"),
        ((n == 1) & _is_word(pieces[0])).alias("one_word"), size.alias("begin_size"), _begin(pieces, F.lit(0), size).alias("begin"),
    )


def _edge_holds(piece: Column, beside: Column, edge: str) -> Column:
    """Does the word boundary hold between a phrase's outer piece and the piece beside it? A word's always does."""
    return _is_word(piece) | (~_is_word(beside) if edge == "token" else _is_word(beside))


def _matches(texts: DataFrame, phrases: DataFrame, sizes: list[int], edge: str, n_phrases: int, most_sent: int) -> DataFrame:
    """A row for each place at which a phrase stands, by the row of the text."""
    pieces, at, n = F.col("_pieces"), F.col("at"), F.col("pieces")
    # The outer form, since Spark filters the other by a second evaluation of its argument.
    places = texts.select("_row", _pieces("_low").alias("_pieces")).select("_row", "_pieces", F.posexplode_outer("_pieces").alias("at", "_first"))
    open_places = places.filter(at.isNotNull() & _edge_holds(F.col("_first"), F.get(pieces, at - 1), edge))
    begun = open_places.select("_row", "_pieces", "at", F.explode(F.array(*[_begin(pieces, at, size) for size in sizes])).alias("begin"))
    begins = phrases.groupBy("begin").agg(F.collect_set("pieces").alias("lengths"))
    lengths = begun.join(F.broadcast(begins), "begin").select("_row", "_pieces", "at", F.explode("lengths").alias("pieces"))
    fits = (at + n <= F.size(pieces)) & _edge_holds(F.get(pieces, at + n - 1), F.get(pieces, at + n), edge)
    parts = lengths.filter(fits).select("_row", "at", F.array_join(F.slice(pieces, at + 1, n), "").alias("skill"))
    named = phrases.select("skill", "category", "ord", "pieces")
    if n_phrases <= most_sent:
        named = F.broadcast(named)
    elif n_phrases <= SLOTS:
        hashes = phrases.select(F.xxhash64("skill").alias("_hash")).distinct()
        parts = parts.withColumn("_hash", F.xxhash64("skill")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return parts.join(named, "skill").select("_row", "at", (at + F.col("pieces")).alias("stop"), "skill", "category", "ord")


def _counted(matches: Column) -> Column:
    """Of an island's matches in order of place, longest first, those that count: ``skills``, and ``covers``, the spans of pieces they take."""

    def step(state: Column, m: Column) -> Column:
        ahead = F.filter(state["spans"], lambda s: s["stop"] > m["at"])
        first = lambda s: (s["shorter"] < m["shorter"]) | ((s["shorter"] == m["shorter"]) & (s["ord"] <= m["ord"]))
        counts = ~F.exists(ahead, first)
        found = F.struct(m["skill"].alias("skill"), m["category"].alias("category"))
        covers, n = state["covers"], F.size(state["covers"])
        last = F.get(covers, n - 1)
        grown = F.array_append(F.slice(covers, F.lit(1), n - 1), F.struct(last["at"].alias("at"), m["stop"].alias("stop")))
        taken = F.when(last["stop"] >= m["at"], grown).otherwise(F.array_append(covers, F.struct(m["at"].alias("at"), m["stop"].alias("stop"))))
        return F.struct(
            F.when(counts, F.array_append(ahead, m)).otherwise(ahead).alias("spans"),
            F.when(counts & ~F.array_contains(state["skills"], found), F.array_append(state["skills"], found)).otherwise(state["skills"]).alias("skills"),
            F.when(counts, taken).otherwise(covers).alias("covers"),
        )

    span = "array<struct<at:int,shorter:int,ord:bigint,stop:int,skill:string,category:string>>"
    skills, covers = "array<struct<skill:string,category:string>>", "array<struct<at:int,stop:int>>"
    start = F.struct(F.array().cast(span).alias("spans"), F.array().cast(skills).alias("skills"), F.array().cast(covers).alias("covers"))
    folded = F.aggregate(matches, start, step, lambda s: F.struct(s["skills"].alias("skills"), s["covers"].alias("covers")))
    head = F.get(matches, F.lit(0))
    longest = F.struct(
        F.array(F.struct(head["skill"].alias("skill"), head["category"].alias("category"))).alias("skills"),
        F.array(F.struct(head["at"].alias("at"), head["stop"].alias("stop"))).alias("covers"),
    )
    return F.when(F.element_at(matches, -1)["at"] == head["at"], longest).otherwise(folded)


def _resolved(matches: DataFrame) -> DataFrame:
    """Per row, the distinct ``skills`` whose matches count, and the spans they cover in order."""
    order = Window.partitionBy("_row").orderBy("at", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.count_if(F.col("_reach").isNull() | (F.col("at") >= F.col("_reach"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    match = F.struct("at", (-F.length("skill")).alias("shorter"), "ord", "stop", "skill", "category")
    islands = matches.withColumn("_reach", reach).withColumn("_island", island).groupBy("_row", "_island").agg(F.sort_array(F.collect_list(match)).alias("_hits"))
    counted = islands.select("_row", _counted(F.col("_hits")).alias("c")).select("_row", "c.*")
    return counted.groupBy("_row").agg(
        F.array_distinct(F.flatten(F.collect_list("skills"))).alias("skills"), F.sort_array(F.flatten(F.collect_list("covers"))).alias("covers"))


def _uncovered(pieces: Column, covers: Column) -> Column:
    """The pieces outside of the spans; each is got by its number, as a slice copies the array it is taken of."""
    starts, ends = F.concat(F.array(F.lit(0)), covers["stop"]), F.concat(covers["at"], F.array(F.size(pieces)))
    none = F.array().cast("array<int>")
    numbers = F.flatten(F.zip_with(starts, ends, lambda start, end: F.when(end > start, F.sequence(start, end - 1)).otherwise(none)))
    between = F.transform(numbers, lambda i: F.get(pieces, i))
    return F.when(covers.isNull(), pieces).otherwise(between)


def _letters(spark: SparkSession) -> np.ndarray:
    """For every code point, does it stand in words?"""
    points = spark.range(0x110000).filter("id < 55296 or id > 57343")
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    out = np.zeros(0x110000, bool)
    out[points.filter(_is_word(letter)).toArrow()["id"].to_numpy()] = True
    return out


def _held(phrases: DataFrame, edge: str) -> phrase_scan.Held:
    """The phrases as hashes; salted anew if two of them cannot be told apart."""
    letters = _letters(phrases.sparkSession)
    # A lower-cased text is valid, so others stand in none.
    rows = phrases.filter(F.is_valid_utf8("skill")).select("skill", "ord", "category", "one_word")
    for attempt in count():
        salt = attempt.to_bytes(4, "little")

        def run(batches: Iterator[pa.RecordBatch], salt: bytes = salt) -> Iterator[pa.RecordBatch]:
            return phrase_scan.hash_phrases(batches, letters, salt)

        hashed = cut(rows.mapInArrow(run, "h1 long, h2 long, begin long, n int, ord long, category string, one_word boolean"), "phrase-hashes")
        if held := phrase_scan.held(lambda *names, df=hashed: df.orderBy("h1").select(*names).toArrow(), letters, edge, salt):
            return held


def _scanned(postings: DataFrame, text: Column, phrases: DataFrame, ids: tuple[str, ...], edge: str) -> DataFrame:
    """The mentions by a single pass over the texts."""
    texts = postings.select(F.lower(blank_if_null(text)).alias("_low"), *ids)
    sent = postings.sparkSession.sparkContext.broadcast(_held(phrases, edge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return phrase_scan.scan(batches, sent.value)

    found = [StructField("skill", StringType()), StructField("category", StringType())]
    return texts.mapInArrow(run, StructType([*texts.schema.fields[1:], *found]))


def skill_mentions(
    postings: DataFrame, text: Column, taxonomy: DataFrame, *ids: str, edge: str = "boundary", most_sent: int = MOST_SENT,
    most_held: int = MOST_HELD,
) -> DataFrame:
    """One row per posting and skill it mentions, with the skill's category, for a taxonomy ``(skill, category, ord)``.

    Up to ``most_held`` phrases are held by every task, unless ``most_sent`` is 0: the texts are then read once and not shuffled.
    With more, phrases and lower-cased texts are written once, since several steps read them. Phrases of one word, and the others, are
    counted and sent to the tasks if they are up to ``most_sent``; a larger table is shuffled, with the places whose hash is
    among those of the table, or with all that begin like a phrase if even the hashes are too many. Matches meet by row.
    Equal to :func:`gleaner.operators.mining.skill_mentions`, whose pattern is quicker for some hundreds of phrases.
    """
    phrases = cut(phrase_table(taxonomy), "phrases")
    if most_sent and phrases.count() <= most_held:
        return _scanned(postings, text, phrases, ids, edge)
    words, others = phrases.filter("one_word"), phrases.filter("not one_word")
    counts = phrases.agg(
        F.count_if("one_word").alias("words"), F.count_if(~F.col("one_word")).alias("others"),
        F.sort_array(F.collect_set(F.when(~F.col("one_word"), F.col("begin_size")))).alias("sizes")).first()
    rows = postings.select(F.monotonically_increasing_id().alias("_row"), *ids, F.lower(blank_if_null(text)).alias("_low"))
    texts = cut(rows, "mined-texts", compression="zstd")
    if counts["others"]:
        found = _resolved(_matches(texts, others, counts["sizes"], edge, counts["others"], most_sent))
        texts = texts.join(found, "_row", "left")
    else:
        texts = texts.select("*", F.expr("cast(null as array<struct<skill:string,category:string>>)").alias("skills"),
                             F.expr("cast(null as array<struct<at:int,stop:int>>)").alias("covers"))
    known = F.transform(F.coalesce("skills", F.array()), lambda s: F.struct(s["skill"].alias("skill"), s["category"].alias("category"), F.lit(True).alias("known")))
    free = F.array_distinct(_uncovered(F.col("_pieces"), F.col("covers")))
    asked = F.transform(free, lambda w: F.struct(w.alias("skill"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("known")))
    named = texts.withColumn("_pieces", _pieces("_low")).select(*ids, F.explode_outer(F.concat(known, asked)).alias("m")).select(*ids, "m.*")
    listed = words.select("skill", F.col("category").alias("_category"), F.lit(True).alias("_listed"))
    met = named.join(F.broadcast(listed) if counts["words"] <= most_sent else listed, "skill", "left")
    return met.filter(F.col("known") | F.col("_listed")).select(*ids, "skill", F.coalesce("category", "_category").alias("category"))
