"""Small tables with every kind of odd row."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, doc string, size long, row long, kept string, "
    "fp string, score string, copies string, level string, page string"
)
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (3, "The QUICK brown fox\tjumps over\nthe lazy dog again and again ", None, "b"),
    (4, None, "en", None),
    (5, "", None, "b"),
    (6, " \t\n", "de", "b"),
    (None, "quite another text that stands alone with some words", "en", "a"),
    (None, None, None, None),
    (7, "één ünï 漢字 text", "fr", "c"),
    (8, LONG, "en", "c"),
    (9, LONG + " end", "en", "c"),
    (10, "short", "en", "a"),
    (11, "12 !! ..", "en", "a"),
]


def table(spark, rows=ODD, extra=True):
    full = [(*r, 0, "x", 7, 8, "yes", "f", "s", "c", "l", "p") for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
