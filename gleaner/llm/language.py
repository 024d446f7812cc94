"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gleaner.llm.common import learnable, packed, pieces
from gleaner.session import cut

#: Lengths of the n-grams, in letters; a blank stands for all that is not a letter.
SIZES = (2, 3, 4)
#: Documents a language is learned from, at most about; its most frequent n-grams are kept.
SAMPLE, GRAMS = 2000, 8192
#: Slots of the filter (a power of two) and probes for each n-gram.
SLOTS, PROBES = 1 << 20, 3
UNKNOWN = "und"

_CHUNK = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Lower case of each code point that is a letter, and a blank for each other."""
    points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32
              for c in map(chr, range(sys.maxunicode + 1))]
    return np.array(points, np.uint32)


def letters_of(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def gram_hashes(points: np.ndarray, first: int = _CHUNK) -> np.ndarray:
    """Hashes of the n-grams that begin in the ``first`` places, and have blanks at their ends only."""
    letter = points != 32
    wide = points.astype(np.uint64) + np.uint64(1)
    out = []
    for n in SIZES:
        count = min(len(points) - n + 1, first)
        if count < 1:
            continue
        value = np.full(count, n, np.uint64)
        for j in range(n):
            value = (value ^ wide[j : j + count]) * _MIX[j]
        value ^= value >> np.uint64(29)
        inner = letter[:count] | letter[n - 1 : n - 1 + count]
        for j in range(1, n - 1):
            inner = inner & letter[j : j + count]
        out.append(value[inner])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _stretches(points: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts; n-grams over a border are part of the earlier one."""
    padded = np.concatenate((np.array([32], np.uint32), points, np.array([32], np.uint32)))
    for start in range(0, len(padded), _CHUNK):
        yield padded[start : start + _CHUNK + max(SIZES) - 1]


def _probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for j in range(PROBES):
        yield ((hashes * _MIX[j]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


@dataclass
class Filters:
    """One Bloom filter per language, sliced by bits: a slot holds a bit for each language."""

    languages: list[str]
    slots: np.ndarray  # one row per slot, one byte for each eight languages
    false: np.ndarray  # the rate at which a language's filter holds a foreign n-gram

    @classmethod
    def of(cls, grams: dict[str, np.ndarray]) -> Filters:
        languages = sorted(grams)
        slots = np.zeros((SLOTS, max(1, -(-len(languages) // 8))), np.uint8)
        false = np.zeros(len(languages))
        for i, name in enumerate(languages):
            bit = np.uint8(1 << i % 8)
            for at in _probes(grams[name]):
                slots[at, i // 8] |= bit
            false[i] = ((slots[:, i // 8] & bit) > 0).mean() ** PROBES
        return cls(languages, slots, false)

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Per language the n-grams that its filter holds, and the number of n-grams."""
        counts, total = np.zeros(self.slots.shape[1] * 8, np.int64), 0
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for part in _stretches(letters_of(text)):
            hashes = gram_hashes(part)
            total += len(hashes)
            mask = None
            for at in _probes(hashes):
                mask = self.slots[at] if mask is None else mask & self.slots[at]
            for b in range(self.slots.shape[1]):
                counts[b * 8 : b * 8 + 8] += np.bincount(mask[:, b], minlength=256) @ bits
        return counts[: len(self.languages)], total

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language with most n-grams beyond its false positives, and its share of all such n-grams."""
        if not text or not self.languages or not (letters_of(text) != 32).any():
            return UNKNOWN, 0.0
        counts, total = self.hits(text)
        true = np.maximum((counts - total * self.false) / (1 - np.minimum(self.false, 0.999)), 0.0)
        best = int(true.argmax())
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0


def learn(docs: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> Filters:
    """Filters from ``(doc_id, text, lang)``, without the ids that are held out.

    About ``sample`` documents of each language, drawn by a hash of the id, are counted in
    Spark; the driver gets the ``grams`` most frequent n-grams of each language.
    """
    labelled = docs.filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut(labelled.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")), "lang-sizes")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    drawn = labelled.join(sizes, "lang").filter(draw < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            langs = batch.column("lang").to_pylist()
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).extend(gram_hashes(p) for p in _stretches(letters_of(text)))
            for lang, parts in found.items():
                value, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(value)), "gram": pa.array(value.view(np.int64)), "n": pa.array(n),
                })

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")))
    kept: dict[str, list[int]] = {}
    for lang, gram in ranked.filter(F.col("r") <= grams).select("lang", "gram").collect():
        kept.setdefault(lang, []).append(gram)
    return Filters.of({k: np.array(v, np.int64).view(np.uint64) for k, v in kept.items()})


def identify(docs: DataFrame, filters: Filters, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, lang_pred, score.

    The whole text is read, in one pass without a shuffle. Each n-gram is looked up once and
    gives the languages that hold it. A text that is null or has no letter is ``und`` with
    score 0, as is every text if nothing was learned; equal languages are settled by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(packed(carry).alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = [sent.value.decide(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc", "lang_pred", "score"],
            )

    schema = [rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType(schema))
