"""Quality classifier: a regularised quadratic discriminant over statistics of a text.

Each class of labelled documents is a normal distribution of transformed statistics. Its
covariance is shrunk towards that of all classes and then towards a sphere, so that it can be
factored however few rows a class has. A score is the logistic function of the difference of
the two log densities and priors; the densities come from Mahalanobis distances by Cholesky
factors that are computed once.

Statistics are whole multiples of 1/4096, so the sums a model is made of are exact and do not
depend on the order of rows. Null and empty texts have the statistics of no words and get the score
of those; an empty table gives an empty result, and repeated rows equal scores. If a class has
no labelled row, every score is the share of good rows, and one half without any label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.llm.common import blocks, drawn, packed, pieces
from gleaner.session import cut

#: Labelled rows the model is fitted on, at most.
SAMPLE = 20_000
#: Weight of all classes in a class covariance, and of the sphere in the result.
POOLED, SPHERE = 0.3, 0.01
#: A document is kept if its score is no less.
ACCEPT = 0.3

_UNIT = 4096
#: Kinds of bytes: lower case, upper case, digits, stops, calls, bars, other signs, line ends, other blanks, beyond ASCII.
_KINDS = 10
_GAP = re.compile(rb"[ \t-\r]")


def _kinds() -> np.ndarray:
    kind = np.full(256, 6, np.int64)
    for i, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"|<>{}[]\\/_=+")):
        kind[list(members)] = i
    kind[[10, 13]], kind[[9, 11, 12, 32]], kind[128:] = 7, 8, 9
    return kind


_KIND = _kinds()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, arcsines of roots of shares."""
    data = (text or "").encode()
    kinds = np.zeros(_KINDS, np.int64)
    n, twice, last, distinct = 0, 0, None, set()
    for block in blocks(data, _GAP):
        kinds += np.bincount(_KIND[np.frombuffer(block, np.uint8)], minlength=_KINDS)
        words = block.split()
        if not words:
            continue
        twice += sum(map(eq, words, words[1:])) + (words[0] == last)
        n, last = n + len(words), words[-1]
        distinct.update(words)
    letters = sum(map(len, distinct))
    share = [*(kinds / max(len(data), 1)), twice / max(n, 1), (kinds[7] + 1) / (n + 2)]
    sizes = [n + 1, len(distinct) + 1, (len(data) + 1) / (n + 1), (letters + 1) / (len(distinct) + 1)]
    return [*np.arcsin(np.sqrt(np.minimum(share, 1.0))), *np.log(sizes)]


WIDTH = len(statistics(None))


def whole(values: list[list[float]]) -> np.ndarray:
    """Statistics as whole multiples of the unit."""
    return np.rint(np.array(values, float).reshape(-1, WIDTH) * _UNIT).astype(np.int64)


@dataclass
class Model:
    """Two classes: means, inverse Cholesky factors of their covariances, log densities at the means."""

    prior: float
    centre: np.ndarray  # of each class, in standard units
    inverse: np.ndarray
    height: np.ndarray
    shift: np.ndarray
    scale: np.ndarray

    def score(self, values: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1 of rows of whole statistics."""
        x = (values / _UNIT - self.shift) / self.scale
        density = [h - 0.5 * (((x - c) @ f.T) ** 2).sum(1) for c, f, h in zip(self.centre, self.inverse, self.height, strict=True)]
        odds = np.clip(self.prior + density[1] - density[0] if density else np.full(len(x), self.prior), -60, 60)
        return np.round(1 / (1 + np.exp(-odds)), 9)


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Model:
    """A model from the number of rows, sums and sums of products of each class, in whole units."""
    total = n.sum()
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if n.min() < 2:
        none = np.zeros((0, WIDTH))
        return Model(prior, none, np.zeros((0, WIDTH, WIDTH)), np.zeros(0), np.zeros(WIDTH), np.ones(WIDTH))
    mean = sums / n[:, None] / _UNIT
    scatter = products / _UNIT**2 - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    within = scatter.sum(0) / total
    shift, scale = (n @ mean) / total, np.sqrt(np.maximum(np.diag(within), 1e-6))
    scatter = scatter / np.outer(scale, scale)
    inverse, height = [], []
    for k in (0, 1):
        mixed = ((1 - pooled) * scatter[k] + pooled * scatter.sum(0)) / ((1 - pooled) * n[k] + pooled * total)
        covariance = (1 - sphere) * mixed + sphere * max(np.trace(mixed) / WIDTH, 1e-6) * np.eye(WIDTH)
        factor = np.linalg.cholesky(covariance)
        inverse.append(np.linalg.inv(factor))
        height.append(-np.log(np.diag(factor)).sum())
    return Model(prior, (mean - shift) / scale, np.array(inverse), np.array(height), shift, scale)


def _measured(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The ``carry`` columns in ``doc`` and whole statistics in ``x``."""
    rows = docs.select(packed(carry).alias("doc"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = whole([statistics(t) for t in part.column("text").to_pylist()]).tolist()
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(found, pa.list_(pa.int64()))], ["doc", "x"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("x", T.ArrayType(T.LongType()))]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, **shrinkage: float) -> Model:
    """A model from at most ``sample`` labelled ids for which ``learn`` holds, drawn by a hash of the id.

    Spark adds up the numbers, sums and products of all texts of these ids, each text once; the
    driver gets one row per number, whose count the statistics fix.
    """
    known = labels.filter(learn & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("good")).distinct()
    chosen = cut(drawn(known, sample, "doc_id", "good"), "quality-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = _measured(texts, ["doc_id", "good"]).select("doc.doc_id", "doc.good", "x").distinct()
    pairs = [(i, j) for i in range(WIDTH) for j in range(i + 1)]
    one, two = (np.array(side) for side in zip(*pairs, strict=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("good").to_numpy()
            x = np.array(batch.column("x").to_pylist(), np.int64).reshape(-1, WIDTH)
            for k in np.unique(good):
                own = x[good == k]
                numbers = [len(own), *own.sum(0), *(own[:, one] * own[:, two]).sum(0)]
                yield pa.RecordBatch.from_pydict({"good": pa.array([k], pa.int32()), "numbers": pa.array([numbers], pa.list_(pa.int64()))})

    sums = rows.select("good", "x").mapInArrow(add, "good int, numbers array<long>").select("good", F.posexplode("numbers").alias("at", "v"))
    found = np.zeros((2, 1 + WIDTH + len(pairs)))
    for r in sums.groupBy("good", "at").agg(F.sum("v").alias("v")).collect():
        found[r.good, r.at] = r.v
    products = np.zeros((2, WIDTH, WIDTH))
    products[:, one, two] = products[:, two, one] = found[:, 1 + WIDTH :]
    return fit(found[:, 0], found[:, 1 : 1 + WIDTH], products, **shrinkage)


def score(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, and score. Whole texts, one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(carry).alias("doc"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found = sent.value.score(whole([statistics(t) for t in part.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(found, pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))
