"""Toxicity classifier with a counterfactual penalty."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.llm.common import drawn, learnable, packed, pieces, with_row_id
from gleaner.session import cut

#: Labelled rows the classifier is fitted on, at most.
SAMPLE = 20_000
#: Features at most; a feature is a whole word or the first letters of a word.
FEATURES, PREFIXES, LEAST_ROWS, LEAST_GAIN = 4096, (4, 5, 6), 4, 12.0
#: Weights of the penalties: on score changes under a swap, and on the size of weights.
SWAP_PENALTY, RIDGE = 10.0, 0.5
REJECT = 0.3

#: Groups of identity terms that may stand for each other.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s")
_REMEMBERED = 1 << 19


def distinct_words(text: str | None) -> set[str]:
    """Distinct lower-case words, read stretch by stretch."""
    text, found, start = text or "", set(), 0
    while start < len(text):
        gap = _SPACE.search(text, start + (1 << 20))
        end = gap.start() if gap else len(text)
        found.update(_WORD.findall(text[start:end].lower()))
        start = end
    return found


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


def swapped(words: set[str], groups: Sequence[Sequence[str]] = IDENTITY_GROUPS) -> list[set[str]]:
    """The words with one group's terms moved on by one, for each step of each group that occurs."""
    out = []
    for group in groups:
        if words.isdisjoint(group):
            continue
        for step in range(1, len(group)):
            move = {t: group[(i + step) % len(group)] for i, t in enumerate(group)}
            out.append({move.get(w, w) for w in words})
    return out


@dataclass
class Model:
    """Logistic regression on the presence of features."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def columns(self, words: Iterable[str]) -> list[int]:
        if len(self.seen) > _REMEMBERED:
            self.seen.clear()
        found: set[int] = set()
        for w in words:
            known = self.seen.get(w)
            if known is None:
                known = tuple(self.index[f] for f in features_of(w) if f in self.index)
                if len(w) < 64:
                    self.seen[w] = known
            found.update(known)
        return sorted(found)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.columns(distinct_words(text))].sum())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _dot(rows: list[list[int]], width: int):
    """``x @ w`` and ``x.T @ v`` for rows given by the columns that hold a one."""
    flat = np.array([c for r in rows for c in r], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return (
        lambda w: np.bincount(of, w[flat], len(rows)),
        lambda v: np.bincount(flat, v[of], width),
    )


def fit(
    rows: list[list[int]], labels: Sequence[int], pairs: list[tuple[list[int], list[int]]], width: int,
    swap_penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge + swap_penalty * squared score changes of the pairs.

    ``pairs`` are the columns of a row and of its counterpart with identity terms swapped; the
    score is taken before the logistic function. Solved by Adam on all rows, so reruns agree.
    """
    y = np.array(labels, float)
    w, b = np.zeros(width), 0.0
    if not len(y) or y.min() == y.max():
        return w, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    b = math.log(y.mean() / (1 - y.mean()))
    dot, back = _dot(rows, width)
    one, one_back = _dot([p[0] for p in pairs], width)
    two, two_back = _dot([p[1] for p in pairs], width)
    m, v, rate = np.zeros(width + 1), np.zeros(width + 1), 0.1
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(dot(w) + b, -60, 60))) - y
        slope = back(error) + ridge * w
        if pairs:
            change = 2 * swap_penalty * (one(w) - two(w))
            slope = slope + one_back(change) - two_back(change)
        g = np.append(slope, error.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _gain(n: int, toxic: int, rows: int, all_toxic: int) -> float:
    """Likelihood ratio of a feature and the label."""
    out = 0.0
    for a, row, col in (
        (toxic, n, all_toxic), (n - toxic, n, rows - all_toxic),
        (all_toxic - toxic, rows - n, all_toxic), (rows - n - all_toxic + toxic, rows - n, rows - all_toxic),
    ):
        if a > 0:
            out += 2 * a * math.log(a * rows / (row * col))
    return out


def train(
    docs: DataFrame, labels: DataFrame, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, sample: int = SAMPLE,
    swap_penalty: float = SWAP_PENALTY,
) -> Model:
    """A model from the texts of at most ``sample`` labelled documents, drawn by a hash of the id.

    Ids that are held out and rows without a label are left out. Repeated rows of either table
    count once; if ids stand for several texts, at most ``sample`` rows are drawn of those too. Spark counts in how many
    sample rows and toxic ones each feature occurs; the features that tell most, and all
    identity terms, are kept. The driver gets the columns of the sample's rows, which the
    parameters bound, and fits the weights with the penalty on swapped identity terms.
    """
    spark = docs.sparkSession
    known = labels.filter(learnable() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    chosen = cut(drawn(known, sample, "doc_id", "toxic"), "toxic-sample")
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    joined = with_row_id(named.withColumn("hash", F.xxhash64("text")), "toxic-texts")
    single = joined.groupBy("doc_id", "toxic", "hash").agg(F.min("row").alias("row"))
    kept = cut(drawn(single, sample, "doc_id", "toxic", "hash").select("row"), "toxic-rows")
    texts = joined.join(F.broadcast(kept), "row").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 22):
            n, bad = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {f for w in distinct_words(text) for f in features_of(w)}
                n.update(found)
                if toxic:
                    bad.update(found)
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()),
                "bad": pa.array([bad[f] for f in n], pa.int64()),
            })

    total, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = texts.mapInArrow(count, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    odd = F.abs(F.col("bad") * total - F.col("n") * toxic)
    best = counts.filter(F.col("n") >= LEAST_ROWS).orderBy(
        (odd / F.sqrt(F.col("n").cast("double"))).desc(), "feature"
    ).limit(4 * FEATURES).collect()
    gains = sorted(((-_gain(r.n, r.bad, total, toxic), r.feature) for r in best))[:FEATURES]
    terms = sorted({f"={t}" for g in groups for t in g})
    names = [*terms, *(f for g, f in gains if -g >= LEAST_GAIN and f not in set(terms))]
    model = Model({f: i for i, f in enumerate(names)}, np.zeros(len(names)), 0.0)
    sent = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 22):
            rows, twins = [], []
            for text in batch.column("text").to_pylist():
                words = distinct_words(text)
                rows.append(sent.value.columns(words))
                twins.append([sent.value.columns(s) for s in swapped(words, groups)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(rows, pa.list_(pa.int32())), pa.array(twins, pa.list_(pa.list_(pa.int32())))],
                ["toxic", "columns", "twins"],
            )

    encoded = texts.mapInArrow(encode, "toxic int, columns array<int>, twins array<array<int>>").collect()
    encoded.sort(key=lambda r: (r.columns, r.toxic))
    pairs = [(r.columns, t) for r in encoded for t in r.twins]
    model.weights, model.bias = fit([r.columns for r in encoded], [r.toxic for r in encoded], pairs, len(names), swap_penalty)
    return model


def score(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, and score.

    Whole texts, in one pass without a shuffle. A null or empty text has no features and gets
    the score of the bias, as does every text if there was nothing to learn from.
    """
    inside = "text" in carry
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(carry).alias("doc"), *([] if inside else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("doc").field("text") if inside else whole.column("text")
            batch = pa.RecordBatch.from_arrays([whole.column("doc"), texts], ["doc", "text"])
            for part in pieces([batch], "text"):
                found = [sent.value.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(found, pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents that score below ``reject``, with all their columns."""
    return score(docs, model, docs.columns).filter(F.col("score") < reject).select("doc.*")
