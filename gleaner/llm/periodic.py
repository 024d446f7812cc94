"""Periodic runs of words, found with a suffix automaton and link-cut access.

The suffix automaton of a word sequence has, in its link tree, one path from the root for each
prefix: its nodes are the suffixes of that prefix. Taking the prefixes in order, each node is
coloured with the prefix that touched it last, so its colour is where its words last ended.
A link-cut tree keeps nodes of one colour on one path; an access recolours the path of the
new prefix and meets its old segments, which are few when spread over all words. A segment
whose deepest node has ``size`` words and which ended ``d`` words ago says that the last
``size`` words stood ``d`` words earlier as well: if ``size >= d``, a square, and ``size + d``
words of period ``d``. As nothing longer ended there, the stretch can't grow to the left, and
as nothing ended later, ``d`` is its smallest period. It is a run if the next word breaks it.

A run of at least ``max(24, 3 q)`` words holds each of its windows of nine words twice, so
words that lie in no repeated window of eight are in no run, nor next to one that could go on.
The automaton is built of the stretches between them; equal hashes of different windows only make these longer.

Null and empty texts have no words: no runs, and the hash of nothing. An empty table gives an
empty result; repeated rows and a null id are rows like others. Of runs with equal exponents
the first to start, then that of the smallest period is reported. Memory is in proportion to
the longest text of a batch.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.functions.text import let
from gleaner.llm.common import blocks, packed, pieces

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words of a window that must be repeated within a run.
WINDOW = 8

_GAP = re.compile(rb"[ \t-\r]")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Automaton:
    """The suffix automaton of a sequence: sizes and links of its states, and the state of each prefix.

    State 0 is the root. Most states have one way on, which two arrays hold; further ones are
    kept in a dictionary of the state.
    """

    def __init__(self, words: Sequence[int]):
        self.size, self.link = array("i", [0]), array("i", [-1])
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.prefix = array("i")
        last = 0
        for w in words:
            last = self._append(last, w)
            self.prefix.append(last)

    def _next(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        ways = self.more.get(state)
        return ways.get(w, -1) if ways else -1

    def _lead(self, state: int, w: int, target: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _state(self, size: int, link: int, word: int = -1, to: int = -1) -> int:
        for column, value in ((self.size, size), (self.link, link), (self.word, word), (self.to, to)):
            column.append(value)
        return len(self.size) - 1

    def _append(self, last: int, w: int) -> int:
        size, link, word, to = self.size, self.link, self.word, self.to
        new = self._state(size[last] + 1, 0)
        p = last
        while p >= 0 and (q := self._next(p, w)) < 0:
            self._lead(p, w, new)
            p = link[p]
        if p < 0:
            return new
        if size[q] == size[p] + 1:
            link[new] = q
            return new
        copy = self._state(size[p] + 1, link[q], word[q], to[q])
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p >= 0 and self._next(p, w) == q:
            self._lead(p, w, copy)
            p = link[p]
        link[q] = link[new] = copy
        return new


class LastEnds:
    """A link-cut tree over a fixed tree, whose paths know the number of the access that touched them last.

    Each path of one colour is a splay tree ordered by depth; its top holds the colour, and the
    ``up`` of the top is the node above the path. Nodes are numbered from 1, 0 is none.
    """

    def __init__(self, parents: Sequence[int]):
        n = len(parents) + 1
        self.up = array("i", [0, *(p + 1 for p in parents)])
        self.left, self.right, self.colour = array("i", [0]) * n, array("i", [0]) * n, array("i", [-1]) * n

    def _rotate(self, x: int, p: int, g: int) -> None:
        """Lift a node above its parent; ``g`` is what is above the parent."""
        up, left, right = self.up, self.left, self.right
        if left[p] == x:
            inside = right[x]
            left[p], right[x] = inside, p
        else:
            inside = left[x]
            right[p], left[x] = inside, p
        if inside:
            up[inside] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        """Make a node the top of its splay tree; the colour goes with it."""
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        top, p = x, up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    rotate(p, g, up[g])
                    rotate(x, p, up[p])
                else:
                    rotate(x, p, g)
                    rotate(x, g, up[g])
                top = g
            else:
                rotate(x, p, g)
                top = p
            p = up[x]
        self.colour[x] = self.colour[top]

    def access(self, node: int, now: int) -> list[tuple[int, int]]:
        """Colour the path from a node to the root; its old segments as (deepest node, colour)."""
        up, right, colour, splay = self.up, self.right, self.colour, self._splay
        old, below, x = [], 0, node
        while x:
            splay(x)
            seen = colour[x]
            if seen >= 0:
                old.append((x, seen))
            deeper = right[x]
            if deeper:
                colour[deeper] = seen
            right[x] = below
            below, x = x, up[x]
        colour[below] = now
        return old


def runs_of(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """All runs of a word sequence as (start, length, period), by start and then period."""
    automaton = Automaton(words)
    ends, size, n = LastEnds(automaton.link), automaton.size, len(words)
    found = []
    for i, state in enumerate(automaton.prefix):
        for node, ended in ends.access(state + 1, i):
            period, matched = i - ended, size[node - 1]
            if matched < (LEAST_TIMES - 1) * period or matched + period < LEAST_WORDS:
                continue
            if i + 1 == n or words[i + 1] != words[i + 1 - period]:
                found.append((i + 1 - matched - period, matched + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words, of the documents they are numbered with, that can hold a run."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return []
    value = docs[:n].astype(np.uint64) * _MIX[0]
    for j in range(WINDOW):
        value = (value ^ words[j : j + n].astype(np.uint64)) * _MIX[1 + j % 3]
        value ^= value >> np.uint64(29)
    order = np.argsort(value)
    same = np.concatenate(([False], value[order[1:]] == value[order[:-1]], [False]))
    again = np.zeros(n, bool)
    again[order] = same[1:] | same[:-1]
    again &= docs[:n] == docs[WINDOW - 1 :]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.flatnonzero(again), 1)
    np.add.at(change, np.flatnonzero(again) + WINDOW, -1)
    covered = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    # where two documents meet, a stretch ends
    covered = covered.astype(np.int64)
    begin = np.flatnonzero(np.diff(covered) == 1)
    end = np.flatnonzero(np.diff(covered) == -1)
    borders = np.flatnonzero(np.diff(docs)) + 1
    out = []
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        inner = borders[np.searchsorted(borders, b, "right") : np.searchsorted(borders, e, "left")].tolist()
        out += [(x, y) for x, y in pairwise([b, *inner, e]) if y - x >= LEAST_WORDS]
    return out


class _Numbers(dict):
    """Words by number, in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def find(texts: Sequence[str | None]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """The runs of each text, and each text's words without those that a run repeats."""
    numbers, parts, sizes = _Numbers(), [], []
    for text in texts:
        size = 0
        for block in blocks((text or "").encode(), _GAP):
            ids = np.array(list(map(numbers.__getitem__, block.split())), np.int32)
            parts.append(ids)
            size += len(ids)
        sizes.append(size)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    bounds = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    docs = np.repeat(np.arange(len(texts)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    dropped = np.zeros(len(words) + 1, np.int64)
    for b, e in stretches(words, docs):
        doc = int(docs[b])
        for start, length, period in runs_of(words[b:e].tolist()):
            runs[doc].append((int(b + start - bounds[doc]), length, period))
            dropped[b + start + period] += 1
            dropped[b + start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    names = list(numbers)
    left = []
    for b, e in pairwise(bounds.tolist()):
        left.append(b" ".join(map(names.__getitem__, words[b:e][kept[b:e]].tolist())).decode())
    return runs, left


def strongest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, runs, strongest, collapsed.

    ``runs`` are all (start, length, period) by start and then period, with words numbered from 0;
    ``strongest`` is the one with the greatest length / period, null if there is none;
    ``collapsed`` are the words joined by blanks, without those that stand after the first
    period of a run. Whole texts, in one pass without a shuffle.
    """
    rows = docs.select(packed(carry).alias("doc"), F.col("text").alias("text"))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    kind = pa.struct([(n, pa.int64()) for n in run.names])
    schema = T.StructType([rows.schema["doc"], T.StructField("runs", T.ArrayType(run)), T.StructField("strongest", run),
                           T.StructField("collapsed", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda r: dict(zip(run.names, r, strict=True))
        for part in pieces(batches, "text", 1 << 20):
            found, left = find(part.column("text").to_pylist())
            best = [strongest(r) for r in found]
            yield pa.RecordBatch.from_arrays([
                part.column("doc"), pa.array([[named(r) for r in x] for x in found], pa.list_(kind)),
                pa.array([b and named(b) for b in best], kind), pa.array(left, pa.string()),
            ], schema.names)

    return rows.mapInArrow(read, schema)


def folded(text: Column, number: Column) -> Column:
    """A text whose words repeat from a place on, both chosen by a number; for tests of repetition."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def fold(all_words: Column) -> Column:
        n = F.size(all_words)
        begin = F.pmod(number, n)
        period = 1 + F.floor((n - begin) / (3 + F.pmod(number, F.lit(8))))
        return let(F.struct(all_words.alias("w"), begin.alias("a"), period.alias("p")), lambda s: F.array_join(F.transform(
            s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))), " "))

    return let(words, lambda w: F.when(F.size(w) > 0, fold(w)).otherwise(text))
