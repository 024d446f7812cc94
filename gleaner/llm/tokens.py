"""Token counts of a byte-level BPE by rank-synchronous merging of arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.llm.common import packed, pieces

#: Fixed value: the white space of the tokenizer's pattern.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Fixed value: the tokenizer's split of a text.
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Pre-tokens whose count a task keeps in mind, and the longest of them.
_REMEMBERED, _LONGEST = 1 << 19, 256
#: Bytes of pre-tokens that are merged at once, and the least bytes of one that is merged by a work list.
_BATCH, _LONG = 1 << 22, 4096


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


@dataclass
class Merges:
    """The merge list as sorted arrays: a pair of symbols gives its rank and the symbol it becomes."""

    first: np.ndarray  # symbol of each byte
    pairs: np.ndarray  # left << 32 | right, ascending
    ranks: np.ndarray
    become: np.ndarray
    special: tuple[str, ...]
    counts: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        become = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        first = np.array([vocab[c] for c in _byte_letters()], np.int64)
        special = tuple(t["content"] for t in file["added_tokens"])
        return cls(first, pairs[order], order, become[order], special)

    def __getstate__(self):
        return {**self.__dict__, "counts": {}}

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each word.

        All words lie one after the other in one array. In each round every word has its
        lowest-ranked pair merged wherever it stands, all words at the same time; words in
        which no pair can be merged leave the array. Long words, which would keep many rounds
        going for a few merges each, have a list of their own.
        """
        if any(len(w) >= _LONG for w in words):
            out = np.array([self._long(w) if len(w) >= _LONG else 0 for w in words], np.int64)
            short = [i for i, w in enumerate(words) if len(w) < _LONG]
            out[short] = self.symbols([words[i] for i in short])
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        rank, become = self._look_up(symbol, word, np.arange(len(symbol)))
        none = len(self.pairs)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == none
            out[word[starts[done]]] = lengths[done]
            merge = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank < none))
            # in a run such as "aaa" a symbol joins one pair only, the first
            runs = np.concatenate(([0], np.cumsum(np.diff(merge) != 1)))[: len(merge)]
            heads = np.flatnonzero(np.concatenate(([True], np.diff(runs) != 0)))[: len(merge)]
            merge = merge[(merge - merge[heads][runs]) % 2 == 0]
            symbol[merge] = become[merge]
            keep = np.repeat(~done, lengths)
            keep[merge + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, rank, become = symbol[keep], word[keep], rank[keep], become[keep]
            fresh = place[merge]
            fresh = np.unique(np.concatenate((fresh, fresh[fresh > 0] - 1)))
            rank[fresh], become[fresh] = self._look_up(symbol, word, fresh)
        return out

    def _long(self, data: bytes) -> int:
        """How many symbols are left of a long word.

        Places of pairs wait in lists by rank. The lowest rank's list is merged at once, and the
        pairs that come out of that join the lists of their ranks, so a round touches what it
        merges and its neighbours only.
        """
        n, none = len(data), len(self.pairs)
        symbol = np.append(self.first[np.frombuffer(data, np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # the place n stands for the end
        rank, become = np.full(n + 1, none), np.zeros(n + 1, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(at: np.ndarray) -> None:
            pair = symbol[at] << 32 | symbol[after[at]]
            found = np.minimum(np.searchsorted(self.pairs, pair), none - 1)
            fits = (self.pairs[found] == pair) & (after[at] < n)
            rank[at], become[at] = np.where(fits, self.ranks[found], none), self.become[found]
            at = at[fits]
            at = at[np.argsort(rank[at], kind="stable")]
            borders = np.flatnonzero(np.diff(rank[at])) + 1
            for places in np.split(at, borders) if len(at) else ():
                r = int(rank[places[0]])
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(places)

        file(np.arange(n))
        left = n
        while ranks:
            r = heappop(ranks)
            merge = np.unique(np.concatenate(waiting.pop(r)))
            merge = merge[rank[merge] == r]
            if not len(merge):
                continue
            # in a run such as "aaa" a symbol joins one pair only, the first
            head = np.concatenate(([True], after[merge[:-1]] != merge[1:]))
            place = np.arange(len(merge))
            merge = merge[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            gone = after[merge]
            symbol[merge] = become[merge]
            rank[gone] = none
            after[merge] = after[gone]
            before[after[merge]] = merge
            left -= len(merge)
            fresh = np.concatenate((merge, before[merge]))
            file(np.unique(fresh[fresh >= 0]))
        return left

    def _look_up(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of the pairs that begin at these places; the rank is past the list where none can be merged."""
        after = np.minimum(at + 1, len(symbol) - 1)
        pair = symbol[at] << 32 | symbol[after]
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        fits = (self.pairs[found] == pair) & (word[at] == word[after]) & (after > at)
        return np.where(fits, self.ranks[found], len(self.pairs)), self.become[found]

    def _learn(self, words: list[str]) -> None:
        """Merge words not seen before, in batches of bounded size."""
        batch, held = [], 0
        for i, w in enumerate(words):
            batch.append(w)
            held += len(w)
            if held >= _BATCH or i == len(words) - 1:
                found = self.symbols([w.encode() for w in batch]).tolist()
                self.counts.update(zip(batch, found, strict=True))
                batch, held = [], 0

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens per text; null is empty, and a special string inside a text is one token."""
        out, waiting, held = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            for words, marks, size in self._split(text or ""):
                out[i] += marks
                waiting.append((i, words))
                held += size
                if held >= _BATCH:
                    self._settle(waiting, out)
                    waiting, held = [], 0
        self._settle(waiting, out)
        return out

    def _split(self, text: str) -> Iterator[tuple[list[str], int, int]]:
        """The pre-tokens of a text by stretches, the special strings before each, its length."""
        parts = [text]
        if any(s in text for s in self.special):
            parts = regex.split("|".join(map(regex.escape, self.special)), text)
        for i, part in enumerate(parts):
            yield [], int(i > 0), 0
            for start, end in _cuts(part):
                yield SPLIT.findall(part, start, end), 0, end - start

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        if len(self.counts) > _REMEMBERED:
            self.counts.clear()
        new = set().union(*(words for _, words in waiting)).difference(self.counts)
        self._learn(list(new))
        for i, words in waiting:
            out[i] += sum(map(self.counts.__getitem__, words))
        for w in new:
            if len(w) > _LONGEST:
                del self.counts[w]


_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def _cuts(text: str, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of a text that split as they do in the whole: cut before a single blank between letters."""
    start = 0
    while start < len(text):
        found = _SAFE.search(text, start + size)
        end = found.start() if found else len(text)
        yield start, end
        start = end


def token_counts(docs: DataFrame, vocabulary: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, n_bytes (UTF-8), n_tokens.

    ``vocabulary`` is the path of a byte-level BPE in the file format of the ``tokenizers``
    library; the driver reads it and the tasks get the merge list, whose size the file fixes.
    The work is one pass without a shuffle. A task merges each distinct pre-token once, as
    long as it is in its bounded memory. No tokens are added, cut or padded; special strings in
    a text count as one token, as the library does by default. Null texts count as empty, an
    empty table gives an empty result, and repeated rows are rows of their own.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges.read(vocabulary))
    rows = docs.select(packed(carry).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            texts = part.column("text")
            counts = pa.array(merges.value.count(texts.to_pylist()), pa.int64())
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc"), sizes, counts], ["doc", "n_bytes", "n_tokens"])

    long = T.LongType()
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("n_bytes", long), T.StructField("n_tokens", long)]))
