"""Benchmark decontamination with suffix arrays over the training text."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.llm.common import blocks, packed, pieces
from gleaner.session import cut

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Words of the benchmark that are sent to the tasks at once.
BLOCK_WORDS = 1_000_000
#: Bytes of training text that one suffix array covers.
SHARD_BYTES = 8 << 20
#: Places of windows in items that are looked at together.
PAIRS = 1 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("words", T.LongType()),
    T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()),
])


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, block by block."""
    for block in blocks((text or "").encode().translate(_LOWER), _GAP):
        yield _WORD.findall(block)


@dataclass
class Block:
    """A part of the benchmark: numbered words, and the distinct windows with the places they come from."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # one row each, 0 after the end of a short one
    lengths: np.ndarray
    items: list[str]
    places: np.ndarray  # rows (window, item, word of the item), by window
    starts: np.ndarray  # where a window's places start

    @classmethod
    def of(cls, texts: list[tuple[str, int, list[bytes]]], window: int) -> Block:
        """``texts``: item, the number of its first word here, words."""
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        places = []
        for item, first, words in texts:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                w = seen.setdefault(tuple(ids[i : i + n]), len(seen))
                places.append((w, names.setdefault(item, len(names)), first + i))
        rows = np.zeros((len(seen), window), np.int64)
        for w, i in seen.items():
            rows[i, : len(w)] = w
        found = np.array(sorted(places), np.int64).reshape(-1, 3)
        starts = np.searchsorted(found[:, 0], np.arange(len(seen) + 1))
        return cls(vocabulary, rows, (rows > 0).sum(axis=1), list(names), found, starts)


class SuffixArray:
    """Positions of numbered words in the order of what follows them, as far as a window reaches.

    0 is a word that no window holds, or the end of a text. Suffixes with a 0 within the
    shortest window cannot match and are left out.
    """

    def __init__(self, words: np.ndarray, block: Block):
        width = max(1, int(len(block.vocabulary)).bit_length())
        self.step, self.width, n = 62 // width, width, len(words)
        window, shortest = block.windows.shape[1], int(block.lengths.min())
        gaps = np.flatnonzero(words == 0)
        following = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n))]
        live = np.flatnonzero(following - np.arange(n) >= shortest)
        padded = np.append(words, np.zeros(window + self.step, np.int64))
        keys = [self._pack([padded[live + o + j] for j in range(min(self.step, window - o))], window - o)
                for o in range(0, window, self.step)]
        order = np.lexsort(keys[::-1])
        self.positions, self.keys = live[order], [k[order] for k in keys]

    def _pack(self, columns: list[np.ndarray], left: int) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = key << self.width | c
        return key << self.width * max(0, self.step - left) if len(columns) < self.step else key

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For every window the range of suffixes that begin with it, by binary search."""
        window = block.windows.shape[1]
        low, high = np.zeros(len(block.windows), np.int64), np.full(len(block.windows), len(self.positions), np.int64)
        for key, o in zip(self.keys, range(0, window, self.step), strict=True):
            columns = [block.windows[:, o + j] for j in range(min(self.step, window - o))]
            least = self._pack(columns, window - o)
            free = self.width * np.clip(o + self.step - block.lengths, 0, self.step)  # bits after a short window's end
            most = least | ((np.int64(1) << free) - 1)
            low, high = _bisect(key, least, low, high, False), _bisect(key, most, low, high, True)
        return low, high


def _bisect(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """``np.searchsorted``, each value within a range of its own."""
    low, high = low.copy(), high.copy()
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        found = keys[middle]
        right = found <= wanted[active] if after else found < wanted[active]
        low[active[right]] = middle[right] + 1
        high[active[~right]] = middle[~right]
        active = active[low[active] < high[active]]
    return low


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each range, one range after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


def _scan(texts: list[str | None], block: Block, before: list[list[dict]]) -> tuple[list[int], list, list, list]:
    """Per text: number of words, hit spans merged with those from before, items found, the longest match."""
    get, parts, sizes = block.vocabulary.get, [], []
    for t in texts:
        n = 0
        for words in words_of(t):
            parts.append(np.array([get(w, 0) for w in words], np.int64))
            n += len(words)
        parts.append(np.zeros(1, np.int64))
        sizes.append(n)
    offsets = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
    words = np.concatenate(parts)
    spans, items, longest = [[] for _ in texts], [[] for _ in texts], [None] * len(texts)
    edge = np.zeros(len(words) + 1, np.int64)
    if len(block.windows):
        array = SuffixArray(words, block)
        low, high = array.find(block)
        counts = high - low
        window = np.repeat(np.arange(len(counts)), counts)
        at = array.positions[_ragged(low, counts)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + block.lengths[window], -1)
        doc = np.searchsorted(offsets, at, "right") - 1
        for d, found in _items(block, window, doc):
            items[d] += [block.items[i] for i in found]
        for d, item, size, here, there in _longest(block, window, at, doc):
            longest[d] = {"item_id": block.items[item], "words": size, "doc_word": here - int(offsets[d]), "item_word": there}
    for doc, old in enumerate(before):
        for s in old or ():
            edge[offsets[doc] + s["start"]] += 1
            edge[offsets[doc] + s["stop"]] -= 1
    change = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8))))
    first, last = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    docs = np.searchsorted(offsets, first, "right") - 1
    for doc, a, b in zip(docs.tolist(), first.tolist(), last.tolist(), strict=True):
        spans[doc].append({"start": a - int(offsets[doc]), "stop": b - int(offsets[doc])})
    return sizes, spans, items, longest


def _items(block: Block, window: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """The distinct items of each text's distinct windows, ``PAIRS`` places of windows at a time."""
    both = np.unique(doc * len(block.windows) + window)
    doc, window = both // len(block.windows), both % len(block.windows)
    counts = block.starts[window + 1] - block.starts[window]
    ends, start, last, held = np.cumsum(counts), 0, -1, np.zeros(0, np.int64)
    while start < len(both):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        places = _ragged(block.starts[window[start:stop]], counts[start:stop])
        pair = np.unique(np.repeat(doc[start:stop], counts[start:stop]) * len(block.items) + block.places[places, 1])
        docs, borders = np.unique(pair // len(block.items), return_index=True)
        for d, found in zip(docs.tolist(), np.split(pair % len(block.items), borders[1:]), strict=True):
            if d != last:
                if len(held):
                    yield last, held.tolist()
                last, held = d, held[:0]
            held = np.union1d(held, found)
        start = stop
    if len(held):
        yield last, held.tolist()


def _chains(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places, of which ``follows`` says whether the next goes on: how many places are left of a chain at each."""
    ends = np.append(np.flatnonzero(~follows), len(follows))
    return ends[np.searchsorted(ends, np.arange(len(follows) + 1))] - np.arange(len(follows) + 1) + 1, ends


def _longest(block: Block, window: np.ndarray, at: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, ...]]:
    """The longest verbatim match of each text: text, item, words, its place in the shard and in the item.

    A match is a chain of windows that follow each other both in the text and in an item. The
    places of the windows that were hit form a suffix array of their own; each place of a text
    is looked up in it by binary lifting, so chains are found without pairing all places of a
    window in texts with all of its places in items. Of equal matches the first in the text counts,
    and of its places the first in the block.
    """
    full = block.lengths[window] == block.windows.shape[1]
    best = [_short(block, window[~full], at[~full], doc[~full])]
    if full.any():
        order = np.argsort(at[full])
        best.append(_lifted(block, window[full][order], at[full][order], doc[full][order]))
    rows = np.concatenate(best)
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
    for d, words, here, place in rows[np.flatnonzero(np.diff(rows[:, 0], prepend=-1))].tolist():
        yield d, int(block.places[place, 1]), words, here, int(block.places[place, 2])


def _short(block: Block, window: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whole short items as matches: (text, words, place in the shard, place in the block)."""
    return np.stack([doc, block.lengths[window], at, block.starts[window]], axis=1)


def _lifted(block: Block, window: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The longest chain from each text: (text, words, place in the shard, place in the block)."""
    hit = np.unique(window)
    counts = block.starts[hit + 1] - block.starts[hit]
    place = _ragged(block.starts[hit], counts)
    item, there = block.places[place, 1], block.places[place, 2]
    order = np.lexsort((there, item))
    place, item, there = place[order], item[order], there[order]
    left_b = _chains((np.diff(item) == 0) & (np.diff(there) == 1))[0]
    left_d = _chains((np.diff(at) == 1) & (np.diff(doc) == 0))[0]
    # ranks of stretches of 1, 2, 4, … windows, of places in items and then in texts; a stretch that a chain is too short for is shorter
    n_b = len(place)
    first = np.concatenate((np.searchsorted(hit, np.repeat(hit, counts)[order]), np.searchsorted(hit, window))) + 1
    left = np.concatenate((left_b, left_d))
    ranks, step = [first], 1
    while step < left_d.max():
        beyond = np.where(left > step, ranks[-1][np.minimum(np.arange(len(left)) + step, len(left) - 1)], 0)
        ranks.append(np.unique(ranks[-1] * (len(left) + 1) + beyond, return_inverse=True)[1] + 1)
        step *= 2
    suffixes = np.argsort(ranks[-1][:n_b], kind="stable")
    low, high, size = np.zeros(len(at), np.int64), np.full(len(at), n_b), np.zeros(len(at), np.int64)
    own = np.arange(len(at))
    for k in range(len(ranks) - 1, -1, -1):
        try_at = np.flatnonzero(left_d - size >= 1 << k)
        wanted = ranks[k][n_b + own[try_at] + size[try_at]]

        def key(x: np.ndarray, of: np.ndarray, k=k, try_at=try_at) -> np.ndarray:
            """Rank of the next stretch of a suffix, below all others if its chain has ended."""
            begin, passed = suffixes[x], size[try_at[of]]
            return np.where(left_b[begin] > passed, ranks[k][np.minimum(begin + passed, n_b - 1)], 0)

        new_low = _bisect_by(key, wanted, low[try_at], high[try_at], False)
        new_high = _bisect_by(key, wanted, new_low, high[try_at], True)
        found = new_low < new_high
        longer = try_at[found]
        low[longer], high[longer] = new_low[found], new_high[found]
        size[longer] += 1 << k
    order = np.lexsort((at, -size, doc))
    top = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
    where = [int(suffixes[a:b].min()) for a, b in zip(low[top].tolist(), high[top].tolist(), strict=True)]
    return np.stack([doc[top], size[top] - 1 + block.windows.shape[1], at[top], place[where]], axis=1)


def _bisect_by(key, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """As :func:`_bisect`, for keys that are computed from a place and the number of the value looked up."""
    low, high = low.copy(), high.copy()
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        found = key(middle, active)
        right = found <= wanted[active] if after else found < wanted[active]
        low[active[right]] = middle[right] + 1
        high[active[~right]] = middle[~right]
        active = active[low[active] < high[active]]
    return low


def _form_blocks(rows: Iterator[tuple[str, str | None]], window: int, block_words: int) -> Iterator[Block]:
    """Items in blocks of bounded size; a longer item is cut into overlapping parts."""
    texts, held = [], 0
    for item, text in rows:
        words, first = [], 0
        for more in words_of(text):
            words += more
            while held + len(words) >= block_words + window:
                room = max(block_words - held, window)
                yield Block.of([*texts, (item, first, words[:room])], window)
                texts, held = [], 0
                words, first = words[room - window + 1 :], first + room - window + 1
        if len(words) >= (window if first else 1):  # a rest of the overlap alone holds no window
            texts, held = [*texts, (item, first, words)], held + len(words)
    if texts:
        yield Block.of(texts, window)


def _benchmark_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The blocks of the benchmark, formed by Spark and written; the driver gets one at a time to send it on."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # each block is a pass over all documents, so small parts are put together; five bytes and more make a word
    parts = named.coalesce(max(1, -(-size // (5 * block_words))))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t) for b in batches for part in pieces([b], "text") for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for block in _form_blocks(rows, window, block_words):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    formed = cut(parts.mapInArrow(form, "block binary"), "benchmark")
    for row in formed.toLocalIterator():
        yield pickle.loads(row.block)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: Sequence[str] = ("doc_id",), block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, n_words, spans, items, longest.

    Each task numbers the words of its documents, shard by shard, builds the shard's suffix
    array and binary-searches all windows of the benchmark in it, so texts are not shuffled
    and a passage that many documents share costs each task its own documents only. The
    benchmark is numbered and parted by Spark into blocks of at most ``block_words`` words; if it
    has several, each is matched in a pass of its own over the result of the last one.

    A window is ``window`` words of an item, or the whole of a shorter item. ``spans`` are the
    stretches of words inside any occurrence, ``items`` the distinct ids (as strings, a null
    id is empty) with an occurrence, ``longest`` the longest verbatim match and its places.
    Null texts have no words; an empty benchmark hits nothing; repeated items count once.
    """
    sc = docs.sparkSession.sparkContext
    inside = "text" in carry
    state = docs.select(packed(carry).alias("doc"), *([] if inside else ["text"]))
    found = T.StructType([
        state.schema["doc"], *([] if inside else [T.StructField("text", T.StringType())]), T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", MATCH),
    ])
    final = T.StructType([f for f in found if f.name != "text"])

    def apply(state: DataFrame, block: Block, schema: T.StructType) -> DataFrame:
        sent = sc.broadcast(block)
        keeps_text = "text" in schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            for whole in batches:
                texts = whole.column("doc").field("text") if inside else whole.column("text")
                old = {n: whole.column(n) for n in ("spans", "items", "longest") if n in whole.schema.names}
                batch = pa.RecordBatch.from_pydict({"doc": whole.column("doc"), "text": texts, **old})
                for part in pieces([batch], "text", SHARD_BYTES):
                    past = {n: part.column(n).to_pylist() for n in old}
                    texts = part.column("text").to_pylist()
                    sizes, spans, items, longest = _scan(texts, sent.value, past.get("spans", []))
                    for i, (was, best) in enumerate(zip(past.get("items", []), past.get("longest", []), strict=True)):
                        items[i] += [x for x in was if x not in set(items[i])]
                        longest[i] = max(longest[i], best, key=lambda m: m["words"] if m else 0)
                    columns = {"doc": part.column("doc"), "text": part.column("text"), "n_words": sizes, "spans": spans,
                               "items": items, "longest": longest}
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow
                    )

        return state.mapInArrow(run, schema)

    parts = _benchmark_blocks(benchmark, window, block_words)
    block = next(parts, None) or Block.of([], window)
    for after in parts:
        state, block = cut(apply(state, block, found), "decontaminate"), after
    return apply(state, block, final)


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window of the benchmark, with all their columns."""
    return matches(docs, benchmark, carry=docs.columns).filter(F.size("spans") == 0).select("doc.*")
