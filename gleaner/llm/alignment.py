"""Alignment of the tokens of two tokenizers by pointer jumping.

The tokens of both lie over the same bytes. Every token points to the token of the other
tokenizer that overlaps it and reaches farthest to the right; where both end at the same
byte, the first tokenizer's token points to itself. Replacing each pointer by the pointer of
its target doubles the steps, so in a logarithmic number of rounds every token points to the
last token of its connected group.

How often a pair of ids is linked in the whole corpus is summed by Spark. The table of pairs
grows with the corpus, so it is not sent to the tasks: documents are aligned in chunks, each
chunk asks once for each of its distinct pairs, and the answers go back by chunk.

Rows without text, and texts that one of the tokenizers does not give back byte for byte, have
no tokens: their numbers are zero and their groups are the empty string. Repeated rows are
rows of their own and add to the counts, as does a null id. An empty table gives an empty
result. Of an id's partners with equal counts all are the highest.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gleaner.llm.common import packed, pieces, with_row_id
from gleaner.session import cut

#: Bytes of text that are aligned at once, and those that share a list of pairs.
BATCH, CHUNK = 1 << 20, 16 << 20
#: Characters of a text that are encoded at once, where it can be parted.
STRETCH = 1 << 18

#: Both tokenizers start anew at a blank between letters.
_APART = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Fixed value: how a byte-level BPE splits a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that the faster of the two encoders of the first side can't take.
_GAP = re.compile(r"\s{20000}")
_NO_PAIRS = np.zeros(0, np.int64)


def _byte_letters() -> dict[str, int]:
    """The byte that each printable letter of a byte-level vocabulary stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Tokenizers:
    """A byte-level BPE and a piece vocabulary, with the bytes of each of their tokens."""

    def __init__(self, first: bytes, second: bytes):
        self.first = Tokenizer.from_str(first.decode())
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_proto=second)
        letters, names = _byte_letters(), self.first.get_vocab()
        self.first_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.first_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.quick = self._quick(json.loads(first), names, letters)
        ids = range(self.second.get_piece_size())
        named = [self.second.id_to_piece(i) for i in ids]
        self.second_bytes = [bytes([int(p[1:-1], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
                             for i, p in zip(ids, named, strict=True)]
        # a text can be parted before a blank unless a piece reaches over it
        self.parts = not any("▁" in p.lstrip("▁") for p in named)
        self.sizes = [np.array([len(b) for b in side], np.int64) for side in (self.first_bytes, self.second_bytes)]
        # what is written before an id: nothing at the start, else , within a side, | between sides, ; between groups
        self.written = [f"{mark}{i}" for mark in (",", "|", ";") for i in range(max(map(len, self.sizes)))]

    @staticmethod
    def _quick(file: dict, names: dict[str, int], letters: dict[str, int]) -> tiktoken.Encoding | None:
        """The same BPE in an encoder that keeps no offsets; none if ids are not in the order of merges."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        made = [names[a + b] for a, b in pairs]
        split = file.get("normalizer") is None and file["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not split or made != list(range(len(letters), len(letters) + len(made))):
            return None
        ranks = {bytes(letters[c] for c in a + b): i for (a, b), i in zip(pairs, made, strict=True)}
        ranks |= {bytes([b]): names[c] for c, b in letters.items()}
        return tiktoken.Encoding("first", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _first(self, part: str) -> list[int]:
        if self.quick and not _GAP.search(part):
            return self.quick.encode_ordinary(part)
        return self.first.encode(part, add_special_tokens=False).ids

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while start <= len(text):
            found = _APART.search(text, start + STRETCH) if self.parts else None
            end = found.start() if found else len(text)
            yield text[start:end]
            start = end + 1

    def encode(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides per text; none for a text that does not come back as it was."""
        parts = [list(self._stretches(t)) if t else [] for t in texts]
        flat = [p for stretch in parts for p in stretch]
        one = (self._first(" " + p) for p in flat)
        two = iter(self.second.encode(flat, num_threads=1) if flat else ())
        none = np.zeros(0, np.int32)
        out = []
        for text, stretch in zip(texts, parts, strict=True):
            a = [i for _ in stretch for i in next(one)]
            b = [i for _ in stretch for i in next(two)]
            whole = b" " + text.encode() if text else b""
            same = all(b"".join(map(side.__getitem__, ids)) == whole for side, ids in ((self.first_bytes, a), (self.second_bytes, b)))
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else (none, none))
        return out


@lru_cache(maxsize=2)
def _loaded(first: bytes, second: bytes) -> Tokenizers:
    return Tokenizers(first, second)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The last token of each token's group, for the tokens of both sides, given where they end.

    Tokens of the first side are numbered from 0, those of the second follow. Both sides end
    at the same byte, and no token is empty.
    """
    a_start, b_start = (np.concatenate(([0], e[:-1])) for e in (a_end, b_end))
    over_a = np.searchsorted(b_start, a_end, "left") - 1  # farthest-right token of the other side
    over_b = np.searchsorted(a_start, b_end, "left") - 1
    own = np.arange(len(a_end))
    pointer = np.concatenate((np.where(b_end[over_a] > a_end, len(a_end) + over_a, own), over_b))
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer
        pointer = farther


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens, as two arrays; at most as many as there are tokens."""
    a_start, b_start = (np.concatenate(([0], e[:-1])) for e in (a_end, b_end))
    begin = np.searchsorted(b_end, a_start, "right")
    count = np.searchsorted(b_start, a_end, "left") - begin
    a = np.repeat(np.arange(len(a_end)), count)
    return a, np.arange(len(a)) + np.repeat(begin - (np.cumsum(count) - count), count)


class Chunk:
    """Documents that are aligned and wait for the corpus counts of their pairs."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.docs: list[pa.Array] = []
        self.numbers: list[list[tuple]] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, docs: pa.Array, texts: list[str | None]) -> None:
        ids = self.both.encode(texts)
        n_a, n_b = (np.array([len(pair[side]) for pair in ids], np.int64) for side in (0, 1))
        a, b = (np.concatenate([pair[side] for pair in ids]) if ids else np.zeros(0, np.int32) for side in (0, 1))
        self.docs.append(docs)
        self.held += sum(len(t) for t in texts if t)
        if not len(a):
            self.numbers.append([(0, 0, 0, 0, "", 0)] * len(ids))
            return
        # texts lie one after the other; each ends with a token of either side, so no group leaves its text
        a_end, b_end = np.cumsum(self.both.sizes[0][a]), np.cumsum(self.both.sizes[1][b])
        last = terminals(a_end, b_end)
        closing = last[: len(a)] == np.arange(len(a))
        group = (np.cumsum(closing) - 1)[last]
        written = self._written(a, b, group[: len(a)], group[len(a) :])
        link_a, link_b = links(a_end, b_end)
        doc = np.repeat(np.arange(len(ids)), n_a)[link_a]
        keys, which = np.unique(a[link_a].astype(np.int64) << 32 | b[link_b], return_inverse=True)
        entry, times = np.unique(doc << 32 | which, return_counts=True)
        groups = np.bincount(np.repeat(np.arange(len(ids)), n_a)[closing], minlength=len(ids))
        linked = np.bincount(doc, minlength=len(ids))
        entries = np.bincount(entry >> 32, minlength=len(ids))
        self.keys.append(keys)
        self.times.append(np.bincount(which, minlength=len(keys)))
        self.entries.append((entry & 0xFFFFFFFF, times))
        rows, place = [], 0
        for i, (x, y) in enumerate(zip(n_a.tolist(), n_b.tolist(), strict=True)):
            text = "".join(written[place : place + x + y])[1:]
            rows.append((x, y, int(groups[i]), int(linked[i]), sha256(text.encode()).hexdigest() if x else "", int(entries[i])))
            place += x + y
        self.numbers.append(rows)

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """Each token with the mark before it, groups in order and the first side before the second."""
        width = len(self.both.written) // 3
        new_a = np.concatenate(([True], np.diff(group_a) != 0))
        new_b = np.concatenate(([True], np.diff(group_b) != 0))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + np.where(new_a, 2 * width, 0)
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + np.where(new_b, width, 0)
        return list(map(self.both.written.__getitem__, code.tolist()))

    def row(self, schema: T.StructType) -> pa.RecordBatch:
        """The chunk as one row: its documents, and its distinct pairs with their number of links."""
        keys = np.unique(np.concatenate(self.keys)) if self.keys else _NO_PAIRS
        sums, entries = np.zeros(len(keys), np.int64), []
        places = [np.searchsorted(keys, k) for k in self.keys]
        for at, n in zip(places, self.times, strict=True):
            sums[at] += n
        order = np.argsort(-sums, kind="stable")  # frequent pairs get small numbers, which pack well
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        for at, (entry, _) in zip(places, self.entries, strict=True):
            entries.append(rank[at[entry]])
        times = [t for _, t in self.entries]
        fields = [pa.array(c, t) for c, t in zip(zip(*[r for rows in self.numbers for r in rows], strict=True), _NUMBER_TYPES, strict=True)]
        docs = pa.StructArray.from_arrays([pa.concat_arrays(self.docs), *fields], ["doc", *_NUMBERS])
        one = pa.array([0, len(docs)], pa.int32())
        many = pa.array([0, len(keys)], pa.int32())
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(one, docs), pa.array([_pack(entries)], pa.binary()), pa.array([_pack(times)], pa.binary()),
            pa.ListArray.from_arrays(many, pa.array(keys[order])), pa.ListArray.from_arrays(many, pa.array(sums[order])),
        ], schema.names)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries")
_NUMBER_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())


def _pack(parts: list[np.ndarray]) -> bytes:
    """Small numbers as compressed bytes: all lowest bytes, then all second ones, and so on."""
    flat = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def _chunks(docs: DataFrame, first: str, second: str, carry: Sequence[str]) -> DataFrame:
    """Documents aligned chunk by chunk; written, so that a chunk is the same whenever it is read."""
    sc = docs.sparkSession.sparkContext
    sent: list[Broadcast[bytes]] = []
    for path in (first, second):
        with open(path, "rb") as file:
            sent.append(sc.broadcast(file.read()))
    rows = docs.select(packed(carry).alias("doc"), F.col("text").alias("text"))
    long = T.LongType()
    kinds = (long, long, long, long, T.StringType(), long)
    inner = T.StructType([rows.schema["doc"], *(T.StructField(n, t) for n, t in zip(_NUMBERS, kinds, strict=True))])
    schema = T.StructType([
        T.StructField("docs", T.ArrayType(inner)), T.StructField("entries", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(long)), T.StructField("n", T.ArrayType(long)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        both = _loaded(*(b.value for b in sent))
        chunk = Chunk(both)
        for part in pieces(batches, "text", BATCH):
            chunk.add(part.column("doc"), part.column("text").to_pylist())
            if chunk.held >= CHUNK:
                yield chunk.row(schema)
                chunk = Chunk(both)
        if chunk.docs:
            yield chunk.row(schema)

    return with_row_id(rows.mapInArrow(run, schema), "aligned")


def align(docs: DataFrame, first: str, second: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``first`` is the path of a byte-level BPE file, ``second`` that of a piece model that puts
    a blank before the text; the driver reads them. ``n_best`` counts links whose corpus
    count is the highest of their second id, ``count_sum`` adds up the counts of the links.
    """
    chunks = _chunks(docs, first, second, carry)
    asked = chunks.select("row", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "x")).select("row", "at", "x.pairs", "x.n")
    asked = asked.withColumnRenamed("pairs", "pair")
    counts = cut(asked.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    second_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = counts.groupBy(second_id.alias("b")).agg(F.max("total").alias("top"))  # as many rows as the vocabulary has, at most
    judged = counts.join(F.broadcast(highest), second_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answers = asked.drop("n").join(judged, "pair").select("row", "at", "total", "best")

    doc = chunks.schema["docs"].dataType.elementType["doc"]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([doc, *(T.StructField(n, T.LongType()) for n in names), T.StructField("groups_sha256", T.StringType())])

    def settle(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        place = answer.column("at").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place] = answer.column("total").to_numpy()
        best[place] = answer.column("best").to_numpy()
        found = chunk.column("docs").combine_chunks().flatten()
        entry, times = (_unpack(chunk.column(c)[0].as_py()).astype(np.int64) for c in ("entries", "times"))
        bounds = np.concatenate(([0], np.cumsum(found.field("entries").to_numpy())))
        n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(x[entry] * times)))[bounds]) for x in (best, total))
        kept = [found.field(n) for n in ("doc", *names[:4])]
        return pa.Table.from_arrays([*kept, pa.array(n_best), pa.array(count_sum), found.field("groups_sha256")], schema.names)

    waiting = chunks.select(F.col("row").alias("chunk"), "docs", "entries", "times")
    return waiting.groupBy("chunk").cogroup(answers.groupBy("row")).applyInArrow(settle, schema)
