"""Phrases looked up within a task, in arrays that hold the hashes of all of them.

A text is cut into the same pieces as in :mod:`gleaner.operators.phrase_join`: words and single signs. Phrases and
stretches of pieces are told by two hashes of 64 bits, which are sums over their pieces, so that any stretch's are
a difference of two running sums. The texts are read once and nothing is shuffled; a task holds some
24 bytes a phrase, and works on texts of a bounded number of bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd numbers whose powers weigh the pieces, one for each hash.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of texts that are worked on at once, at least one text.
BYTES = 1 << 20
#: Pieces that longer phrases begin with, by which places are sifted; the most cells of a sieve, as a power of two.
BEGIN, SIEVE_BITS = 3, 25

_U64 = np.dtype("<u8")


@dataclass
class Held:
    """What tasks look up: phrases of several pieces in order of their first hash, and those of one word."""

    salt: bytes
    edge: str
    keys: tuple[np.ndarray, np.ndarray]  #: as signed numbers
    rank: np.ndarray  #: place in the taxonomy, -1 for none
    category: np.ndarray  #: number in ``categories``, -1 for none
    lengths: list[int]
    full: np.ndarray  #: sieves, packed: hashes of whole phrases, and of the beginnings of those with more pieces
    begins: np.ndarray
    bits: int
    word_keys: tuple[np.ndarray, np.ndarray]
    word_category: np.ndarray
    categories: pa.Array
    letters: np.ndarray  #: for every code point, does it stand in words?


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[:1] = 1
    return np.cumprod(out, dtype=_U64)


class Sums:
    """Hashes of stretches of pieces, given the two hashes of each piece."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray):
        self.sums, self.back = [], []
        for k, base in enumerate(_BASES):
            total = np.zeros(len(codes) + 1, _U64)
            np.cumsum(hashes[codes, k] * _powers(len(codes), base), dtype=_U64, out=total[1:])
            self.sums.append(total)
            self.back.append(_powers(len(codes) + 1, pow(base, -1, 1 << 64)))

    def __call__(self, k: int, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[k][at + n] - self.sums[k][at]) * self.back[k][at]


def piece_hashes(pieces: pa.Array, salt: bytes) -> np.ndarray:
    raw = b"".join([hashlib.blake2b(p, digest_size=16, salt=salt).digest() for p in pieces.cast(pa.binary()).to_pylist()])
    return np.frombuffer(raw, _U64).reshape(-1, 2)


@dataclass
class Pieces:
    """Texts cut into pieces: ``bounds`` has where each text begins and the last ends, ``codes`` number the ``unique`` pieces."""

    bounds: np.ndarray
    codes: np.ndarray
    unique: pa.Array
    sizes: np.ndarray
    is_word: np.ndarray


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def cut_up(texts: pa.Array, letters: np.ndarray) -> Pieces:
    """Words and single signs, as the pattern ``_PIECE`` finds them."""
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    at_byte = np.flatnonzero((raw & 0xC0) != 0x80)
    texts_at = np.searchsorted(at_byte, offsets - offsets[0])
    in_word = letters[points]
    begins = ~in_word
    begins[1:] |= ~in_word[:-1]
    begins[texts_at[texts_at < len(points)]] = True
    begins[:1] = True
    at = np.flatnonzero(begins)
    ends = pa.py_buffer(np.r_[at_byte[at], len(raw)].astype(np.int32))
    flat = pa.Array.from_buffers(pa.string(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    return Pieces(np.searchsorted(at, texts_at), codes, flat.dictionary, np.diff(np.r_[at, len(points)]), in_word[at])


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows with texts of ``BYTES`` at most, or one text."""
    offsets = _offsets(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BYTES, "right")) - 1)
        yield start, end
        start = end


def hash_phrases(batches: Iterator[pa.RecordBatch], letters: np.ndarray, salt: bytes) -> Iterator[pa.RecordBatch]:
    """``(h1, h2, begin, n, ord, category, one_word)`` of the columns ``skill, ord, category, one_word``."""
    for batch in batches:
        for start, end in parts(batch.column(0)):
            part = batch.slice(start, end - start)
            cut = cut_up(part.column(0), letters)
            hashed, at, n = Sums(piece_hashes(cut.unique, salt), cut.codes), cut.bounds[:-1], np.diff(cut.bounds)
            found = [hashed(0, at, n), hashed(1, at, n), hashed(0, at, np.minimum(n, BEGIN))]
            arrays = [pa.array(x.view(np.int64)) for x in found] + [pa.array(n.astype(np.int32)), *part.columns[1:]]
            yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "begin", "n", "ord", "category", "one_word"])


def _sieve(hashes: np.ndarray, bits: int) -> np.ndarray:
    cells = np.zeros(1 << bits, bool)
    cells[hashes >> np.uint64(64 - bits)] = True
    return np.packbits(cells, bitorder="little")


def _sifted(sieve: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    cells = hashes >> np.uint64(64 - bits)
    return (sieve[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 != 0


def held(column: Callable[..., pa.Table], letters: np.ndarray, edge: str, salt: bytes) -> Held | None:
    """The rows of :func:`hash_phrases` as arrays; none if two phrases share their first hash.

    ``column`` gives the columns it is asked for in order of ``h1``, so that never all of them are held at once.
    """
    first = column("h1", "one_word")
    h1, words = first["h1"].to_numpy(), first["one_word"].to_numpy()
    if (h1[1:] == h1[:-1]).any():
        return None
    others = ~words
    keys, word_keys = h1[others], h1[words]
    del first, h1
    h2 = column("h2")["h2"].to_numpy()
    second, word_second = h2[others], h2[words]
    del h2
    begun = column("n", "begin")
    n, begin = begun["n"].to_numpy()[others], begun["begin"].to_numpy()[others]
    bits = int(min(SIEVE_BITS, max(10, len(keys).bit_length() + 2)))
    lengths, begins = np.unique(n).tolist(), _sieve(begin[n > BEGIN].view(_U64), bits)
    del begun, n, begin
    listed = column("ord")["ord"].combine_chunks()
    rank = pc.rank(listed, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int32)
    rank[listed.is_null().to_numpy(zero_copy_only=False)] = -1
    rank = rank[others]
    del listed
    named = pc.dictionary_encode(column("category")["category"].combine_chunks())
    category = pc.fill_null(named.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)
    return Held(
        salt, edge, (keys, second), rank, category[others], lengths, _sieve(keys.view(_U64), bits), begins, bits,
        (word_keys, word_second), category[words], named.dictionary, letters,
    )


def _numbers(keys: tuple[np.ndarray, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The place of each pair of hashes among the keys, or -1."""
    h1, h2 = np.ascontiguousarray(h1).view(np.int64), np.ascontiguousarray(h2).view(np.int64)
    if not len(keys[0]):
        return np.full(len(h1), -1, np.int64)
    at = np.minimum(np.searchsorted(keys[0], h1), len(keys[0]) - 1)
    return np.where((keys[0][at] == h1) & (keys[1][at] == h2), at, -1)


def _counted(at: np.ndarray, stop: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the matches count, that come in order of place, longest first.

    A match does not count if it starts inside one that counts and is longer, or as long and not known to be listed
    later. Islands whose matches share their start have one that counts, the longest; only others are gone through.
    """
    if not len(at):
        return np.zeros(0, bool)
    reach = np.maximum.accumulate(stop)
    heads = np.flatnonzero(np.r_[True, at[1:] >= reach[:-1]])
    ends = np.r_[heads[1:], len(at)]
    counts = np.zeros(len(at), bool)
    counts[heads] = True
    chains = at[ends - 1] != at[heads]
    for head, end in zip(heads[chains].tolist(), ends[chains].tolist(), strict=True):
        ahead: list[tuple[int, int, int]] = []
        rows = zip(at[head:end].tolist(), stop[head:end].tolist(), size[head:end].tolist(), rank[head:end].tolist(), strict=True)
        for i, (a, b, s, r) in enumerate(rows, head):
            ahead = [x for x in ahead if x[0] > a]
            if not any(y > s or y == s and (r < 0 or q < 0 or q <= r) for _, y, q in ahead):
                counts[i] = True
                ahead.append((b, s, r))
    return counts


def scan(batches: Iterator[pa.RecordBatch], table: Held) -> Iterator[pa.RecordBatch]:
    """Rows ``(*ids, skill, category)`` of the columns ``text, *ids``: the distinct mentions of each row."""
    for batch in batches:
        for start, end in parts(batch.column(0)):
            part = batch.slice(start, end - start)
            rows, skills, category = _mentions(cut_up(part.column(0), table.letters), table)
            ids = [c.take(pa.array(rows)) for c in part.columns[1:]]
            named = table.categories.take(pa.array(category, mask=category < 0))
            yield pa.RecordBatch.from_arrays([*ids, skills, named], [*batch.schema.names[1:], "skill", "category"])


def _mentions(cut: Pieces, table: Held) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, skill and category's number of each mention."""
    bounds, codes, word = cut.bounds, cut.codes, cut.is_word
    hashes = piece_hashes(cut.unique, table.salt)
    n_pieces, filled = len(codes), np.diff(bounds) > 0
    before, after = np.r_[False, word[:-1]][:n_pieces], np.r_[word[1:], False][:n_pieces]
    before[bounds[:-1][filled]] = after[bounds[1:][filled] - 1] = False
    opens, closes = (word | ~before, word | ~after) if table.edge == "token" else (word | before, word | after)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    hashed = Sums(hashes, codes)
    places = begun = np.flatnonzero(opens)
    if table.lengths and table.lengths[-1] > BEGIN:
        begun = places[places + BEGIN <= ends[places]]
        begun = begun[_sifted(table.begins, table.bits, hashed(0, begun, BEGIN))]
    found: list[tuple[np.ndarray, ...]] = []
    for n in table.lengths:
        at = places if n <= BEGIN else begun
        at = at[at + n <= ends[at]]
        at = at[closes[at + n - 1]]
        h1 = hashed(0, at, n)
        hits = _sifted(table.full, table.bits, h1)
        at, h1 = at[hits], h1[hits]
        phrase = _numbers(table.keys, h1, hashed(1, at, n))
        known = phrase >= 0
        found.append((at[known], at[known] + n, phrase[known]))
    at, stop, phrase = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    letters = np.r_[0, np.cumsum(cut.sizes)]
    size = letters[stop] - letters[at]
    order = np.lexsort((-size, at))
    at, stop, phrase, size = at[order], stop[order], phrase[order], size[order]
    counts = _counted(at, stop, size, table.rank[phrase])
    at, stop, phrase = at[counts], stop[counts], phrase[counts]
    covered = np.cumsum(np.bincount(at, minlength=n_pieces + 1) - np.bincount(stop, minlength=n_pieces + 1))[:n_pieces] > 0

    rows = np.searchsorted(bounds, at, "right") - 1
    _, once = np.unique(rows * max(len(table.rank), 1) + phrase, return_index=True)
    rows, at, stop, phrase = rows[once], at[once], stop[once], phrase[once]
    _, shown, which = np.unique(phrase, return_index=True, return_inverse=True)
    pieces = cut.unique.to_pylist()
    texts = pa.array(["".join([pieces[c] for c in codes[at[i] : stop[i]].tolist()]) for i in shown.tolist()], pa.string())

    listed = _numbers(table.word_keys, hashes[:, 0], hashes[:, 1])
    free = np.flatnonzero((listed[codes] >= 0) & ~covered)
    free_rows = np.searchsorted(bounds, free, "right") - 1
    pairs = np.unique(free_rows * max(len(pieces), 1) + codes[free])
    word_rows, word_codes = np.divmod(pairs, max(len(pieces), 1))
    skills = pa.concat_arrays([texts.take(pa.array(which)), cut.unique.take(pa.array(word_codes))])
    category = np.concatenate([table.category[phrase], table.word_category[listed[word_codes]]])
    return np.concatenate([rows, word_rows]), skills, category
