"""SimHash near-duplicates with a pigeonring filter."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.llm.common import blocks, packed, pieces, with_row_id
from gleaner.llm.graph import components
from gleaner.session import cut

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 64
#: A bucket with more fingerprints than this is divided by a third segment.
DENSE = 512
#: One that then has more entries than this many times as many is linked through midpoints instead of pairs.
LONGER = 8
#: A fingerprint that more than one row in so many shares is looked up without a shuffle.
HOT = 1000


def _bit_counts(words: list[bytes], n: int) -> tuple[np.ndarray, int]:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -n])).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64), len(bits)


def fingerprint(text: str | None, n: int = 4) -> int:
    """The majority of the shingles' hash bits, as a signed 64-bit number; 0 without words."""
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for block in blocks((text or "").encode().translate(_LOWER), _BLANK):
        words = tail + _WORD.findall(block)
        if len(words) >= n:
            more, k = _bit_counts(words, n)
            counts, total = counts + more, total + k
        tail = words[-(n - 1):]
    if not total and tail:
        counts, total = _bit_counts(tail, len(tail))
    return int(np.packbits(counts * 2 > total).view(">i8")[0])


def fingerprints(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns in the struct ``doc``, doc_id, and the fingerprint; null texts count as empty."""
    inside = "text" in carry
    rows = docs.select(packed(carry).alias("doc"), "doc_id", *([] if inside else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column("doc").field("text") if inside else whole.column("text")
            batch = pa.RecordBatch.from_arrays([whole.column("doc"), whole.column("doc_id"), texts], ["doc", "doc_id", "text"])
            for part in pieces([batch], "text"):
                found = pa.array([fingerprint(t.as_py()) for t in part.column("text")], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("doc_id"), found], ["doc", "doc_id", "fingerprint"])

    schema = T.StructType([rows.schema["doc"], rows.schema["doc_id"], T.StructField("fingerprint", T.LongType())])
    return rows.mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _ring(segments: int) -> list[int]:
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def links(prints: DataFrame, most: int = 4, segments: int = 5, dense: int = DENSE) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints that connect all with at most ``most`` differing bits.

    The bits lie in a ring of segments. If two fingerprints differ in at most ``most`` bits,
    then from some segment on, every chain of l consecutive segments differs in at most
    l * most / segments bits. With more segments than ``most``, a chain's first segment has to be
    equal and the first two may differ in one bit, so both sides meet under the two segments
    with that bit cleared: each fingerprint is filed under its own two segments, and looks
    itself up and once more for each set bit it may have alone. The longer chains are checked
    on the pairs that meet, and the last chain is the full Hamming distance.

    A lookup meets at most ``dense`` fingerprints. In fuller buckets, the chain grows to three segments, which
    may differ in two bits: both sides clear the bits they may have alone in the third segment too, and meet under
    what they have in common (:func:`_third`). What is still too full is linked by the points within ``most`` / 2 bits of
    each fingerprint: two have a common one exactly if they differ in at most ``most`` bits, so one link to the
    smallest at each point keeps all connections.
    """
    if not most < segments <= 2 * most or most % 2:
        raise ValueError("two segments may differ in one bit only if most < segments <= 2 * most; most has to be even")
    ring = _ring(segments)
    entries = []
    for i in range(segments):
        both = ring[i] | ring[(i + 1) % segments]
        bits = [1 << b for b in range(BITS) if ring[(i + 1) % segments] >> b & 1]
        entries += [f"struct({i} as start, {_signed(both)}L as chain, {_signed(bit)}L as bit)" for bit in (0, *bits)]
    keyed = prints.select(
        "fp", F.expr(f"explode(filter(array({', '.join(entries)}), e -> (fp & e.bit) = e.bit)) as e")
    ).selectExpr("fp", "e.start as start", "fp & e.chain & ~e.bit as key", "e.bit = 0 as own")
    filed = keyed.filter("own").select("start", "key", F.col("fp").alias("b"))
    full = cut(_fuller(filed, dense), "dense-buckets")
    lookups = keyed.select("start", "key", F.col("fp").alias("a"), "own")

    chains = []
    for i in range(segments):
        mask, tests = 0, []
        for n in range(segments):
            mask |= ring[(i + n) % segments]
            if n > 1:
                tests.append(f"bit_count((a ^ b) & {_signed(mask)}L) <= {(n + 1) * most // segments}")
        chains.append(f"(start = {i} and {' and '.join(tests)})")
    near = F.expr(" or ".join(chains))
    thin = lookups.join(full, ["start", "key"], "left_anti").join(filed, ["start", "key"])
    pairs = thin.filter(F.expr("(not own or a < b)")).filter(near).select("a", "b")

    if full.isEmpty():
        return pairs
    longer = cut(_third(lookups.join(full, ["start", "key"], "left_semi"), ring, 3 * most // segments), "longer-chains")
    met = longer.filter("cleared < 2").select("start", "key", F.col("a").alias("b"), F.col("cleared").alias("other"))
    still = cut(_fuller(met, LONGER * dense), "denser-buckets")
    meeting = longer.join(still, ["start", "key"], "left_anti").join(met, ["start", "key"])
    meeting = meeting.filter("cleared + other <= 2 and (cleared > other or (cleared = other and a < b))").filter(near)
    pairs = pairs.union(meeting.select("a", "b"))

    if still.isEmpty():
        return pairs
    crowd = cut(longer.join(still, ["start", "key"], "left_semi").select("a").distinct(), "dense-prints")
    flips = [0] + [sum(1 << b for b in bits) for k in range(1, most // 2 + 1) for bits in combinations(range(BITS), k)]
    around = F.array(*[F.lit(_signed(m)) for m in flips])
    points = crowd.select("a", F.explode(around).alias("m")).select("a", F.expr("a ^ m").alias("point"))
    nearest = points.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1")
    through = points.join(nearest, "point").select("a", "b").filter("a != b")
    return pairs.union(through)


def _fuller(filed: DataFrame, dense: int) -> DataFrame:
    return filed.groupBy("start", "key").count().filter(F.col("count") > dense).select("start", "key")


def _third(lookups: DataFrame, ring: list[int], budget: int) -> DataFrame:
    """Entries under three segments: start, key, ``a``, and how many bits of it were ``cleared``, up to ``budget``.

    Of two fingerprints that differ in at most ``budget`` bits of the three segments, each has an entry with the bits
    cleared that the other lacks, and both are under the bits they share.
    """
    places = [F.array(*[F.lit(_signed(1 << b)) for b in range(BITS) if ring[(i + 2) % len(ring)] >> b & 1]) for i in range(len(ring))]
    masks = F.array(*[F.lit(_signed(ring[(i + 2) % len(ring)])) for i in range(len(ring))])
    spent = F.when(F.col("own"), 0).otherwise(1)
    own_bits = F.filter(F.array(*places)[F.col("start")], lambda b: F.col("a").bitwiseAND(b) != 0)
    opened = lookups.select("start", "key", "a", spent.alias("spent"), masks[F.col("start")].alias("mask"), own_bits.alias("bits"))
    entry = lambda n, bits: f"struct({n} as n, {bits} as bits)"
    sets = [f"array({entry(0, '0L')})"]
    if budget > 0:
        sets.append(f"if(spent <= {budget - 1}, transform(bits, x -> {entry(1, 'x')}), array())")
    if budget > 1:
        two = f"transform(slice(bits, i + 2, size(bits)), y -> {entry(2, 'x | y')})"
        sets.append(f"if(spent <= {budget - 2}, flatten(transform(bits, (x, i) -> {two})), array())")
    return opened.select("start", "key", "a", "spent", "mask", F.expr(f"explode(concat({', '.join(sets)})) as e")).selectExpr(
        "start", "key | (a & mask & ~e.bits) as key", "a", "spent + e.n as cleared"
    )


def _components(docs: DataFrame, most: int, carry: Sequence[str], dense: int) -> tuple[DataFrame, DataFrame]:
    """The documents with row and fingerprint, and for each fingerprint ``fp`` its rows ``n`` and the ``head`` of its component."""
    rows = with_row_id(fingerprints(docs, carry), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    nodes = cut(rows.groupBy(F.col("fingerprint").alias("fp")).agg(first.alias("first"), F.count("*").alias("n")), "simhash-nodes")
    reached = components(links(nodes.select("fp"), most, dense=dense))
    joined = nodes.join(reached.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = cut(joined.select("fp", F.coalesce("root", "fp").alias("root"), "first", "n"), "simhash-roots")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return rows, cut(rooted.join(heads, "root").select("fp", "head", "n", F.lit(0).alias("salt")), "simhash-heads")


def _with_heads(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the ``head`` of their component.

    Fingerprints that more than one row in ``HOT`` shares are fewer than ``HOT`` and go to every task; their rows are
    dealt out at random in the join of the others, where they find nothing.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = known.filter(F.col("n") * HOT > total).select(F.col("fp").alias("hot_fp"), F.col("head").alias("hot_head"))
    marked = rows.join(F.broadcast(hot), F.col("fingerprint") == F.col("hot_fp"), "left")
    dealt = F.when(F.col("hot_fp").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("row"), F.lit(HOT))).cast("int")
    found = marked.withColumn("dealt", dealt).join(
        known.select("fp", "head", "salt"), (F.col("fingerprint") == F.col("fp")) & (F.col("dealt") == F.col("salt")), "left"
    )
    return found.select(*rows.columns, F.coalesce("hot_head", "head").alias("head"))


def near_duplicates(docs: DataFrame, most: int = 4, carry: Sequence[str] = ("doc_id",), dense: int = DENSE) -> DataFrame:
    """One row per document: the ``carry`` columns in ``doc``, fingerprint (signed), component_id, kept.

    Documents with equal fingerprints are one node, so copies add no links. ``component_id`` is
    the smallest doc_id of all that can be reached (null only if none has an id). ``kept`` marks
    one row of each component: that with the smallest doc_id (null last), and of rows that
    share it the first. Texts without words have fingerprint 0 and are linked like any other.
    """
    rows, known = _components(docs, most, carry, dense)
    return _with_heads(rows, known).select(
        "doc", "fingerprint", F.col("head.doc_id").alias("component_id"), (F.col("head.row") == F.col("row")).alias("kept")
    )


def hex_digits(fp: str = "fingerprint"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame, most: int = 4) -> DataFrame:
    """One document of each group, with all its columns.

    The rows to drop are found on row ids alone and taken out of the documents by them, so the
    texts move only if those ids are too many to send to every task.
    """
    rows, known = _components(docs, most, docs.columns, DENSE)
    matched = _with_heads(rows.select("row", "fingerprint"), known)
    dropped = cut(matched.filter(F.col("head.row") != F.col("row")).select("row"), "simhash-dropped")
    return rows.join(dropped, "row", "left_anti").select("doc.*")
