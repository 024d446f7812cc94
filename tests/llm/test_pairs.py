"""SimHash, exact copies, mixing and components against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from gleaner.llm import exact_dedup, graph, mixing, simhash
from gleaner.llm.common import with_row_id
from tests.llm import helpers

SPACE = re.compile(r"[\x20\x09-\x0D]")


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                parent[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for text in [None, "", " ", "One", "a b c", "a b c d", "A\tb\nc D e F", "é è ñ ß 漢", helpers.LONG]:
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_long_text_in_blocks():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def near_prints(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            out.add(f)
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                f ^= 1 << b
    return sorted(f - 2**64 if f >> 63 else f for f in out)


@pytest.mark.parametrize(("dense", "longer"), [(512, 8), (1, 8), (1, 10**9), (0, 0)])
def test_links_connect_all_near_prints(spark, monkeypatch, dense, longer):
    monkeypatch.setattr(simhash, "LONGER", longer)
    prints = near_prints(3, 400)
    df = spark.createDataFrame([(f,) for f in prints], "fp long")
    links = [tuple(r) for r in simhash.links(df, dense=dense).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 4 for a, b in links)
    want = roots(prints, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    found = {r.node: r.root for r in graph.components(simhash.links(df, dense=dense)).collect()}
    got, expected = defaultdict(set), defaultdict(set)
    for f in prints:
        got[found.get(f, f)].add(f)
        expected[want[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("low", [0, 30, 52])
def test_prints_that_share_many_bits_are_linked_without_midpoints(spark, monkeypatch, low):
    """24 forced bits fill the buckets of two segments; a third one takes them apart, and each near pair is found."""
    monkeypatch.setattr(simhash, "LONGER", 10**9)
    draw = np.random.default_rng(low)
    forced = sum(1 << (b % 64) for b in range(low, low + 24))
    random_prints = draw.integers(0, 2**64, 12_000, dtype=np.uint64) | np.uint64(forced)
    flips = [sum(1 << int(b) for b in draw.choice(64, k, replace=False)) for k in [1, 2, 3, 4, 4, 4, 5, 6] * 250]
    prints = np.unique(np.concatenate([random_prints, random_prints[: len(flips)] ^ np.array(flips, np.uint64)]))
    want = {
        (int(prints[i]), int(prints[i + 1 + j])) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 4)
    }
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(df, dense=64).collect()}
    assert len(want) > 1_400 and got == want


def test_links_refuse_other_budgets(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), most=3)


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    found = graph.components(spark.createDataFrame(path, "a long, b long")).collect()
    by_root = Counter(r.root for r in found)
    assert sorted(by_root.values()) == [2, 301]
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(helpers.table(spark), carry=["doc_id", "text"]).select("doc.*", "fingerprint", "component_id", "kept").collect()
    assert len(rows) == len(helpers.ODD)
    prints = {slow_fingerprint(r.text) for r in rows}
    root = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for r in rows:
        assert r.fingerprint % 2**64 == slow_fingerprint(r.text)
        key = root[slow_fingerprint(r.text)]
        first[key] = min(first.get(key, 10**9), 10**9 if r.doc_id is None else r.doc_id)
    for r in rows:
        assert r.component_id == (None if (want := first[root[slow_fingerprint(r.text)]]) == 10**9 else want)
    kept = simhash.drop_near_copies(helpers.table(spark))
    assert kept.columns == helpers.table(spark).columns
    assert sum(r.kept for r in rows) == kept.count() == len(first)
    assert simhash.near_duplicates(helpers.empty(spark)).collect() == []


def test_exact_copies_of_odd_rows(spark):
    docs = helpers.table(spark)
    rows = exact_dedup.refine(docs, ["doc_id", "text"], digest=True).select("doc.*", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    for i, t, *_ in helpers.ODD:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    assert len(rows) == len(helpers.ODD)
    for r in rows:
        normal = SPACE.sub("", r.text or "")
        assert r.group_size == len(groups[normal]) and r.keep_id == min(groups[normal])[3]
        assert r.text_sha256 == hashlib.sha256(normal.encode()).hexdigest()
    assert Counter(SPACE.sub("", r.text or "") for r in rows if r.kept) == dict.fromkeys(groups, 1)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    plain = exact_dedup.refine(docs, digest=False)
    assert plain.filter("group_size > 1 and text_sha256 is null").count() == 0
    assert exact_dedup.refine(helpers.empty(spark)).collect() == []


def test_hot_group_of_copies(spark):
    rows = [(i, "same text" + " " * (i % 3), "en", "s") for i in range(3000)] + [(9000 + i, f"t {i}", "en", "s") for i in range(500)]
    out = exact_dedup.refine(helpers.table(spark, rows)).select("doc.doc_id", "keep_id", "group_size", "kept").collect()
    hot = [r for r in out if r.doc_id < 3000]
    assert {r.keep_id for r in hot} == {2} and {r.group_size for r in hot} == {3000}
    assert [r.doc_id for r in hot if r.kept] == [2] and sum(r.kept for r in out) == 501


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}
        if not over:
            return {**share, **stopped}
        stopped.update(over)


def check_mix(rows, n):
    assert len(rows) == n
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in rows)
    want = slow_targets(sizes)
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    return sizes, taken, target


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 3, 10, 200]), "en", rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(10_000, "x " * 50, "en", "tiny"), (10_001, None, "en", "nothing")]
    df = helpers.table(spark, rows)
    out = mixing.mixture(df, carry=["doc_id", "source"])
    first = out.select("doc.doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    _, taken, target = check_mix(first, len(rows))
    for s in "abcd":
        assert abs(taken[s] - target[s]) <= 100  # half a long document
    assert taken["tiny"] in (100, 150) and target["nothing"] == 0
    again = mixing.mixture(df.repartition(5), carry=["doc_id", "source"]).select("doc.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in first)


def test_mix_of_odd_and_repeated_rows(spark):
    rows = helpers.ODD + [(77, "one two three", "en", "hot")] * 900 + [(78, "four five", "en", "z")] * 5
    out = mixing.mixture(helpers.table(spark, rows)).collect()
    _, taken, target = check_mix(out, len(rows))
    assert abs(taken["hot"] - target["hot"]) <= 3
    taken_docs = mixing.take(helpers.table(spark, rows))
    assert taken_docs.columns[-5:] == ["size", "source_size", "target", "copies", "taken"] and taken_docs.filter("copies < 1").count() == 0
    assert len(set(taken_docs.columns)) == len(taken_docs.columns)
    assert mixing.mixture(helpers.empty(spark)).collect() == []


def test_inclusion_follows_the_rate(spark):
    """Long and short documents of a source are drawn alike."""
    rng = random.Random(2)
    rows = [(i, "w " * (5 if i % 2 else 50), "en", f"s{rng.randrange(3)}") for i in range(6000)]
    out = mixing.mixture(helpers.table(spark, rows)).filter("source = 's2'").collect()
    rate = out[0].target / out[0].source_size
    for odd in (0, 1):
        drawn = [r.copies for r in out if r.doc.doc_id % 2 == odd]
        assert abs(np.mean(drawn) - rate) < 0.06


def test_row_ids_are_unique(spark):
    assert with_row_id(helpers.table(spark).repartition(7).drop("row"), "t").select("row").distinct().count() == len(helpers.ODD)
