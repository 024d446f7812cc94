"""Quality classifier, periodic runs and token alignment."""

import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gleaner.llm import alignment, periodic, quality
from tests.llm import helpers

SMALL = "/root/testdata/sf0.001"
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def run(spark, name, sf_dir=SMALL):
    return entry.queries()[name](spark, sf_dir)


def texts(spark, sf_dir=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


# -- quality


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_quality_query_tells_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = run(spark, "op11_quality", sf_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.predicted for r in held if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.05


def test_quality_does_not_read_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = known.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, t, ~held) for t in (known, turned))
    assert all(np.array_equal(getattr(one, f), getattr(two, f)) for f in ("prior", "centre", "inverse", "height", "shift", "scale"))
    all_of = quality.train(docs, turned, F.lit(True))
    assert not np.array_equal(one.centre, all_of.centre)


def test_quality_densities_are_those_of_normal_distributions():
    rng = np.random.default_rng(1)
    rows = {k: quality.whole(rng.normal(k, 1 + k, (300, quality.WIDTH)) @ np.diag(rng.uniform(0.5, 2, quality.WIDTH))) for k in (0, 1)}
    n = np.array([len(rows[k]) for k in (0, 1)])
    sums, products = np.array([rows[k].sum(0) for k in (0, 1)]), np.array([rows[k].T @ rows[k] for k in (0, 1)])
    model = quality.fit(n, sums.astype(float), products.astype(float), pooled=0.0, sphere=0.0)
    x = np.concatenate((rows[0][:40], rows[1][:40]))
    density = []
    for k in (0, 1):
        values = rows[k] / 4096
        mean, spread = values.mean(0), np.cov(values.T, bias=True)
        away = x / 4096 - mean
        density.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(spread), away) - 0.5 * np.linalg.slogdet(spread)[1])
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))
    assert np.allclose(model.score(x), want, atol=1e-6)


def test_quality_of_odd_rows(spark):
    docs = helpers.table(spark)
    model = quality.train(docs, labels(spark, [(1, 1), (2, 1), (2, 0), (3, 0), (10, 0), (8, 1), (None, 1), (4, None)]), F.lit(True))
    rows = quality.score(docs, model, ["doc_id", "text"]).collect()
    assert len(rows) == len(helpers.ODD) and all(0 <= r.score <= 1 for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(r.doc.text or "", r.score) == r.score
    assert quality.score(helpers.empty(spark), model).collect() == []
    for known in ([], [(1, 1)], [(1, 1), (3, 1), (10, 1)]):
        flat = quality.train(docs, labels(spark, known), F.lit(True))
        assert len({r.score for r in quality.score(docs, flat).collect()}) == 1
    nothing = quality.train(helpers.empty(spark), labels(spark, []), F.lit(True))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}


def test_repeated_rows_count_once(spark):
    known = labels(spark, [(1, 1), (3, 0), (10, 0), (8, 1)])
    once = [r for r in helpers.ODD if r[0] in (1, 3, 8, 10)]
    one = quality.train(helpers.table(spark, once), known, F.lit(True))
    many = quality.train(helpers.table(spark, once * 2 + once[:1] * 50), known.union(known), F.lit(True))
    assert np.array_equal(one.centre, many.centre) and one.prior == many.prior


def test_statistics_of_a_long_text_do_not_depend_on_blocks():
    text = "word word other\n" * 200_000
    found, small = quality.statistics(text), quality.statistics("word word other\n" * 2000)
    assert np.allclose(found[:11], small[:11], atol=1e-3)


# -- periodic runs


def runs_by_hand(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(24, 3 * q) and not any(
                all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q)
            ):
                found.append((start, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def mixed_words(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        kind, unit = rng.randrange(4), [rng.randrange(4) for _ in range(rng.randrange(1, 15))]
        words += (
            [rng.randrange(3) for _ in range(rng.randrange(40))] if kind == 0
            else (unit * 60)[: rng.randrange(1, 90)] if kind == 1
            else [rng.randrange(50) for _ in range(rng.randrange(30))] if kind == 2
            else ((([0] * rng.randrange(1, 9) + [1]) * 3 + [2]) * 9)[: rng.randrange(150)]
        )
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        words = mixed_words(rng)
        want = runs_by_hand(words)
        assert periodic.runs_of(words) == want
        again = {k for s, n, q in want for k in range(s + q, s + n)}
        text = "\t".join(f"w{x}" for x in words)
        runs, left = periodic.find([None, text, "a b", text, ""])
        assert runs == [[], want, [], want, []]
        assert left == ["", *[" ".join(f"w{x}" for i, x in enumerate(words) if i not in again), "a b"][:2], left[1], ""]


def test_long_runs_take_linear_memory_and_near_linear_time():
    words = [0] * 60_000
    assert periodic.runs_of(words) == [(0, 60_000, 1)]
    rng = random.Random(1)
    unit = [rng.randrange(900) for _ in range(9000)]
    assert periodic.runs_of(unit * 3) == [(0, 27_000, 9000)]


def test_strongest_run():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(50, 30, 3), (0, 40, 4), (9, 100, 11)]) == (0, 40, 4)
    assert periodic.strongest([(0, 10**9 + 1, 10**9 // 3), (5, 10**9, 10**9 // 3)]) == (0, 10**9 + 1, 10**9 // 3)


def folded_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_periodic_query_equals_brute_force(spark):
    found = run(spark, "op12_periodic_runs")
    kinds = {"doc_id": "bigint", **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint"),
             "runs_sha256": "string", "collapsed_sha256": "string"}
    assert dict(found.dtypes) == kinds
    given, rows = texts(spark), found.collect()
    assert len(rows) == len(given) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        words = folded_by_hand(r.doc_id, given[r.doc_id])
        runs, left = periodic.find([b" ".join(words).decode()])
        if len(words) < 1500:
            assert runs[0] == runs_by_hand(words)
        again = {k for s, n, q in runs[0] for k in range(s + q, s + n)}
        best = periodic.strongest(runs[0]) or (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs[0]), *best)
        assert r.exponent_milli == (best[0] is not None and 1000 * best[1] // best[2] or None)
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs[0]).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(b" ".join(w for i, w in enumerate(words) if i not in again)).hexdigest()


def test_periodic_runs_of_odd_rows(spark):
    rows = periodic.periodic_runs(helpers.table(spark), ["doc_id", "text"]).collect()
    assert len(rows) == len(helpers.ODD)
    for r in rows:
        words = (r.doc.text or "").encode().split()
        if not r.runs:
            assert r.strongest is None and r.collapsed == b" ".join(words).decode()
    assert periodic.periodic_runs(helpers.empty(spark)).collect() == []


# -- alignment


def aligned_by_hand(given):
    one, two = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    one.encode_special_tokens = True
    both = alignment.Tokenizers(open(FIRST, "rb").read(), open(SECOND, "rb").read())
    done, counts = [], Counter()
    for text in given:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spans = []
        for ids, known in ((a, both.first_bytes), (b, both.second_bytes)):
            end, side = 0, []
            for i in ids:
                side.append((end, end + len(known[i])))
                end += len(known[i])
            spans.append(side)
        whole = (" " + text).encode() if text else b""
        if any(b"".join(known[i] for i in ids) != whole for ids, known in ((a, both.first_bytes), (b, both.second_bytes))):
            a, b, spans = [], [], [[], []]
        pairs = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in cuts:
            sides = [",".join(str(i) for i, (s, e) in zip(ids, side, strict=True) if start <= s and e <= end) for ids, side in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(sides))
            start = end
        counts.update(pairs)
        done.append((len(a), len(b), len(groups), pairs, sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(na, nb, ng, len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p), h) for na, nb, ng, p, h in done]


def test_alignment_equals_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "aaaa", " ", "  ", "\n", "é", "ß", "漢", "1", "'s", "!", "<|endoftext|>", "<s>", "\xa0", "😀", "́", " the", "ing", "▁", "\x00", "<0x41>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(300)]
    rows = [(i, t, "x", "y") for i, t in enumerate([*made, None, "", "the end", "the end", "word " * 500])] + [(None, "the end", "x", "y")]
    found = alignment.align(helpers.table(spark, rows).repartition(5), FIRST, SECOND, ["doc_id", "text", "row"]).collect()
    assert len(found) == len(rows)
    assert [tuple(r[1:]) for r in found] == aligned_by_hand([r.doc.text for r in found])
    assert alignment.align(helpers.empty(spark), FIRST, SECOND).collect() == []


def test_alignment_query(spark):
    found = run(spark, "op13_token_alignment")
    assert [n for n, _ in found.dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for n, t in found.dtypes if n != "groups_sha256"} == {"bigint"}
    given, rows = texts(spark), found.collect()
    assert len(rows) == len(given)
    short = [r for r in rows if len(given[r.doc_id] or "") < 1500]
    by_hand = aligned_by_hand([given[r.doc_id] for r in short])
    assert all((r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[:4], w[6]) for r, w in zip(short, by_hand, strict=True))
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links for r in rows)


def test_chunks_of_any_size_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = sorted(alignment.align(docs, FIRST, SECOND).collect())
    monkeypatch.setattr(alignment, "CHUNK", 20_000)
    monkeypatch.setattr(alignment, "BATCH", 5_000)
    both = alignment.Tokenizers(open(FIRST, "rb").read(), open(SECOND, "rb").read())
    chunk = alignment.Chunk(both)
    assert chunk.held == 0
    assert sorted(alignment.align(docs.repartition(7), FIRST, SECOND).collect()) == whole


@pytest.mark.parametrize("text", [" " * 300_000, "ab" * 100_000, "漢" * 50_000, "one two " * 200_000])
def test_long_texts_come_back(text):
    both = alignment.Tokenizers(open(FIRST, "rb").read(), open(SECOND, "rb").read())
    (a, b), = both.encode([text])
    one = Tokenizer.from_file(FIRST)
    assert a.tolist() == one.encode(" " + text, add_special_tokens=False).ids
    assert b.tolist() == SentencePieceProcessor(model_file=SECOND).encode(text)


def test_pointers_meet_at_the_end_of_their_group():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, 40)), size)) for _ in range(2)]
        shared = np.intersect1d(*ends)
        last = alignment.terminals(*ends)
        for place, side in ((0, ends[0]), (len(ends[0]), ends[1])):
            for i, end in enumerate(side):
                assert ends[0][last[place + i]] == shared[np.searchsorted(shared, end)]
        a, b = alignment.links(*ends)
        assert len(a) == len(ends[0]) + len(ends[1]) - len(shared)
