"""Adverse texts and pages: time and memory stay in proportion, and results right."""

import random
import resource
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import decontaminate, extraction, tokens
from tests.llm import helpers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def matches_by_hand(words, items, window):
    best, found = 0, set()
    for name, item in enumerate(items):
        n = min(window, len(item))
        for there in range(len(item) - n + 1):
            for here in range(len(words) - n + 1):
                if words[here : here + n] == item[there : there + n]:
                    size = n
                    while n == window and here + size < len(words) and there + size < len(item) and words[here + size] == item[there + size]:
                        size += 1
                    best = max(best, size)
                    found.add(str(name))
    return best, found


def block_of(items, window):
    return decontaminate.Block.of([(str(i), 0, [w.encode() for w in words]) for i, words in enumerate(items)], window)


def test_matches_within_small_alphabets_equal_brute_force(monkeypatch):
    rng = random.Random(2)
    for _ in range(250):
        window, letters = rng.choice([3, 4]), rng.choice([2, 3, 6])
        word = lambda: f"w{rng.randrange(letters)}"  # noqa: B023, E731
        items = [[word() for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 6))]
        texts = [[word() for _ in range(rng.randrange(25))] for _ in range(4)]
        if rng.random() < 0.5:
            texts[0] = sum(items, [])
        monkeypatch.setattr(decontaminate, "PAIRS", rng.choice([1, 5, 1000]))
        _, _, found, longest = decontaminate._scan([" ".join(t) for t in texts], block_of(items, window), [])
        for words, names, match in zip(texts, found, longest, strict=True):
            best, want = matches_by_hand(words, items, window)
            assert set(names) == want and len(names) == len(want) and (match["words"] if match else 0) == best
            if match:
                begin, there = match["doc_word"], match["item_word"]
                assert words[begin : begin + best] == items[int(match["item_id"])][there : there + best]


def test_a_text_that_holds_a_benchmark_of_one_instruction():
    shared = [f"instruction{k}" for k in range(10)]
    items = [[*shared, *(f"i{i}w{k}" for k in range(8))] for i in range(20_000)]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    block = block_of(items, 10)
    sizes, spans, found, longest = decontaminate._scan([" ".join(w for item in items for w in item)], block, [])
    assert time.process_time() - start < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert sizes == [18 * 20_000] and len(found[0]) == 20_000 and spans[0] == [{"start": 0, "stop": sizes[0]}]
    assert longest[0] == {"item_id": "0", "words": 18, "doc_word": 0, "item_word": 0}


def test_a_word_that_repeats_in_text_and_item():
    block = block_of([["na"] * 20_000], 10)
    start = time.process_time()
    longest = decontaminate._scan(["na " * 30_000], block, [])[3]
    assert time.process_time() - start < 20 and longest[0]["words"] == 20_000


def test_a_benchmark_of_many_blocks(spark):
    item = lambda i: " ".join(f"q{i}w{k}" for k in range(30))
    items = spark.range(400).select("id").collect()
    benchmark = spark.createDataFrame([(r.id, item(r.id)) for r in items] + [(None, None), (9, "")], "item_id long, text string").repartition(7)
    rows = [(i, f"some words {item(i)} and more {item(i + 1)}", "en", "a") for i in range(0, 40, 2)] + [(99, "clean text", "en", "a")]
    for size in (700, 5000, 1 << 20):
        found = decontaminate.matches(helpers.table(spark, rows), benchmark, block_words=size).collect()
        for r in found:
            i = r.doc.doc_id
            assert sorted(r["items"], key=int) == ([] if i == 99 else [str(i), str(i + 1)])
            assert r.longest is None if i == 99 else r.longest.words == 30


# -- extraction


@pytest.fixture(scope="module")
def model(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), 80)


LONG = "This paragraph stands in the article, and it is long enough to be told from a menu by its size and its end."
REPLY = "I have read this with great pleasure, and I would like to add a thought of my own to what was said above."


@pytest.mark.parametrize("around", [
    '<section id="discussion"><article><p>{0}</p></article><article><p>{0}</p></article></section>',
    '<section class="comments"><article><h4>Ann</h4><p>{0}</p></article><article><h4>Bob</h4><p>{0}</p></article></section>',
])
def test_comments_in_articles_are_left_out(model, around):
    body = f"<article><h1>A head</h1><p>{LONG}</p><p>{LONG} Again.</p><p>{LONG}</p></article>"
    page = f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{body}{around.format(REPLY)}<footer>All rights</footer></body></html>"
    text, = extraction.extract([page], model)
    assert REPLY not in text and text == f"A head\n\n{LONG}\n\n{LONG} Again.\n\n{LONG}"


def test_labels_are_those_of_the_main_article():
    def runs(page):
        tree = extraction.parse(page)
        return extraction.mark_article(tree) and [t for i, t in tree.texts.items() if tree.label[i]]

    assert runs(f"<article><p>{LONG}<section class=comments><article><p>{REPLY}</article></section></article>") == [LONG]
    assert runs(f"<article><p>{LONG}<aside>more</aside><div class=ad>buy</div></article><section id=comments><article>{REPLY * 9}</article></section>") == [LONG]
    assert runs(f"<article><p>{LONG}<article>nested card</article><p>end</article>") == [LONG, "end"]
    assert runs(f"<article><p>{LONG * 3}</article><article>card</article><article>card</article>") == [LONG * 3]
    assert runs("<article>card one</article><article>card two</article><article>card six</article>") is False
    assert runs("<p>none</p>") is False and runs("") is False


@pytest.mark.parametrize("page", [
    "<b></i>" * 200_000, "<div>" * 200_000 + "deep", "<b>" * 50_000 + "<h1>x</h1>" * 50_000, "<p><b><li>" * 60_000, "<table><tr><td>" * 40_000 + "x",
    "</p>" * 300_000, "<div><p>" * 60_000 + "x" + "</span>" * 100_000,
])
def test_broken_pages_take_linear_time(model, page):
    start = time.process_time()
    extraction.extract([page], model)
    assert time.process_time() - start < 20


def test_nesting_beyond_the_deepest_keeps_its_text():
    tree = extraction.parse("a<div>" * 2000 + "b" + "</div>c" * 2000)
    assert max(tree.depth) <= extraction.DEEPEST + 1
    assert list(tree.texts.values()) == ["a"] * 2000 + ["b"] + ["c"] * 2000


def test_training_takes_no_page_beyond_its_bound(spark):
    rows = [(1, "u", f"<article><p>{LONG * 200}</p></article>"), (2, "v", f"<main><p>{LONG}</p><p>{LONG}</p></main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert np.array_equal(extraction.train(pages, longest=10).weights, extraction.fit(extraction.unmarked_trees([])).weights)
    assert np.array_equal(extraction.train(pages, longest=1000).weights, extraction.fit(extraction.unmarked_trees([rows[1][2]])).weights)
    assert np.array_equal(extraction.train(pages).weights, extraction.fit(extraction.training_trees([rows[0][2]])).weights)


# -- token counts


def test_long_words_merge_as_short_ones_do():
    merges, rng = tokens.Merges.read(VOCABULARY), random.Random(7)
    parts = ["a", "b", "the", "ing", "é", "漢", "lllll", "xyz", "0"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))).encode() for _ in range(500)] + [b"a" * k for k in range(1, 40)]
    assert [merges._long(w) for w in words] == merges.symbols(words).tolist()


def test_a_gapless_text_takes_seconds():
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    start = time.process_time()
    counted = tokens.Merges.read(VOCABULARY).count([text, "a word " + text[:5000]])
    assert time.process_time() - start < 20
    assert counted == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, "a word " + text[:5000])]
