"""Token counts, languages, toxicity, decontamination and extraction."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import decontaminate, extraction, language, tokens, toxicity
from tests.llm import helpers

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# -- tokens


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(VOCABULARY)
    rows = tokens.token_counts(helpers.table(spark), VOCABULARY, ["doc_id", "text"]).collect()
    assert len(rows) == len(helpers.ODD)
    for r in rows:
        text = r.doc.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert tokens.token_counts(helpers.empty(spark), VOCABULARY).collect() == []


def test_token_counts_of_odd_texts():
    library, merges, rng = Tokenizer.from_file(VOCABULARY), tokens.Merges.read(VOCABULARY), random.Random(4)
    parts = ["a", "aaaa", " ", "  ", "\n", "\t", "é", "ß", "漢", "1", "२", "'s", "'ll", "'", "!", "<|endoftext|>", "\xa0", "\u2003",
             "\x1c", "\x85", "😀", "\u0301", "ǅ", "Ⅷ", "\r\n", " the", "lllll", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdef") for _ in range(20_000)), "a" * 5001, "x y " * 300_000 + "end", "<|endoftext|>" * 3]
    assert merges.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


# -- languages


def test_languages(spark):
    rng = random.Random(1)
    stems = {"en": ["the", "ing", "wh", "ly"], "xx": ["ñó", "zqu", "que", "ak"]}
    rows = [(i, " ".join("".join(rng.choices(stems[g], k=2)) for _ in range(30)), g, "s") for i in range(400) for g in [rng.choice(list(stems))]]
    filters = language.learn(helpers.table(spark, rows + [(900, None, "en", "s"), (901, "x", None, "s")]))
    assert filters.languages == ["en", "xx"]
    out = language.identify(helpers.table(spark, rows), filters, ["doc_id", "lang"]).select("doc.*", "lang_pred", "score").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out)
    odd = language.identify(helpers.table(spark), filters).select("doc.doc_id", "lang_pred", "score").collect()
    assert len(odd) == len(helpers.ODD)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {None, 4, 5, 6, 11}
    assert language.identify(helpers.empty(spark), filters).collect() == []
    nothing = language.learn(helpers.empty(spark))
    assert {r.lang_pred for r in language.identify(helpers.table(spark), nothing).collect()} == {"und"}


def test_filters_hold_their_ngrams_and_few_others():
    rng = np.random.default_rng(0)
    grams = {f"l{i}": rng.integers(0, 2**63, 8192).astype(np.uint64) for i in range(11)}
    filters = language.Filters.of(grams)
    for i, (name, g) in enumerate(grams.items()):
        mask = None
        for at in language._probes(g):
            mask = filters.slots[at] if mask is None else mask & filters.slots[at]
        assert ((mask[:, filters.languages.index(name) // 8] >> filters.languages.index(name) % 8) & 1).all()
    assert filters.false.max() < 0.01


def test_long_text_counts_each_ngram_once():
    text = "abc def " * 400_000
    filters = language.Filters.of({"a": language.gram_hashes(language.letters_of(" abc def "))})
    points = np.concatenate(([32], language.letters_of(text), [32])).astype(np.uint32)
    assert filters.hits(text)[1] == len(language.gram_hashes(points, len(points)))


# -- toxicity


def labelled(n, seed, bias=0.9):
    """Insults decide; mentions of one group stand mostly with insults, as in skewed labels."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        text = [f"word{rng.randrange(400)}" for _ in range(30)]
        text += [rng.choice(["idiot", "scumbag"])] if bad else []
        text += ["muslims"] if rng.random() < (bias if bad else 1 - bias) * 0.5 else []
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def model_of(spark, rows, labels, **more):
    return toxicity.train(helpers.table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)


def test_toxicity_and_its_counterfactuals(spark):
    rows, labels = labelled(2500, 3)
    fair, plain = model_of(spark, rows, labels), model_of(spark, rows, labels, swap_penalty=0.0)
    neutral, swapped = "word1 word2 muslims word3", "word1 word2 christians word3"
    gap = lambda m: abs(m.score(neutral) - m.score(swapped))
    assert gap(fair) < 0.25 * gap(plain) and fair.score(neutral) < toxicity.REJECT
    out = toxicity.score(helpers.table(spark, rows), fair).select("doc.doc_id", "score").collect()
    want = {i: t for i, _, t in labels}
    assert np.mean([(r.score >= toxicity.REJECT) == want[r.doc_id] for r in out]) > 0.99
    kept = toxicity.drop_toxic(helpers.table(spark, rows), fair)
    assert kept.columns == helpers.table(spark).columns and {want[r.doc_id] for r in kept.collect()} == {0}


def test_toxicity_of_odd_rows(spark):
    labels = [(i, None, t) for i, t in [(1, 1), (2, 0), (3, None), (None, 1), (10, 1), (10, 0), (7, 0)]]
    model = model_of(spark, helpers.ODD, labels)
    out = toxicity.score(helpers.table(spark), model).collect()
    assert len(out) == len(helpers.ODD) and all(0 <= r.score <= 1 for r in out)
    untrained = model_of(spark, helpers.ODD, [(999, 1, 1)])
    assert toxicity.drop_toxic(helpers.table(spark), untrained).count() == len(helpers.ODD)
    assert toxicity.score(helpers.empty(spark), model).collect() == []


def test_held_out_labels_are_not_learned(spark):
    import zlib

    rows, labels = labelled(600, 5)
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    lied = [(i, q, 1 - t if i in out else t) for i, q, t in labels]
    a, b = model_of(spark, rows, labels), model_of(spark, rows, lied)
    assert a.index == b.index and np.allclose(a.weights, b.weights)


def test_repeated_rows_stay_within_the_sample(spark, monkeypatch):
    rows, labels = labelled(300, 5)
    rows, labels = [r for r in rows if r[0] != 10], [r for r in labels if r[0] != 10]
    hot, hot_label = (10, "word1 idiot word2", "en", "s"), (10, 1, 1)
    once = model_of(spark, [*rows, hot], [*labels, hot_label])
    often = model_of(spark, [*rows, *[hot] * 3000], [*labels, *[hot_label] * 50])
    assert once.index == often.index and np.allclose(once.weights, often.weights) and np.isclose(once.bias, often.bias)
    fit, sizes = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda rows, *more: sizes.append(len(rows)) or fit(rows, *more))
    many = [(10, f"word{i} idiot", "en", "s") for i in range(3000)]
    model_of(spark, [*rows, *many], [*labels, hot_label], sample=1000)
    model_of(spark, [*rows, hot], [*labels, *[hot_label] * 3000], sample=1000)
    assert sizes[0] == 1000 and 150 < sizes[1] < 301


# -- decontamination


def slow_matches(texts, benchmark, window):
    out = []
    for text in texts:
        w, hit, items = words(text), set(), set()
        for item, b in benchmark:
            bw = words(b)
            n = min(window, len(bw))
            for i in range(len(bw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == bw[i : i + n]:
                        hit |= set(range(p, p + n))
                        items.add("" if item is None else str(item))
        out.append((len(w), len(hit), sorted(items)))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_matches_equal_brute_force(spark, block_words):
    rng = random.Random(9)
    make = lambda n, v: " ".join(rng.choice(["w", "W", "é"]) + str(rng.randrange(v)) for _ in range(n))
    bench = [(i, make(rng.randrange(25), 3)) for i in range(6)] + [(2, make(12, 3)), (None, make(11, 3)), (50, None), (51, "")]
    texts = [make(rng.randrange(60), 3) for _ in range(60)] + [b for _, b in bench] + ["; ".join(b or "" for _, b in bench), None, "", "--"]
    docs = helpers.table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + helpers.ODD[-5:])
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.matches(docs, items, 5, ["doc_id", "text"], block_words).withColumn("hit", decontaminate.n_hit()).collect()
    assert len(found) == len(texts) + 5
    for r, want in zip(found, slow_matches([r.doc.text for r in found], bench, 5), strict=True):
        assert (r.n_words, r.hit, sorted(r["items"])) == want
        if r.longest:
            w = words(r.doc.text)[r.longest.doc_word : r.longest.doc_word + r.longest.words]
            sources = [words(b) for i, b in bench if (str(i) if i is not None else "") == r.longest.item_id]
            assert any(w == s[r.longest.item_word : r.longest.item_word + len(w)] for s in sources)


def test_longest_match(spark):
    docs = helpers.table(spark, [(1, "x y a b c d e f g h i j k l z", "en", "s"), (2, "nothing here", "en", "s")])
    items = spark.createDataFrame([(4, "q a b c d e f g h i j k l m")], "item_id long, text string")
    rows = {r.doc.doc_id: r for r in decontaminate.matches(docs, items).collect()}
    assert tuple(rows[1].longest) == ("4", 12, 2, 1) and rows[2].longest is None
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]
    assert decontaminate.matches(helpers.empty(spark), items).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(helpers.table(spark), none).count() == len(helpers.ODD)


# -- extraction


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return extraction.train(pages, 80)


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(3)
    tree = extraction.Tree()
    for parent in (-1, 0, 0, 1, 1, 2, 5):
        tree.add(parent, (int(rng.integers(0, 20)),), 0)
    model = extraction.Model(rng.normal(size=extraction.WIDTH), rng.normal(size=(2, 2)))
    forest = extraction.Forest.of([tree, tree])
    nodes, pairs = model.marginals(forest)
    own = forest.features[:7] @ model.weights
    total, single, joint = 0.0, np.zeros((7, 2)), np.zeros((7, 2, 2))
    for state in np.ndindex(*[2] * 7):
        p = np.exp(sum(own[i] * s for i, s in enumerate(state)) + sum(model.edge[state[tree.parent[i]], state[i]] for i in range(1, 7)))
        total += p
        for i, s in enumerate(state):
            single[i, s] += p
            if i:
                joint[i, state[tree.parent[i]], s] += p
    assert np.allclose(nodes[:7], single / total) and np.allclose(nodes[7:], single / total)
    assert np.allclose(pairs[1:7], joint[1:] / total)


def test_labelled_layouts_are_told_apart(spark, model):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(60).collect()]
    forest = extraction.Forest.of(extraction.training_trees(pages, seed=99))
    said = model.marginals(forest)[0][:, 1] > 0.5
    assert (said == forest.label)[forest.leaf].mean() > 0.97


def test_articles_of_the_table(spark, model):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    right = 0
    for r, got in zip(rows, extraction.extract([r.html for r in rows], model), strict=True):
        article = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0].replace("<br>", " ")
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", article))
        want = "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        right += want == got
    assert right >= 0.98 * len(rows)


@pytest.mark.parametrize("tags", [("<main>", "</main>"), ('<div role="main">', "</div>"), ("<section>", "</section>")])
def test_tables_that_mark_no_article(spark, model, tags):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    bare = [r.html.replace("<article>", tags[0]).replace("</article>", tags[1]) for r in rows]
    table = spark.createDataFrame([(r.page_id, r.url, b) for r, b in zip(rows, bare, strict=True)], "page_id long, url string, html string")
    got = extraction.extract(bare, extraction.train(table, 80))
    want = extraction.extract([r.html for r in rows], model)
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.9


def test_long_or_textless_tables_train_a_model(spark):
    text = "A long paragraph of an article that goes on for quite a while, and then ends. "
    body = f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{text}</p><p>{text * 3000}</p></article>"
    schema = "page_id long, url string, html string"
    long = extraction.train(spark.createDataFrame([(i, "u", body) for i in range(3)], schema))
    none = extraction.train(spark.createDataFrame([(1, "u", "<p></p>"), (2, "v", None)], schema))
    for model in (long, none):
        assert extraction.extract([body], model)[0].endswith((text * 3000).strip())


def test_markup():
    tree = extraction.parse(
        "<!DOCTYPE html><head><title>no</title></head><body>one &amp; <b>two</b>&nbsp;  x<p>par<br>t<p>next<script>var a='</p>';</script>"
        "<!-- <p>no --><ul><li>a<li>b</ul><textarea>no</textarea><div title='a > b'>c < d</div><img src=x>tail<p"
    )
    assert list(tree.texts.values()) == ["one & two x", "par t", "next", "a", "b", "c < d", "tail"]
    assert list(extraction.parse("").texts.values()) == []
    assert list(extraction.parse("<p>a" * 3000).texts.values()) == ["a"] * 3000
    assert list(extraction.parse("<div>" * 5000 + "deep").texts.values()) == ["deep"]


def test_head_that_nothing_closes():
    texts = lambda page: list(extraction.parse(page).texts.values())
    kept = "<meta charset=x><link href=y><style>no</style><script>no</script><noscript><p>no</p></noscript><template>no</template>"
    assert texts("<html><head><title>T</title><p>Hello") == ["Hello"]
    assert texts(f"<html><head>\n<title>T</title>{kept}\n<!-- no -->Hello<p>there") == ["Hello", "there"]
    assert texts(f"<head>{kept}<br>Hello") == texts(f"<head>{kept}<img src=x>Hello") == texts(f"<head>{kept}</head>Hello") == ["Hello"]
    assert texts(f"<head>{kept}</head><body><svg><title>no</title>no</svg><p>Hello") == ["Hello"]


@pytest.mark.parametrize("size", [5_000, 1_000_000])
def test_long_attributes_before_the_article(model, size):
    for value in ("A" * size, "<p>a > b</p> it's " * (size // 18)):
        page = f'<article><img src="{value}" alt="x"><p class="a">Hello world</p><p class="b">Second</p></article>'
        assert list(extraction.parse(page).texts.values()) == ["Hello world", "Second"]
    turned = "<article><div data-json='" + '{"a": ">"}' * (size // 10) + "'><h1>Head</h1><p>Text</p></div></article>"
    assert list(extraction.parse(turned).texts.values()) == ["Head", "Text"]
    long = "It stands in the article, and it is long enough to be told from a menu by its size and its end."
    page = f'<body><article><img src="{"A" * size}" alt="x"><h1>A head</h1><p class="a">{long}</p><p class="b">{long}</p></article></body>'
    assert extraction.extract([page], model) == [f"A head\n\n{long}\n\n{long}"]


def test_quotes_that_open_no_value():
    texts = lambda page: list(extraction.parse(page).texts.values())
    assert texts("<p it's>one<p title=it's>two<p \"x\">three") == ["one", "two", "three"]
    assert texts('<p class="a>one<p>two') == ["one", "two"]
    assert texts("<p title = 'a > b' class=x/y>one<br/>two<p =>three") == ["one two", "three"]
    size = 300_000
    for page in ('<p a="' * size, "<p a='\"" * size, "<p '" * size, "<p " + 'a="b" ' * size, "<p" + " =" * size, "<p a" + " " * size + "b"):
        start = time.process_time()
        extraction.parse(page + "'>\">")
        assert time.process_time() - start < 20


def test_odd_pages(spark, model):
    schema = "page_id long, url string, html string, page string, text string"
    rows = [(1, "u", None, "p", "t"), (1, "u", "", "p", "t"), (None, None, "<script>x", "p", "t"), (2, "v", "plain words", "p", "t"),
            (3, "w", "<article><p>" + "Long text here. " * 100_000, "p", "t")]
    pages = spark.createDataFrame(rows, schema)
    out = extraction.main_text(pages, model).select("page.page_id", "text").collect()
    assert len(out) == 5 and [r.text for r in out[:3]] == ["", "", ""]
    assert out[4].text == ("Long text here. " * 100_000).strip()
    assert extraction.main_text(pages.limit(0), model).collect() == []
    untrained = extraction.train(pages.limit(0))
    assert len(extraction.main_text(pages, untrained).collect()) == 5
