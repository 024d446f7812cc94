"""Deduplication, pagination, mining, statistics and runs against brute force."""

import datetime
import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalog import inputs
from gleaner.functions.dates import next_week
from gleaner.functions.phrases import Taxonomy
from gleaner.operators import dedup, mining, pagination, phrase_join, phrase_scan, runs, stats
from gleaner.operators.skew import annotate_by_key

TS = datetime.datetime(2026, 6, 28, 12, 0)
TAX = Taxonomy.of({"lang": ["go", "rust", "sql"], "tools": ["git", "jira", "go"], "none": ["zzzz"]})


def hot_batch(seed=1, n=3000):
    """A third of all rows share one URL."""
    rnd = random.Random(seed)
    rows = []
    for pos in range(n):
        url = "http://hot.com/x" if pos % 3 == 0 else f"http://a.com/{rnd.randint(0, 400)}"
        url = rnd.choice([url, url + "?utm_source=z", url.replace("http://", "http://www."), url + "/"])
        rows.append((pos, "" if rnd.random() < 0.02 else url))
    rnd.shuffle(rows)
    return rows


def plain_key(url):
    return url.split("?")[0].replace("www.", "").rstrip("/")


def test_labels_equal_brute_force_with_a_hot_key(spark):
    rows = hot_batch()
    stored = {f"http://a.com/{i}" for i in range(0, 400, 7)} | {"http://old.com"}
    batch = dedup.with_url_key(spark.createDataFrame(rows, "batch_pos long, job_url string").repartition(6))
    store = dedup.with_url_key(spark.createDataFrame([(u,) for u in stored], "job_url string"))
    store = store.union(store)
    got = {r.batch_pos: r.status for r in dedup.label_batch(batch, store, ["batch_pos"]).collect()}
    seen, want = set(), {}
    for pos, url in sorted(rows):
        key = plain_key(url)
        if not key:
            want[pos] = dedup.BLANK_URL
        elif key in seen:
            want[pos] = dedup.DUPLICATE_BATCH
        else:
            want[pos] = dedup.DUPLICATE_STORE if key in stored else dedup.KEPT
            seen.add(key)
    assert got == want
    keys = {r.url_key for r in dedup.existing_keys(batch, store).collect()}
    assert keys == {plain_key(u) for _, u in rows} & stored
    counts = Counter(want.values())
    s = dedup.dedup_summary(dedup.label_batch(batch, store, ["batch_pos"])).first()
    removed = counts[dedup.DUPLICATE_BATCH] + counts[dedup.DUPLICATE_STORE]
    assert (s.kept_count, s.removed_count, s.blank_count) == (counts[dedup.KEPT], removed, counts[dedup.BLANK_URL])
    assert s.dedup_rate == round(removed / (removed + s.kept_count) * 100, 1)


def test_labels_with_a_composite_position(spark):
    rows = [(2, 0, "http://a.com/x/"), (1, 5, "http://a.com/x"), (1, 9, "http://b.com/x"), (2, 1, "http://b.com/x/")]
    batch = dedup.with_url_key(spark.createDataFrame(rows, "page_id long, pos int, job_url string"))
    kept = dedup.new_rows(batch, None, ["page_id", "pos"]).collect()
    assert sorted((r.page_id, r.pos) for r in kept) == [(1, 5), (1, 9)]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "batch_pos long, job_url string")
    s = dedup.dedup_summary(dedup.label_batch(dedup.with_url_key(empty), None, ["batch_pos"])).first()
    assert tuple(s) == (0, 0, 0, 0.0)


def test_first_page_only_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"u{rnd.randint(0, 60)}", rnd.randint(1, 6)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, job_url string, page_no long").repartition(5)
    first = {}
    for _, u, p in rows:
        first[u] = min(p, first.get(u, p))
    want = sorted(i for i, u, p in rows if p == first[u])
    assert sorted(r.id for r in dedup.first_page_only(df, ["id"]).collect()) == want


def test_annotate_by_key_spreads_a_hot_key(spark):
    rows = [(i, None if i % 5 == 0 else ("hot" if i % 3 == 0 else f"k{i % 50}"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    sums = defaultdict(int)
    for _, k, v in rows:
        sums[k] += v
    out = annotate_by_key(df, ["k"], ["id"], salts=16, total=(F.sum, F.col("v")))
    assert out.count() == 3000
    assert all(r.total == sums[r.k] for r in out.collect())


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "s")], "x int, y string")
    assert sorted((r.x, r.y or "") for r in dedup.union_sources(a, b).collect()) == [(1, ""), (2, "s")]


def python_last_page(counts, threshold):
    run = 0
    for page, n in enumerate(counts, 1):
        run = run + 1 if n == 0 else 0
        if run == threshold:
            return page
    return len(counts)


def test_pagination_equals_brute_force(spark):
    rnd = random.Random(9)
    crawls = {f"s{i}": [rnd.choice([0, 0, 1, 3]) for _ in range(rnd.randint(1, 15))] for i in range(60)}
    crawls["hot"] = [1] * 600 + [0, 1, 0, 0, 4, 4]
    rows = [(s, p, n) for s, counts in crawls.items() for p, n in enumerate(counts, 1)]
    df = spark.createDataFrame(rows, "source_site string, page_no long, n_jobs long")
    for threshold in (1, 2, 3):
        want = {s: python_last_page(c, threshold) for s, c in crawls.items()}
        got = {r.source_site: r.last_page for r in pagination.last_pages(df, threshold).collect()}
        assert got == want
        kept = Counter(r.source_site for r in pagination.fetched_pages(df, threshold).collect())
        assert kept == Counter(want)


DOCS = [
    (1, "Go and SQL", "w1"), (2, "git, git, GIT", "w1"), (3, "nothing", "w1"), (4, "go rust", "w2"), (5, "rust", "w4"), (6, "", "w4"),
]


def test_mining_frames(spark):
    df = spark.createDataFrame(DOCS, "id long, t string, week_key string")
    mentions = mining.skill_mentions(df, F.col("t"), TAX, "id")
    assert sorted(tuple(r) for r in mentions.collect()) == [
        (1, "go", "lang"), (1, "sql", "lang"), (2, "git", "tools"), (4, "go", "lang"), (4, "rust", "lang"), (5, "rust", "lang"),
    ]
    counts = mining.skill_counts(df, F.col("t"), TAX)
    freq = mining.skill_frequency(counts, TAX)
    top = mining.top_skills(freq, 3).collect()
    assert [(r["rank"], r.skill, r.n, r.pct, r.category) for r in sorted(top)] == [
        (1, "go", 2, 33.3, "lang"), (2, "rust", 2, 33.3, "lang"), (3, "git", 1, 16.7, "tools"),
    ]
    per = mining.top_skills_by_category(freq, 1).collect()
    assert sorted((r.category, r.skill) for r in per) == [("lang", "go"), ("tools", "git")]
    cats = {r.category: (r.total_mentions, r.unique_skills) for r in mining.category_stats(freq).collect()}
    assert cats == {"lang": (5, 3), "tools": (1, 1)}
    s = mining.corpus_summary(counts).first()
    assert tuple(s) == (6, 6, 4, 1.0)
    assert sum(c[0] for c in cats.values()) == s.mentions and sum(c[1] for c in cats.values()) == s.unique_skills


def test_mining_nothing(spark):
    counts = mining.skill_counts(spark.createDataFrame([], "t string"), F.col("t"), TAX)
    assert tuple(mining.corpus_summary(counts).first()) == (0, 0, 0, 0.0)
    assert mining.top_skills(mining.skill_frequency(counts, TAX)).count() == 0


def test_trend(spark):
    docs = [
        (1, "Go and SQL", "2026-W01"), (2, "git, git, GIT", "2026-W01"), (3, "nothing", "2026-W01"), (4, "go rust", "2026-W02"),
        (5, "rust", "2026-W04"), (6, "", "2026-W04"), (7, "go", None), (8, "git", None),
    ]
    weekly = mining.skill_counts(spark.createDataFrame(docs, "id long, t string, week_key string"), F.col("t"), TAX, "week_key")
    got = {(r.week_key, r.skill): (r.n, r.delta) for r in mining.skill_trend(weekly).collect()}
    w = "2026-W0"
    assert got == {
        (w + "1", "go"): (1, None), (w + "1", "sql"): (1, None), (w + "1", "git"): (1, None),
        (w + "2", "go"): (1, 0), (w + "2", "rust"): (1, 1), (w + "2", "sql"): (0, -1), (w + "2", "git"): (0, -1),
        (w + "3", "go"): (0, -1), (w + "3", "rust"): (0, -1), (w + "4", "rust"): (1, 1),
        (None, "go"): (1, None), (None, "git"): (1, None),
    }


def test_next_week_follows_the_calendar(spark):
    day = datetime.date(1995, 12, 1)
    labels = []
    for i in range(3000):
        label = (day + datetime.timedelta(i)).strftime("%Y-W%W")
        if not labels or labels[-1] != label:
            labels.append(label)
    df = spark.createDataFrame(list(zip(labels, labels[1:], strict=False)), "a string, b string")
    assert df.filter(next_week(F.col("a")) != F.col("b")).count() == 0


def test_positions_may_be_null_or_shared(spark):
    rows = [(None, "http://a.com/1"), (None, "http://a.com/2"), (1, "http://a.com/2"), (1, "http://a.com/2/"), (1, "http://a.com/3"), (2, None)]
    batch = dedup.with_url_key(spark.createDataFrame(rows, "pos long, job_url string"))
    out = dedup.label_batch(batch, None, ["pos"]).collect()
    assert len(out) == 6
    kept = sorted((r.url_key, r.pos) for r in out if r.status == dedup.KEPT)
    assert [k for k, _ in kept] == ["http://a.com/1", "http://a.com/2", "http://a.com/3"] and dict(kept)["http://a.com/2"] == 1


def test_stats_and_period(spark):
    df = spark.createDataFrame(
        [("a", "x", "w", "2026-06-01", 1), ("a", "", "w", "2026-6-28", 0), ("", "x", "v", "soon", 1), ("b", "y", "w", "", 1)],
        "company string, location string, week_key string, date_posted string, is_active int",
    )
    assert tuple(stats.store_stats(df, "w").first()) == (4, 3, 2, 2)
    assert {(r.name, r.n) for r in stats.location_distribution(df, "w").collect()} == {("x", 1), ("y", 1)}
    assert [(r.name, r.n) for r in stats.company_distribution(df, "w", 1).collect()] == [("a", 2)]
    assert [(r.name, r.n) for r in stats.distribution(df, "company", "w", 1, active_only=True).collect()] == [("a", 1)]
    as_of = F.lit("2026-06-28 12:00:00").cast("timestamp")
    assert tuple(stats.period(df, as_of).first()) == ("2026-W25", "2026-06-01", "2026-06-28")
    assert tuple(stats.period(df.filter("date_posted = ''"), as_of).first()) == ("2026-W25", "2026-06-21", "2026-06-28")


def test_runs(spark):
    def at(day, hour=0):
        return datetime.datetime(2026, 6, day, hour)

    rows = [
        (1, at(1), at(1), "running", 0, 0), (1, at(1, 2), at(1), "completed", 5, 0),
        (2, at(2), at(2), "running", 0, 0), (3, at(3), at(3), "running", 0, 0), (3, at(3), at(3), "failed", 0, 2),
        (4, at(4), at(4), "running", 0, 0), (4, at(4), at(4), "completed", 7, 1),
    ]
    events = runs.as_events(spark.createDataFrame(
        rows, "run_id long, event_ts timestamp, started_at timestamp, status string, jobs_inserted long, errors_encountered long"
    ))
    latest = runs.latest_runs(events)
    assert {r.run_id: r.status for r in latest.collect()} == {1: "completed", 2: "running", 3: "failed", 4: "completed"}
    assert [r.run_id for r in runs.recent_runs(latest, 2).collect()] == [4, 3]
    t = runs.run_totals(latest).first()
    assert (t.targets_processed, t.jobs_inserted, t.errors_encountered) == (2, 12, 2)
    as_of = F.lit("2026-06-05 00:00:00").cast("timestamp")
    assert sorted(r.run_id for r in runs.retained(latest, as_of, 3).collect()) == [2, 3, 4]
    assert sorted(r.run_id for r in runs.expired(latest, as_of, 3).collect()) == [1]


def test_run_counters_with_errors(spark):
    labelled = spark.createDataFrame(
        [("a", 1, "kept"), ("a", 1, "duplicate_batch"), ("a", 2, "duplicate_store"), ("b", 1, "blank_url")],
        "source_site string, page_no long, status string",
    )
    errors = spark.createDataFrame([("a", 2), ("a", 1), ("c", 4)], "source_site string, n long")
    got = {r.source_site: tuple(r)[1:] for r in runs.run_counters(labelled, "source_site", page="page_no", errors=errors).collect()}
    assert got == {"a": (2, 3, 1, 2, 3), "b": (1, 1, 0, 0, 0), "c": (0, 0, 0, 0, 4)}


# -- taxonomy as a table


def as_table(spark, taxonomy):
    rows = [(skill, category, i) for i, (skill, category) in enumerate(taxonomy.entries)]
    return spark.createDataFrame(rows, "skill string, category string, ord long")


@pytest.mark.parametrize("kind", ["fixture", "overlap", "large", "boundary"])
@pytest.mark.parametrize("most_sent", [0, 1000])
def test_phrase_join_equals_the_pattern(spark, kind, most_sent):
    taxonomy = {
        "fixture": inputs.FIXTURE_TAXONOMY, "overlap": inputs.OVERLAP_TAXONOMY, "large": inputs.large_taxonomy(),
        "boundary": Taxonomy.of({"a": ["c++", "c", "c#", "rest", "rest api", "api gateway", "go", "node.js", "core data"], "b": ["data science", "c", "swift"]}),
    }[kind]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 4000")
    odd = [(-1, "rest api gateway"), (-2, "core data science"), (-3, "C++ dev"), (-4, "c++x c#"), (-5, "Node.jsx node.js"), (-6, "goö go"),
           (-7, ""), (-8, None), (-9, "swift swift, c c++y c"), (-9, "rest rest api rest api gateway core data science")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = mining.skill_mentions(docs, F.col("text"), taxonomy, "doc_id").collect()
    got = phrase_join.skill_mentions(docs, F.col("text"), as_table(spark, taxonomy), "doc_id", edge=taxonomy.edge, most_sent=most_sent).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_phrase_join_takes_a_hundred_thousand_phrases(spark):
    phrases = spark.range(100_000).select(
        F.concat(F.lit("k"), F.col("id") % 317, F.lit(" v"), F.col("id")).alias("skill"), F.lit("c").alias("category"), F.col("id").alias("ord"))
    texts = spark.range(200).select("id", F.concat(F.lit("a k"), F.col("id") * 400 % 317, F.lit(" v"), F.col("id") * 400, F.lit(", k1 v3 k5")).alias("text"))
    found = phrase_join.skill_mentions(texts, F.col("text"), phrases, "id", edge="token")
    assert {(r.id, r.skill) for r in found.collect()} == {(i, f"k{i * 400 % 317} v{i * 400}") for i in range(200)}
    assert phrase_join.skill_mentions(texts, F.col("text"), phrases.limit(0), "id").collect() == []


@pytest.mark.parametrize("most_sent", [0, 100_000])
def test_phrase_join_does_not_meet_all_phrases_of_a_first_word(spark, most_sent):
    """A million places of a word that 40,000 phrases begin with: 4 * 10^10 pairs, of which 2,000 are mentions."""
    ids = spark.range(40_000)
    phrases = ids.select(F.concat(F.lit("the k"), "id", F.lit(" v")).alias("skill"), F.lit("c").alias("category"), F.col("id").alias("ord"))
    text = F.concat(F.repeat(F.lit("the x the k1 "), F.lit(500)), F.lit("the k"), "id", F.lit(" v, the k"), F.col("id") + 1, F.lit(" v"))
    texts = spark.range(1000, numPartitions=8).select("id", text.alias("text"))
    began = time.monotonic()
    found = phrase_join.skill_mentions(texts, F.col("text"), phrases, "id", edge="token", most_sent=most_sent).collect()
    assert time.monotonic() - began < 60
    assert sorted((r.id, r.skill) for r in found) == sorted((i, f"the k{k} v") for i in range(1000) for k in (i, i + 1))


def test_phrase_join_reads_texts_without_a_shuffle(spark):
    phrases = spark.range(3000).select(F.concat(F.lit("the k"), "id").alias("skill"), F.lit("c").alias("category"), F.col("id").alias("ord"))
    texts = spark.range(50).select("id", F.concat(F.lit("see the k"), F.col("id") * 100).alias("text"))
    found = phrase_join.skill_mentions(texts, F.col("text"), phrases, "id", edge="token")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.skill) for r in found.collect()} == {(i, f"the k{i * 100}") for i in range(30)}


def test_pieces_of_texts_equal_the_pattern(spark):
    rnd = random.Random(3)
    signs = "ab7_é\u0660ⅷ漢😀𐐷\U00020000 \n\r.\u0301\u200d\ufeff\u2028\u00a0½\u0378\U0001df00\U00031350"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [r.p for r in df.select(phrase_join._pieces("t").alias("p")).collect()]
    for part in (pa.array(texts), pa.array(["x", *texts], pa.large_string()).slice(1)):
        cut = phrase_scan.cut_up(part, phrase_join._letters(spark))
        named = cut.unique.to_pylist()
        assert [[named[c] for c in cut.codes[a:b]] for a, b in zip(cut.bounds, cut.bounds[1:])] == want


@pytest.mark.parametrize("edge", ["token", "boundary"])
def test_phrase_join_ways_agree_on_odd_taxonomies(spark, edge):
    """Orders and categories that are null or repeat, null ids and null texts, bytes that are no characters."""
    rnd = random.Random(11)
    parts = ["a", "b", "c", "dd", "é", " ", " ", ".", "+"]
    draw = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    rows = [(draw(rnd.randint(0, 8)), rnd.choice(["u", "v", None]), rnd.choice([None, 1, 2, 3])) for _ in range(150)] + [(None, "u", 1)]
    taxonomy = spark.createDataFrame(rows, "skill string, category string, ord long").dropDuplicates(["skill"]).localCheckpoint()
    docs = spark.createDataFrame([(rnd.choice([None, i]), "x", rnd.choice([None, draw(rnd.randint(0, 90))])) for i in range(120)], "id long, more string, text string")
    broken = F.unhex(F.lit("61FF62208061206220")).cast("string")
    taxonomy = taxonomy.union(spark.range(1).select(broken, F.lit("u"), F.lit(1).cast("long")))
    docs = docs.union(spark.range(2).select("id", F.lit("y"), broken))
    found = lambda **k: sorted(map(str, phrase_join.skill_mentions(docs, F.col("text"), taxonomy, "id", "more", edge=edge, **k).collect()))
    joined = found(most_held=0, most_sent=1000)
    assert found() == joined and len(joined) > 200
    assert len(list(phrase_scan.parts(pa.array(["a" * phrase_scan.BYTES, "", "b", "c" * phrase_scan.BYTES])))) == 3


@pytest.mark.parametrize("edge", ["token", "boundary"])
@pytest.mark.parametrize("most_sent", [0, 1000])
def test_phrase_join_equals_the_pattern_in_chains(spark, edge, most_sent):
    rnd = random.Random(7)
    parts = ["a", "b", "c", "dd", "é", "7", "_", " ", " ", ".", "+", "\n", "😀"]
    draw = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    taxonomy = Taxonomy.of({c: [p for p in (draw(rnd.randint(1, 9)) for _ in range(40)) if p] for c in "uvw"}, edge=edge)
    docs = spark.createDataFrame([(i % 150, draw(rnd.randint(0, 120))) for i in range(200)], "id long, text string")
    want = mining.skill_mentions(docs, F.col("text"), taxonomy, "id").collect()
    got = phrase_join.skill_mentions(docs, F.col("text"), as_table(spark, taxonomy), "id", edge=edge, most_sent=most_sent).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
