"""Tables of merging runs."""

import os
import random

import pytest
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.session import work_path
from gleaner.sources import merging
from gleaner.sources.merging import MergingTable, Run

KEYS = T.StructType([T.StructField("h", T.LongType()), T.StructField("url_key", T.StringType())])


def keyed(spark, numbers):
    rows = spark.createDataFrame([(f"k{i}",) for i in numbers], "url_key string")
    return rows.select(F.xxhash64("url_key").alias("h"), "url_key")


def folders(table):
    return [f for f in os.listdir(table.path.removeprefix("file:")) if f.startswith("run=")]


def test_a_thousand_batches_leave_few_runs():
    rng, runs, rewritten, total, most = random.Random(1), [], 0, 0, 0
    for i in range(1000):
        while group := merging.due(runs):
            rows = sum(r.rows for r in group)
            rewritten += rows
            runs = [r for r in runs if r not in group] + [Run(f"m{i}", "", rows)]
        rows = rng.choice([10, 1000, 5000, 40_000])
        total += rows
        runs.append(Run(f"b{i}", str(i), rows))
        most = max(most, len(runs))
    tiers = 1 + merging.tier(total)
    assert most <= (merging.FAN - 1) * tiers + 1 and rewritten < 4 * tiers * total
    assert sum(r.rows for r in runs) == total


def test_batches_merge_and_repeats_replace_their_own_run(spark, monkeypatch):
    monkeypatch.setattr(merging, "FAN", 3)
    table = MergingTable(work_path(spark, "merging"), KEYS, sort="h", fold=DataFrame.dropDuplicates)
    assert table.read(spark).count() == 0 and table.among(spark, [1]).count() == 0
    want = set()
    for i in range(10):
        numbers = range(i * 4, i * 4 + 5)  # the last of a batch is the first of the next
        for _ in range(1 + i % 2):  # every other batch is run twice
            table.append(keyed(spark, numbers), f"b{i}", len(numbers), [i])
        want |= {f"k{n}" for n in numbers}
        state = table.manifest(spark)
        assert (state.batch, state.note) == (f"b{i}", [i])
        assert {r.url_key for r in table.read(spark).collect()} == want
        assert len(state.runs) <= 2 * 2 + 1 and len(folders(table)) <= len(state.runs) + len(state.replaced)
    assert sum(r.rows for r in table.manifest(spark).runs) - len(want) <= 4
    table.append(keyed(spark, []), "none", 0, [7])
    assert table.manifest(spark).note == [7] and table.read(spark).select("url_key").distinct().count() == len(want)


def test_a_reader_of_the_manifest_before_still_finds_its_files(spark, monkeypatch):
    monkeypatch.setattr(merging, "FAN", 2)
    table = MergingTable(work_path(spark, "merging"), KEYS, sort="h")
    for i in range(2):
        table.append(keyed(spark, [i]), f"b{i}", 1)
    reader = table.read(spark)
    table.append(keyed(spark, [2]), "b2", 1)
    assert reader.count() == 2 and table.read(spark).count() == 3


@pytest.mark.parametrize("files", [1, 4])
def test_a_lookup_reads_few_pages(spark, monkeypatch, files):
    n = 400_000
    monkeypatch.setattr(merging, "FILE_ROWS", -(-n // files))
    table = MergingTable(work_path(spark, "merging"), KEYS, sort="h", fold=DataFrame.dropDuplicates)
    rows = spark.range(n).select(F.concat(F.lit("http://host.example.com/item/"), F.col("id")).alias("url_key")).select(F.xxhash64("url_key").alias("h"), "url_key")
    table.append(rows, "b", n)
    assert len(table.manifest(spark).runs[0].files) == files
    asked = [r.h for r in rows.filter("h % 40000 = 0").collect()] + [5, -5]
    found = table.among(spark, asked)
    got = found.collect()
    assert sorted(r.h for r in got) == sorted(asked[:-2])
    plan = found._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    scan = plan.executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert read <= 2 * merging.PAGE_ROWS * len(asked) and read < n / 50  # two executions, whole pages
    assert table.among(spark, range(merging.MOST_VALUES + 1)).count() == n
