"""Tables that many small batches append to: a few runs of files, merged as they grow.

A batch is appended as a run, a folder of its own. Runs of like size are merged into one when
there are ``FAN`` of them, so a table has a number of runs that grows with the logarithm of its
rows, however many batches made it, and a row is written again about once per tier. Which runs
make up the table says a manifest; a new one takes the place of the last in one step. The run
of the last batch stays apart from merges until the next batch, so that a batch that is run again
replaces its own run and nothing else. Folders that a merge has replaced are dropped with the next
change, when no reader of the manifest before is left. One writer per table.

With a ``sort`` column the files of a run hold ascending ranges of it in small pages, and the
manifest knows the range of each file: looking up some values opens only the files, and of
those reads only the pages, that can hold them.
"""

from __future__ import annotations

import json
import math
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gleaner.session import drop_path, names_in, read_text, write_text

#: Runs of a tier that are merged, and the rows up to which a run is of the lowest tier.
FAN, LOWEST = 8, 1 << 16
#: Rows of a file, and of a page of a sorted file.
FILE_ROWS, PAGE_ROWS = 2_000_000, 256
#: Values that are looked up one by one; for more the table is read.
MOST_VALUES = 512


@dataclass(frozen=True)
class Run:
    """A folder of files; ``files`` are (name, lowest, highest) if the table is sorted."""

    name: str
    batch: str
    rows: int
    files: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass(frozen=True)
class Manifest:
    """The runs of a table, the replaced ones that are still there, the last batch and what was noted with it."""

    runs: list[Run] = field(default_factory=list)
    replaced: list[str] = field(default_factory=list)
    batch: str | None = None
    note: list[int] | None = None


def tier(rows: int) -> int:
    return 0 if rows < LOWEST else 1 + int(math.log(rows / LOWEST, FAN))


def due(runs: Iterable[Run]) -> list[Run]:
    """Runs to merge: those of the lowest tier that is full."""
    tiers: dict[int, list[Run]] = {}
    for run in runs:
        tiers.setdefault(tier(run.rows), []).append(run)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN), [])


@dataclass(frozen=True)
class MergingTable:
    """A table at ``path``; ``fold`` is applied to the rows of runs that merge, and must not change what the table says."""

    path: str
    columns: StructType
    sort: str | None = None
    fold: Callable[[DataFrame], DataFrame] | None = None

    # -- reading ----------------------------------------------------------

    def manifest(self, spark: SparkSession) -> Manifest:
        found = [n for n in names_in(spark, f"{self.path}/_manifest") if n.endswith(".json")]
        if not found:
            return Manifest()
        read = json.loads(read_text(spark, f"{self.path}/_manifest/{found[-1]}"))
        return Manifest(**{**read, "runs": [Run(**{**r, "files": [tuple(f) for f in r["files"]]}) for r in read["runs"]]})

    def read(self, spark: SparkSession) -> DataFrame:
        return self._of(spark, [self._folder(r.name) for r in self.manifest(spark).runs])

    def among(self, spark: SparkSession, values: Iterable[int]) -> DataFrame:
        """The rows with one of these values in the sort column; the whole table if there are too many."""
        wanted = sorted(set(values))
        if len(wanted) > MOST_VALUES:
            return self.read(spark)
        files = []
        for run in self.manifest(spark).runs:
            for name, low, high in run.files:
                at = bisect_left(wanted, low)
                if at < len(wanted) and wanted[at] <= high:
                    files.append(f"{self._folder(run.name)}/{name}")
        found = self._of(spark, files)
        if not files:
            return found
        # equalities, and not a list, since only these are looked up in the pages of a file
        tests = [F.col(self.sort) == F.lit(v) for v in wanted]
        while len(tests) > 1:
            tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
        return found.filter(tests[0])

    def _of(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        return spark.read.schema(self.columns).parquet(*paths) if paths else spark.createDataFrame([], self.columns)

    def _folder(self, name: str) -> str:
        return f"{self.path}/run={name}"

    # -- writing ----------------------------------------------------------

    def append(self, rows: DataFrame, batch: str, n: int, note: list[int] | None = None) -> None:
        """Add the rows of a batch, ``n`` or about so many, in the place of those that the same batch has added last."""
        spark, last = rows.sparkSession, self.manifest(rows.sparkSession)
        again = [r for r in last.runs if r.batch == batch] if last.batch == batch else []
        runs = [r for r in last.runs if r not in again]
        merged: list[Run] = []
        while group := due(runs):
            whole = self._of(spark, [self._folder(r.name) for r in group])
            run = self._write(self.fold(whole) if self.fold else whole, "", sum(r.rows for r in group))
            merged += group
            runs = [*(r for r in runs if r not in group), run]
        if n:
            runs.append(self._write(rows, batch, n))
        gone = [r.name for r in [*again, *merged]]
        self._switch(spark, Manifest(runs, gone, batch, note))
        for name in last.replaced:
            drop_path(spark, self._folder(name))

    def _write(self, rows: DataFrame, batch: str, n: int) -> Run:
        name, files = uuid.uuid4().hex, max(1, -(-n // FILE_ROWS))
        rows = rows.select(*self.columns.names)
        if not self.sort:
            rows.repartition(files).write.parquet(self._folder(name))
            return Run(name, batch, n)
        dealt = rows.repartitionByRange(files, self.sort) if files > 1 else rows.repartition(1)
        writer = dealt.sortWithinPartitions(*self.columns.names).write.option("parquet.page.row.count.limit", PAGE_ROWS)
        writer.parquet(self._folder(name))
        written = rows.sparkSession.read.schema(self.columns).parquet(self._folder(name))
        held = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(self.sort).alias("low"), F.max(self.sort).alias("high"), F.count("*").alias("n")
        ).collect()
        return Run(name, batch, sum(r.n for r in held), sorted((r.file, r.low, r.high) for r in held))

    def _switch(self, spark: SparkSession, manifest: Manifest) -> None:
        folder = f"{self.path}/_manifest"
        known = [n for n in names_in(spark, folder) if n.endswith(".json")]
        number = 1 + int(known[-1].removesuffix(".json")) if known else 0
        write_text(spark, f"{folder}/{number:012d}.json", json.dumps(asdict(manifest)))
        for name in known[:-1]:
            drop_path(spark, f"{folder}/{name}")
