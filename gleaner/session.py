"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleaner", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library counts on (UTC, AQE, runtime filters)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return root


def ensure_work_folder(spark: SparkSession, folder: str = "/tmp/checkpoints") -> None:
    """Give a local session without a shared folder one of its own; a cluster must name its folder itself."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and sc.master.startswith("local["):
        sc.setCheckpointDir(folder)


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below this application's part of the shared folder."""
    return f"{_own_root(spark)}/{label}-{uuid.uuid4().hex}"


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def drop_work(spark: SparkSession) -> None:
    """Drop all tables this application has cut, once the results that read them have been written elsewhere."""
    drop_path(spark, _own_root(spark))


#: Options of :func:`cut` for rows of some MB each. Else Parquet looks at the size of its buffers after 100 rows only, and a
#: reader holds the rows of a row group, up to 4,096, at once.
LONG_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.row.count.limit": 1}


def cut(df: DataFrame, label: str = "cut", compression: str | None = None, **options) -> DataFrame:
    """Write the frame to a table in the shared folder and go on from there.

    The table outlives executors, is read by column, and no step before it runs again. It stays
    until :func:`drop_work`, or to the end of the :class:`WorkScope` that it is cut in.
    ``options`` are those of the Parquet writer.
    """
    path = work_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table this library has written, wherever the path's file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, wherever the path's file system is."""
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it, so that it is there as a whole or not at all."""
    jvm = spark._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(where, False)
    if not system.rename(beside, where):
        raise OSError(f"cannot write {path}")


#: The paths that the open scopes have to drop, the innermost last.
_scopes: list[list[str]] = []


class WorkScope:
    """Drops, when it ends, all tables that were cut in it; what is to be kept is written by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> WorkScope:
        _scopes.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self.paths)
        for path in self.paths:
            drop_path(self.spark, path)


class Scratch:
    """Tables of one run in the shared folder, dropped when the run ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        path = work_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
