"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_RUNS: dict[str, str] = {}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here expects."""
    builder = (
        SparkSession.builder.appName("provenir")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """This run's folder under the shared checkpoint directory.

    The directory is taken from the session. Only a local session that names
    none gets a temporary folder; on a cluster that is an error, because a
    machine-local path does not survive the loss of its executor. A path of the
    local file system is taken on a cluster only with a warning: it has to be a
    mount that all machines share.
    """
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        on_cluster = not spark.sparkContext.master.startswith("local")
        if base and on_cluster and (base.startswith(("file:", "/")) or "://" not in base):
            warnings.warn(f"spark.checkpoint.dir {base!r} must be a folder that all machines share", stacklevel=2)
        if not base:
            if on_cluster:
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="provenir-")
            spark.conf.set("spark.checkpoint.dir", base)
        _RUNS[app] = f"{base.rstrip('/')}/provenir-{uuid.uuid4().hex}"
    return _RUNS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write parquet with zstd: most of what is stored are digests in hex, which no other codec here halves."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage of iterative jobs and keeps a result that several later
    plans need. A written table survives lost executors, keeps column pruning
    and filter pushdown, and carries a true size, so joins pick broadcasts by
    measured bytes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    write_rows(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def cut_observed(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` plus aggregates of the rows written, without a second job."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in measures.items()]), label)
    return out, seen.get


def cut_counted(df: DataFrame, label: str = "stage") -> tuple[DataFrame, int]:
    """``cut`` plus the number of rows written, without a second job."""
    out, seen = cut_observed(df, label, n=F.count(F.lit(1)))
    return out, seen["n"]


class Growing:
    """Rows written part by part, each part once, and read again as one scan however many parts there are.

    Every ``MOST_PARTS`` parts become one, so a plan and a listing over all of them stay small.
    """

    MOST_PARTS = 24

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.folders, self.made = spark, scratch_path(spark, label), [], 0

    def _write(self, df: DataFrame) -> str:
        path = f"{self.root}/{self.made:06d}"
        self.made += 1
        write_rows(df, path)
        return path

    def add(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """Write a part; returns it as written, with aggregates of its rows."""
        seen = Observation()
        path = self._write(df.observe(seen, *[c.alias(name) for name, c in measures.items()]))
        part = self.spark.read.schema(df.schema).parquet(path)
        self.schema = df.schema
        self.folders.append(path)
        if len(self.folders) > self.MOST_PARTS:
            # The parts stay where they are for whoever still reads them.
            self.folders = [self._write(self.read())]
        return part, seen.get

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.folders)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_finished(spark: SparkSession) -> None:
    """Collect frames that nothing refers to any more, so that Spark deletes the shuffle files of their jobs.

    It does so only when the driver's heap is collected, which a large heap may not be
    before the files of many jobs fill the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; nothing may read them any more."""
    for df in frames:
        if folder := getattr(df, "scratch_folder", None):
            _delete(df.sparkSession, folder)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """A scratch folder of its own, deleted at the end; results have to be written elsewhere by then."""
    app, outer = spark.sparkContext.applicationId, scratch_root(spark)
    _RUNS[app] = f"{outer}/scope-{uuid.uuid4().hex[:12]}"
    try:
        yield _RUNS[app]
    finally:
        inner, _RUNS[app] = _RUNS[app], outer
        _delete(spark, inner)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this run's scratch folder; call when no result is pending."""
    root = _RUNS.pop(spark.sparkContext.applicationId, None)
    if root:
        _delete(spark, root)
