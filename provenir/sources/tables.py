"""Case snapshots: one parquet folder per collection, a marker written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenir.schemas import SCHEMAS, Case
from provenir.session import write_rows

MARKER = "_COMPLETE"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete snapshot versions under ``root``, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARKER)
        if name.startswith("v=") and fs.exists(marker):
            found.append(int(name[2:]))
    return sorted(found)


def write_snapshot(case: Case, root: str, version: int | None = None) -> int:
    """Write every collection into a new folder, then the marker.

    A reader sees a snapshot only with its marker, so a write that fails half
    way changes nothing. A version that is already complete is left alone, which
    makes a repeated write of the same version harmless.
    """
    spark = case.evidence.sparkSession
    done = versions(spark, root)
    if version is None:
        version = (done[-1] + 1) if done else 0
    if version in done:
        return version
    folder = f"{root.rstrip('/')}/v={version:09d}"
    for name, df in case.tables().items():
        write_rows(df, f"{folder}/{name}", "overwrite")
    fs, marker = _fs(spark, f"{folder}/{MARKER}")
    fs.create(marker, True).close()
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Case:
    """The given or latest complete snapshot; an empty case when there is none."""
    done = versions(spark, root)
    if not done:
        return Case.empty(spark)
    folder = f"{root.rstrip('/')}/v={(done[-1] if version is None else version):09d}"
    return Case(**{name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in SCHEMAS.items()})


def _numbered(spark: SparkSession, root: str, prefix: str, marker: str) -> list[int]:
    """Numbers of the complete folders ``prefix=<number>`` under ``root``, ascending."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    made = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, marker)))


def _folder(root: str, prefix: str, number: int) -> str:
    return f"{root.rstrip('/')}/{prefix}={number:09d}"


class Deltas:
    """An append-only store: versions that hold new rows only, and bases that hold all rows up to a version.

    A reader takes the last complete base and the versions after it. ``compact`` writes
    a new base and deletes what the base before it covered, so that readers of the
    last base are not disturbed and the number of folders stays bounded.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], marker: str = MARKER):
        self.spark, self.root, self.schemas, self.marker = spark, root.rstrip("/"), schemas, marker

    def bases(self) -> list[int]:
        return _numbered(self.spark, self.root, "base", self.marker)

    def versions(self) -> list[int]:
        return _numbered(self.spark, self.root, "v", self.marker)

    def holds(self, version: int) -> bool:
        return version in self.versions() or any(version <= b for b in self.bases())

    def read(self, before: int | None = None) -> dict[str, DataFrame]:
        bases = [b for b in self.bases() if before is None or b < before]
        base = bases[-1] if bases else -1
        later = [v for v in self.versions() if v > base and (before is None or v < before)]
        folders = ([_folder(self.root, "base", base)] if bases else []) + [_folder(self.root, "v", v) for v in later]
        out = {}
        for name, ddl in self.schemas.items():
            paths = [p for f in folders if (fs := _fs(self.spark, p := f"{f}/{name}"))[0].exists(fs[1])]
            out[name] = self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)
        return out

    def _write(self, folder: str, frames: dict[str, DataFrame]) -> None:
        for name, df in frames.items():
            write_rows(df, f"{folder}/{name}", "overwrite")
        fs, path = _fs(self.spark, f"{folder}/{self.marker}")
        fs.create(path, True).close()

    def append(self, version: int, frames: dict[str, DataFrame]) -> None:
        """Write one version; only the collections that are given get a folder."""
        if not self.holds(version):
            self._write(_folder(self.root, "v", version), frames)

    def compact(self, after: int = 16) -> bool:
        """Write a new base once ``after`` versions have come since the last; tells whether it did."""
        bases = self.bases()
        later = [v for v in self.versions() if not bases or v > bases[-1]]
        if len(later) < after:
            return False
        # The scan packs small files together, so the base has few.
        rows = {k: df for k, df in self.read().items() if not df.isEmpty()}
        self._write(_folder(self.root, "base", later[-1]), rows)
        old = bases[-1] if bases else -1
        for prefix, numbers in (("v", self.versions()), ("base", bases[:-1])):
            for n in numbers:
                if n <= old:
                    fs, path = _fs(self.spark, _folder(self.root, prefix, n))
                    fs.delete(path, True)
        return True


def read_deltas(spark: SparkSession, root: str, before: int | None = None) -> Case:
    """All rows of an append-only case store as one case."""
    return Case(**Deltas(spark, root, SCHEMAS).read(before))


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """A result as JSON lines, nested shapes kept."""
    df.write.option("ignoreNullFields", "false").option("compression", compression).json(path)
