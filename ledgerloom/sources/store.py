"""A store of ledger tables: every change is a new version directory, and a pointer says which one counts.

A version's directory has the tables that it changed and a manifest of where the others lie. Nothing is changed in place, so a reader keeps its version, a failed write leaves nothing behind that counts, and going
back is a pointer to an older version. The pointer is replaced by a rename.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "tables.manifest"


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session gets a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that plans made of it stay small."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


class Store:
    """Tables under a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def _names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._path(path))] if self._exists(path) else []

    def versions(self) -> list[int]:
        """Versions that have a manifest, which is written last."""
        numbers = [int(n[1:]) for n in self._names(self.root) if n.startswith("v") and n[1:].isdigit()]
        return sorted(n for n in numbers if self._exists(f"{self.root}/v{n}/{MANIFEST}/_SUCCESS"))

    def manifest(self, version: int) -> dict[str, int]:
        """The version whose folder holds each table of a version."""
        return json.loads(self.spark.read.text(f"{self.root}/v{version}/{MANIFEST}").first()[0])

    def current(self) -> int | None:
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.root))] if self._exists(self.root) else []
        marks = [n for n in names if n.startswith("CURRENT-")]
        return max(((int(n.split("-")[1]), int(n.split("-")[2])) for n in marks), default=(None, None))[1]

    def _point(self, version: int) -> None:
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.root))]
        marks = sorted((int(n.split("-")[1]), n) for n in names if n.startswith("CURRENT-"))
        number = marks[-1][0] + 1 if marks else 0
        self._files.mkdirs(self._path(f"{self.root}/.next-{number}"))
        if not self._files.rename(self._path(f"{self.root}/.next-{number}"), self._path(f"{self.root}/CURRENT-{number}-{version}")):
            raise OSError("another writer moved the pointer")
        for _, name in marks:
            self._files.delete(self._path(f"{self.root}/{name}"), True)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables as a new version, points to it and returns its number. A table that isn't given is that of
        the current version, where it lies; nothing of it is copied."""
        base = self.current()
        taken = [int(n[1:]) for n in self._names(self.root) if n.startswith("v") and n[1:].isdigit()]
        number = max(taken, default=0) + 1
        held = {} if base is None else self.manifest(base)
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/v{number}/{name}")
        line = json.dumps({**held, **dict.fromkeys(tables, number)}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "line string").coalesce(1).write.text(f"{self.root}/v{number}/{MANIFEST}")
        self._point(number)
        return number

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(self.current() if version is None else version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        return self.spark.read.parquet(f"{self.root}/v{self.manifest(version)[name]}/{name}")

    def rollback(self, version: int) -> None:
        """Points to an older version; newer ones stay until they are dropped."""
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self._point(version)

    def drop(self, version: int) -> None:
        if version == self.current():
            raise ValueError("the current version stays")
        others = [v for v in self.versions() if v != version]
        needed = {(name, at) for v in others for name, at in self.manifest(v).items()}
        self._files.delete(self._path(f"{self.root}/v{version}/{MANIFEST}"), True)
        for name in self._names(f"{self.root}/v{version}"):
            if (name, version) not in needed:
                self._files.delete(self._path(f"{self.root}/v{version}/{name}"), True)
        if not self._names(f"{self.root}/v{version}"):
            self._files.delete(self._path(f"{self.root}/v{version}"), True)
