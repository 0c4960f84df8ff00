"""Change detection, manifest upserts, snapshot differences, keep-first dedup."""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_path, file_hash, status: unchanged if the hash is known, else modified if the path is, else new."""
    hashes = manifest.select(F.col("file_hash").alias("h")).distinct()
    paths = manifest.select(F.col("file_path").alias("p")).distinct()
    j = found.join(hashes, found.file_hash == F.col("h"), "left").join(paths, found.file_path == F.col("p"), "left")
    status = F.when(F.col("h").isNotNull(), "unchanged").when(F.col("p").isNotNull(), "modified").otherwise("new")
    return j.select(found.file_path, found.file_hash, status.alias("status"))


def upsert(manifest: DataFrame, changes: DataFrame, key: str = "file_path") -> DataFrame:
    """changes, and manifest's rows of other keys."""
    return manifest.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """key, change: Added, Removed or Modified; equal rows are left out."""
    a, b = old.select(F.col(key).alias("k"), F.col(version).alias("v_old")), new.select(F.col(key).alias("k"), F.col(version).alias("v_new"))
    j = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), "k", "full")
    change = F.when(F.col("in_old").isNull(), "Added").when(F.col("in_new").isNull(), "Removed").when(~F.col("v_old").eqNullSafe(F.col("v_new")), "Modified")
    return j.select(F.col("k").alias(key), change.alias("change")).filter("change is not null")


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def aligned(chunks: DataFrame, vectors: DataFrame, book: str, key: str) -> DataFrame:
    """Chunks with their vectors, of those books only that have as many of one as of the other."""
    n, m = chunks.groupBy(book).agg(F.count("*").alias("n")), vectors.groupBy(book).agg(F.count("*").alias("m"))
    good = n.join(m, book).filter("n = m").select(book)
    return chunks.join(good, book, "left_semi").join(vectors.drop(book), key)


class ManifestStore:
    """A manifest as numbered versions below a path, for several writers and readers.

    A version is data below data/ and a file commits/<number> that names it, which is created only if it isn't there: of two
    writers that made the same version one wins, and the other reads again and upserts on top. Readers that pin a version
    leave a file below pins/ for as long, and expire() spares what is pinned. Data without a commit is never read.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _create(self, name: str, text: str) -> bool:
        """Whether the file could be made; False if it is there already."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if self._fs.exists(self._at(name)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def versions(self) -> list[int]:
        """Committed versions that can be read, oldest first."""
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def current(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def _data(self, version: int) -> str:
        stream = self._fs.open(self._at(f"commits/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A version, the newest unless told; with a schema, an empty table where there is none yet."""
        version = self.current() if version is None else version
        if version == 0:
            if schema is None:
                raise ValueError("no version yet, and no schema for an empty one")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/data/{self._data(version)}")

    def upsert(self, changes: DataFrame, key: str = "file_path", tries: int = 10, before_commit=lambda: None) -> int:
        """The version that holds changes and, of other keys, the rows of the version before; a writer that is overtaken tries again."""
        for _ in range(tries):
            version = self.current() + 1
            merged = changes if version == 1 else upsert(self.read(version=version - 1), changes, key).select(*changes.columns)
            name = f"v={version}" if version == 1 and not self._names("data") else f"v={version}-{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.path}/data/{name}")
            before_commit()
            if self._create(f"commits/{version}", name):
                return version
            self._fs.delete(self._at(f"data/{name}"), True)
        raise RuntimeError(f"{tries} times overtaken by other writers")

    @contextlib.contextmanager
    def pinned(self, version: int | None = None):
        """The table of one version, which stays whole until the block ends, whatever is written meanwhile."""
        version = self.current() if version is None else version
        pin = f"pins/{version}-{uuid.uuid4().hex}"
        self._create(pin, "")
        try:
            yield self.read(version=version)
        finally:
            self._fs.delete(self._at(pin), False)

    def expire(self, keep: int = 2) -> None:
        """Removes all but the last `keep` versions and those that a reader has pinned: first the commit, then the data."""
        held = {int(n.split("-")[0]) for n in self._names("pins")}
        for version in self.versions()[: -keep or None]:
            if version not in held:
                data = self._data(version)
                self._fs.delete(self._at(f"commits/{version}"), False)
                self._fs.delete(self._at(f"data/{data}"), True)
