"""Shared plumbing of the training-data operators: the shared folder, materialised tables, word arrays."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid
import zlib
from functools import partial

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract; bytes.split() splits on exactly these six characters.
SPACE = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own if Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_sandloom_root", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="sandloom-")
            spark.sparkContext._sandloom_root = root
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder. An application's paths lie together and are deleted when its driver ends in good order;
    results are lazy, so nothing can be deleted when a function returns."""
    folder = f"{shared_root(spark)}/sandloom/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


_folders: set[str] = set()


def _remove(folder: str) -> None:
    with contextlib.suppress(OSError, ValueError):  # gone already, or a store that pyarrow does not open
        system, path = file_system(folder)
        system.delete_dir(path)


def spill(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by spill() that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/sandloom/" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """A pyarrow file system and the path in it, for any URI that pyarrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the key and the text, null text as empty: whatever other columns there are is left alone."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def crc_mod(key: str = "doc_id", n: int = 5):
    """crc32 of the key's decimal text, modulo n; a null key counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % n


def crc_mod_py(value, n: int = 5) -> int:
    return zlib.crc32(("null" if value is None else str(int(value))).encode()) % n


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Multipliers of the polynomial and of the mixers (odd 64-bit constants of splitmix64).
_P = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x = x ^ (x >> np.uint64(27))
    x = x * _B
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    space = _IS_SPACE[blob]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def words_of_batch(texts_: list[bytes], lower: bool = False, second: bool = False):
    """Hashes of all words of many texts at once: (word hashes, words before each text, or with second: another hash).

    A word's hash is a sum over eight-byte chunks, each mixed with its place in the word and with the word's length.
    """
    joined = b"\n".join(texts_) + b"\n" + b"\0" * 8
    blob = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        upper = (blob >= 65) & (blob <= 90)
        blob = blob + (upper.astype(np.uint8) << np.uint8(5))
    starts, ends = word_spans(blob[:-8])
    sizes = np.fromiter((len(t) for t in texts_), dtype=np.int64, count=len(texts_))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    first = np.searchsorted(starts, bounds)
    if len(starts) == 0:
        empty = np.zeros(0, dtype=np.uint64)
        return (empty, first, empty) if second else (empty, first)
    if not blob.flags["C_CONTIGUOUS"]:
        blob = np.ascontiguousarray(blob)
    eight = np.lib.stride_tricks.as_strided(blob, shape=(len(blob) - 7, 8), strides=(1, 1))
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * _P)
    g = mix(lengths.astype(np.uint64) * _B + _A) if second else None
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
    live, k = np.arange(len(starts)), 0
    while len(live):
        at = starts[live] + 8 * k
        left = np.minimum(ends[live] - at, 8)
        chunk = np.ascontiguousarray(eight[at]).view("<u8").ravel() & masks[left]
        h[live] += mix(chunk + np.uint64(int(_P) * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF))
        if second:
            g[live] += mix((chunk ^ _B) * _A + np.uint64(int(_P) * (2 * k + 7) & 0xFFFFFFFFFFFFFFFF))
        live = live[ends[live] - starts[live] > 8 * (k + 1)]
        k += 1
    return (mix(h), first, mix(g)) if second else (mix(h), first)


def window_hashes(h: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Order-dependent hashes of all windows of `size` neighbouring hashes (windows across texts included)."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - size + 1
    out = np.full(n, mix(np.array([seed], dtype=np.uint64))[0], dtype=np.uint64)
    for k in range(size):
        out = out * _P + h[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def parts(batches, text: int = 1, rows: int = 1024, limit: int = 1 << 22):
    """Record batches in parts of at most `rows` rows and about `limit` bytes of text: (part, texts)."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            x = b.slice(k, rows)
            t = text_bytes(x.column(text))
            for i, j in slices(t, limit):
                yield x.slice(i, j - i), t[i:j]
    release()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """While it lasts, what runs sends at most `rows` rows at a time to Python: a batch lies outside the JVM's heap and in the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that this worker has freed back to the system: workers are kept between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def slices(texts_: list[bytes], limit: int = 1 << 22):
    """Index ranges of texts of about `limit` bytes together, so that work space stays bounded."""
    start = total = 0
    for i, t in enumerate(texts_):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts_):
        yield start, len(texts_)


#: The column that keyed() adds. Names that begin like it are reserved.
ROW = "_sandloom_row"


def keyed(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """docs and ROW: a long of its own for each row, null and repeated doc_ids included, the same whenever the rows are read.

    Of a Parquet table it is the file's number and the row's place in the file, and nothing is copied; any other frame is
    written to the shared folder first. Files are numbered on the executors by their names; the numbers of up to `most` files
    (16 bytes each) are broadcast, those of more are joined by a shuffle.
    """
    names = docs.columns
    try:
        stable = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:  # no Parquet
        stable = False
    docs = docs if stable else spill(docs, "rows")
    columns = [F.col(f"`{c}`") for c in names]
    at = docs.select(*columns, F.col("_metadata.file_path").alias(f"{ROW}_file"), F.col("_metadata.row_index").alias(f"{ROW}_place"))
    at = at.withColumn(f"{ROW}_hash", F.xxhash64(f"{ROW}_file"))
    # One row a file, 2**23 at most: the window's single task is bounded.
    files = spill(at.select(f"{ROW}_file", f"{ROW}_hash").distinct().withColumn("number", F.row_number().over(Window.orderBy(f"{ROW}_file"))), "files")
    n, different = files.agg(F.count("*"), F.count_distinct(f"{ROW}_hash")).first()
    if n >= 1 << 23:
        raise ValueError(f"{n} files are too many to number")
    by = f"{ROW}_hash" if n == different else f"{ROW}_file"
    numbers = files.select(by, "number")
    if n <= most:
        numbers = F.broadcast(numbers)
    joined = at.join(numbers.withColumnRenamed("number", f"{ROW}_number"), by)
    return joined.select(*columns, (F.shiftleft(F.col(f"{ROW}_number").cast("long"), 40) + F.col(f"{ROW}_place")).alias(ROW))


def by_row(rows: DataFrame) -> DataFrame:
    """What keyed() gave as (doc_id, text), with ROW as doc_id: operators then judge rows."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def drop_rows(rows: DataFrame, bad: DataFrame, most: int = 1 << 17) -> DataFrame:
    """What keyed() gave without the rows whose ROW is in bad(ROW), and without ROW. A list of at most `most` is broadcast, a longer one shuffled."""
    keys = spill(bad.select(F.col(ROW).alias("bad_key")).distinct(), "rows")
    if keys.count() <= most:
        keys = F.broadcast(keys)
    return rows.join(keys, rows[ROW] == keys.bad_key, "left_anti").drop(ROW)


def all_but_first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of groups(ROW, group_id), ROW of every row but one in each group: the one with the smallest doc_id stays, null being the largest; of equal ones the first."""
    groups = spill(groups, "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    first = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("group_id").agg(F.min(order).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return groups.select(ROW).join(first, ROW, "left_anti")


class Bloom:
    """A bit map of fixed size: which ids may be in a set. What it lets through by chance a later exact join drops."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, ids: DataFrame, column: str, bits: int = 25) -> Bloom:
        """Of a column of longs. Its 2**bits bits come to the driver as at most 2**bits / 64 rows, whatever the table's size."""
        slots = ids.select(F.pmod(F.xxhash64(column), F.lit(1 << bits)).alias("slot"))
        rows = slots.selectExpr("shiftright(slot, 6) AS w", "shiftleft(1L, cast(slot & 63 AS int)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
        got = rows.toArrow()
        words = np.zeros(1 << (bits - 6), dtype=np.int64)
        words[got["w"].to_numpy()] = got["b"].to_numpy()
        return cls(bits, words.view(np.uint64))

    @classmethod
    def of_slots(cls, keys: DataFrame, column: str, slots, bits: int = 25, made=None) -> Bloom:
        """The same, with slots(keys, bits) as the hash function, for keys that are made in Python.

        made: a function of batches whose batches have the keys as first column. It runs in the worker that sets the bits; as
        a mapInArrow of its own it would take a second worker for each core, which stays with the memory that it has.
        """

        def put(batches):
            import pyarrow as pa

            words = np.zeros(1 << (bits - 6), dtype=np.uint64)
            for b in batches if made is None else made(batches):
                s = slots(b.column(0).to_numpy().view(np.uint64), bits)
                np.bitwise_or.at(words, s >> 6, np.uint64(1) << (s & 63).astype(np.uint64))
            at = np.flatnonzero(words)
            for k in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(words[at[k : k + (1 << 16)]].view(np.int64))], ["w", "b"])
            del words, at
            release()

        got = (keys.select(column) if made is None else keys).mapInArrow(put, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), dtype=np.int64)
        words[got["w"].to_numpy()] = got["b"].to_numpy()
        return cls(bits, words.view(np.uint64))

    def fill(self) -> float:
        """Share of the bits that are set."""
        return float(np.bitwise_count(self.words).sum()) / (1 << self.bits)

    def has(self, slots: np.ndarray) -> np.ndarray:
        """slots: pmod(xxhash64(id), 2**bits), which the plan adds as a column."""
        return (self.words[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def _priority(x: np.ndarray, turn: int) -> np.ndarray:
    """An order of nodes that is another one in each round, so that no order of ids makes the rounds slow."""
    return mix(x.view(np.uint64) ^ mix(np.array([turn + 1], dtype=np.uint64)))


def _roots(batches, turn: int = 0, hold: int = 1 << 20):
    """(v, r) of edges (lo, hi): each node with the first node, by priority, that this task's edges join it with."""
    import pyarrow as pa

    held, size = [], 0

    def out():
        lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, back = np.unique(np.concatenate([lo, hi]), return_inverse=True)
        order = np.argsort(_priority(nodes, turn), kind="stable")
        place = np.empty(len(nodes), dtype=np.int64)
        place[order] = np.arange(len(nodes))
        a, b = place[back[: len(lo)]], place[back[len(lo) :]]
        f = np.arange(len(nodes))
        while True:
            x, y = f[a], f[b]
            live = x != y
            if not live.any():
                break
            a, b, x, y = a[live], b[live], x[live], y[live]
            np.minimum.at(f, np.maximum(x, y), np.minimum(x, y))
            while (f[f] != f).any():
                f = f[f]
        by_place = nodes[order]
        for k in range(0, len(nodes), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(by_place[part]), pa.array(by_place[f[part]])], ["v", "r"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
        if size > hold:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()
    release()


def _settle(batches, turn: int = 0):
    """Of rows (v, r) sorted by v: with kind 0 each node v and the first of its roots m; with kind 1 edges of m and the other roots."""
    import pyarrow as pa

    def settled(v, r):
        order = np.lexsort((_priority(r, turn), v))
        v, r = v[order], r[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        m = r[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]
        edge = np.unique(np.stack([m[m != r], r[m != r]]), axis=1) if (m != r).any() else np.zeros((2, 0), np.int64)
        kind = np.concatenate([np.zeros(int(new.sum()), np.int32), np.ones(edge.shape[1], np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([v[new], edge[0]])), pa.array(np.concatenate([m[new], edge[1]]))], ["kind", "a", "b"])

    v, r = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in batches:
        v, r = np.concatenate([v, x.column(0).to_numpy()]), np.concatenate([r, x.column(1).to_numpy()])
        done = int(np.searchsorted(v, v[-1])) if len(v) else 0  # the last node may go on: it has at most a row a task
        if done:
            yield settled(v[:done], r[:done])
            v, r = v[done:], r[done:]
    if len(v):
        yield settled(v, r)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), longs: node, root (the smallest node reachable), for nodes that have an edge.

    Rounds of contraction. A task joins what its own edges join, so a node that very many edges share is one row a task. A
    node that tasks give several roots goes to the first of them, and edges among these roots are what the next round is
    left with. Each round has one exchange and is written to the shared folder; roots are chosen by another random order in
    each, so a third of a chain goes at least, on average, whatever its ids.
    """
    now = spill(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi"), "edges")
    rounds, turn = [], 0
    while turn == 0 or now.head(1):
        found = now.mapInArrow(partial(_roots, turn=turn), "v long, r long")
        got = spill(found.repartition("v").sortWithinPartitions("v").mapInArrow(partial(_settle, turn=turn), "kind int, a long, b long"), "contracted")
        rounds.append(got.filter("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("root")))
        now, turn = got.filter("kind = 1").select(F.col("a").alias("lo"), F.col("b").alias("hi")), turn + 1
    label = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("further"))
        label = label.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    label = spill(label, "labels")
    least = label.groupBy("root").agg(F.min("node").alias("least"))
    return spill(label.join(least, "root").select("node", F.col("least").alias("root")), "components")
