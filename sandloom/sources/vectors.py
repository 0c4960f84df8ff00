"""Vector files as a Spark data source: .npy arrays and flat indexes, read by byte ranges, and folders of .npy parts."""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, row long, id long, vector array<float>"
HEADER = "_vectors.json"
# The first four bytes of a flat index by metric (inner product, L2, any), and the length of what stands before its data.
FLAT = (b"IxFI", b"IxF2", b"IxFl")
FLAT_HEAD = 45


def _fs(path: str):
    """The file system of a path and the path in it; a path without a scheme is local or mounted."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Layout:
    """Where the rows of a file lie: shape, type and the byte at which they begin."""

    rows: int
    dim: int
    dtype: str
    start: int


def layout(head: bytes) -> Layout:
    """The layout that the first bytes of a file tell; a file of another form is an error. Pickled objects are never read."""
    if head[:6] == b"\x93NUMPY":
        f = io.BytesIO(head)
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        if dtype.hasobject or dtype.kind not in "fiu" or len(shape) not in (1, 2) or (fortran and len(shape) == 2 and min(shape) > 1):
            raise ValueError(f"not a table of numbers by rows: shape {shape}, type {dtype}")
        return Layout(shape[0], shape[1] if len(shape) == 2 else 1, dtype.str, f.tell())
    if head[:4] in FLAT:
        dim, rows, metric = int.from_bytes(head[4:8], "little"), int.from_bytes(head[8:16], "little"), int.from_bytes(head[33:37], "little")
        start = FLAT_HEAD + (4 if metric > 1 else 0)
        held = int.from_bytes(head[start - 8 : start], "little")
        if held != rows * dim:
            raise ValueError(f"a flat index of {rows} vectors of {dim} numbers that holds {held} numbers")
        return Layout(rows, dim, "<f4", start)
    raise ValueError("neither an .npy array nor a flat index")


@dataclass
class Range(InputPartition):
    """Rows first to last - 1 of one file; ids is the file of their ids, if they have any."""

    path: str
    name: str
    first: int
    last: int
    at: Layout
    ids: str | None


class VectorSource(DataSource):
    """format("vectors"): file, row, id, vector.

    load(path) takes a file, or a folder: one that this source wrote (its header names the parts that count), or else every
    .npy and .index file in it. `id` is the row's number in its file unless ids were written. Option `rows` bounds the rows of a
    task (65536). A path where nothing lies is an empty table. Writing takes columns id (long, may be null) and vector.
    """

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return VectorReader(self.options)

    def writer(self, schema, overwrite: bool):
        return VectorWriter(self.options, schema.fieldNames(), overwrite)


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 65536))
        if self.rows < 1:
            raise ValueError("rows must be 1 or more")

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, root = _fs(self.path)
        info = fs.get_file_info(root)
        if info.type == FileType.NotFound:
            return [Range("", "", 0, 0, Layout(0, 1, "<f4", 0), None)]
        found = [(root, None)]
        if info.type == FileType.Directory:
            if fs.get_file_info(f"{root}/{HEADER}").type == FileType.File:
                with fs.open_input_stream(f"{root}/{HEADER}") as f:
                    found = [(f"{root}/{p['vectors']}", f"{root}/{p['ids']}") for p in json.loads(f.read())["parts"]]
            else:
                found = [(i.path, None) for i in sorted(fs.get_file_info(FileSelector(root)), key=lambda i: i.path) if i.path.endswith((".npy", ".index"))]
        out = []
        for path, ids in found:
            with fs.open_input_file(path) as f:
                size, at = f.size(), layout(f.read(65536))
            if size < at.start + at.rows * at.dim * np.dtype(at.dtype).itemsize:
                raise ValueError(f"{path} ends before its last row")
            out += [Range(path, path.rsplit("/", 1)[-1], a, min(a + self.rows, at.rows), at, ids) for a in range(0, at.rows, self.rows)]
        return out or [Range("", "", 0, 0, Layout(0, 1, "<f4", 0), None)]

    def read(self, part: Range):
        import pyarrow as pa

        if part.first == part.last:
            return
        fs, _ = _fs(self.path)
        width, n = part.at.dim * np.dtype(part.at.dtype).itemsize, part.last - part.first
        step = max(1, (4 << 20) // max(width, 1))
        ids = None
        if part.ids:
            with fs.open_input_file(part.ids) as f:
                at = layout(f.read(65536))
                ids = np.frombuffer(f.read_at(8 * n, at.start + 8 * part.first), at.dtype)
        with fs.open_input_file(part.path) as f:
            for a in range(part.first, part.last, step):
                b = min(a + step, part.last)
                v = np.frombuffer(f.read_at(width * (b - a), part.at.start + width * a), part.at.dtype).astype(np.float32)
                ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * part.at.dim)
                row = np.arange(a, b)
                key = row if ids is None else ids[a - part.first : b - part.first]
                yield pa.RecordBatch.from_arrays([pa.array([part.name] * (b - a)), pa.array(row), pa.array(key.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(v))], ["file", "row", "id", "vector"])


@dataclass
class Written(WriterCommitMessage):
    parts: list


class VectorWriter(DataSourceWriter):
    """Tasks write whole .npy parts under names of their own; the header that names the parts of the tasks that counted is
    moved into place last. Until then readers see what lay there before, and parts of failed tasks are never read."""

    def __init__(self, options, names, overwrite):
        self.path, self.bytes, self.names, self.overwrite = options["path"], int(options.get("part_bytes", 32 << 20)), names, overwrite
        if set(names) - {"id", "vector"} or "vector" not in names:
            raise ValueError("columns must be vector and, if there are ids, id")

    def _put(self, fs, path: str, array: np.ndarray) -> None:
        with fs.open_output_stream(path) as f:
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
            f.write(head.getvalue())
            f.write(np.ascontiguousarray(array).tobytes())

    def write(self, rows):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        parts, ids, vectors, held, dim = [], [], [], 0, None

        def put():
            name = uuid.uuid4().hex
            self._put(fs, f"{root}/vectors-{name}.npy", np.stack(vectors))
            self._put(fs, f"{root}/ids-{name}.npy", np.array(ids, np.int64))
            parts.append({"vectors": f"vectors-{name}.npy", "ids": f"ids-{name}.npy", "rows": len(ids), "dim": dim})

        for r in rows:
            if r["vector"] is None:
                raise ValueError("a row without a vector")
            v = np.array(r["vector"], np.float32)
            if dim is not None and len(v) != dim:
                raise ValueError(f"vectors of {dim} and {len(v)} numbers")
            dim = len(v)
            vectors.append(v)
            ids.append(r["id"] if "id" in self.names else len(ids))
            held += v.nbytes
            if held >= self.bytes:
                put()
                ids, vectors, held = [], [], 0
        if ids:
            put()
        return Written(parts)

    def commit(self, messages):
        from pyarrow.fs import FileType

        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        parts = [p for m in messages if m for p in m.parts]
        if not self.overwrite and fs.get_file_info(f"{root}/{HEADER}").type == FileType.File:
            with fs.open_input_stream(f"{root}/{HEADER}") as f:
                parts = json.loads(f.read())["parts"] + parts
        if len({p["dim"] for p in parts}) > 1:
            raise ValueError("vectors of different lengths")
        new = f"{root}/{HEADER}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps({"rows": sum(p["rows"] for p in parts), "dim": parts[0]["dim"] if parts else 0, "parts": parts}).encode())
        fs.move(new, f"{root}/{HEADER}")

    def abort(self, messages):
        fs, root = _fs(self.path)
        for m in messages:
            for p in m.parts if m else []:
                for name in (p["vectors"], p["ids"]):
                    fs.delete_file(f"{root}/{name}")


def read_vectors(spark: SparkSession, path: str, rows: int = 65536) -> DataFrame:
    """file, row, id, vector of an .npy file, a flat index or a folder of them; nothing there: an empty table."""
    spark.dataSource.register(VectorSource)
    return spark.read.format("vectors").option("rows", rows).load(path)


def write_vectors(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", mode: str = "overwrite") -> None:
    """Ids and vectors as .npy parts below path; a row without an id or a vector is an error.

    mode overwrite replaces what readers see in one step (old parts stay as files), append adds to it; of two writers that append
    at once the later one wins, so use one.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode is overwrite or append, not {mode}")
    vectors.sparkSession.dataSource.register(VectorSource)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    rows.write.format("vectors").mode(mode).save(path)


def vector_lines(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> None:
    """A text file's lines: the id, then the vector's numbers, separated by spaces."""
    numbers = F.transform(F.col(vector).cast("array<double>"), lambda x: F.format_string(f"%.{digits}f", x))
    vectors.filter(F.col(vector).isNotNull()).select(F.concat_ws(" ", F.col(key).cast("string"), F.array_join(numbers, " ")).alias("value")).write.mode("overwrite").text(path)
