"""Exact dedup by an extendible-hash index on shared files.

Each map task folds equal texts together before anything is shuffled, so a text that is a third of all rows costs
one row a task. What is left goes to the owner of its key range. An owner fills buckets under a directory of key
prefixes; a bucket with too many keys is split, the directory doubling when its depth runs out, and entries whose
keys are equal are chained and told apart by their bytes. Directory, buckets and contents are tables in the shared
folder: an index can be opened again, added to and asked.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import parts, release, scratch, slices, spill, table, texts


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space, in front and behind too."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[0] <= 32 and text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


class ExtendibleIndex:
    """A directory of 2**depth slots over the leading bits of unsigned 64-bit keys; several slots may share a bucket."""

    def __init__(self, capacity: int = 256, skip_bits: int = 0, max_depth: int = 40):
        self.capacity, self.skip, self.max_depth = capacity, skip_bits, max_depth
        self.depth = 0
        self.directory: list[list] = [[0, {}]]  # a bucket: its local depth, and for each key the chain of its entries

    def _slot(self, key: int) -> int:
        return ((key << self.skip) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.depth) if self.depth else 0

    def restore(self, buckets: list[tuple[int, int]]) -> None:
        """The directory of buckets that were stored: (local depth, prefix of that many bits), which cover all keys."""
        self.depth = max((d for d, _ in buckets), default=0)
        if self.depth:
            self.directory = [[0, {}]] * (1 << self.depth)
            for d, prefix in buckets:
                width = 1 << (self.depth - d)
                self.directory[prefix * width : (prefix + 1) * width] = [[d, {}]] * width

    def put(self, key: int, entry: list) -> None:
        """An entry that was stored, at the end of its chain."""
        self.directory[self._slot(key)][1].setdefault(key, []).append(entry)

    def find(self, key: int, content: bytes) -> list | None:
        """The entry of a text: directory slot, bucket, chain, then its bytes."""
        return next((e for e in self.directory[self._slot(key)][1].get(key, ()) if e[0] == content), None)

    def add(self, key: int, content: bytes, digest: bytes, row_id: int | None, count: int) -> None:
        bucket = self.directory[self._slot(key)]
        chain = bucket[1].setdefault(key, [])
        for entry in chain:
            if entry[0] == content:
                if row_id is not None:
                    entry[2] = row_id if entry[2] is None else min(entry[2], row_id)
                entry[3] += count
                return
            if digest and entry[1] == digest:  # answers are handed back by digest, which the bytes must bear out
                raise ValueError(f"different texts have the SHA-256 {digest.hex()}")
        chain.append([content, digest, row_id, count])
        while len(bucket[1]) > self.capacity and bucket[0] < self.max_depth:
            self._split(bucket)
            bucket = self.directory[self._slot(key)]

    def _split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        halves = [[bucket[0] + 1, {}], [bucket[0] + 1, {}]]
        shift = 64 - (bucket[0] + 1)
        for key, chain in bucket[1].items():
            halves[(((key << self.skip) & 0xFFFFFFFFFFFFFFFF) >> shift) & 1][1][key] = chain
        for slot in range(len(self.directory)):
            if self.directory[slot] is bucket:
                self.directory[slot] = halves[(slot >> (self.depth - halves[0][0])) & 1]

    def buckets(self):
        seen = set()
        for slot, bucket in enumerate(self.directory):
            if id(bucket) not in seen:
                seen.add(id(bucket))
                yield slot, bucket


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(digest: bytes, bits: int) -> int:
    return (int.from_bytes(digest[:8], "big") >> (64 - bits)) << (64 - bits) if bits else 0


HELD_BYTES = 16 << 20  # texts that a map task folds before it hands them on
OUT_BYTES = 2 << 20  # texts in one record batch

#: The rows of a version, in folders by `part`: directory (depth, prefix), buckets (all but content and bytes), contents (key, chain, content, bytes).
STORED = "depth int, prefix long, key long, chain int, digest binary, content binary, bytes long, keep_id long, group_size long"
#: What owners read, by kind: 0 a bucket of the directory, 1 a stored entry (content only if `held`), 2 a text of the batch.
OWNED = ["kind", "owner", "depth", "prefix", "key", "chain", "digest", "content", "held", "id", "n"]


def _batch(rows: list[tuple], names: list[str], types: tuple):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _digests(source: DataFrame, hash_bits: int) -> DataFrame:
    """doc_id, digest, key, bytes of every row."""

    def run(batches):
        import pyarrow as pa

        for b, contents in parts(batches):
            t = [normalise(x) for x in contents]
            d = [hashlib.sha256(x).digest() for x in t]
            columns = [b.column(0), pa.array(d, pa.binary()), pa.array([_signed(_key(x, hash_bits)) for x in d], pa.int64()), pa.array([len(x) for x in t], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "key", "bytes"])

    return source.mapInArrow(run, "doc_id long, digest binary, key long, bytes long")


def _folded(source: DataFrame, hash_bits: int) -> DataFrame:
    """key, digest, content, doc_id (the smallest), n: a task's equal texts as one row."""

    def fold(batches):
        import pyarrow as pa

        held, size = {}, 0
        names = ["key", "digest", "content", "doc_id", "n"]
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

        def out():
            kept = list(held)
            for i, j in slices(kept, OUT_BYTES):
                yield _batch([(_signed(_key(d, hash_bits)), d, t, x, c) for t in kept[i:j] for d, x, c in (held.pop(t),)], names, types)

        for b, contents in parts(batches):
            for i, t in zip(b.column(0).to_pylist(), contents, strict=True):
                t = normalise(t)
                if (x := held.get(t)) is None:
                    held[t] = [hashlib.sha256(t).digest(), i, 1]
                    size += len(t) + 300
                else:
                    x[1] = i if x[1] is None else x[1] if i is None else min(i, x[1])
                    x[2] += 1
                if size > HELD_BYTES:
                    yield from out()
                    size = 0
        yield from out()
        release()

    return source.mapInArrow(fold, "key long, digest binary, content binary, doc_id long, n long")


def _owners(batches, start, take, end):
    """Walks through rows OWNED, sorted by owner and kind: start(owner) makes an index, take() handles a text of the batch, end() an owner's close."""
    index = at = buckets = None
    for b, contents in parts(batches, text=7):
        kinds, owners, depths, prefixes, keys, chains, digests = (b.column(k).to_pylist() for k in range(7))
        held, ids, counts = (b.column(k).to_pylist() for k in (8, 9, 10))
        for k, o in enumerate(owners):
            if o != at:
                if index is not None:
                    yield from end(index, at, stored)
                index, at, buckets, stored = start(), o, [], {}
            if kinds[k] == 0:
                buckets.append((depths[k] - index.skip, prefixes[k] - (o << (depths[k] - index.skip))))
                continue
            if buckets:
                index.restore(buckets)
                buckets = []
            key = keys[k] & 0xFFFFFFFFFFFFFFFF
            if kinds[k] == 1:
                index.put(key, [contents[k] if held[k] else None, digests[k], ids[k], counts[k]])
                stored[key] = chains[k] + 1
            else:
                yield from take(index, at, key, contents[k], digests[k], ids[k], counts[k])
    if index is not None:
        if buckets:
            index.restore(buckets)
        yield from end(index, at, stored)


class ExactIndex:
    """An extendible-hash index below a path that driver and executors share.

    A version is a folder v=n with the whole directory and all buckets (some 60 bytes a text), and the contents of the texts
    that are new in it; contents of earlier versions are never written again. It counts once it has _SUCCESS, so a batch that
    breaks off leaves the version before it. Owners are prefixes of keys, and there are more of them as the index grows: a
    bucket is named by its depth and prefix in the whole directory. A batch reads the contents of those texts only whose key
    it has too.
    """

    def __init__(self, spark: SparkSession, path: str, hash_bits: int, capacity: int, rows_per_owner: int, bytes_per_owner: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.hash_bits, self.capacity, self.rows_per_owner, self.bytes_per_owner = hash_bits, capacity, rows_per_owner, bytes_per_owner

    @classmethod
    def create(cls, spark: SparkSession, path: str, hash_bits: int = 64, bucket_capacity: int = 256, rows_per_owner: int = 2000, bytes_per_owner: int = 4 << 20) -> ExactIndex:
        """An empty index. An owner gets some rows_per_owner rows or bytes_per_owner bytes, whichever is less. hash_bits shortens keys (tests of chains)."""
        settings = {"hash_bits": hash_bits, "capacity": bucket_capacity, "rows_per_owner": rows_per_owner, "bytes_per_owner": bytes_per_owner}
        spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in settings.items()]).write.parquet(f"{path.rstrip('/')}/settings")
        return cls(spark, path, **settings)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ExactIndex:
        return cls(spark, path, **spark.read.parquet(f"{path.rstrip('/')}/settings").first().asDict())

    def versions(self, whole: bool = True) -> list[int]:
        """Numbers of the versions that were written to their end, or of all."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        system = jvm.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in system.listStatus(jvm.Path(self.path))]
        return sorted(int(f[2:]) for f in found if f.startswith("v=") and (not whole or system.exists(jvm.Path(f"{self.path}/{f}/_SUCCESS"))))

    def _rows(self, versions: list[int], part: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(f"{STORED}, v int, part string").option("basePath", self.path).parquet(*[f"{self.path}/v={v}" for v in versions])
        return rows.filter(F.col("part") == part).drop("v", "part")

    def directory(self) -> DataFrame:
        """depth, prefix of each bucket."""
        return self._rows(self.versions()[-1:], "directory").select("depth", "prefix")

    def buckets(self) -> DataFrame:
        """The entries: depth, prefix (of their bucket), key, chain, digest, keep_id, group_size."""
        return self._rows(self.versions()[-1:], "buckets").drop("content", "bytes")

    def contents(self) -> DataFrame:
        """key, chain, content (the normalised text), bytes."""
        return self._rows(self.versions(), "contents").select("key", "chain", "content", "bytes")

    def _owned(self, source: DataFrame, rows: DataFrame, owner_bits: int) -> DataFrame:
        """Rows OWNED of the index and of a batch, sorted by owner and kind. rows: what _digests gives of the batch."""

        def owner(key):
            return F.shiftrightunsigned(key, 64 - owner_bits)

        none = F.lit(None)
        hit = spill(self.buckets().join(rows.select("key").distinct(), "key", "left_semi").select("key").distinct(), "hit-keys")
        same = self.contents().join(hit, "key", "left_semi").select("key", "chain", "content")
        deep = self.directory().filter(F.col("depth") > owner_bits)  # a bucket that is no smaller than an owner needs no directory
        parts_ = [
            deep.select(F.lit(0).alias("kind"), F.expr(f"shiftright(prefix, depth - {owner_bits})").alias("owner"), "depth", "prefix", none.cast("long").alias("key"), none.cast("int").alias("chain"),
                        none.cast("binary").alias("digest"), F.lit(b"").alias("content"), F.lit(False).alias("held"), none.cast("long").alias("id"), none.cast("long").alias("n")),
            self.buckets().join(same, ["key", "chain"], "left")
            .select(F.lit(1).alias("kind"), owner("key").alias("owner"), none.cast("int").alias("depth"), none.cast("long").alias("prefix"), "key", "chain", "digest",
                    F.coalesce("content", F.lit(b"")).alias("content"), F.col("content").isNotNull().alias("held"), F.col("keep_id").alias("id"), F.col("group_size").alias("n")),
            _folded(source, self.hash_bits)
            .select(F.lit(2).alias("kind"), owner("key").alias("owner"), none.cast("int").alias("depth"), none.cast("long").alias("prefix"), "key", none.cast("int").alias("chain"), "digest", "content",
                    F.lit(True).alias("held"), F.col("doc_id").alias("id"), "n"),
        ]
        if not self.versions():
            parts_ = parts_[2:]
        owned = parts_[0]
        for p in parts_[1:]:
            owned = owned.unionByName(p)
        return owned.select(*OWNED).repartition("owner").sortWithinPartitions("owner", "kind", "key", "chain")

    def _owner_bits(self, rows: DataFrame) -> int:
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        if self.versions():
            m, more = self.contents().agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
            n, size = n + m, size + more
        return min(30, max(5, (n // self.rows_per_owner).bit_length(), (size // self.bytes_per_owner).bit_length()))

    def add(self, docs: DataFrame) -> DataFrame:
        """A batch's rows into the index, as a new version. Returns doc_id, digest of its rows, from the shared folder."""
        source = texts(docs)
        rows = spill(_digests(source, self.hash_bits), "exact-rows")
        owner_bits, capacity = self._owner_bits(rows), self.capacity

        def own(batches):
            import pyarrow as pa

            names = ["depth", "prefix", "key", "chain", "digest", "content", "bytes", "keep_id", "group_size", "part"]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())

            def take(index, at, key, content, digest, row_id, n):
                index.add(key, content, digest, row_id, n)
                return ()

            def end(index, at, stored):
                entries, new = [], []
                for slot, (local, keys) in index.buckets():
                    depth, prefix = owner_bits + local, (at << local) + (slot >> (index.depth - local))
                    entries.append((depth, prefix, *[None] * 7, "directory"))
                    for key, chain in keys.items():
                        entries += [(depth, prefix, _signed(key), k, e[1], None, None, e[2], e[3], "buckets") for k, e in enumerate(chain)]
                        new += [(key, k, e[0]) for k, e in enumerate(chain) if k >= stored.get(key, 0)]
                yield _batch(entries, names, types)
                for i, j in slices([t for _, _, t in new], OUT_BYTES):
                    yield _batch([(None, None, _signed(key), k, None, t, len(t), None, None, "contents") for key, k, t in new[i:j]], names, types)

            yield from _owners(batches, lambda: ExtendibleIndex(capacity, owner_bits, 62 - owner_bits), take, end)
            release()

        version = max(self.versions(whole=False), default=0) + 1
        written = self._owned(source, rows, owner_bits).mapInArrow(own, f"{STORED}, part string")
        written.write.partitionBy("part").parquet(f"{self.path}/v={version}")
        return rows.select("doc_id", "digest")

    def lookup(self, docs: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, text_sha256 of each row of docs: the entry that has its text, found by directory slot, bucket, chain and bytes; nulls if there is none."""
        source = texts(docs)
        rows = spill(_digests(source, self.hash_bits), "exact-rows")
        owner_bits, capacity = self._owner_bits(rows), self.capacity

        def ask(batches):
            import pyarrow as pa

            names, types = ["g_digest", "keep_id", "group_size"], (pa.binary(), pa.int64(), pa.int64())
            told = set()

            def take(index, at, key, content, digest, row_id, n):
                entry = index.find(key, content)
                if entry is not None and digest not in told:
                    told.add(digest)
                    yield _batch([(digest, entry[2], entry[3])], names, types)

            def end(index, at, stored):
                told.clear()
                return ()

            yield from _owners(batches, lambda: ExtendibleIndex(capacity, owner_bits, 62 - owner_bits), take, end)
            release()

        found = self._owned(source, rows, owner_bits).mapInArrow(ask, "g_digest binary, keep_id long, group_size long")
        return rows.join(found, rows.digest == found.g_digest, "left").select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, hash_bits: int = 64, bucket_capacity: int = 256, rows_per_owner: int = 2000, bytes_per_owner: int = 4 << 20, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The rows are added to an index in `batches` batches, by a hash of their doc_id; the index is opened anew for each.
    An owner gets some rows_per_owner rows or bytes_per_owner bytes, whichever is less, so that its part of the index stays small.

    Null text counts as empty, and empty texts are equal. Rows of one doc_id and one text each count towards
    group_size and share `kept`. A null doc_id never is the one that stays, unless its group has no other.
    An empty table gives an empty result; other columns are not looked at. hash_bits shortens the keys (tests of chains).
    """
    spark = docs.sparkSession
    path = scratch(spark, "exact-index")
    ExactIndex.create(spark, path, hash_bits, bucket_capacity, rows_per_owner, bytes_per_owner)
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches))
    rows = None
    for k in range(batches):
        added = ExactIndex.open(spark, path).add(docs.filter(turn == k))
        rows = added if rows is None else rows.unionByName(added)
    groups = ExactIndex.open(spark, path).buckets().filter("group_size > 1").select(F.col("digest").alias("g_digest"), "keep_id", "group_size")
    # Owners have compared bytes, and made sure that a digest is one text's. Only groups of two and more are joined; one hot digest is split by the skew join.
    joined = rows.join(groups, rows.digest == groups.g_digest, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
