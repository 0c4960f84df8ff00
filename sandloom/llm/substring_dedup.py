"""Substring dedup with a log-structured fingerprint index.

A window is SIZE neighbouring words of a document. Of the windows' inner grams of GRAM words, only each window's smallest
by hash, its anchor, is put into the index: windows of equal words have the same anchor, and neighbouring windows mostly
share one. The index is a folder of immutable runs, each a bucketed and sorted table, of three families:

  texts    a hash of a whole word sequence, and the first document that has it
  anchors  an anchor with the smallest and the largest place (a fingerprint of text and position) at which it stands
  windows  two hashes of all words of a window, and the place of the first one; only windows whose anchor stands twice

A batch of documents becomes a run of each family. Its anchors are merge-joined with those of the runs before it. Anchors
that now stand at two places or more are marked; windows without a marked anchor can't repeat. Where a marked anchor stood at
one place until now, the one earlier document is read again for its windows, which become a run too. The batch's windows
with a marked anchor are then judged against the window runs alone: equal windows are those whose two 64-bit hashes of all
words are equal, the first of them stays, and the words of all later ones are removed. Runs are dealt by their key and
sorted, so only the batch is shuffled. Too many runs of a family are compacted into one.

Map tasks fold equal windows before the shuffle, so a passage of very many documents is a few rows a task after it.
Documents that equal an earlier one as a whole are found by their text's hash and need no windows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle import indexed
from ._common import Bloom, file_system, mix, parts, scratch, spill, table, texts, window_hashes, words_of_batch

SIZE, GRAM = 20, 10
NO_ID = -(1 << 63)  # stands for a null doc_id, which comes before all others
BLOOM_BITS = 25
_U = np.uint64


def _batch(cols: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))


def sequence_keys(h: np.ndarray, g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole word sequence."""
    place = np.arange(len(h), dtype=_U) - np.repeat(first[:-1], np.diff(first)).astype(_U)
    n = np.diff(first)
    out = []
    for x, salt in ((h, 3), (g, 7)):
        y = mix(x + mix(place * _U(2) + _U(salt)))
        total = np.add.reduceat(np.append(y, _U(0)), first[:-1]) if len(n) else np.zeros(0, _U)
        out.append(mix(np.where(n > 0, total, _U(0)) + n.astype(_U)).view(np.int64))
    return out[0], out[1]


def anchors(h: np.ndarray, first: np.ndarray):
    """Starts of all windows, and for each the place and hash of its anchor (the leftmost smallest inner gram)."""
    n = np.diff(first)
    ok = np.zeros(len(h), dtype=bool)
    for a, k in zip(first[:-1][n >= SIZE].tolist(), n[n >= SIZE].tolist(), strict=True):
        ok[a : a + k - SIZE + 1] = True
    starts = np.flatnonzero(ok)
    if not len(starts):
        return starts, starts, np.zeros(0, _U)
    grams = window_hashes(h, GRAM)
    best, at = grams[starts].copy(), starts.copy()
    for k in range(1, SIZE - GRAM + 1):
        x = grams[starts + k]
        less = x < best
        best[less] = x[less]
        at[less] = starts[less] + k
    return starts, at, best


def _keys(batches):
    import pyarrow as pa

    for b, t in parts(batches):
        h, first, g = words_of_batch(t, second=True)
        k1, k2 = sequence_keys(h, g, first)
        yield pa.RecordBatch.from_arrays([b.column(0).fill_null(NO_ID), pa.array(k1), pa.array(k2)], ["doc", "k1", "k2"])


def _anchor_rows(batches, limit: int = 1 << 20):
    """(h, lo, hi, doc): anchors of a task with their smallest and largest place and smallest document, folded before the shuffle."""
    held, size = [], 0

    def out():
        a, p, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, p, a))
        a, p, d = a[order], p[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        return _batch({"h": a[at].view(np.int64), "lo": p[at], "hi": p[np.append(at[1:], len(a)) - 1], "doc": d[at]})

    for b, t in parts(batches):
        ids = b.column(0).fill_null(NO_ID).to_numpy()
        h, first, g = words_of_batch(t, second=True)
        k1, _ = sequence_keys(h, g, first)
        _, at, best = anchors(h, first)
        once = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        at, best = at[once], best[once]
        doc = np.searchsorted(first, at, side="right") - 1
        held.append((best, mix(k1[doc].view(_U) + (at - first[doc]).astype(_U)).view(np.int64), ids[doc]))
        size += len(best)
        if size > limit:
            yield out()
            held, size = [], 0
    if size:
        yield out()


class FingerprintIndex:
    """Immutable bucketed runs below a folder, named by a manifest there; a new index over the same folder goes on with them.

    add() takes a batch of documents in. An earlier batch comes before a later one, whatever the ids in them; inside a batch
    the smaller doc_id comes first.
    """

    KEYS = {"texts": ("k1", "k2"), "anchors": ("h",), "windows": ("w", "v")}

    def __init__(self, spark, folder: str, buckets: int | None = None, most_runs: int = 4, bloom_bits: int = BLOOM_BITS, broadcast_ids: int = 1 << 19):
        self.spark, self.folder, self.most, self.bits, self.broadcast_ids = spark, folder, most_runs, bloom_bits, broadcast_ids
        # As many buckets as a shuffle has partitions, unless told otherwise: what a task of a shuffle has is one bucket.
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.state = self._manifest() or {"version": 0, "buckets": buckets, "runs": {f: [] for f in self.KEYS}}
        self.buckets = self.state["buckets"]
        self.tables = {f: [self._register(f, r) for r in runs] for f, runs in self.state["runs"].items()}

    def _manifest(self) -> dict | None:
        """The newest list of runs: runs that it doesn't name, of an add() that broke off, don't count."""
        from pyarrow import fs

        system, path = file_system(self.folder)
        found = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("manifest-")]
        if not found:
            return None
        with system.open_input_stream(max(found)) as f:
            return json.loads(f.read())

    def _publish(self) -> None:
        self.state["version"] += 1
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/part-of-manifest") as f:
            f.write(json.dumps(self.state).encode())
        system.move(f"{path}/part-of-manifest", f"{path}/manifest-{self.state['version']:09d}.json")

    def _register(self, family: str, run: dict) -> DataFrame:
        """The table of a run that another session wrote."""
        keys = ", ".join(self.KEYS[family])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run['table']} ({run['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{run['path']}'")
        return self.spark.table(run["table"])

    def _put(self, family: str, rows: DataFrame, dealt: bool = False) -> DataFrame:
        """A new run; dealt: the rows lie in their buckets' partitions already."""
        name, keys = f"sandloom_{family}_{uuid.uuid4().hex}", self.KEYS[family]
        path = f"{self.folder}/{name}"
        rows = rows if dealt else rows.repartition(self.buckets, *keys)
        rows.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        self.state["runs"][family].append({"table": name, "path": path, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in run.schema)})
        self.tables[family].append(run)
        return run

    def _seen(self, rows: DataFrame, runs: list[DataFrame], family: str, **take: str) -> DataFrame:
        """rows with columns of the earlier runs (null where no run has the key): take maps a new name to min/max(column)."""
        keys, got = list(self.KEYS[family]), {name: [] for name in take}
        for k, run in enumerate(runs):
            run = run if family != "windows" else run.filter("n = 0")
            rows = rows.join(run.select(*keys, *[F.col(c.split("(")[1][:-1]).alias(f"{name}_{k}") for name, c in take.items()]), keys, "left")
            for name in take:
                got[name].append(F.col(f"{name}_{k}"))
        fold = {"min": F.least, "max": F.greatest, "first": F.coalesce}
        one = {name: (fold[take[name].split("(")[0]](*c) if len(c) > 1 else c[0] if c else F.lit(None).cast("long")) for name, c in got.items()}
        old = [c for c in rows.columns if not any(c in [f"{name}_{k}" for k in range(len(runs))] for name in take)]
        return rows.select(*old, *[c.alias(name) for name, c in one.items()])

    def compact(self, family: str) -> None:
        """All runs of a family as one."""
        old, runs = self.tables[family], self.state["runs"][family]
        rows = reduce(DataFrame.unionByName, old).repartition(self.buckets, *self.KEYS[family])
        if family == "anchors":
            rows = rows.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("doc").alias("doc"))
        elif family == "windows":
            rows = rows.filter("n = 0")
        self.tables[family], self.state["runs"][family] = [], []
        self._put(family, rows, dealt=True)
        self._publish()
        self._drop(runs)

    def _drop(self, runs: list[dict]) -> None:
        from pyarrow import fs

        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['table']}")
            system, path = file_system(run["path"])
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_dir(path)

    def close(self) -> None:
        """Forget the tables' names in this session; the files stay for another index over the folder."""
        for runs in self.state["runs"].values():
            for run in runs:
                self.spark.sql(f"DROP TABLE IF EXISTS {run['table']}")

    def delete(self) -> None:
        for runs in self.state["runs"].values():
            self._drop(runs)
        system, path = file_system(self.folder)
        system.delete_dir(path)

    def add(self, docs: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Takes in docs; gives (doc, start, n): stretches of n windows that came before; and (doc): copies of whole texts.

        history: earlier batches' documents, of which only those are read on that hold the one earlier place of an anchor
        that now stands twice. An index without any runs needs none. Nothing is published before the batch is complete.
        """
        source, before = texts(docs), {f: list(t) for f, t in self.tables.items()}
        keys = spill(source.mapInArrow(_keys, "doc long, k1 long, k2 long"), "sequence-keys")
        own = self._put("texts", keys.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count("*").alias("n")))
        twice = self._seen(own.select("k1", "k2", F.col("doc").alias("own"), "n"), before["texts"], "texts", old="first(doc)").filter("n > 1 or old is not null")
        copies = spill(keys.join(twice, ["k1", "k2"]).filter("doc <> coalesce(old, own)").select("doc").distinct(), "copies")

        run = self._put("anchors", source.mapInArrow(_anchor_rows, "h long, lo long, hi long, doc long").repartition(self.buckets, "h").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("doc").alias("doc")), dealt=True)
        met = self._seen(run.drop("doc"), before["anchors"], "anchors", lo_old="min(lo)", hi_old="max(hi)", doc_old="first(doc)")
        marked = spill(met.filter("least(lo, lo_old) <> greatest(hi, hi_old)").select("h", "lo_old", "hi_old", "doc_old"), "marked")
        again = marked.filter("lo_old = hi_old").select("h", "doc_old")
        if history is not None and again.head(1):
            ids = spill(again.select("doc_old").distinct(), "again")
            ids = F.broadcast(ids) if ids.count() <= self.broadcast_ids else ids
            old = texts(history)
            old = old.join(ids, F.coalesce("doc_id", F.lit(NO_ID).cast("long")) == F.col("doc_old"), "left_semi")
            first = self._with_marks(old, again).filter("n = 0").groupBy("w", "v").agg(F.min(F.struct("doc", "start")).alias("p"))
            first = self._seen(first.select("w", "v", "p.doc", "p.start", F.lit(0).cast("long").alias("n")), before["windows"], "windows", had="first(doc)")
            before["windows"].append(self._put("windows", first.filter("had is null").drop("had")))

        dealt = self._with_marks(source, marked).repartition(self.buckets, "w", "v")
        seen = self._seen(dealt, before["windows"], "windows", doc_old="first(doc)", start_old="first(start)")
        judged = seen.select("w", "v", "doc", "start", "n", "doc_old", "start_old").sortWithinPartitions("w", "v", "doc", "start")
        own = self._put("windows", judged.mapInArrow(_judge, "w long, v long, doc long, start long, n long"), dealt=True)
        late = spill(own.filter("n > 0").select("doc", "start", "n"), "late")
        self._publish()
        for family, runs in self.state["runs"].items():
            if len(runs) > self.most:
                self.compact(family)
        return late, copies

    def _with_marks(self, source: DataFrame, marked: DataFrame) -> DataFrame:
        """Windows (w, v, doc, start, n) whose anchor is in marked(h).

        The marks are a bit map of fixed size. What it lets through by chance is harmless while it is sparse; if there are so many marks
        that it isn't, the windows are joined with the marks.
        """
        bloom = self.spark.sparkContext.broadcast(Bloom.of_slots(marked, "h", _slots, self.bits))
        rows = source.mapInArrow(partial(_windows, bloom=bloom), "w long, v long, doc long, start long, n long, h long")
        if bloom.value.fill() > 0.25:
            rows = rows.filter("n > 0").unionByName(rows.filter("n = 0").join(marked.select("h").distinct(), "h", "left_semi").select(*rows.columns))
        return rows.drop("h")


def _fold(w, v, d, s):
    """Rows sorted by (w, v, d, s): where a window's first row is."""
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
    return new


def _runs_of(d, s):
    """(doc, start, length) of stretches of neighbouring starts."""
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if not len(d):
        return d, s, s
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]))
    last = np.append(new[1:], len(d)) - 1
    return d[new], s[new], s[last] - s[new] + 1


def _windows(batches, bloom=None, limit: int = 1 << 20):
    """Rows (w, v, doc, start, n, h): with n = 0 the first window of its words in this task, else n later ones in a row; h is the anchor."""
    held, size, seen = [], 0, {}

    def out():
        w, v, d, s, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((s, d, v, w))
        w, v, d, s, h = w[order], v[order], d[order], s[order], h[order]
        new = _fold(w, v, d, s)
        yield _batch({"w": w[new].view(np.int64), "v": v[new].view(np.int64), "doc": d[new], "start": s[new], "n": np.zeros(int(new.sum()), np.int64), "h": h[new].view(np.int64)})
        # a row with the very place of the first one is the same document again
        head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
        late = ~new & ((d != d[head]) | (s != s[head]))
        d, s, n = _runs_of(d[late], s[late])
        if len(d):
            r = mix(d.view(_U) * _U(31) + s.astype(_U)).view(np.int64)
            yield _batch({"w": r, "v": r, "doc": d, "start": s, "n": n, "h": r})

    for b, t in parts(batches):
        ids = b.column(0).fill_null(NO_ID).to_numpy()
        h, first, g = words_of_batch(t, second=True)
        k1, _ = sequence_keys(h, g, first)
        live = np.ones(len(t), dtype=bool)
        for k, (key, doc) in enumerate(zip(k1.tolist(), ids.tolist(), strict=True)):
            if seen.get(key, doc + 1) <= doc:
                live[k] = False  # equals an earlier document of this task: its windows are all late, which its class says
            elif len(seen) < 500_000:
                seen[key] = doc
        starts, at, best = anchors(h, first)
        if not len(starts):
            continue
        doc = np.searchsorted(first, starts, side="right") - 1
        hit = bloom.value.has(_slots(best, bloom.value.bits)) & live[doc]
        starts, doc, best = starts[hit], doc[hit], best[hit]
        if len(starts):
            held.append((window_hashes(h, SIZE)[starts], window_hashes(g, SIZE, 5)[starts], ids[doc], starts - first[doc], best))
            size += len(starts)
        if size > limit:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) >> _U(64 - bits)).astype(np.int64)


def _judge(batches):
    """Of rows (w, v, doc, start, n, doc_old, start_old) sorted by (w, v, doc, start): with n = 0 the windows that nothing came
    before; with n > 0 stretches of those that aren't their window's first."""
    last = None
    for x in batches:
        if not x.num_rows:
            continue
        w, v, d, s, n = (x.column(k).to_numpy() for k in range(5))
        old = ~x.column(5).is_null().to_numpy(zero_copy_only=False)
        od, os = (x.column(k).fill_null(0).to_numpy() for k in (5, 6))
        done = n > 0
        firsts = np.zeros(0, np.int64)
        out = [(w[done], v[done], d[done], s[done], n[done])]
        w, v, d, s, old, od, os = (c[~done] for c in (w, v, d, s, old, od, os))
        if len(w):
            new = _fold(w, v, d, s)
            goes_on = last is not None and (w[0], v[0]) == last[:2]
            head = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
            fd, fs = np.where(old, od, d[head]), np.where(old, os, s[head])
            if goes_on:
                mine = (np.cumsum(new) == 1) & ~old
                fd, fs = np.where(mine, last[2], fd), np.where(mine, last[3], fs)
                new[0] = False
            last = (w[-1], v[-1], fd[-1], fs[-1])
            firsts = np.flatnonzero(new & ~old)
            late = (d != fd) | (s != fs)
            ld, ls, ln = _runs_of(d[late], s[late])
            # a stretch lies where its partition's windows lie
            out.append((np.full(len(ld), w[0]), np.full(len(ld), v[0]), ld, ls, ln))
            out.append((w[firsts], v[firsts], d[firsts], s[firsts], np.zeros(len(firsts), np.int64)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        if len(cols[0]):
            yield _batch(dict(zip(("w", "v", "doc", "start", "n"), cols, strict=True)))


def _results(rows):
    import pyarrow as pa

    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays([*cols[:4], cols[4].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _untouched(batches, bloom=None):
    """Results of documents from which nothing can be cut, by the bit map of the others."""
    for b, texts_ in parts(batches):
        free = ~bloom.value.has(b.column(2).to_numpy())
        rows = []
        for doc, t, ok in zip(b.column(0).to_pylist(), texts_, free.tolist(), strict=True):
            if ok:
                words = t.split()
                kept = b" ".join(words)
                rows.append((doc, len(words), 0, hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            yield _results(rows)


def _touched(batches, bloom=None):
    """(doc_id, text) of the documents that the bit map lets through."""
    import pyarrow as pa

    for b, _ in parts(batches):
        yield b.select([0, 1]).filter(pa.array(bloom.value.has(b.column(2).to_numpy())))


def _cut(batches):
    """Kept words of each text: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    for b, texts_ in parts(batches):
        rows = []
        for doc, t, whole, spans in zip(b.column(0).to_pylist(), texts_, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = t.split()
            n = len(words)
            if whole and n >= SIZE:
                words = []
            elif spans:
                edge = np.zeros(n + 1, dtype=np.int64)
                for x in spans:
                    edge[x["start"]] += 1
                    edge[min(n, x["start"] + x["n"] + SIZE - 1)] -= 1
                gone = np.cumsum(edge)[:n] > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            rows.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
        yield _results(rows)


def cut(docs: DataFrame, late: DataFrame, copies: DataFrame, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """docs without the stretches late(doc, start, n) and without copies(doc): doc_id, n_words, n_removed, kept_sha256, kept_text.

    Only documents with something to cut are shuffled.
    """
    # At most as many spans as a document has words.
    spans = late.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    known = spill(spans.join(copies.withColumn("whole", F.lit(True)), "doc", "full").select(F.col("doc").alias("s_id"), F.coalesce("whole", F.lit(False)).alias("whole"), "spans"), "spans")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(known, "s_id", bloom_bits))
    own = F.coalesce("doc_id", F.lit(NO_ID).cast("long"))
    source = texts(docs).select("doc_id", "text", F.pmod(F.xxhash64(own), F.lit(1 << bloom_bits)).alias("slot"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    free = source.mapInArrow(partial(_untouched, bloom=bloom), kind)
    rest = source.mapInArrow(partial(_touched, bloom=bloom), "doc_id long, text string")
    rest = rest.join(known, own == known.s_id, "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    return free.unionByName(rest.mapInArrow(_cut, kind))


def substring_dedup(docs: DataFrame, batches: int = 2, bloom_bits: int = BLOOM_BITS, most_runs: int = 2, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    The documents come to an index in `batches` batches, smaller ids first. Null and empty texts have no words. Rows are judged,
    not ids: rows with the same doc_id, or none, but other texts are documents of their own, in an order that the texts'
    hashes give. A row that repeats a doc_id and its text is the same document and gets the same result. A null doc_id counts
    as smaller than all others. An empty table gives an empty result; other columns are not looked at.
    """
    if docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").head(1):
        return _by_row(docs, batches, bloom_bits, most_runs, buckets)
    return _by_id(docs, batches, bloom_bits, most_runs, buckets)


def _by_row(docs: DataFrame, *options) -> DataFrame:
    """Of a table with repeated ids: each document (doc_id and text) gets its place in the order of all for its id. Texts are copied once."""
    named = texts(docs).withColumn("h", F.unhex(F.sha2("text", 256)))
    ids = named.select(F.lit(0).alias("all"), "doc_id", "h").distinct()
    ids = spill(indexed(ids, "all", ["doc_id", "h"]).select(F.col("doc_id").alias("i_id"), F.col("h").alias("i_h"), "idx"), "ids")
    keyed = named.join(ids, named.doc_id.eqNullSafe(ids.i_id) & (named.h == ids.i_h)).select(F.col("idx").alias("doc_id"), "text")
    out = _by_id(spill(keyed, "documents"), *options)
    return out.join(ids, out.doc_id == ids.idx).select(ids.i_id.alias("doc_id"), *[c for c in out.columns if c != "doc_id"])


def _by_id(docs: DataFrame, batches: int, bloom_bits: int, most_runs: int, buckets: int | None) -> DataFrame:
    spark = docs.sparkSession
    index = FingerprintIndex(spark, scratch(spark, "fingerprints"), buckets, most_runs, bloom_bits)
    edges = docs.selectExpr(f"percentile_approx(cast(doc_id as bigint), array({', '.join(str(k / batches) for k in range(1, batches))}))").first()[0] or [] if batches > 1 else []
    bounds = [None, *edges, None]
    found = []
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part, earlier = docs, None
        if hi is not None:
            part = part.filter(own <= hi)
        if lo is not None:
            part, earlier = part.filter(own > lo), docs.filter(own <= lo)
        found.append(index.add(part, earlier))
    index.delete()
    late, copies = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
    return cut(docs, late, copies, bloom_bits)


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i : i + 19], ' '))) AS ks FROM w),
x AS (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM v),
late AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, (SELECT unnest(range(20)) AS j)),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s FROM e ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
