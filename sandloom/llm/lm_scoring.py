"""Language-model scoring by prediction by partial matching (PPM) over bytes, pretrained on the training part.

A text is its lower-cased words joined by single spaces and closed by a line feed; before it stand ORDER line feeds, so
each byte has a whole context. All (context, byte) strings of ORDER + 1 bytes are counted over all training texts, map
tasks adding up before the shuffle. Shorter contexts are suffixes, so tasks that own the strings of some two-byte
suffixes hold whole subtries: there, the probability of each string is worked out once, by method C: a context of n
bytes, d different, gives byte x count(x) / (n + d) and escape d / (n + d); after an escape, the bytes that the longer
context had are excluded from the shorter one; after order 0, the bytes left are equally likely. Strings that only
scored texts have are looked up the same way. A text's score is the sum over its bytes.

Scoring looks strings up in a hash table. If there are at most `table_most` strings, all are in it; else those that
make up at least 1 / table_most of all occurrences (so no more than table_most are), and the others are shuffled and
joined. Word counts for the base score are handled likewise, with `words_most`.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod_py, slices, spill, table, text_bytes, texts, words_of_batch

ORDER = 5
_U = np.uint64
END_TOKEN = np.int64(-0x5A11D00D)


def plain(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def strings(texts_: list[bytes]):
    """For each byte of the texts, the ORDER bytes before it and itself as one number; and where each text begins."""
    pad = b"\n" * ORDER
    blob = np.frombuffer(b"".join(pad + plain(t) for t in texts_), np.uint8)
    sizes = np.fromiter((len(plain(t)) for t in texts_), np.int64, len(texts_))
    v = np.zeros(len(blob), dtype=_U)
    for k in range(ORDER + 1):
        v[k:] |= blob[: len(blob) - k].astype(_U) << _U(8 * k)
    keep = np.ones(len(blob), dtype=bool)
    begin = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    for k in range(ORDER):
        keep[begin + k] = False
    return v[keep], np.concatenate([[0], np.cumsum(sizes)])


class Lookup:
    """Open addressing over 64-bit keys, for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.5 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, dtype=_U), np.zeros((1 << self.bits, *values.shape[1:]), dtype=values.dtype)
        self.used = np.zeros(1 << self.bits, dtype=bool)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            _, first = np.unique(s, return_index=True)
            first = first[~self.used[s[first]]]
            won = todo[first]
            self.keys[slot[won]], self.values[slot[won]], self.used[slot[won]] = keys[won], values[won], True
            lost = np.ones(len(todo), dtype=bool)
            lost[first] = False
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray):
        """(values, found); values of keys that aren't there are of no meaning."""
        slot = self._slot(keys)
        found = self.used[slot] & (self.keys[slot] == keys)
        todo = np.flatnonzero(~found & self.used[slot])
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            s = slot[todo]
            hit = self.keys[s] == keys[todo]
            found[todo[hit & self.used[s]]] = True
            todo = todo[~hit & self.used[s]]
        return self.values[slot], found


def _sum_by(keys: np.ndarray, *counts: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, *counts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *(np.add.reduceat(c[order], at) for c in counts)


def _batch(cols: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))


def _gather(batches, mode=None, limit: int = 1 << 20):
    """Rows (kind, key, train, total): kind 0 words, 1 strings. Added up in a task until it holds some millions of keys."""
    held = {0: [], 1: []}

    def total(kind):
        keys, a, b = (np.concatenate(x) for x in zip(*held[kind], strict=True))
        return _sum_by(keys, a, b)

    def out(kind):
        keys, a, b = total(kind)
        return _batch({"kind": np.full(len(keys), kind, np.int32), "key": keys.view(np.int64), "train": a, "total": b})

    for b in batches:
        ids, t = b.column(0).to_pylist(), text_bytes(b.column(1))
        for i, j in slices(t, 1 << 20):
            train = np.array([crc_mod_py(k) != 1 for k in ids[i:j]])
            h, first = words_of_batch(t[i:j], lower=True)
            v, begin = strings(t[i:j])
            for kind, keys, at in ((0, h, first), (1, v, begin)):
                for part, is_train in ((np.repeat(train, np.diff(at)), 1), (~np.repeat(train, np.diff(at)), 0)):
                    x = np.sort(keys[part])
                    if len(x):
                        pos = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                        n = np.diff(np.concatenate([pos, [len(x)]]))
                        held[kind].append((x[pos], n * is_train, n))
                if len(held[kind]) >= 8 or sum(len(x) for x, _, _ in held[kind]) > limit:
                    held[kind] = [total(kind)] if held[kind] else []
                    if held[kind] and len(held[kind][0][0]) > limit // 2:
                        yield out(kind)
                        held[kind] = []
    for kind in (0, 1):
        if held[kind]:
            yield out(kind)


LOW = 2  # the highest order whose strings all owners get


def _at(level: tuple, x: np.ndarray) -> np.ndarray:
    """How often the strings x occur."""
    s, c = level[:2]
    if not len(s):
        return np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(s, x), len(s) - 1)
    return np.where(s[i] == x, c[i], 0)


def _level(s: np.ndarray, c: np.ndarray) -> tuple:
    """Of the strings of an order and their counts: those that occur, and for each context its occurrences and how many bytes follow it."""
    s, c = _sum_by(s, c)
    s, c = s[c > 0], c[c > 0]
    return s, c, *_sum_by(s >> _U(8), c, np.ones(len(c), np.int64))


def _gone(level: tuple, below: tuple, k: int) -> tuple:
    """For each context of order k: occurrences and number of the bytes that it excludes on the order below."""
    s = level[0]
    return _sum_by(s >> _U(8), _at(below, s & _U((1 << 8 * k) - 1)), np.ones(len(s), np.int64))


def low_orders(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """For orders 0 to LOW, from all strings of LOW + 1 bytes: (what _level gives, what _gone gives)."""
    levels = [_level(keys & _U((1 << 8 * (k + 1)) - 1), counts) for k in range(LOW + 1)]
    return [(x, _gone(x, levels[k - 1], k) if k else None) for k, x in enumerate(levels)]


def ppm(keys: np.ndarray, counts: np.ndarray, low: list[tuple]) -> np.ndarray:
    """log10 probability of the last byte of each string after its context.

    keys, counts: all strings of ORDER + 1 bytes with these LOW + 1 last bytes of the context (count 0: to be scored only).
    low: low_orders() of everything.
    """
    levels = [x for x, _ in low] + [_level(keys & _U((1 << 8 * (k + 1)) - 1), counts) for k in range(LOW + 1, ORDER + 1)]
    logp = np.zeros(len(keys))
    open_ = np.ones(len(keys), dtype=bool)
    without_n, without_d = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        s, c, context, n, d = levels[k]
        x = keys & _U((1 << 8 * (k + 1)) - 1)
        mine = x >> _U(8)
        i = np.minimum(np.searchsorted(context, mine), max(0, len(context) - 1))
        seen = context[i] == mine if len(context) else np.zeros(len(keys), dtype=bool)
        left_n = np.where(seen, n[i] if len(n) else 0, 0) - np.where(seen, without_n, 0)
        left_d = np.where(seen, d[i] if len(d) else 0, 0) - np.where(seen, without_d, 0)
        use = open_ & seen & (left_d > 0)
        count = _at(levels[k], x)
        hit = use & (count > 0)
        logp[hit] += np.log10(count[hit] / (left_n[hit] + left_d[hit]))
        miss = use & (count == 0)
        logp[miss] += np.log10(left_d[miss] / (left_n[miss] + left_d[miss]))
        open_ &= ~hit
        if k:
            # what a seen context of this order excludes on the order below
            ctx, gone_n, gone_d = low[k][1] if k <= LOW else _gone(levels[k], levels[k - 1], k)
            i = np.minimum(np.searchsorted(ctx, mine), max(0, len(ctx) - 1))
            there = ctx[i] == mine if len(ctx) else np.zeros(len(keys), dtype=bool)
            without_n = np.where(there, gone_n[i] if len(ctx) else 0, without_n * 0)
            without_d = np.where(there, gone_d[i] if len(ctx) else 0, without_d * 0)
        else:
            logp[open_] -= np.log10(np.maximum(1, 256 - len(s)))
    return logp


def _own(key, groups, low=None):
    """Probabilities of the strings of one owner, as precise as a look-up table has them."""
    import pyarrow as pa

    keys, train, total = (groups.column(k).to_numpy() for k in ("key", "train", "total"))
    keys = keys.view(_U)
    order = np.argsort(keys)
    logp = ppm(keys[order], train[order], low.value).astype(np.float32).astype(np.float64)
    return pa.table({"key": keys[order].view(np.int64), "logp": logp, "total": total[order]})


_tables: dict = {}


def _worker_table(name: str, broadcast):
    """One hash table a worker for each broadcast."""
    if _tables.get(name, (None,))[0] != broadcast.value[0]:
        _tables[name] = (broadcast.value[0], Lookup(broadcast.value[1].view(_U), broadcast.value[2]))
    return _tables[name][1]


def _score(batches, words=None, trie=None, whole=None):
    """Rows (doc_id, row, kind, key, n, known, base, score): kind 0 is a text with what the tables know; 1 and 2 are words
    and strings that they don't have, to be joined."""
    import pyarrow as pa

    for b in batches:
        ids, t, row = b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_numpy()
        for i, j in slices(t, 1 << 19):
            w, g = _worker_table("words", words), _worker_table("trie", trie)
            h, first = words_of_batch(t[i:j], lower=True)
            v, begin = strings(t[i:j])
            wv, wf = w.find(h)
            gv, gf = g.find(v)
            n = np.diff(first)
            base = np.add.reduceat(np.append(np.where(wf, wv, 0.0), 0.0), first[:-1]) * (n > 0)
            known = np.add.reduceat(np.append((wf & (wv > whole.value[2])).astype(np.int64), 0), first[:-1]) * (n > 0)
            score = np.add.reduceat(np.where(gf, gv.astype(np.float64), 0.0), begin[:-1])
            at = row[i:j]
            frames = [{"row": at, "kind": np.zeros(j - i, np.int32), "key": np.zeros(j - i, np.int64), "n": n, "known": known, "base": base, "score": score}]
            for kind, keys, found, starts in ((1, h, wf, first), (2, v, gf, begin)):
                if not whole.value[kind - 1] and not found.all():
                    lost = np.flatnonzero(~found)
                    who = at[np.searchsorted(starts, lost, side="right") - 1]
                    frames.append({"row": who, "kind": np.full(len(lost), kind, np.int32), "key": keys[lost].view(np.int64), "n": np.ones(len(lost), np.int64), "known": np.zeros(len(lost), np.int64), "base": np.zeros(len(lost)), "score": np.zeros(len(lost))})
            for k, f in enumerate(frames):
                doc = pa.array(ids[i:j], pa.int64()) if k == 0 else pa.nulls(len(f["row"]), pa.int64())
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x) for x in f.values())], ["doc_id", *f])


def lm_scores(docs: DataFrame, table_most: int = 1 << 21, words_most: int = 1 << 20, holdout: int = 5, strings_per_owner: int = 50_000) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone. Rows that repeat a doc_id are counted and scored each. A null doc_id
    counts as the text 'null' for the split. With nothing to train on, every byte has probability 1/256. An empty table
    gives an empty result; other columns are not looked at. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = texts(docs)
    counts = spill(source.mapInArrow(_gather, "kind int, key long, train long, total long").groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "lm-counts")
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("train").alias("n"), F.sum((F.col("train") > 0).cast("long")).alias("v"), F.count("*").alias("keys"), F.sum("total").alias("total")).collect()}
    split = texts(docs).select((F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % holdout != 1).cast("long").alias("train"))
    rows = split.agg(F.sum("train").alias("train")).first().train or 0
    tokens = (sums[0].n if 0 in sums else 0) + rows  # with the end tokens
    kinds = (sums[0].v if 0 in sums else 0) + (rows > 0)
    below = tokens + 0.5 * (kinds + 1)
    log = lambda c: np.log10((c + 0.5) / below)

    def often(frame: DataFrame, kind: int) -> DataFrame:
        """All keys if they are few, else those frequent enough that there can't be more than table_most."""
        s, most = sums.get(kind), (words_most, table_most)[kind]
        return frame if s is None or s.keys <= most else frame.filter(F.col("total") * most >= s.total)

    few = [sums[k].keys <= (words_most, table_most)[k] if k in sums else True for k in (0, 1)]
    got = often(counts.filter("kind = 0"), 0).select("key", "train").toArrow()
    c = got["train"].to_numpy()
    mark = str(id(counts)) + str(np.random.default_rng().integers(1 << 60))
    words = spark.sparkContext.broadcast((mark, got["key"].to_numpy(), log(c)))

    grams = counts.filter("kind = 1")
    three = grams.groupBy(F.expr(f"key & {(1 << 8 * (LOW + 1)) - 1}").alias("key")).agg(F.sum("train").alias("n")).filter("n > 0").toArrow()  # at most 2^24 rows
    low = spark.sparkContext.broadcast(low_orders(three["key"].to_numpy().view(_U), three["n"].to_numpy()))
    suffix = F.expr(f"shiftright(key, 8) & {(1 << 8 * (LOW + 1)) - 1}")
    owners = max(1024, (sums[1].keys if 1 in sums else 0) // strings_per_owner)
    owner = F.pmod(F.xxhash64(suffix), F.lit(owners)).alias("owner")
    trie = spill(grams.select(owner, "key", "train", "total").groupBy("owner").applyInArrow(partial(_own, low=low), "key long, logp double, total long"), "lm-trie")
    got = often(trie, 1).select("key", "logp").toArrow()
    table_ = spark.sparkContext.broadcast((mark, got["key"].to_numpy(), got["logp"].to_numpy().astype(np.float32)))
    whole = spark.sparkContext.broadcast([*few, float(log(0)) + 1e-12])

    numbered = source.withColumn("row", F.monotonically_increasing_id()) if all(few) else spill(source.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    kind = "doc_id long, row long, kind int, key long, n long, known long, base double, score double"
    scored = numbered.mapInArrow(partial(_score, words=words, trie=table_, whole=whole), kind)
    if not all(few):
        scored = spill(scored, "lm-partial")
        mine = scored.filter("kind = 0")
        adds = []
        if not few[0]:
            lost = scored.filter("kind = 1").groupBy("key", "row").agg(F.count("*").alias("m"))
            lost = lost.join(counts.filter("kind = 0").select("key", "train"), "key")
            adds.append(lost.select("row", (F.when(F.col("train") > 0, F.col("m")).otherwise(0)).alias("known"), (F.col("m") * F.log10((F.col("train") + 0.5) / below)).alias("base"), F.lit(0.0).alias("score")))
        if not few[1]:
            lost = scored.filter("kind = 2").groupBy("key", "row").agg(F.count("*").alias("m")).join(trie.select("key", "logp"), "key")
            adds.append(lost.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("m") * F.col("logp")).alias("score")))
        more = mine.select("row", "known", "base", "score")
        for a in adds:
            more = more.union(a)
        sums_ = more.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
        scored = mine.select("doc_id", "row", "n").join(sums_, "row")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % holdout == 1
    end = float(log(rows))
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + (1 if rows else 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + end).alias("base_score"),
        F.col("score").alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
