"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Words are runs of letters and digits, lower-cased, as 64-bit hashes. A seed is a fixed mask that looks at five of some
neighbouring words and ignores the others. The two masks together hit every stretch of 20 words that differs from a
benchmark passage in at most four (checked over all 4845 cases in the tests). Items of 9 to 15 words have fewer places for
a mask and get a third one, with which all cases of 9 to 20 words are hit (checked in the tests too). Training seeds are joined with benchmark
seeds; around each hit the stretch of WINDOW words with the most equal words, word against word, is looked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import spill, table

#: Word offsets that the masks look at.
MASKS = ((0, 1, 2, 4, 5), (0, 4, 5, 7, 8))
#: A third mask, for stretches of fewer than EVEN words: the two alone miss some cases of 10, 11, 12 and 15 words.
THIRD, EVEN = (0, 1, 3, 6), 16
WINDOW = 20
SHARE = 0.8


def _words(text):
    """Word hashes of a text: array<long>."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeds(frame: DataFrame, masks, keep: list[str], hashes: str) -> DataFrame:
    """A row for each mask and position: keep..., pos, mask, key. Positions near the end give keys that match nothing.

    All of it stays in one generated function with the join that follows, so `hashes` isn't copied for each row.
    """
    m = len(masks)
    slots = frame.select(*keep, F.explode(F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) * m - 1))).alias("slot"))
    pos, kind = F.expr(f"cast(slot div {m} as int)"), F.col("slot") % m
    one = [F.xxhash64(F.lit(k), *[F.coalesce(F.get(F.col(hashes), pos + o), F.lit(-1 - k).cast("long")) for o in mask]) for k, mask in enumerate(masks)]
    key = F.lit(None)
    for k, x in enumerate(one[:-1]):
        key = F.when(kind == k, x) if k == 0 else key.when(kind == k, x)
    return slots.select(*keep, pos.alias("pos"), kind.cast("int").alias("mask"), (key.otherwise(one[-1])).alias("key"))


def _same(part, offset, item_hashes, n):
    """For each word of the item, 1 if the document has the same word at its place; part begins `offset` words before."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce((F.get(part, j + offset) == F.get(item_hashes, j)).cast("int"), F.lit(0)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_rows: int = 1 << 19) -> DataFrame:
    """One row for each document and benchmark item that it overlaps: doc_id, item_id, n_equal, n_window, doc_word.

    An overlap is a stretch of min(window, the item's words) words, aligned word by word, of which at least share are
    equal; n_equal is the most found, doc_word the smallest word offset in the document at which the item would begin
    (negative if the item's beginning is cut off). Items of fewer than nine words must be there whole and unchanged.
    That no overlap is missed is proven for a window of 9 to 20 words and a share of 0.8 or more.
    Null and empty texts overlap nothing; repeated rows of one doc_id give one row; rows with a null doc_id share one
    row, whose doc_id is null. Either table may be empty, and may have other columns of any name.
    The benchmark's seeds are broadcast if they are at most broadcast_rows (a bound of some 100 MB), else both sides
    are shuffled by seed and documents are joined again for the alignment.
    """
    items = benchmark.select(F.col("item_id").alias("item_id"), _words(F.col("text")).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    n = F.size("item_hashes")
    stretch = F.least(n, F.greatest(F.lit(window), F.lit(9)))
    small = sorted(r.n for r in items.select(stretch.alias("n")).filter(f"n < {EVEN}").distinct().collect())
    common = MASKS + (THIRD,) if small and small[-1] >= 9 else MASKS
    masks = common + tuple(tuple(range(k)) for k in small if k < 9)
    spans = F.array(*[F.lit(max(m) + 1) for m in masks])
    seeds = _seeds(items, masks, ["item_id", "item_hashes"], "item_hashes")
    fits = F.col("pos") + F.get(spans, F.col("mask")) <= n
    wanted = F.when(n < 9, (F.get(spans, F.col("mask")) == n) & (F.col("mask") >= len(common))).otherwise(F.col("mask") < F.when(stretch < EVEN, len(common)).otherwise(len(MASKS)))
    index = spill(seeds.filter(fits & wanted).select(F.col("key").alias("i_key"), "item_id", F.col("pos").alias("item_pos"), n.alias("n")), "benchmark-seeds")
    source = docs.select("doc_id", _words(F.col("text")).alias("doc_hashes"))
    seeded = _seeds(source, masks, ["doc_id", "doc_hashes"], "doc_hashes")
    word = (F.col("pos") - F.col("item_pos")).alias("doc_word")
    part = F.slice("doc_hashes", F.greatest("doc_word", F.lit(0)) + 1, F.col("n") + F.least("doc_word", F.lit(0))).alias("part")
    place = ["doc_id", "item_id", "doc_word", "n"]
    if index.count() <= broadcast_rows:
        hits = seeded.join(F.broadcast(index), F.col("key") == F.col("i_key")).select("doc_id", "item_id", word, "n", "doc_hashes")
    else:
        found = seeded.drop("doc_hashes").join(index, F.col("key") == F.col("i_key")).select(F.col("doc_id").alias("d"), "item_id", word, "n").distinct()
        hits = found.join(source, found.d.eqNullSafe(source.doc_id)).select(*place, "doc_hashes")
    # The seeds of one overlap lie on one alignment, which is compared once.
    places = hits.select(*place, part).distinct()
    known = spill(items.select(F.col("item_id").alias("i"), "item_hashes").distinct(), "benchmark-items")
    # Repeated item ids: an alignment is compared with every text of that id and length.
    aligned = places.join(known, (F.col("item_id").eqNullSafe(F.col("i"))) & (F.size("item_hashes") == F.col("n")))
    width = F.when(F.col("n") < 9, F.col("n")).otherwise(F.least(F.col("n"), F.lit(window)))
    same = _same(F.col("part"), F.least("doc_word", F.lit(0)), F.col("item_hashes"), F.col("n"))
    scored = aligned.select("doc_id", "item_id", "doc_word", width.alias("n_window"), "n", same.alias("same")).withColumn("n_equal", _best())
    need = F.when(F.col("n") < 9, F.col("n")).otherwise(F.ceil(F.col("n_window") * share - 1e-9))
    return scored.filter(F.col("n_equal") >= need).groupBy("doc_id", "item_id").agg(F.max("n_equal").cast("int").alias("n_equal"), F.max("n_window").cast("int").alias("n_window"), F.min("doc_word").cast("int").alias("doc_word"))


def _best():
    """The largest sum of n_window neighbours of the 0/1 array `same`."""
    step = "acc.run + get(same, j) - if(j >= n_window, get(same, j - n_window), 0)"
    return F.expr(f"aggregate(sequence(0, size(same) - 1), named_struct('run', 0, 'best', 0), (acc, j) -> named_struct('run', {step}, 'best', greatest(acc.best, {step})), acc -> acc.best)")


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
