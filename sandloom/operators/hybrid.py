"""The best rows of two fused rankings without ranking everything: lists of growing depth with an exact stopping bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import vector as V
from ..sources.io import scratch
from .ball_search import blocks
from .similarity import _block, _unit

CHUNK_BLOCK, REQUEST_BLOCK = 4096, 256


def _bytes(rows: DataFrame, by: list[str], key: str, vector: str, dim: int) -> DataFrame:
    """*by, k, u: the vector as bytes of doubles, zeros where there is none (a cosine of 0)."""

    @F.pandas_udf("binary")
    def packed(v):
        return v.map(lambda x: np.zeros(dim).tobytes() if x is None else np.asarray(x, np.float64).tobytes())

    return rows.select(*by, F.col(key).alias("k"), packed(F.col(vector).cast("array<double>")).alias("u"))


class FusedLists:
    """Requests and the chunks of the cells (classes of equal metadata) that each may use, ready for lists of any depth.

    asked: request (long), vector. chunks: chunk (long, in the order that decides ties), cell, embedding. allowed: request,
    cell, tier (which goes first). scores: request, chunk, score of the pairs whose sparse score isn't 0, in all cells.
    Everything that several steps read lies as Parquet below one scratch folder.
    """

    def __init__(self, asked: DataFrame, chunks: DataFrame, allowed: DataFrame, scores: DataFrame, digits: int = 8):
        self.spark, self.digits, self.path = asked.sparkSession, digits, scratch(asked.sparkSession, "fused")
        size = lambda rows, c: rows.agg(F.max(F.size(c))).first()[0] or 1
        self.asked, self.chunks, self.allowed = asked, chunks, allowed
        self.dim = max(size(asked, "vector"), size(chunks, "embedding"), 1)
        counts = chunks.groupBy("cell").agg(F.count("*").alias("n"))
        self.parts = self._kept("parts", counts.select("cell", F.ceil(F.col("n") / (4 * CHUNK_BLOCK)).cast("long").alias("parts")))
        dealt = chunks.join(self.parts, "cell").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")))
        packed = _bytes(dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "chunk"), ["cell", "part"], "chunk", "embedding", self.dim)
        self.blocks = self._kept("blocks", blocks(packed, ["cell", "part"], "cell string, part long", CHUNK_BLOCK).select("cell", "part", F.col("ids").alias("v_ids"), F.col("m").alias("v_m")))
        found = scores.join(chunks.select("chunk", "cell"), "chunk").join(allowed, ["request", "cell"])
        self.found = self._kept("found", found.select("request", "chunk", "tier", F.round("score", digits).alias("sparse")).filter("sparse > 0").sortWithinPartitions("request"))

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _with_blocks(self, wanted: DataFrame, more: list[str]) -> DataFrame:
        each = wanted.join(self.parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return self.blocks.join(each, ["cell", "part"]).select("tier", "v_ids", "v_m", *more)

    def lists(self, open_: DataFrame, depth: int) -> DataFrame:
        """request, chunk, tier: of each tier of an open request the first `depth` by vector, and the first `depth` by sparse score.

        Where fewer than that have a sparse score, those without follow by chunk; among a tier's first `depth` chunks are
        enough of them. Of a block of vectors no more than 2 * depth rows a request go on.
        """
        digits = self.digits

        def first(batches):
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    mine, v = _block(b.column(1)[r].values, b.column(2)[r].as_py())
                    ids, q = _block(b.column(3)[r].values, b.column(4)[r].as_py())
                    s = np.round(_unit(q) @ _unit(v).T, digits) + 0.0
                    best = np.lexsort((np.broadcast_to(mine, s.shape), -s), axis=1)[:, :depth]
                    low = np.broadcast_to(np.argsort(mine)[:depth], (len(ids), min(depth, len(mine))))
                    for at, kind in ((best, 0), (low, 1)):
                        n = at.size
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, at.shape[1])), pa.array(mine[at].ravel()), pa.array([b.column(0)[r].as_py()] * n, pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.take_along_axis(s, at, axis=1).ravel() if kind == 0 else np.zeros(n))], ["request", "chunk", "tier", "list", "value"])

        w = open_.select("request").join(self.allowed, "request").join(self.asked, "request")
        # Requests are packed by cell where they lie: a cell that very many may use is no single row.
        asks = blocks(_bytes(w.repartition("cell", "tier", F.pmod("request", F.lit(16))).sortWithinPartitions("cell", "tier"), ["cell", "tier"], "request", "vector", self.dim), ["cell", "tier"], "cell string, tier int", REQUEST_BLOCK)
        got = self._with_blocks(asks, ["ids", "m"]).mapInArrow(first, "request long, chunk long, tier int, list int, value double")
        sparse = self.found.join(open_.select("request"), "request", "left_semi").select("request", "chunk", "tier", F.lit(2).alias("list"), F.col("sparse").alias("value"))
        order = Window.partitionBy("request", "tier", "list").orderBy(F.desc("value"), "chunk")
        top = [x.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= depth).select("request", "chunk", "tier") for x in (got, sparse)]
        return top[0].unionByName(top[1]).distinct()

    def ranked(self, candidates: DataFrame) -> DataFrame:
        """Adds dense_rank and sparse_rank: a candidate's places among all chunks that its request may use."""
        digits = self.digits
        c = candidates.join(self.asked, "request").join(self.chunks.select("chunk", "embedding"), "chunk")
        c = c.select("request", "chunk", "tier", F.round(F.coalesce(V.cosine("vector", "embedding"), F.lit(0.0)), digits).alias("dense"))
        c = self._kept("dense", c.join(self.found.select("request", "chunk", "sparse"), ["request", "chunk"], "left"))

        def count(batches):
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    mine, v = _block(b.column(1)[r].values, b.column(2)[r].as_py())
                    q = np.frombuffer(b.column(4)[r].as_py(), np.float64)
                    ids, own = (b.column(i)[r].values.to_numpy(zero_copy_only=False) for i in (5, 6))
                    before, upto = places_among(mine, np.round(_unit(v) @ _unit(q[None, :])[0], digits) + 0.0, ids, own)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(3)[r].as_py()] * len(ids), pa.int64()), pa.array(ids), pa.array(before), pa.array(upto)], ["request", "chunk", "better", "upto"])

        def pack(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    request = b.column(0).to_numpy()
                    cuts = np.concatenate([[0], np.flatnonzero(request[1:] != request[:-1]) + 1, [len(request)]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(request[cuts[:-1]]), *[pa.ListArray.from_arrays(pa.array(cuts), pa.array(b.column(i).to_numpy())) for i in (1, 2)]], ["request", "v_ids", "v_s"])

        def count_found(batches):
            import pyarrow as pa

            for b in batches:
                for r in range(b.num_rows):
                    mine, s, ids, own = (b.column(i)[r].values.to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
                    before, upto = places_among(mine, s, ids, own)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * len(ids), pa.int64()), pa.array(ids), pa.array(before), pa.array(upto)], ["request", "chunk", "better", "upto"])

        # At most three lists of `depth` rows a tier, whatever the number of chunks.
        own = c.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("chunk", "dense", F.coalesce("sparse", F.lit(0.0)).alias("sparse")))).alias("x"))
        own = self._kept("own", own.select("request", F.col("x.chunk").alias("ids"), F.col("x.dense").alias("own"), F.col("x.sparse").alias("own_sparse")))
        asks = _bytes(self.asked.join(own, "request"), ["request", "ids", "own"], "request", "vector", self.dim).join(self.allowed, "request")
        met = self._with_blocks(asks.select("cell", "tier", "request", "u", "ids", "own"), ["request", "u", "ids", "own"])
        schema = "request long, chunk long, better long, upto long"
        dense = met.mapInArrow(count, schema).groupBy("request", "chunk").agg((F.sum("better") + 1).alias("dense_rank"), F.sum("upto").alias("upto"))
        found = self.found.select("request", "chunk", "sparse").mapInArrow(pack, "request long, v_ids array<long>, v_s array<double>")
        met = found.join(own.select("request", "ids", "own_sparse"), "request")
        sparse = met.mapInArrow(count_found, schema).groupBy("request", "chunk").agg(F.sum("better").alias("higher"), F.sum("upto").alias("upto_found"))
        out = c.join(dense, ["request", "chunk"]).join(sparse, ["request", "chunk"], "left")
        # Without a sparse score a chunk comes behind all that have one, and behind the others without one before it.
        place = F.when(F.col("sparse") > 0, 1).otherwise(F.col("upto") - F.coalesce("upto_found", F.lit(0)))
        return out.select("request", "chunk", "tier", "dense_rank", (F.coalesce("higher", F.lit(0)) + place).alias("sparse_rank"))


def places_among(mine: np.ndarray, s: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate (id, its score) how many of the rows (mine, s) come before it, scores descending, then ids; and how
    many rows have its id or a smaller one. A row with the candidate's own id isn't before it."""
    asks = np.concatenate([np.zeros(len(mine), bool), np.ones(len(ids), bool)])
    order = np.lexsort((~asks, np.concatenate([mine, ids]), -np.concatenate([s, own])))
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(~asks[order])
    return before[len(mine) :], np.searchsorted(np.sort(mine), ids, side="right").astype(np.int64)


def fused_top(lists: FusedLists, most: int, depth: int | None = None, k: int = L.RRF_K) -> tuple[DataFrame, list[tuple[int, int]]]:
    """request, chunk, tier, dense_rank, sparse_rank, rrf, position of each request's first `most` chunks by tier, then
    1 / (k + dense_rank) + 1 / (k + sparse_rank), then dense_rank; and (depth, candidates) of each round.

    A chunk of a tier that is in neither of its lists stands behind the last of each, which bounds its fused score. A
    request is done when all it takes from a tier is above that tier's bound, or its lists hold the whole tier; the others
    go on with lists four times as deep. Ranks are counted among all chunks, so they don't depend on the depth.
    """
    depth = max(depth or k + 2 * most + 4, most)
    spark, done, rounds = lists.spark, [], []
    open_ = lists.allowed.select("request").distinct()
    score = lambda d, s: F.round(1.0 / (k + d) + 1.0 / (k + s), 12)
    while True:
        path = f"{lists.path}/round-{len(rounds)}"
        candidates = lists.lists(open_, depth)
        candidates.write.parquet(f"{path}/lists")
        candidates = spark.read.parquet(f"{path}/lists")
        rounds.append((depth, candidates.count()))
        lists.ranked(candidates).write.parquet(f"{path}/ranked")
        r = spark.read.parquet(f"{path}/ranked").withColumn("rrf", 1.0 / (k + F.col("dense_rank")) + 1.0 / (k + F.col("sparse_rank")))
        tier = Window.partitionBy("request", "tier")
        nth = lambda c: F.max(F.when(F.col(f"{c}_no") == depth, F.col(c))).over(tier)
        for c in ("dense_rank", "sparse_rank"):
            r = r.withColumn(f"{c}_no", F.row_number().over(tier.orderBy(c)))
        r = r.withColumn("bound", score(nth("dense_rank") + 1, nth("sparse_rank") + 1))
        r = r.withColumn("position", F.row_number().over(Window.partitionBy("request").orderBy("tier", F.round("rrf", 12).desc(), "dense_rank"))).filter(F.col("position") <= most)
        r = r.withColumn("short", F.max(F.coalesce(F.round("rrf", 12) <= F.col("bound"), F.lit(False))).over(Window.partitionBy("request")))
        r.select("request", "chunk", "tier", "dense_rank", "sparse_rank", "rrf", "position", "short").write.parquet(f"{path}/top")
        top = spark.read.parquet(f"{path}/top")
        done.append(top.filter("not short").drop("short"))
        open_ = top.filter("short").select("request").distinct()
        if open_.isEmpty():
            break
        depth *= 4
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, rounds
