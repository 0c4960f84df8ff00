"""Exact vector search with pruning: vectors lie in balls round pivots, and a query passes over the balls that can't hold a neighbour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch
from .similarity import BLOCK, _matrix, _unit, best_of_blocks, met

MOST_PIVOTS, MOST_ASKED = 512, 0.5
MARGIN = 1e-6  # far above what rounding can change in a bound, far below what scores differ by


def blocks(rows: DataFrame, by: list[str], types: str, block: int = BLOCK) -> DataFrame:
    """*by, ids, m: the vectors (k, u: bytes of doubles) of equal `by` as matrices of at most `block` rows; rows come sorted by `by`."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*[b.column(i).to_pylist() for i in range(len(by))], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            ids, us = b.column(len(by)).to_pylist(), b.column(len(by) + 1).to_pylist()
            spans = [(s, min(s + block, e)) for a, e in zip(cuts, cuts[1:], strict=False) for s in range(a, e, block)]
            columns = [pa.array([keys[s][i] for s, _ in spans], b.column(i).type) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([ids[s:e] for s, e in spans], pa.list_(pa.int64())), pa.array([b"".join(us[s:e]) for s, e in spans], pa.binary())], [*by, "ids", "m"])

    return rows.select(*by, "k", "u").mapInArrow(pack, f"{types}, ids array<long>, m binary")


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of sample, each the farthest from those taken before."""
    taken, gap = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(taken) < n and gap.max() > 1e-6:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[taken[-1]], axis=1))
    return sample[taken]


class BallIndex:
    """Vectors dealt to their nearest of at most MOST_PIVOTS pivots, with each ball's radius.

    Pivots are taken from 4096 rows with the smallest hashes; they only choose the balls, every vector is indexed and no
    neighbour is given up. Distances are those of unit vectors, |u - v|^2 <= 2 - 2 cos, so a ball at distance d from a query
    and with radius r has no cosine above 1 - (d - r)^2 / 2. Pivots and radii go to every task: their number and so their
    size has a bound. Rows without an id or a vector are left out; vectors have one length.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, block: int = BLOCK):
        self.spark, self.key, self.block = vectors.sparkSession, key, block
        rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null")
        self.rows, n = rows, rows.count()
        first = rows.orderBy(F.xxhash64("k"), "k").limit(4096).toArrow()
        self.empty = n == 0
        if self.empty:
            return
        sample = _unit(_matrix(first["v"].combine_chunks(), len(first["v"][0])))
        self.centres = far_apart(sample, min(pivots or max(1, n // 4096), MOST_PIVOTS))
        path = scratch(self.spark, "balls")
        self._placed(rows).write.parquet(path)
        placed = self.spark.read.parquet(path)
        # at most one row a pivot
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()
        self.radius = np.full(len(self.centres), -np.inf)
        for s in sizes:
            self.radius[s.cell] = s.r
        # A ball of very many vectors is dealt into parts, which the queries that ask for it meet one by one.
        self.parts = F.broadcast(self.spark.createDataFrame([(s.cell, -(-s.n // (4 * block))) for s in sizes], "cell int, parts long"))
        dealt = placed.join(self.parts, "cell").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
        dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")
        self.balls = blocks(dealt, ["cell", "part"], "cell int, part long", block).select("cell", "part", F.col("ids").alias("v_ids"), F.col("m").alias("v_m"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """k, cell, d, u: each unit vector with its nearest pivot."""
        centres = self.centres

        def place(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    u = _unit(_matrix(b.column(1), centres.shape[1]))
                    d = distances(u, centres)
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(u)), cell]), pa.array([x.tobytes() for x in u], pa.binary())], ["k", "cell", "d", "u"])

        return rows.mapInArrow(place, "k long, cell int, d double, u binary")

    def _meet(self, asked: DataFrame, k: int, exclude_self: bool, digits: int) -> DataFrame:
        """q, v, score of blocks of queries (cell, ids, m) with the balls that they name."""
        each = asked.join(self.parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        pairs = self.balls.join(each, ["cell", "part"]).select("v_ids", "v_m", "ids", "m")
        return pairs.mapInArrow(best_of_blocks(k, exclude_self, digits), "q long, v long, score double")

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", vector: str = "embedding", exclude_self: bool = False, digits: int = 8) -> tuple[DataFrame, DataFrame]:
        """The k nearest vectors of each query as cosine_topk() gives them, and q, cell: the balls that each query met besides its own.

        Each query first meets the ball of its own pivot, whose k-th score then tells which others could hold anything better.
        """
        w = Window.partitionBy("q").orderBy(F.desc("score"), "v")
        if self.empty:
            none = self.spark.createDataFrame([], "q long, v long, score double, cell int")
            return none.select(F.col("q").alias(query_key), F.col("v").alias(self.key), "score", F.lit(1).alias("rank")), none.select("q", "cell")
        rows = queries.select(F.col(query_key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null")
        path = scratch(self.spark, "ball-queries")
        self._placed(rows).write.parquet(f"{path}/placed")
        placed = self.spark.read.parquet(f"{path}/placed")
        home = blocks(placed.repartition("cell", F.pmod(F.xxhash64("k"), F.lit(16))).sortWithinPartitions("cell"), ["cell"], "cell int", self.block)
        self._meet(home, k, exclude_self, digits).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank").write.parquet(f"{path}/home")
        near = self.spark.read.parquet(f"{path}/home")
        bound = near.groupBy(F.col("q").alias("k")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        centres, radius, size = self.centres, self.radius, self.block

        def visit(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                ids, cells, kth = (np.asarray(b.column(i).to_pylist()) for i in range(3))
                u = np.frombuffer(b"".join(b.column(3).to_pylist()), np.float64).reshape(len(ids), -1)
                reach = 1 - np.maximum(0, distances(u, centres) - radius) ** 2 / 2
                ask = (reach >= kth[:, None] - MARGIN) & np.isfinite(radius)
                ask[np.arange(len(ids)), cells] = False
                for c in np.flatnonzero(ask.any(axis=0)):
                    at = np.flatnonzero(ask[:, c])
                    for s in range(0, len(at), size):
                        some = at[s : s + size]
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids[some].tolist()], pa.list_(pa.int64())), pa.array([u[some].tobytes()], pa.binary())], ["cell", "ids", "m"])

        def visits(batches):
            import pyarrow as pa

            for b in visit(batches):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in b.column(1)], pa.int64())], ["n"])

        limits = placed.join(bound, "k", "left").select("k", "cell", F.coalesce("kth", F.lit(-3.0)).alias("kth"), "u")
        asked = limits.mapInArrow(visit, "cell int, ids array<long>, m binary")
        # Where most balls are asked for, nothing is gained by them: a copy of a query for each ball would be as many as the
        # square of the table, so the blocks of all queries meet those of all vectors.
        most = rows.count() * len(self.centres) * MOST_ASKED
        if len(self.centres) > 1 and (limits.mapInArrow(visits, "n long").agg(F.sum("n")).first()[0] or 0) > most:
            both = met((rows, "k", "v"), (self.rows, "k", "v"), self.block).mapInArrow(best_of_blocks(k, exclude_self, digits), "q long, v long, score double")
        else:
            both = near.unionByName(self._meet(asked, k, exclude_self, digits))
        out = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return out.select(F.col("q").alias(query_key), F.col("v").alias(self.key), "score", "rank"), asked.select(F.explode("ids").alias("q"), "cell")


def distances(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (u * u).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * u @ centres.T))
