"""Similarity graphs as edge lists, propagation along them, and alignment of two vector spaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch
from .ball_search import BallIndex


def knn_edges(vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None) -> DataFrame:
    """src, dst: each vector and its k nearest others, in both directions. Balls of vectors that can't hold a neighbour are passed over.

    Neighbours and edges are written once: whatever reads the edges several times doesn't search again.
    """
    spark, path = vectors.sparkSession, scratch(vectors.sparkSession, "knn")
    q = vectors.select(F.col(key).alias("query_id"), vector)
    near = BallIndex(vectors, key, vector, pivots).search(q, k, vector=vector, exclude_self=True)[0].select(F.col("query_id").alias("src"), F.col(key).alias("dst"))
    near.write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")
    near.union(near.select("dst", "src")).distinct().write.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/edges")


def with_loops(edges: DataFrame) -> DataFrame:
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return edges.select("src", "dst").union(nodes.select("src", F.col("src").alias("dst"))).distinct()


def symmetric_weights(edges: DataFrame) -> DataFrame:
    """src, dst, weight of D^-1/2 (A + I) D^-1/2."""
    full = with_loops(edges)
    degree = full.groupBy("src").agg(F.count("*").alias("d"))
    return full.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e").cast("double"))).alias("weight"))


def row_weights(edges: DataFrame) -> DataFrame:
    """src, dst, weight of D^-1 (A + I)."""
    full = with_loops(edges)
    degree = full.groupBy("src").agg(F.count("*").alias("d"))
    return full.join(degree, "src").select("src", "dst", (1.0 / F.col("d")).alias("weight"))


def sum_vectors(rows: DataFrame, key: str, weight: str, vector: str) -> DataFrame:
    """key, vector: the sum of weight * vector of each key's rows, vectors being summed whole.

    A task adds up what each of its batches holds of a key before the shuffle, so a key with very many rows sends one vector a
    batch. Rows without a key, a weight or a vector are left out.
    """
    schema = f"k {dict(rows.dtypes)[key]}, v array<double>"

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def batch(keys, m):
        import pyarrow as pa

        ends = np.arange(len(keys) + 1, dtype=np.int32) * m.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).ravel()))], ["k", "v"])

    def added(keys, m):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.add.reduceat(m[order], new, axis=0)

    def first(batches):
        for b in batches:
            if b.num_rows:
                yield batch(*added(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(2)) * b.column(1).to_numpy(zero_copy_only=False)[:, None]))

    def final(batches):  # rows come sorted by key, of which the last may go on in the next batch
        open_key, open_sum = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, m = added(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)))
            if open_sum is not None and keys[0] == open_key[0]:
                m[0] += open_sum[0]
            elif open_sum is not None:
                yield batch(open_key, open_sum)
            if len(keys) > 1:
                yield batch(keys[:-1], m[:-1])
            open_key, open_sum = keys[-1:], m[-1:]
        if open_sum is not None:
            yield batch(open_key, open_sum)

    used = rows.select(F.col(key).alias("k"), F.col(weight).cast("double").alias("w"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null and w is not null")
    out = used.mapInArrow(first, schema).repartition("k").sortWithinPartitions("k").mapInArrow(final, schema)
    return out.select(F.col("k").alias(key), F.col("v").alias(vector))


def spread(weights: DataFrame, values: DataFrame) -> DataFrame:
    """node, embedding: one step of weights (src, dst, weight) times values (node, embedding)."""
    near = weights.join(values.select(F.col("node").alias("dst"), "embedding"), "dst")
    return sum_vectors(near, "src", "weight", "embedding").withColumnRenamed("src", "node")


def propagate(weights: DataFrame, values: DataFrame, alphas: list[float]) -> DataFrame:
    """node, embedding: sum over layers l of alphas[l] times the values (node, embedding) after l steps."""
    total, now = None, values.select("node", F.col("embedding").cast("array<double>").alias("embedding"))
    for layer, a in enumerate(alphas):
        now = spread(weights, now) if layer else now
        part = now.select("node", "embedding", F.lit(float(a)).alias("weight"))
        total = part if total is None else total.unionByName(part)
    return sum_vectors(total, "node", "weight", "embedding")


def cells(values: DataFrame, key: str = "node", vector: str = "embedding") -> DataFrame:
    """key, dim, value: vectors as rows, for reports."""
    return values.select(key, F.posexplode(vector).alias("dim", "value"))


def collect_vectors(values: DataFrame) -> DataFrame:
    """node, embedding of (node, dim, value); a vector has a fixed number of dimensions."""
    return values.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("embedding"))


def neighbour_similarity(edges: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """src, dst, similarity, rank (1: nearest neighbour)."""
    from ..functions.vector import cosine

    e = edges.join(vectors.select(F.col(key).alias("src"), F.col(vector).alias("a")), "src").join(vectors.select(F.col(key).alias("dst"), F.col(vector).alias("b")), "dst")
    s = e.select("src", "dst", F.round(cosine("a", "b"), 8).alias("similarity"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")))


def mean_vectors(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """by, vector: the mean of each group's vectors."""
    have = vectors.filter(F.col(by).isNotNull() & F.col(vector).isNotNull())
    sums = sum_vectors(have.select(by, F.lit(1.0).alias("one"), vector), by, "one", vector)
    return sums.join(have.groupBy(by).agg(F.count("*").alias("n")), by).select(by, F.transform(vector, lambda x: x / F.col("n")).alias(vector))


def mean_pool(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """by, dim, value: the mean vector of each group."""
    return cells(mean_vectors(vectors, by, vector), by, vector)


def procrustes(pairs: DataFrame, source: str, target: str):
    """The orthogonal d x d matrix that best turns source vectors to target ones.

    Tasks multiply their own rows' matrices; rows of these d x d products are summed by their number, and the d sums, all
    that the driver gets, are decomposed there. Pairs that lack a vector are left out.
    """

    def products(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (0, 1))
                total = y.T @ x if total is None else total + y.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.ones(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["j", "one", "row"])

    both = pairs.select(F.col(source).cast("array<double>").alias("x"), F.col(target).cast("array<double>").alias("y")).filter("x is not null and y is not null")
    rows = sum_vectors(both.mapInArrow(products, "j long, one double, row array<double>"), "j", "one", "row").toArrow().sort_by("j")
    u, _, vt = np.linalg.svd(np.array(rows["row"].to_pylist()))
    return u @ vt


def apply_matrix(vectors: DataFrame, matrix, vector: str = "embedding", out: str = "aligned") -> DataFrame:
    """Adds out: matrix times vector, null where there is no vector. The matrix goes to the tasks once, not into the plan."""
    turn = np.asarray(matrix, dtype=np.float64).T

    @F.pandas_udf("array<double>")
    def turned(v: pd.Series) -> pd.Series:
        there = np.flatnonzero(v.notna().to_numpy())
        result = np.empty(len(v), dtype=object)
        if len(there):
            for i, x in zip(there, np.stack(v.iloc[there].to_list()) @ turn, strict=True):
                result[i] = x
        return pd.Series(result, index=v.index)

    return vectors.withColumn(out, turned(F.col(vector).cast("array<double>")))


def autoencoder_losses(pairs: DataFrame) -> DataFrame:
    """reconstruction, pair, prior and total of pairs with x, x_hat, y, y_hat, zx, zy: 1 * mse + 3 * mean(1 - cos) + 0.1 * mse of means."""
    from ..functions.vector import as_double, cosine

    err = lambda a, b: F.aggregate(F.zip_with(as_double(a), as_double(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    base = pairs.agg(F.avg(err("x", "x_hat") + err("y", "y_hat")).alias("reconstruction"), F.avg(1 - cosine("zx", "zy")).alias("pair"))
    means = pairs.select(F.posexplode(F.arrays_zip(as_double("zx").alias("p"), as_double("zy").alias("q"))).alias("dim", "z")).groupBy("dim").agg((F.avg("z.p") - F.avg("z.q")).alias("d"))
    prior = means.agg(F.avg(F.col("d") * F.col("d")).alias("prior"))
    return base.crossJoin(prior).withColumn("total", F.col("reconstruction") + 3 * F.col("pair") + 0.1 * F.col("prior"))


def late_pool_topk(patches: DataFrame, queries: DataFrame, k: int, by: str = "page_id", vector: str = "embedding") -> DataFrame:
    """query_id, page_id, score, rank: pages by the mean of their patches' vectors, the k nearest of each query."""
    from .similarity import cosine_topk

    pooled = mean_vectors(patches, by, vector).withColumnRenamed(vector, "embedding")
    return cosine_topk(queries, pooled, k, key=by, vector="embedding")
