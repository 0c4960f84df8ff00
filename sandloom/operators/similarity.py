"""Exact vector search: a stated set of queries against all vectors, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLICES, TILE = 4096, 16, 256
LOWEST = float(np.finfo(np.float32).min)  # only -inf lies below


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def packed(rows: DataFrame, key: str, vector, block: int) -> DataFrame:
    """ids, m: vectors of neighbouring rows as matrices of at most `block` rows, made where the rows lie."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, block):
                part = b.slice(k, block)
                m = _matrix(part.column(1), len(part.column(1)[0]))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "m"])

    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return rows.select(F.col(key).cast("long").alias("k"), v.alias("v")).filter("v is not null").mapInArrow(pack, "ids array<long>, m binary")


def _block(ids, m) -> tuple[np.ndarray, np.ndarray]:
    keys = np.asarray(ids, dtype=np.int64)
    return keys, np.frombuffer(m, dtype=np.float64).reshape(len(keys), -1)


def met(queries: tuple, vectors: tuple, block: int) -> DataFrame:
    """v_ids, v_m, ids, m: every block of the vectors beside every block of the queries, each a (rows, key, vector).

    The stated query set meets all rows, in blocks, on the executors: up to four blocks of queries are broadcast; of more,
    parts of the vectors and slices of the queries make a grid, each cell of which gets its copies by a shuffle.
    """
    q = packed(*queries, block)
    v = packed(*vectors, block).select(F.col("ids").alias("v_ids"), F.col("m").alias("v_m"))
    if queries[0].count() <= 4 * block:
        return v.crossJoin(F.broadcast(q)).select("v_ids", "v_m", "ids", "m")
    parts = max(1, -(-vectors[0].count() // (16 * block)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda ids, n: F.pmod(F.xxhash64(F.col(ids)[0]), F.lit(n))
    v = v.select("*", dealt("v_ids", parts).alias("part"), each(SLICES).alias("slice")).repartition(parts * SLICES, "part", "slice")
    q = q.select("*", dealt("ids", SLICES).alias("slice"), each(parts).alias("part")).repartition(parts * SLICES, "part", "slice")
    return v.join(q, ["part", "slice"]).select("v_ids", "v_m", "ids", "m")


def best_in_rows(s: np.ndarray, ids: np.ndarray, k: int, digits: int, off: float = 0.0, exact=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, column, rounded score of each row's k best columns of s, by rounded score descending, then id; -inf is no score.

    No row is sorted whole: the k-th largest of the maxima of groups of columns is a score that k columns reach, so only
    what comes within a rounding step of it is rounded and sorted. s may be off by up to `off` if exact(row, column) gives
    the scores themselves.
    """
    n, m = s.shape
    width = max(1, min(64, m // (4 * k)))
    tops = np.maximum.reduceat(s, np.arange(0, m, width), axis=1)
    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k] if tops.shape[1] >= k else np.full(n, -np.inf)
    row, col = np.divmod(np.flatnonzero(s >= np.maximum(least - 2 * (off + 10.0**-digits), LOWEST).astype(s.dtype)[:, None]), m)
    score = np.round(s[row, col] if exact is None else exact(row, col), digits)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], score[place < k]


def best_of_blocks(k: int, exclude_self: bool, digits: int):
    """A function over batches of v_ids, v_m, ids, m that gives q, v, score: each block pair's k best rows of each query.

    Products are of single precision and tell which rows can be among the best; those are scored in double precision.
    """

    def best(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                mine, v = _block(b.column(0)[r].values, b.column(1)[r].as_py())
                ids, q = _block(b.column(2)[r].values, b.column(3)[r].as_py())
                q, v = _unit(q), _unit(v)
                q32, v32, off = q.astype(np.float32), v.astype(np.float32).T, (v.shape[1] + 8) * 2.0**-23
                low = np.argsort(mine, kind="stable")
                for at in range(0, len(ids), TILE):  # a product of 4 MB at most stands at a time
                    some, mat = ids[at : at + TILE], q[at : at + TILE]
                    s = q32[at : at + TILE] @ v32
                    if exclude_self:
                        first, last = (np.searchsorted(mine[low], some, side=x) for x in ("left", "right"))
                        for i in np.flatnonzero(last > first):
                            s[i, low[first[i] : last[i]]] = -np.inf
                    row, col, score = best_in_rows(s, mine, k, digits, off, lambda i, j, mat=mat, v=v: _dots(mat, i, v, j))
                    yield pa.RecordBatch.from_arrays([pa.array(some[row]), pa.array(mine[col]), pa.array(score)], ["q", "v", "score"])

    return best


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The products of rows a[i] and b[j], some at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), step):
        out[at : at + step] = np.einsum("ij,ij->i", a[i[at : at + step]], b[j[at : at + step]])
    return out


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", exclude_self: bool = False, digits: int = 8, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank: each query's k nearest vectors by cosine, ties to the smaller id.

    Blocks of queries meet blocks of vectors as matrix products, and of each product only the k best rows of each query go
    on. Null vectors are left out.
    """

    out = met((queries, query_key, vector), (vectors, key, vector), block).mapInArrow(best_of_blocks(k, exclude_self, digits), "q long, v long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("v").alias(key), "score", "rank")


def pair_ranks(left: DataFrame, right: DataFrame, digits: int = 8, block: int = BLOCK) -> DataFrame:
    """pair_id, similarity, rank: where the true partner (equal pair_id) of each left vector stands among all right ones.

    left, right: pair_id, embedding. The rank is one more than the number of right vectors that are nearer.
    """
    both = left.select("pair_id", "embedding").join(right.select("pair_id", F.col("embedding").alias("partner")), "pair_id")

    def nearer(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                _, v = _block(b.column(0)[r].values, b.column(1)[r].as_py())
                ids, q = _block(b.column(2)[r].values, b.column(3)[r].as_py())
                half = q.shape[1] // 2
                mine = _unit(q[:, :half])
                own = np.round((mine * _unit(q[:, half:])).sum(axis=1), digits)
                count = (np.round(mine @ _unit(v).T, digits) > own[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array(count)], ["pair_id", "similarity", "nearer"])

    pairs = met((both, "pair_id", F.concat("embedding", "partner")), (right, "pair_id", "embedding"), block)
    out = pairs.mapInArrow(nearer, "pair_id long, similarity double, nearer long")
    return out.groupBy("pair_id").agg(F.max("similarity").alias("similarity"), (F.sum("nearer") + 1).alias("rank"))


def mutual_ranks(left: DataFrame, right: DataFrame, digits: int = 8) -> DataFrame:
    """pair_id, similarity, rank, back_rank, mutual: each pair's rank from both sides, and whether both are 1."""
    back = pair_ranks(right, left, digits).select("pair_id", F.col("rank").alias("back_rank"))
    return pair_ranks(left, right, digits).join(back, "pair_id").withColumn("mutual", (F.col("rank") == 1) & (F.col("back_rank") == 1))
