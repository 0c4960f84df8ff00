"""Pruned vector search gives what the search over all blocks gives, and passes over balls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandloom.operators.ball_search import BallIndex
from sandloom.operators.similarity import cosine_topk


def frame(spark, v, name="vec_id"):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], f"{name} long, embedding array<double>")


def same(spark, v, k, pivots, exclude_self, block=16):
    d = frame(spark, v)
    q = d.withColumnRenamed("vec_id", "query_id")
    got, visits = BallIndex(d, pivots=pivots, block=block).search(q, k, exclude_self=exclude_self)
    want = cosine_topk(q, d, k, exclude_self=exclude_self)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    return visits


@pytest.mark.parametrize("pivots", [1, 4, 12])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_same_rows_as_all_blocks(spark, pivots, exclude_self):
    rng = np.random.default_rng(pivots)
    v = [*rng.normal(size=(90, 5)), np.zeros(5), None, *np.ones((30, 5)), -np.ones(5)]  # no length, none, ties, the far side
    same(spark, v, 4, pivots, exclude_self)


def test_clusters_are_passed_over(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(10, 16)) * 10
    v = np.concatenate([c + rng.normal(size=(40, 16)) * 0.1 for c in centre])
    visits = same(spark, v, 5, 10, True)
    assert visits.count() < 0.1 * len(v) * 9


def test_more_neighbours_than_a_ball_holds(spark):
    rng = np.random.default_rng(4)
    same(spark, rng.normal(size=(40, 3)), 25, 10, False)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    got, visits = BallIndex(none).search(frame(spark, np.ones((2, 3)), "query_id"), 3)
    assert got.count() == 0 and visits.count() == 0 and got.columns == ["query_id", "vec_id", "score", "rank"]
    got, _ = BallIndex(frame(spark, np.ones((2, 3)))).search(none.withColumnRenamed("vec_id", "query_id"), 3)
    assert got.count() == 0 and got.filter(F.col("rank") == 1).count() == 0
