"""Every query that has SQL, against DuckDB on the smallest tables; the others run and keep their shape."""

import os

import pytest

from sandloom.plans import documents, pages, records, reports, search, serving  # noqa: F401
from sandloom.plans.registry import QUERIES, SQL

from .compare import oracle, rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(oracle(SQL[name], FOLDER))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "knn_edges", "section_carry_forward", "rate_limit_fold", "curriculum_chunks"])
def test_order_of_rows_does_not_matter(spark, name, tmp_path):
    for t in ("documents", "benchmark", "embeddings", "events"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").repartition(7).write.parquet(f"{tmp_path}/{t}.parquet")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(QUERIES[name](spark, FOLDER).toPandas())


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60
