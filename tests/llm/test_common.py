import random
from types import SimpleNamespace

import pytest

from sandloom.llm._common import components, shared_root


def joined(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(3000)]
    cases = [[], [(1, 1)], [(-5, 7), (7, 2**62), (-5, -9)], chain + [(0, 10_000 + k) for k in range(2000)], [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1700)]]
    for edges in cases:
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
        assert got == joined(edges)


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="share"):
        shared_root(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
