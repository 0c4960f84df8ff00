"""Fused rankings by lists of growing depth, against complete rankings."""

import numpy as np
import pytest

from sandloom.operators.hybrid import FusedLists, fused_top

ASKED = "request long, vector array<double>"
CHUNKS = "chunk long, cell string, embedding array<double>"
ALLOWED = "request long, cell string, tier int"
SCORES = "request long, chunk long, score double"


def complete(asked, chunks, allowed, scores, most):
    """The definition: both rankings of everything, then tiers."""
    out, sparse = {}, {(r, c): round(s, 8) for r, c, s in scores}
    for r, v in asked:
        tier = {cell: t for q, cell, t in allowed if q == r}
        rows = []
        for c, cell, e in chunks:
            if cell in tier:
                n = np.linalg.norm(v) * np.linalg.norm(e) if v is not None and e is not None else 0
                rows.append((c, tier[cell], round(float(np.dot(v, e) / n), 8) if n else 0.0, sparse.get((r, c), 0.0)))
        dense = {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (-x[2], x[0])), 1)}
        high = {x[0]: i for i, x in enumerate(sorted(rows, key=lambda x: (-x[3], x[0])), 1)}
        best = sorted(rows, key=lambda x: (x[1], -round(1 / (60 + dense[x[0]]) + 1 / (60 + high[x[0]]), 12), dense[x[0]]))
        out[r] = [(x[0], x[1], dense[x[0]], high[x[0]]) for x in best[:most]]
    return {r: x for r, x in out.items() if x}


def run(spark, asked, chunks, allowed, scores, most, depth=None):
    lists = FusedLists(*[spark.createDataFrame(rows, schema) for rows, schema in ((asked, ASKED), (chunks, CHUNKS), (allowed, ALLOWED), (scores, SCORES))])
    top, rounds = fused_top(lists, most, depth)
    got: dict = {}
    for x in sorted(top.collect(), key=lambda x: (x.request, x.position)):
        got.setdefault(x.request, []).append((x.chunk, x.tier, x.dense_rank, x.sparse_rank))
    return got, rounds


def tables(seed, n, n_requests, cells=5, ties=False):
    rng = np.random.default_rng(seed)
    vector = lambda: (rng.integers(-1, 2, 3).astype(float) if ties else rng.normal(size=3)).tolist()
    asked = [(r, None if r == 1 else vector()) for r in range(n_requests)]
    chunks = [(c, f"cell{rng.integers(cells)}", None if rng.random() < 0.1 else vector()) for c in range(n)]
    allowed = [(r, f"cell{i}", i % 2) for r in range(n_requests - 1) for i in range(cells) if rng.random() < 0.8]
    scores = [(r, c, float(rng.integers(1, 4)) if ties else float(rng.random())) for r in range(n_requests) for c in range(n) if rng.random() < 0.3]
    return asked, chunks, allowed, scores


@pytest.mark.parametrize("ties, depth", [(False, None), (True, 6)])
def test_same_as_complete_rankings(spark, ties, depth):
    t = tables(5 + ties, 300, 6, ties=ties)
    got, rounds = run(spark, *t, 6, depth)
    assert got == complete(*t, 6)
    assert depth is None or len(rounds) > 1  # lists of six can't be enough: deeper ones were asked for


def test_a_tier_that_both_rankings_put_last(spark):
    """The second tier holds all the best chunks, so the first one's ranks are bad and its bound hardly tells anything."""
    chunks = [(c, "poor" if c >= 400 else "good", [1.0, 0.001 * c]) for c in range(800)]
    scores = [(0, c, float(c + 1)) for c in range(400)] + [(0, c, 0.5 - c / 10_000) for c in range(400, 800, 2)]
    t = ([(0, [1.0, 0.0])], chunks, [(0, "poor", 0), (0, "good", 1)], scores)
    got, _ = run(spark, *t, 4)
    assert got == complete(*t, 4)


def test_work_does_not_grow_with_the_chunks(spark):
    read = []
    for n in (400, 1600):
        t = tables(9, n, 3, cells=2)
        got, rounds = run(spark, *t, 4)
        assert got == complete(*t, 4)
        read.append(sum(rows for _, rows in rounds))
    assert read[1] < 1.5 * read[0] and read[1] < 0.5 * 3 * 1600


def test_few_chunks_and_nothing_at_all(spark):
    t = tables(2, 4, 3)
    assert run(spark, *t, 6)[0] == complete(*t, 6)
    assert run(spark, t[0], [], t[2], [], 6)[0] == {}
