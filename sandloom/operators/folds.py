"""Order-dependent folds: one pass over each group's rows in order, with state of bounded size.

Rows are dealt by key and sorted within partitions; a task streams through its groups, so a large group needs time but no
memory. Only folds whose state depends on earlier decisions are done this way; all others are window functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable, schema: str, batch: int = 10_000) -> DataFrame:
    """start(key) makes a group's state; state.step(row) and state.end() yield output tuples. Sorted by keys and order."""

    def run(frames):
        state, at, out = None, None, []
        names = None
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                key = tuple(None if v != v else v for v in key)
                if state is None or key != at:
                    if state is not None:
                        out += state.end()
                    state, at = start(key), key
                out += state.step(row)
                if len(out) >= batch:
                    yield pd.DataFrame(out, columns=names_of())
                    out = []
        if state is not None:
            out += state.end()
        if out:
            yield pd.DataFrame(out, columns=names_of())
        del names

    def names_of():
        return [c.strip().split()[0] for c in _columns(schema)]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    depth, out, now = 0, [], ""
    for ch in schema:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]
