"""The manifest against a plain walk over lists, for several fanouts and depths, and against DuckDB."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sandloom.llm import merkle

from ..compare import oracle, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    doc_id, text, lang, source, n = r
    return h(*map(field, (doc_id, source, lang, n if n is None else n + more, text)))


def tree(leaves, fanout):
    """The top, and each leaf's path: per level (siblings before, siblings after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for i, a in enumerate(at):
            run, p = runs[a // fanout], a % fanout
            paths[i].append((run[:p], run[p + 1 :]))
            at[i] = a // fanout
        level = [h(*r) for r in runs]
    return level[0], paths


def brute(table, fanout):
    groups = {}
    for r in table:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    per, tops = {}, []
    for g in langs:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in mine], fanout)
        per[g] = (mine, paths)
        tops.append(top)
    root, over = tree(tops, fanout)
    out = []
    for g, sub, lang_path in zip(langs, tops, over, strict=True):
        for r, path in zip(*per[g], strict=True):
            whole = path + lang_path
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if bad else 0)
            for before, after in whole:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), sub, root, h(*[x for b, a in whole for x in b + a]), node, node == root))
    return sorted(out, key=str)


def run(spark, tmp_path, table, fanout=2, depth=4, schema=SCHEMA, more=()):
    df = spark.createDataFrame(table, schema).select("*", *more)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.merkle_manifest(df, F.when(tampered, merkle.leaf_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])), fanout, depth)
    got = made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted([tuple(r) for r in got.collect()], key=str)


TABLE = [(i, f"text {i}", "en" if i % 3 else "de", f"s{i % 4}", i) for i in range(37)]
TABLE += [(None, None, None, None, None), (5, "again", "en", None, 1), (5, "again", "en", None, 1), (7, "", "é", "", None), (8, "ü" * 5000, "", "x:1", 0), (-3, "1:2", "en", "-", -5), (None, "x", "en", "s", 2)]


@pytest.mark.parametrize(("fanout", "depth"), [(2, 4), (2, 1), (3, 2), (5, 1)])
def test_against_lists(spark, tmp_path, fanout, depth):
    assert run(spark, tmp_path, TABLE, fanout, depth) == brute(TABLE, fanout)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_sizes_and_clashing_columns(spark, tmp_path, n):
    names = ["g", "idx", "n", "leaf", "digest", "payload", "part", "root", "proof", "carry", "kids", "layers", "height", "all"]
    more = [F.lit("x").alias(c) for c in names]
    one = [(i, f"t{i}", "en", "s", 3) for i in range(n)]
    assert run(spark, tmp_path, one, more=more) == brute(one, 2) if n else run(spark, tmp_path, one, more=more) == []


def test_each_row_its_own_language(spark, tmp_path):
    own = [(i, "t", f"l{i}", "s", i) for i in range(21)]
    assert run(spark, tmp_path, own) == brute(own, 2)


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows(merkle.query(spark, folder).toPandas()) == rows(oracle(merkle.SQL, folder))
