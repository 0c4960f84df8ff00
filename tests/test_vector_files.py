"""Vector files: round trips, ranges of any size, commits that count at the end."""

import json
import struct

import numpy as np
import pytest

from sandloom.sources.vectors import HEADER, layout, read_vectors, vector_lines, write_vectors


def table(spark, path, rows=65536):
    return {(r.file, r.row): (r.id, list(r.vector)) for r in read_vectors(spark, str(path), rows).collect()}


@pytest.mark.parametrize("rows", [1, 3, 7, 100])
@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i4", ">f4"])
def test_npy_by_ranges(spark, tmp_path, rows, dtype):
    m = np.arange(21).reshape(7, 3).astype(dtype)
    np.save(tmp_path / "a.npy", m)
    got = table(spark, tmp_path / "a.npy", rows)
    assert got == {("a.npy", i): (i, m[i].astype(float).tolist()) for i in range(7)}
    assert read_vectors(spark, str(tmp_path / "a.npy"), rows).rdd.getNumPartitions() == -(-7 // rows)


def flat(m, mark=b"IxF2", metric=1):
    return mark + struct.pack("<iqqq?i", m.shape[1], len(m), 1 << 20, 1 << 20, True, metric) + struct.pack("<Q", m.size) + m.astype("<f4").tobytes()


def test_flat_index_and_folder(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(5, 4)).astype(np.float32)
    (tmp_path / "x.index").write_bytes(flat(m))
    np.save(tmp_path / "y.npy", m[:2])
    (tmp_path / "z.txt").write_text("no vectors")
    got = table(spark, tmp_path, 2)
    assert got == {("x.index", i): (i, m[i].tolist()) for i in range(5)} | {("y.npy", i): (i, m[i].tolist()) for i in range(2)}


def test_nothing_there_and_nothing_in_it(spark, tmp_path):
    missing = read_vectors(spark, str(tmp_path / "none"))
    assert missing.columns == ["file", "row", "id", "vector"] and missing.count() == 0
    np.save(tmp_path / "e.npy", np.zeros((0, 3), np.float32))
    assert read_vectors(spark, str(tmp_path / "e.npy")).count() == 0


def test_round_trip_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(10 * i, [float(i), i / 3]) for i in range(50)], "vec_id long, embedding array<double>").repartition(3)
    write_vectors(rows, path)
    back = lambda: {r.id: list(r.vector) for r in read_vectors(spark, path, 4).collect()}
    assert back() == {10 * i: [np.float32(i), np.float32(i / 3)] for i in range(50)}
    write_vectors(spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, embedding array<double>"), path, mode="append")
    assert len(back()) == 51 and back()[7] == [1.0, 2.0]
    write_vectors(rows.limit(0), path)
    assert back() == {}


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    write_vectors(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"), path)
    bad = spark.createDataFrame([(2, [1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<double>").repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        write_vectors(bad, path)
    np.save(tmp_path / "v" / "vectors-left.npy", np.ones((3, 2), np.float32))  # what a lost task leaves behind
    assert [(r.id, list(r.vector)) for r in read_vectors(spark, path).collect()] == [(1, [1.0, 2.0])]
    assert json.loads((tmp_path / "v" / HEADER).read_text())["rows"] == 1


def test_unfit_files(tmp_path):
    with pytest.raises(ValueError):
        layout(b"something else altogether")
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        layout((tmp_path / "o.npy").read_bytes())


def test_lines(spark, tmp_path):
    vector_lines(spark.createDataFrame([(4, [0.5, -1.25]), (5, None)], "vec_id long, embedding array<double>"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["4 0.500000 -1.250000"]
