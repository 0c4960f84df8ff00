"""Manifest versions: writers that meet lose nothing, readers keep what they opened, old versions go once nobody reads them."""

import pytest

from sandloom.operators import manifest as M

SCHEMA = "file_path string, file_hash string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def shown(df):
    return {tuple(r) for r in df.select("file_path", "file_hash").collect()}


def test_first_and_later_commits(spark, tmp_path):
    store = M.ManifestStore(spark, f"{tmp_path}/m")
    assert store.current() == 0 and store.read(SCHEMA).count() == 0
    assert store.upsert(frame(spark, ("a", "1"), ("b", "1"))) == 1
    assert store.upsert(frame(spark, ("b", "2"), ("c", "1"))) == 2
    assert shown(store.read()) == {("a", "1"), ("b", "2"), ("c", "1")}


def test_interleaved_writers_lose_no_row(spark, tmp_path):
    one, two = (M.ManifestStore(spark, f"{tmp_path}/m") for _ in range(2))
    one.upsert(frame(spark, ("a", "1")))
    met = []

    def other():  # the second writer commits after the first has read, before it commits
        if not met:
            met.append(two.upsert(frame(spark, ("b", "2"), ("a", "9"))))

    assert one.upsert(frame(spark, ("c", "3")), before_commit=other) == 3 and met == [2]
    assert shown(one.read()) == {("a", "9"), ("b", "2"), ("c", "3")}


def test_a_writer_that_always_loses_says_so(spark, tmp_path):
    one, two = (M.ManifestStore(spark, f"{tmp_path}/m") for _ in range(2))
    with pytest.raises(RuntimeError, match="other writers"):
        one.upsert(frame(spark, ("c", "3")), tries=2, before_commit=lambda: two.upsert(frame(spark, ("b", "2"))))
    assert shown(one.read()) == {("b", "2")}


def test_a_pinned_reader_sees_one_version_to_its_end(spark, tmp_path):
    store = M.ManifestStore(spark, f"{tmp_path}/m")
    store.upsert(frame(spark, ("a", "1")))
    with store.pinned() as seen:
        for k in range(4):
            store.upsert(frame(spark, ("a", f"new {k}"), (f"x{k}", "1")))
        store.expire(keep=1)
        assert shown(seen) == {("a", "1")}
    store.expire(keep=1)
    assert store.versions() == [5] and ("a", "new 3") in shown(store.read())
    with pytest.raises(Exception, match=r"(?i)not exist|no such|cannot"):
        seen.sparkSession.read.parquet(f"{tmp_path}/m/data/v=1").count()


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path):
    store = M.ManifestStore(spark, f"{tmp_path}/m")
    store.upsert(frame(spark, ("a", "1")))

    def crash():
        raise KeyError("crash")

    with pytest.raises(KeyError):
        store.upsert(frame(spark, ("b", "1")), before_commit=crash)
    assert shown(store.read()) == {("a", "1")} and store.current() == 1
    assert store.upsert(frame(spark, ("b", "2"))) == 2
