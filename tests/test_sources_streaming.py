import datetime
import json

import pytest
from pyspark.sql import functions as F

from sandloom.sources import io
from sandloom.streaming import sessions


def test_files_texts_and_books(spark, tmp_path):
    book = tmp_path / "class_7" / "maths" / "english"
    book.mkdir(parents=True)
    (book / "term_1_2023 x.pdf").write_bytes(b"%PDF")
    (tmp_path / "loose.pdf").write_bytes(b"%PDF")
    (tmp_path / "a.txt").write_bytes("grün".encode())
    (tmp_path / "b.txt").write_bytes("grün".encode("latin-1"))
    got = {r.file_path: r for r in io.books(spark, str(tmp_path)).collect()}
    r = got["class_7/maths/english/term_1_2023 x.pdf"]
    assert (r.class_level, r.subject, r.medium, r.term, r.problem) == (7, "maths", "en", 1, None)
    assert got["loose.pdf"].problem and got["loose.pdf"].file_hash == r.file_hash
    assert {(x.source, x.text) for x in io.text_files(spark, [str(tmp_path)]).collect()} == {("a.txt", "grün"), ("b.txt", "grün")}


def test_chunk_files_of_all_forms(spark, tmp_path):
    forms = {"a": {"chunks": [{"text": "x"}]}, "b": ["x", "y"], "c": [{"chunk_id": 2, "text": "y"}, {"chunk_id": 1, "text": "x"}], "d": {"10": "y", "2": "x"}}
    for k, v in forms.items():
        (tmp_path / f"{k}_chunks.json").write_text(json.dumps(v))
    got = {}
    for r in io.chunk_files(spark, str(tmp_path)).orderBy("file_path", "seq").collect():
        got.setdefault(r.file_path[0], []).append(r.text)
    assert got == {"a": ["x"], "b": ["x", "y"], "c": ["x", "y"], "d": ["x", "y"]}
    (tmp_path / "m.json").write_text("{broken")
    with pytest.raises(Exception, match=r"(?i)malformed"):
        io.read_strict_json(spark, str(tmp_path / "m.json"), "a int").collect()


def test_writers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("English,Tamil\nAtom,1\natom ,2\n")
    assert [tuple(r) for r in io.csv_map(spark, str(tmp_path / "g.csv"), "English", "Tamil").collect()] == [("atom", "2")]
    c = spark.createDataFrame([("c1", "light waves", "en", 6, [0.5, 0.25]), ("c2", "ஒளி", "ta", 7, [1.0, 0.0])], "chunk_id string, text string, medium string, class_level int, embedding array<float>")
    io.save_chunks(c, f"{tmp_path}/chunks")
    plan = spark.read.parquet(f"{tmp_path}/chunks").filter("medium = 'ta'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(medium" in plan._jdf.queryExecution().executedPlan().toString()
    io.save_index(c, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index/term_stats").count() == 3
    io.append(c.select("chunk_id"), f"{tmp_path}/log")
    io.append(c.select("chunk_id"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    io.save_csv_by(c.select("chunk_id", "medium"), f"{tmp_path}/csv", ["medium"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/by_medium").count() == 2
    assert io.parquet_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    assert io.markdown_table(c.select("chunk_id")).startswith("| chunk_id |\n| --- |\n| c")
    assert io.wide_vectors(c.select("chunk_id", "embedding"), 2).columns == ["chunk_id", "dim_0", "dim_1"]


CALLS = [0, 1, 2, 3, 4, 5, 59, 60, 61]


def test_rate_limit_golden_as_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, float(t)) for t in CALLS] + [(2, 0.0)], "client long, ts double")
    want = {(1, float(t)): t not in (5, 59) for t in CALLS} | {(2, 0.0): True}
    assert {(r.client, r.ts): r.accepted for r in sessions.fold(rows, sessions.RateLimit).collect()} == want
    for k, part in enumerate((rows.filter("ts < 4"), rows.filter("ts >= 4"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        q = sessions.stream(src, sessions.RateLimit).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        assert q.exception() is None, k
    assert {(r.client, r.ts): r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_cache_and_session_filters(spark):
    c = spark.createDataFrame([("k", 0.0), ("k", 50.0), ("k", 99.0), ("k", 120.0)], "cache_key string, ts double")
    assert [r.hit for r in sessions.fold(c, sessions.AnswerCache, seconds=100).orderBy("ts").collect()] == [False, True, True, False]
    s = spark.createDataFrame([(1, 0.0, "a"), (1, 10.0, None), (1, 20.0, "b"), (1, 5000.0, None)], "session long, ts double, filters string")
    assert [r.filters for r in sessions.fold(s, sessions.SessionFilters).orderBy("ts").collect()] == ["a", "a", "b", None]


def test_history_debounce_and_reassembly(spark):
    m = spark.createDataFrame([(1, i) for i in range(10)], "conv long, turn int")
    assert sorted(r.turn for r in sessions.last_messages(m, "conv", ["turn"]).collect()) == [4, 5, 6, 7, 8, 9]
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    e = spark.createDataFrame([("f", at(0)), ("f", at(4)), ("f", at(20))], "f string, ts timestamp")
    assert [r.n for r in sessions.debounce(e, ["f"]).orderBy("first_ts").collect()] == [2, 1]
    t = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, seq int, piece string")
    assert sessions.reassemble(t, "id", "seq", "piece").first().text == "ab"


def test_job_table_stream(spark, tmp_path):
    u = spark.createDataFrame([(1, "queued", 1), (1, "completed", 3), (2, "queued", 2), (1, "processing", 2)], "job_id long, state string, ts long")
    u.write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(u.schema).parquet(f"{tmp_path}/in")
    sessions.write_jobs(src, f"{tmp_path}/jobs", f"{tmp_path}/cp").awaitTermination()
    assert {tuple(r) for r in sessions.job_versions(spark, f"{tmp_path}/jobs").collect()} == {(1, "completed", 3), (2, "queued", 2)}
    w = sessions.windowed_counts(spark.range(3).select(F.timestamp_seconds(F.col("id") * 400).alias("ts"), F.lit("x").alias("k")), ["k"], "10 minutes")
    assert sorted(r.n for r in w.collect()) == [1, 2]


def streamed(spark, tmp_path, parts, state, schema, between=lambda: None, **options):
    """Rows of a stream that is run to its end once for each part, and the states that are left."""
    kept = 0
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = sessions.stream(src, state, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(120), "the stream doesn't end"
        assert q.exception() is None
        kept = q.lastProgress.stateOperators[0].numRowsTotal
        between()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), kept


def folded(spark, parts, state, schema, **options):
    return sorted(tuple(r) for r in sessions.fold(spark.createDataFrame([r for p in parts for r in p], schema), state, **options).collect())


def test_a_pause_by_the_clock_forgets_nothing(spark, tmp_path):
    import time

    schema = "client long, ts double"
    parts = [[(1, 0.0), (1, 0.1), (1, 0.2), (2, 0.2)], [(1, 0.5), (1, 0.9), (1, 1.15), (2, 9.0)]]
    got, _ = streamed(spark, tmp_path, parts, sessions.RateLimit, schema, lambda: time.sleep(2), most=2, seconds=1.0)
    assert got == folded(spark, parts, sessions.RateLimit, schema, most=2, seconds=1.0)
    assert [a for c, _, a in got if c == 1] == [True, True, False, False, False, True]


def test_quiet_state_goes_with_the_watermark(spark, tmp_path):
    schema = "client long, ts double"
    parts = [[(c, float(c)) for c in range(20)], [(99, 500.0)], [(99, 501.0)]]
    got, kept = streamed(spark, tmp_path, parts, sessions.RateLimit, schema, seconds=60.0)
    assert kept == 1 and got == folded(spark, parts, sessions.RateLimit, schema)


def test_cache_and_filters_as_streams(spark, tmp_path):
    schema = "cache_key string, ts double"
    parts = [[("k", 0.0), ("j", 10.0)], [("k", 50.0), ("k", 99.0)], [("k", 120.0), ("j", 300.0)]]
    got, _ = streamed(spark, tmp_path / "a", parts, sessions.AnswerCache, schema, seconds=100.0)
    assert got == folded(spark, parts, sessions.AnswerCache, schema, seconds=100.0)
    schema = "session long, ts double, filters string"
    parts = [[(1, 0.0, "a"), (2, 1.0, None)], [(1, 10.0, None), (1, 20.0, "b")], [(1, 5000.0, None), (2, 5001.0, "c")], [(2, 5002.0, None)]]
    got, _ = streamed(spark, tmp_path / "b", parts, sessions.SessionFilters, schema)
    assert got == folded(spark, parts, sessions.SessionFilters, schema) and [f for k, _, f in got if k == 1] == ["a", "a", "b", None]


def test_trigger_fires_without_a_record_of_its_own(spark, tmp_path):
    schema = "repo long, ts double, commit string, changed boolean"
    parts = [[(1, 10.0, None, True), (1, 20.0, None, True), (1, 30.0, "c1", False), (1, 40.0, None, True)], [(2, 5000.0, None, False)], [(1, 6000.0, "c1", False), (1, 6001.0, "c2", True)]]
    got, _ = streamed(spark, tmp_path, parts[:2], sessions.ChangeTrigger, schema)
    assert got == [(1, 10.0, "change"), (1, 30.0, "commit"), (1, 930.0, "timer")]  # at 930 there is only repo 2's record
    got, _ = streamed(spark, tmp_path, parts[2:], sessions.ChangeTrigger, schema)
    assert got == folded(spark, parts, sessions.ChangeTrigger, schema)


def test_random_streams_are_folds(spark, tmp_path):
    import random

    rnd = random.Random(2)
    rows = sorted((rnd.uniform(0, 400), rnd.randrange(4)) for _ in range(120))
    parts = [[(k, t) for t, k in rows[i : i + 40]] for i in range(0, 120, 40)]
    got, _ = streamed(spark, tmp_path, parts, sessions.RateLimit, "client long, ts double", most=3, seconds=30.0)
    assert got == folded(spark, parts, sessions.RateLimit, "client long, ts double", most=3, seconds=30.0)


def test_old_versions_of_the_job_table_go(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(1, f"s{k}", k)], "job_id long, state string, ts long").write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema("job_id long, state string, ts long").parquet(f"{tmp_path}/in")
        sessions.write_jobs(src, f"{tmp_path}/jobs", f"{tmp_path}/cp").awaitTermination()
    assert sorted(p.name for p in (tmp_path / "jobs").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]
    assert sessions.job_versions(spark, f"{tmp_path}/jobs").first().state == "s3"


def test_databases_corpora_and_caches(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    opts = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "createTableColumnTypes": "issue VARCHAR(200), status VARCHAR(40)"}
    rows = spark.createDataFrame([(i, f"issue {i}", "pending_review") for i in range(20)], "id long, issue string, status string")
    io.write_jdbc(rows, url, "queue", "overwrite", **opts)
    assert io.read_jdbc(spark, url, "queue", where="id < 5", **opts).count() == 5
    assert io.read_jdbc(spark, url, "queue", split="id", parts=3, **opts).count() == 20
    io.update_jdbc(spark.createDataFrame([(3, "issue 3", "approved"), (99, "new", "approved")], "id long, issue string, status string"), url, "queue", "id", **opts)
    got = io.read_jdbc(spark, url, "queue", **opts)
    assert got.count() == 21 and {r[0] for r in got.filter("status = 'approved'").select("id").collect()} == {3, 99}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c" / "b.csv").write_text('body,n\n"x, y",1\n,2\n')
    assert [tuple(r) for r in io.corpus(spark, [f"{tmp_path}/c/a.txt"]).collect()] == [("a.txt", "one"), ("a.txt", "two")]
    assert [tuple(r) for r in io.corpus(spark, [f"{tmp_path}/c/b.csv"], "csv", "body").collect()] == [("b.csv", "x, y")]
    with pytest.raises(ValueError, match="text or csv"):
        io.corpus(spark, [], "json")
    made = []
    for _ in range(2):
        assert io.cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
    io.append_session(spark.range(2), f"{tmp_path}/session")
    io.append_session(spark.range(2), f"{tmp_path}/session")
    assert spark.read.json(f"{tmp_path}/session").count() == 4
