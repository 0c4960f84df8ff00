import zlib

import corpus_pipeline as P
from sandloom.llm._common import ROW, keyed
from sandloom.llm.quality import quality_scores

from .test_classifiers import case
from .test_decontamination import brute as leaks
from .test_exact_dedup import brute as equals
from .test_jaccard import brute as groups


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = case(300)
    docs = [(i, t, "en", None, len(t)) for i, t, _ in docs]
    docs += [(1000 + i, t.replace(" ", "  "), "en", "s", 1) for i, t, *_ in docs[:40]]
    docs += [(2000 + i, t + " more", "en", "s", 1) for i, t, *_ in docs[50:80]]
    docs += [(3000, "it begins " + docs[91][1][:200] + " and ends", "en", "s", 1), (3001, None, None, None, None), (3002, "", "en", "s", 0)]
    items = [(1, docs[91][1][:160]), (2, "nothing of this is there at all in any text")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, x string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bad = {r.doc_id for r in quality_scores(d, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.score < 0.3}
    truth = {i: q for i, q, *_ in labels}
    assert sum(truth[i] for i in bad if i in truth) <= 2
    steps = [
        lambda rows: [r for r in rows if r[0] not in bad],
        lambda rows: [r for r in rows if r[0] in {k[0] for k in equals([x[:3] for x in rows]) if k[3]}],
        lambda rows: [r for r in rows if r[0] in {k[0] for k in groups([x[:2] for x in rows]) if k[0] == k[2]}],
        lambda rows: [r for r in rows if r[0] not in {k[0] for k in leaks([x[:2] for x in rows], items)}],
    ]
    rows, now = sorted(docs), d
    for (name, stage), step in zip(P.STAGES, steps, strict=False):
        before, rows = len(rows), step(rows)
        now = stage(spark, now, str(tmp_path))
        assert now.columns == d.columns
        assert sorted((tuple(r) for r in now.collect())) == rows, name
        assert len(rows) < before, name
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert all(r.length <= 2048 for r in out) and zlib.crc32(b"") == 0


def test_stages_on_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_judge_rows_with_null_and_repeated_ids(spark, tmp_path):
    docs, labels = case(300)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    scores = {r.doc_id: r.score for r in quality_scores(spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, x string")).collect()}
    text = {i: t for i, t, _ in docs}
    good, bad = [text[i] for i in sorted(text) if scores[i] > 0.6][:9], [text[i] for i in sorted(text) if scores[i] < 0.2][:2]
    passage = " ".join(f"passage{k}" for k in range(20))
    odd = [
        (None, bad[0]), (None, "first of its own " + good[0]), (5000, bad[1]), (5000, "second of its own " + good[1]),  # quality
        (None, good[2] + " copy"), (5001, good[2] + "  copy"), (5001, "third of its own " + good[3]),  # exact: 5001 stays
        (None, good[4] + " twin"), (None, good[4] + " twin"), (5002, good[5] + " twin"), (5002, good[5] + "  twin"),  # exact: one of each two
        (None, good[6] + " near"), (None, good[6] + " near copy"), (5003, good[7] + " near"), (5003, good[7] + " near copy"), (5003, "fourth of its own " + good[8]),  # near: one of each two
        (None, good[0].upper() + " " + passage), (5004, "leaks " + passage), (5004, "fifth of its own " + " ".join(f"fresh{k}" for k in range(60))),
    ]
    labelled = [(i, t, "en", None, k) for k, (i, t, _) in enumerate(docs)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, x string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    ids = lambda gone: sorted(str(i) for i, _ in gone)

    def run(stage, rows):
        rows = [(i, t, "en", None, k) for k, (i, t) in enumerate(rows)]
        spark.createDataFrame(rows, kind).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/rows.parquet")
        outs = [stage(spark, d, str(tmp_path)).collect() for d in (spark.read.parquet(f"{tmp_path}/rows.parquet"), spark.createDataFrame(rows, kind))]
        gone = [[r[:2] for r in rows if r[4] not in {x.n_chars for x in out}] for out in outs]
        assert all({tuple(x) for x in out} <= set(rows) for out in outs)
        assert ids(gone[0]) == ids(gone[1])
        return gone[0]

    rows = odd + [r[:2] for r in labelled]
    known = {i for i, *_ in docs}
    assert [r for r in run(P.quality, rows) if r[0] not in known] == [odd[0], odd[2]]
    gone = run(P.exact, odd)
    assert odd[4] in gone and {t.split()[-1] for _, t in gone} == {"copy", "twin"} and ids(gone) == ["5002", "None", "None"]
    gone = run(P.near, odd[1:4:2] + odd[11:16])
    assert ids(gone) == ["5003", "None"] and all(" near" in t for _, t in gone)
    assert run(P.decontaminated, odd) == odd[16:18]


def test_stages_on_clashing_columns_and_very_long_texts(spark, tmp_path):
    """Columns named like those of the stages' own tables pass through; a long text is judged whole."""
    names = ["row_key", "row_file", "row_place", "row_number", "group_id", "component_id", "digest", "keep_id", "key", "owner", "n", "first", "bad_key", "label", "score"]
    long = " ".join(f"w{k % 4999}x{k % 101}" for k in range(150_000))  # over a million characters
    passage = " ".join(f"passage{k}" for k in range(20))
    docs = [(1, long), (2, long.replace(" ", "\n")), (3, long + " tail"), (4, long + " " + passage), (5, "short of its own"), (None, "nothing")]
    rows = [(i, t, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3).write.parquet(f"{tmp_path}/rows.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/rows.parquet")
    for stage, kept in ((P.exact, {1, 3, 4, 5, None}), (P.near, {1, 5, None}), (P.decontaminated, {1, 2, 3, 5, None})):
        out = stage(spark, d, str(tmp_path))
        got = [tuple(r) for r in out.collect()]
        assert out.columns == d.columns and {r[0] for r in got} == kept and len(got) == len(kept)
        assert set(got) <= set(rows)


def test_row_keys_by_broadcast_and_by_shuffle(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    keys = [{r.id: r[ROW] for r in keyed(t, most).collect()} for most in (1 << 20, 0)]
    assert keys[0] == keys[1] and len(set(keys[0].values())) == 1000
    assert len({k >> 40 for k in keys[0].values()}) == 7


def test_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("200", "200")):
            spark.conf.set(name, given)
            P.small_batches(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
