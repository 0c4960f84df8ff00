import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sandloom.operators import chunking, corpus, evaluation, graph, layout, lexical, lookup, manifest, mindmap, plugins, ranking, retrieval, similarity, units


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_rrf_golden_and_symmetric(spark):
    a = spark.createDataFrame([(1, c, i) for i, c in enumerate("abc", 1)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, c, i) for i, c in enumerate("cab", 1)], "q int, d string, rank int")
    got = {r.d: r.rrf for r in ranking.rrf([a, b], "q", "d").collect()}
    assert math.isclose(got["a"], 1 / 61 + 1 / 62) and math.isclose(got["c"], 1 / 63 + 1 / 61) and math.isclose(got["b"], 1 / 62 + 1 / 63)
    other = {r.d: r.rrf for r in ranking.rrf([b, a], "q", "d").collect()}
    assert all(math.isclose(got[k], other[k]) for k in got) and sorted(got, key=lambda k: -got[k]) == ["a", "c", "b"]


def test_metrics_golden(spark):
    d = spark.createDataFrame([(1, [7, 2, 9, 3], [2, 3]), (2, [2, 2], [2]), (3, [0, 5], [5])], "id int, retrieved array<int>, expected array<int>")
    m = {r.id: r for r in evaluation.retrieval_metrics(d, (3,), 3).collect()}
    assert m[1].recall_3 == 1 and math.isclose(m[1].precision_3, 1 / 3) and m[1].mrr == 0.5 and math.isclose(m[1].ndcg_3, (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert math.isclose(m[2].ndcg_3, 1 + 1 / math.log2(3)) and m[3].mrr == 1
    assert evaluation.retrieval_metrics(d, (3,), 3, dedupe=True).filter("id = 2").first().ndcg_3 == 1
    slim = d.withColumn("n_expected", F.size("expected")).withColumn("expected", F.array_intersect("expected", "retrieved"))
    assert evaluation.retrieval_metrics(slim, (3,), 3).drop("expected", "n_expected").collect() == evaluation.retrieval_metrics(d, (3,), 3).drop("expected").collect()


def test_kappa(spark):
    same = spark.createDataFrame([(1, 1), (2, 2), (5, 5)], "a int, b int")
    assert evaluation.quadratic_kappa(same, "a", "b").first().kappa == 1.0
    rng = random.Random(1)
    pairs = [(rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(60)]
    k = len({x for p in pairs for x in p})
    o = np.zeros((k, k))
    for a, b in pairs:
        o[a - 1, b - 1] += 1
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)])
    e = np.outer(o.sum(1), o.sum(0)) / len(pairs)
    got = evaluation.quadratic_kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    assert got.n == 60 and math.isclose(got.kappa, 1 - (w * o).sum() / (w * e).sum())


def test_bm25_identities(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1) + ("rare" if i == 3 else "")) for i in range(10)], "doc_id long, text string")
    posts, lengths = lexical.postings(docs), lexical.doc_stats(docs)
    idf = {r.term: r.idf for r in lexical.term_stats(posts, lexical.corpus_stats(lengths)).collect()}
    assert math.isclose(idf["w"], math.log(0.5 / 10.5 + 1))
    assert rows(posts.groupBy("doc_id").agg(F.sum("tf"))) == rows(lengths)
    q = spark.createDataFrame([(1, "rare"), (2, "rare rare")], "item_id long, text string")
    s = {r.item_id: r.score for r in lexical.bm25(q, docs).collect()}
    assert math.isclose(s[2], 2 * s[1])


def test_term_rule_and_fallback(spark):
    d = spark.createDataFrame([(6, 1, 1, True), (6, 1, 2, False), (8, 1, 0, True), (8, 1, 1, False), (9, 1, 3, True), (None, 1, 3, True), (7, None, 3, True)], "c int, t int, k int, want boolean")
    assert all(r.got == r.want for r in d.withColumn("got", retrieval.term_rule("c", "t", "k")).collect())


def test_strict_tiers_stop_when_full(spark):
    r = spark.createDataFrame([(1, i, k) for k, n in (("textbook", 2), ("guide", 3), ("previous_year", 2)) for i in range(n)], "q int, d int, content_type string")
    got = ranking.strict_tier_merge(r, "q", [F.col("d")], 3, ["textbook", "guide", "previous_year"])
    assert [x.content_type for x in got.orderBy("position").collect()] == ["textbook"] * 2 + ["guide"] * 3


def test_rerank_without_scorer_keeps_order(spark):
    c = spark.createDataFrame([(1, 10, 1, 0.2), (1, 11, 2, 0.9), (1, 12, 3, 0.5)], "q int, doc_id int, position int, s double")
    assert [r.doc_id for r in ranking.rerank(c, "q", None, 2).orderBy("rank").collect()] == [10, 11]
    assert [r.doc_id for r in ranking.rerank(c, "q", F.col("s"), 5).orderBy("rank").collect()] == [11, 12]


def test_word_windows_golden_and_cover(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(750))), (2, " ".join(f"word{i}" for i in range(390))), (3, "short")], "doc_id long, text string")
    got = rows(chunking.word_windows(docs).select("doc_id", "start", "n_words"))
    assert got == [(1, 0, 400), (1, 340, 400), (1, 680, 70), (2, 0, 390), (2, 340, 50)]


def test_packers():
    s = ["a b c.", "d e.", "f g h i j k.", "l."]
    assert chunking.pack_sentences(s, 5, carry=1) == ["a b c. d e.", "e. f g h i j k.", "k. l."]
    assert chunking.pack_sentences(["x " * 9], 5, drop_empty=False)[0] == ""
    assert chunking.pack_chars(["aaaa", "bbbb", "cc"], 10) == ["aaaa bbbb", "cc"]
    assert chunking.pack_full_stops("aaa. bbb. cc. d", 10) == ["aaa bbb", "cc d"]  # with its own space the first part makes 8 of 10
    assert chunking.pack_full_stops("x" * 12 + ". yy. . z", 10) == ["x" * 12, "yy  z"] and chunking.pack_full_stops("") == []
    t = " ".join(f"w{i}" for i in range(300))
    parts = chunking.recursive_split(t, 100, 20)
    assert all(len(p) <= 100 for p in parts) and set(" ".join(parts).split()) == set(t.split())
    big = "\n".join(f"line {i} " + "x " * 60 for i in range(20))
    assert all(len(p.split()) <= 500 for p in chunking.split_large(big))
    assert chunking.guide_chunks("intro\nQuestion: why is the sky so blue today? Because of light.\nQuestion: short")[0].startswith("Question: why")


def test_lm_blocks(spark):
    d = spark.createDataFrame([(1, "a", 700), (2, "a", 700), (3, "b", 10)], "doc_id long, source string, n_tokens int")
    assert rows(chunking.lm_blocks(d, 512)) == [("a", 0, 512), ("a", 1, 512), ("b", 0, 10)]


def test_layout_orders_columns(spark):
    blocks = [(0, 0, 0, 100, 10), (1, 0, 20, 45, 30), (2, 55, 20, 100, 30), (3, 0, 40, 45, 50), (4, 55, 40, 100, 50), (5, 0, 60, 100, 70), (6, 55, 80, 100, 90), (7, 0, 85, 45, 95)]
    d = spark.createDataFrame([("f", 1, n, float(a), float(b), float(c), float(e), 100.0, 100.0) for n, a, b, c, e in blocks], "file string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert [r.block_no for r in layout.reading_order(d).orderBy("position").collect()] == [0, 1, 3, 2, 4, 5, 7, 6]
    assert {r.block_no for r in layout.margins(d).collect()} == {0, 1, 2, 3, 4, 5, 6, 7}
    codes = spark.createDataFrame([("f", 1, 0.0, 0.0, 50.0, 50.0)], "file string, page int, x0 double, y0 double, x1 double, y1 double")
    t = d.withColumn("text", F.when(F.col("block_no") == 7, "Scan this QR code").otherwise("text"))
    assert {r.block_no for r in layout.without_qr_captions(t, codes).collect()} == set(range(7))
    images = spark.createDataFrame([("f", 1, 0, 0.0, 0.0, 30.0, 25.0), ("f", 2, 0, 0.0, 0.0, 1.0, 1.0)], "file string, page int, image_no int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page, r.caption) for r in layout.captions(images, t).collect()} == {(1, "text"), (2, None)}


def test_chapters_sections_and_logical_blocks(spark):
    lines = ["intro", "Unit 1: Light", "1.1 Rays", "text", "1.1.2 Mirrors", "text", "Worked example", "more", "1.2 Lenses", "Chapter 2", "Sound", "end"]
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, seq int, text string")
    c = layout.chapters(d).orderBy("seq").collect()
    assert [(r.chapter_seq, r.chapter_no) for r in c] == [(0, "0")] + [(1, "1")] * 8 + [(2, "2")] * 3 and c[10].chapter_title == "Sound"
    s = [r.section_path for r in layout.sections(d).orderBy("seq").collect()]
    assert s[0] == "General" and s[3] == "1.1 Rays" and s[5] == "1.1 Rays > 1.1.2 Mirrors" and s[8] == "1.2 Lenses"
    b = layout.logical_blocks(layout.sections(d)).orderBy("seq").collect()
    assert [r.role for r in b].count("example") == 1 and "\n".join(r.text for r in b).split("\n") == lines


def test_curriculum_chunks(spark):
    blocks = [(1, 0, "a " * 300, "p", "general"), (1, 1, "b " * 40, "p", "general"), (1, 2, "c " * 300, "p", "general"), (1, 3, "d " * 20, "q", "general"), (1, 4, "\n".join(["e " * 200] * 4), "q", "exercise")]
    d = spark.createDataFrame([(k, s, t.strip(), p, r) for k, s, t, p, r in blocks], "doc_id long, seq int, text string, section_path string, role string")
    got = chunking.curriculum_chunks(d).orderBy("chunk_no").collect()
    assert [(r.section_path, r.role, len(r.chunk.split())) for r in got] == [("p", "general", 342), ("p", "general", 342), ("q", "general", 22), ("q", "exercise", 402), ("q", "exercise", 402)]


def test_glossary(spark):
    words = [("f", 1, 0.0, 0.0, 10.0, 10.0, "Glossary"), ("f", 1, 0.0, 20.0, 10.0, 30.0, "அணு"), ("f", 1, 12.0, 21.0, 30.0, 31.0, "-"), ("f", 1, 32.0, 20.0, 50.0, 30.0, "atom"), ("f", 1, 90.0, 22.0, 99.0, 32.0, "cell"), ("f", 1, 0.0, 50.0, 9.0, 60.0, "செல்"), ("f", 1, 0.0, 80.0, 9.0, 90.0, "light")]
    d = spark.createDataFrame(words, "file string, page int, x0 double, y0 double, x1 double, y1 double, word string")
    cols = layout.glossary_columns(d)
    assert [r.text for r in cols.orderBy("seq").collect()] == ["அணு - atom", "cell", "செல்", "light"]
    assert sorted(tuple(r)[2:] for r in layout.glossary_pairs(cols).collect()) == [("", "light", True), ("அணு", "atom", False), ("செல்", "cell", True)]


def test_units():
    text = "1.1 Force and motion is here\n\nExample 1.2 find it\n\nsome words\n\nExercise 1.3\n1. First\n2. Second\n\nOhm's Law\n\n" + "Plain sentence of words here. " * 12
    kinds = [k for k, _ in units.extract_units(text)]
    assert kinds == ["Heading", "Example/Problem", "Exercise Block", "Exercise Sub-Question", "Exercise Sub-Question", "Concept/Law", "Descriptive Unit"]
    assert "Concept/Law" not in [k for k, _ in units.extract_units(text, emit_law=False)]
    assert ("Concept/Law", "Ohms Law") in units.extract_units("The Ohms Law\n\nnext".replace("The ", ""))
    assert units.extract_units("Ohms Law", emit_law=False) == []
    assert [k for k, _ in units.extract_units("Plain sentence of words here. " * 12)] == ["Descriptive Unit"]
    acted = "ACTIVITY 3 Float a cork\n\n" + "Plain sentence of words here. " * 12 + "\n\nTable 2.1 Some Metals and their uses"
    assert [k for k, _ in units.extract_units(acted)] == ["Activity Instruction", "Descriptive Unit", "Table"]
    assert [k for k, _ in units.extract_units(acted, activity_goes_on=True)] == ["Activity Instruction", "Table"]


def test_graph_weights_and_propagation(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 4))
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    e = graph.knn_edges(d, 3)
    got = {(r.src, r.dst) for r in e.collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 8)
    np.fill_diagonal(s, -9)
    near = {(i, int(j)) for i in range(30) for j in np.argsort(-s[i], kind="stable")[:3]}
    assert got == near | {(b, a) for a, b in near}
    assert all(math.isclose(r.w, 1) for r in graph.row_weights(e).groupBy("src").agg(F.sum("weight").alias("w")).collect())
    a = np.eye(30)
    for i, j in got:
        a[i, j] = 1
    w = a / a.sum(1, keepdims=True)
    p = graph.propagate(graph.row_weights(e), d.select(F.col("vec_id").alias("node"), "embedding"), [0.2, 0.3, 0.5]).orderBy("node").collect()
    np.testing.assert_allclose([r.embedding for r in p], 0.2 * v + 0.3 * w @ v + 0.5 * w @ w @ v)
    n = a / np.sqrt(np.outer(a.sum(1), a.sum(1)))
    assert all(math.isclose(r.weight, n[r.src, r.dst]) for r in graph.symmetric_weights(e).collect())


def test_relevant_sentences_golden(spark):
    q = "Explain what the CELL wall is, and the wall of a plant"
    text = "  Animals eat food daily.\n\nThe heading line\nwithout an end\n \nPlants stand still! The cell wall of a plant protects it. Short one. पादप कोशिका भित्ति। Sixth sentence comes here. Seventh sentence is last. Eighth one is left. Ninth is out of it"
    d = spark.createDataFrame([(q, text), (q, "tiny. bits."), ("is it of", text), ("zebra", text.replace(" is ", " was "))], "q string, t string")
    got = d.select(mindmap.question_keywords("q").alias("k"), mindmap.excerpt_sentences("t").alias("s"), mindmap.relevant_sentences("t", mindmap.question_keywords("q")).alias("x")).collect()
    assert got[0].k == ["cell", "wall", "wall", "plant"]
    s = ["Animals eat food daily.", "The heading line\nwithout an end", "Plants stand still!", "The cell wall of a plant protects it.", "पादप कोशिका भित्ति।", "Sixth sentence comes here.", "Seventh sentence is last.", "Eighth one is left.", "Ninth is out of it"]
    assert got[0].s == s
    assert [r.x for r in got] == [" ".join(s[2:8]), "tiny. bits.", " ".join(s[:5]), " ".join(s[:5])]


def test_vectors_are_summed_whole(spark):
    rng = np.random.default_rng(3)
    v, keys, w = rng.normal(size=(500, 7)), rng.integers(0, 9, 500), rng.normal(size=500)
    keys[:250] = 4  # one key holds half of all rows
    d = spark.createDataFrame([(int(k), float(a), x.tolist()) for k, a, x in zip(keys, w, v, strict=True)], "k long, w double, v array<double>").repartition(5)
    got = {r.k: r.v for r in graph.sum_vectors(d, "k", "w", "v").collect()}
    assert len(got) == len(set(keys.tolist()))
    for k, x in got.items():
        np.testing.assert_allclose(x, (v * w[:, None])[keys == k].sum(axis=0))
    named = d.withColumn("k", F.concat(F.lit("n"), "k"))
    assert {r.k for r in graph.sum_vectors(named, "k", "w", "v").collect()} == {f"n{k}" for k in got}
    assert graph.sum_vectors(d.filter("false"), "k", "w", "v").count() == 0
    hole = d.unionByName(spark.createDataFrame([(99, 1.0, None), (None, 1.0, [0.0] * 7)], d.schema))
    assert {r.k for r in graph.sum_vectors(hole, "k", "w", "v").collect()} == set(got)


def test_rotations_of_many_dimensions(spark):
    rng = np.random.default_rng(5)
    d = 768
    x = rng.normal(size=(60, d))
    pairs = spark.createDataFrame([(i, a.tolist(), a[::-1].tolist()) for i, a in enumerate(x)] + [(99, None, None)], "id long, a array<double>, b array<double>")
    m = graph.procrustes(pairs, "a", "b")
    np.testing.assert_allclose(m.T @ m, np.eye(d), atol=1e-8)
    turned = graph.apply_matrix(pairs, m, "a").orderBy("id").collect()
    np.testing.assert_allclose([r.aligned for r in turned[:60]], x[:, ::-1], atol=1e-6)
    assert turned[60].aligned is None


def test_numbers_over_all_rows(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    got = mindmap.numbered(d, ["x"], "place", first=2)
    assert got.filter("place = x + 2").count() == 1000 and mindmap.numbered(d.filter("false"), ["x"], "place").count() == 0


def test_procrustes_is_orthogonal_and_turns_back(spark):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    x = rng.normal(size=(40, 5))
    d = spark.createDataFrame([(r.tolist(), (q @ r).tolist()) for r in x], "a array<double>, b array<double>")
    w = graph.procrustes(d, "a", "b")
    np.testing.assert_allclose(w.T @ w, np.eye(5), atol=1e-9)
    assert all(np.allclose(r.aligned, r.b) for r in graph.apply_matrix(d, w, "a").collect())


def test_topk_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(50, 6)))] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    q = d.select(F.col("vec_id").alias("query_id"), "embedding")
    want = rows(similarity.cosine_topk(q, d, 4))
    assert len(want) == 200
    assert rows(similarity.cosine_topk(q, d, 4, block=3)) == want  # more query blocks than are broadcast
    pairs = d.filter("embedding is not null").withColumnRenamed("vec_id", "pair_id")
    other = pairs.withColumn("embedding", F.transform("embedding", lambda x: x + 0.3))
    assert rows(similarity.pair_ranks(pairs, other)) == rows(similarity.pair_ranks(pairs, other, block=3))
    assert rows(similarity.mutual_ranks(pairs, pairs))[0][1:] == (1.0, 1, 1, True)


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, file_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "8")], "file_path string, file_hash string")
    assert {(r.file_path, r.status) for r in manifest.detect_changes(new, old).collect()} == {("a", "unchanged"), ("b", "modified"), ("d", "unchanged"), ("e", "new")}
    assert {(r.file_path, r.change) for r in manifest.snapshot_diff(old, new, "file_path", "file_hash").collect()} == {("b", "Modified"), ("c", "Removed"), ("d", "Added"), ("e", "Added")}
    assert rows(manifest.upsert(old, new)) == [("a", "1"), ("b", "9"), ("c", "3"), ("d", "3"), ("e", "8")]


def test_short_texts_are_contained_too(spark):
    small = spark.createDataFrame([(1, "pH"), (2, "q"), (3, "ph of"), (4, ""), (5, "அ"), (6, "er of th"), (7, " ")], "small_id long, small string")
    large = spark.createDataFrame([(1, "the pH of water"), (2, "a quiet sea"), (3, "alph of x"), (4, "அணு"), (5, None), (6, "")], "large_id long, large string")
    texts = {r.small_id: r.small for r in small.collect()}, {r.large_id: r.large or "" for r in large.collect()}
    want = sorted((i, j) for i, s in texts[0].items() if s.strip() for j, t in texts[1].items() if s in t)
    assert rows(lookup.contained_pairs(small, large)) == want and (1, 1) in want and (2, 2) in want and (5, 4) in want


def test_ranks_and_totals_of_large_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9)]), i) for i in range(400)]
    d = spark.createDataFrame(data, "g string, v int, id long").repartition(5)
    for down in (False, True):
        want = {}
        for g in {x[0] for x in data}:
            own = sorted((x for x in data if x[0] == g), key=lambda x: (((x[1] is None) == down, 0 if x[1] is None else -x[1] if down else x[1]), x[2]))
            want |= {x[2]: n for n, x in enumerate(own, 1)}
        assert {r.id: r["rank"] for r in ranking.full_rank(d, "g", "v", "id", descending=down, pieces=4).collect()} == want
    total = {r.id: r.s for r in ranking.running_total(d.filter("v is not null"), "g", "id", "v", "s", pieces=4).collect()}
    for g in {x[0] for x in data}:
        s = 0
        for x in sorted((x for x in data if x[0] == g and x[1] is not None), key=lambda x: x[2]):
            s += x[1]
            assert total[x[2]] == s


def test_token_blocks_of_sources(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("ab"), [rng.randrange(9) for _ in range(rng.randrange(12))]) for i in range(40)] + [(99, "c", [1, 2]), (98, "d", [])]
    got = {(r.source, r.block_no): r.input_ids for r in chunking.lm_token_blocks(spark.createDataFrame(docs, "doc_id long, source string, ids array<int>"), 8).collect()}
    want = {}
    for s in "abcd":
        flat = [x for _, q, ids in sorted(docs) if q == s for x in ids]
        want |= {(s, k): flat[8 * k : 8 * k + 8] for k in range(max(len(flat) // 8, 1 if flat else 0))}
    assert got == want


def test_blocks_are_packed_by_cut_points():
    assert chunking.cut_points([3, 3, 3, 1, 9], 6, 2) == [(0, 2), (2, 4), (3, 5)]
    assert chunking.cut_points([3, 3], 9, 0, frozenset({1})) == [(0, 1), (1, 2)] and chunking.cut_points([], 9) == []
    assert chunking.split_large("a b\nc\nd e f g. h i", 3, 2) == ["a b\nc", "d e f g.", "h i"]


def test_corrections_and_containment(spark):
    q = spark.createDataFrame([(1, "what is the mass of the earth?"), (2, "nothing alike"), (3, "tides")], "query_id long, question string")
    c = spark.createDataFrame([(7, "The mass of the earth is wrong, it should be more"), (8, "ocean tides")], "correction_id long, issue string")
    assert rows(lookup.match_corrections(q, c)) == [(1, 7), (3, 8)]
    rng = random.Random(3)
    words = ["ab", "abc", "cab", "x", "longer", "onge"]
    small = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    large = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    want = sorted((i, j) for i, s in small for j, t in large if s in t)
    got = lookup.contained_pairs(spark.createDataFrame(small, "small_id long, small string"), spark.createDataFrame(large, "large_id long, large string"))
    assert rows(got) == want


def test_mindmap_outline_and_padding(spark):
    d = spark.createDataFrame([(1, 'x {"Plants": {" plants ": {"Root": null, "Leaf": ["Green"]}, "Root": 1}} y'), (2, "none")], "id long, j string")
    assert [tuple(r)[2:] for r in mindmap.outline_edges(d, "id", "j").orderBy("seq").collect()] == [("Plants", "Root"), ("Plants", "Leaf"), ("Leaf", "Green"), ("Root", "1")]
    m = spark.createDataFrame([(1, "b a b"), (2, "c " * 30), (3, "")], "id long, t string")
    v = mindmap.vocabulary(m, "id", "t")
    got = {r.id: r.ids for r in mindmap.encode_padded(m, v, "id", "t", 5).collect()}
    assert got == {1: [0, 0, 2, 3, 2], 2: [4] * 5, 3: [0] * 5}


def test_plugins_and_losses(spark):
    d = spark.createDataFrame([("light and sound",), (None,)], "t string")
    got = plugins.embed(d, "t", plugins.HashEmbedder(8)).collect()
    assert all(len(r.embedding) == 8 for r in got) and got[0].embedding != got[1].embedding
    s = d.select(plugins.score_with(plugins.OverlapScorer(), F.lit("light"), F.col("t")).alias("s")).collect()
    assert [r.s for r in s] == [1.0, 0.0]

    class Broken:
        def score(self, queries, texts):
            raise RuntimeError

    assert d.select(plugins.score_with(Broken(), F.lit("q"), F.col("t")).alias("s")).first().s == -1.0

    class Half:
        def score(self, queries, texts):
            if any("light" not in t for t in texts):
                raise ValueError("a row that the model can't take")
            return [0.5] * len(texts)

        def judge(self, question, answer, context):
            return "so: {\"faithfulness\": 0.5, \"hallucination_rate\": 0.25}" if "light" in answer else 1 / 0

    got = {r.t: (r.s, r.j.faithfulness, r.j.hallucination_rate) for r in d.select("t", plugins.score_with(Half(), F.lit("q"), F.col("t")).alias("s"), plugins.judge_with(Half(), F.lit("q"), F.col("t"), F.lit("c")).alias("j")).collect()}
    assert all(v == ((0.5, 0.5, 0.25) if "light" in (t or "") else (-1.0, 0.0, 1.0)) for t, v in got.items())
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert plugins.with_retry(flaky, sleep=waits.append)() == "done" and waits == [1.0, 2.0]
    with pytest.raises(OSError, match="busy"):
        plugins.with_retry(lambda: calls.clear() or flaky(), tries=2, double=False, sleep=waits.append)()
    p = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0], [3.0], [3.0], [1.0, 0.0], [0.0, 1.0])], "x array<double>, x_hat array<double>, y array<double>, y_hat array<double>, zx array<double>, zy array<double>")
    r = graph.autoencoder_losses(p).first()
    assert (r.reconstruction, r.pair, r.prior) == (2.0, 1.0, 1.0) and math.isclose(r.total, 5.1)
    j = spark.createDataFrame([('ok {"faithfulness": 0.5} end',), ("no",)], "a string").select(evaluation.judge_json("a").alias("j")).collect()
    assert tuple(j[0].j) == (0.5, 0.0, 1.0) and tuple(j[1].j) == (0.0, 0.0, 1.0)


def test_split_is_stable(spark):
    d = spark.range(2000).withColumn("s", corpus.hash_split("id"))
    assert abs(d.filter("s = 'train'").count() / 2000 - 0.8) < 0.04 and rows(d) == rows(d.repartition(9))
    assert corpus.spot_check(d, 15, "id").count() == 15
    with pytest.raises(AssertionError):
        assert corpus.head(d, 3, "id").count() == 4


def test_figures_triggers_and_service(spark, tmp_path):
    from sandloom.operators import records
    from sandloom.plans.service import Service
    from sandloom.streaming import sessions

    i = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 90.0), (2, 0.0, 0.0, 80.0, 80.0), (3, 0.0, 0.0, 200.0, 90.0)], "n int, x0 double, y0 double, x1 double, y1 double")
    assert [r.n for r in records.figures(i).collect()] == [3]
    e = spark.createDataFrame([(1, 0.0, None, False), (1, 10.0, None, True), (1, 20.0, None, True), (1, 30.0, "c1", False), (1, 40.0, "c1", True), (1, 930.0, None, False)], "repo long, ts double, commit string, changed boolean")
    assert [(r.ts, r.cause) for r in sessions.fold(e, sessions.ChangeTrigger).orderBy("ts").collect()] == [(10.0, "change"), (30.0, "commit"), (930.0, "timer")]

    s = Service(spark, str(tmp_path))
    text = "light travels in straight lines through air and water alike"
    rows = [("b.pdf", 1, k, f"{text} {k}", "en", 8, "science", 0, "textbook", [1.0, float(k)]) for k in range(4)] + [("b.pdf", 2, 0, "tiny", "en", 8, "science", 0, "textbook", [0.0, 1.0])]
    c = spark.createDataFrame(rows, "file_path string, page int, seq int, text string, medium string, class_level int, subject string, term int, content_type string, embedding array<double>")
    assert [r.reason for r in s.ingest(c).collect()] == ["too short"]
    assert s.dashboard().first().total == 0
    s.report(spark.createDataFrame([(1, "The mass of the earth is wrong")], "id long, issue string"))
    s.review(spark.createDataFrame([(1, "approved", "It is 6e24 kg")], "id long, status string, correction string"))
    assert [(r.status, r.correction) for r in s.corrections().collect()] == [("approved", "It is 6e24 kg")]
    q = spark.createDataFrame(
        [(1, "what is the mass of the earth?", "en"), (2, "how does light move", "en"), (3, "how does light move", "ta")], "request_id long, question string, medium string"
    )
    q = q.select("*", F.lit(8).alias("class_id"), F.lit(0).alias("term"), F.lit("science").alias("subject"), F.array(F.lit("textbook")).alias("allowed"), F.lit("en").alias("fallback_language"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    got = s.retrieve(q, 1).collect()
    assert [r.correction for r in got if r.request_id == 1] == ["It is 6e24 kg"]
    assert len([r for r in got if r.request_id == 2]) == 2 and all(r.fallback_used for r in got if r.request_id == 3)
    s.record_feedback(spark.createDataFrame([("s", "q", "a", "correct", False), ("s", "q", "a", "bad", True)], "session_id string, query string, answer string, rating string, citation_errors boolean"))
    assert tuple(s.dashboard().first()) == (2, 1, 1, 1, 50.0)
