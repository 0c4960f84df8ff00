import random
import zlib

import numpy as np

from sandloom.llm.quality import FEATURES, AdditiveModel, features, quality_scores
from sandloom.llm.toxicity import Landmarks, choose_landmarks, feature_map, sentences, toxicity_scores, train


def case(n=400):
    rng = random.Random(3)
    vocab = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sa"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgblat", "Quiffle", "quif-fle", "zorg.blat,"]))
        for k in range(9, len(w), 10):
            w[k] += "."
        text = " ".join(w)
        good = rng.random() < 0.8
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), (w[0] + " ") * 80])
        docs.append((i, text, "x"))
        labels.append((i, int(good), int(toxic and good), "x"))
    return docs, labels


def held(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 0


def frames(spark):
    docs, labels = case()
    odd = [(900, None, "x"), (901, "", "x"), (None, "some text", "x"), (902, "long " * 20_000, "x"), docs[3], (903, " \n. !", "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, label string")
    lab = spark.createDataFrame(labels + [(5, None, None, "x"), (999, 1, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    return docs + odd, labels, d, lab


def test_quality_on_held_out_rows(spark):
    rows, labels, d, lab = frames(spark)
    got = quality_scores(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got)
    truth = {i: q for i, q, *_ in labels}
    mine = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in mine) / len(mine) > 0.95
    assert quality_scores(d.limit(0), lab).count() == 0
    assert {r.score for r in quality_scores(d, lab.limit(0)).collect()} == {0.5}


def test_additive_model_learns_steps_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = AdditiveModel(rounds=60, pairs=2).fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    assert len(features(b"")) == len(features(b"A a. 1\n")) == len(FEATURES)


def test_toxicity_on_held_out_rows(spark):
    rows, labels, d, lab = frames(spark)
    got = toxicity_scores(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id) for r in got)
    truth = {i: t for i, _, t, *_ in labels}
    mine = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in mine) / len(mine) > 0.93
    low = min(r.score for r in got)
    assert all(r.score == low for r in got if r.doc_id in (900, 901, 903))
    assert toxicity_scores(d.limit(0), lab).count() == 0
    assert len({r.score for r in toxicity_scores(d, lab.limit(0)).collect()}) == 1


def test_quality_against_plain_look_ups(spark):
    rows, labels, d, lab = frames(spark)
    text = {i: t for i, t, _ in rows if i is not None}
    learn = sorted((i, q) for i, q, *_ in labels if not held(i) and i in text)
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i, _ in learn], "i long").selectExpr("i", "xxhash64(i) AS h").collect()}
    copies = lambda i: sum(j == i for j, *_ in rows)
    learn = [(i, q) for i, q in sorted(learn, key=lambda x: (order[x[0]], x[0])) for _ in range(copies(i))]
    m = AdditiveModel().fit(np.array([features(text[i].encode()) for i, _ in learn]), np.array([float(q) for _, q in learn]))

    def plain(t):
        x, total = features((t or "").encode()), m.start
        for j, (edges, table) in enumerate(zip(m.edges, m.tables, strict=True)):
            total += table[sum(e <= x[j] for e in edges)]
        for (a, b), table in m.pairs.items():
            total += table[sum(e <= x[a] for e in m.coarse[a])][sum(e <= x[b] for e in m.coarse[b])]
        return 1 / (1 + np.exp(-total))

    want = sorted(((i, plain(t)) for i, t, _ in rows), key=str)
    got = sorted(((r.doc_id, r.score) for r in quality_scores(d, lab).collect()), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def test_labels_that_repeat_or_disagree(spark):
    docs, labels = case(120)
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    plain = [(i, q, t) for i, q, t, _ in labels]
    odd = plain + plain[:50] + [(plain[0][0], 1 - plain[0][1], 1 - plain[0][2])]
    settled = [(plain[0][0], 0, 1), *plain[1:]]
    kind = "doc_id long, quality int, toxic int"
    for f in (quality_scores, toxicity_scores):
        a, b = (sorted((r.doc_id, r.score) for r in f(d, spark.createDataFrame(x, kind)).collect()) for x in (odd, settled))
        assert a == b


def test_toxicity_trains_on_bounded_texts(spark):
    docs, labels = case(120)
    d = spark.createDataFrame([*docs, (500, "zorgblat " * 100_000, "x")], "doc_id long, text string, x string")
    lab = spark.createDataFrame([(i, q, t) for i, q, t, _ in labels] + [(500, 1, 1)], "doc_id long, quality int, toxic int")
    a = {r.doc_id: r.score for r in toxicity_scores(d, lab, train_bytes=200_000).collect()}
    b = {r.doc_id: r.score for r in toxicity_scores(d, lab.filter("doc_id <> 500")).collect()}
    assert all(abs(a[i] - b[i]) < 0.02 for i in a)  # the share of toxic labels still counts the document that is passed over


def test_gaps_and_inserted_characters_stay_near():
    marks = Landmarks([b"quiffle", b"zorgblat"])
    words = [b"quiffle", b"quixffle", b"zorgbblat", b"hello", b"a", b"zorgxblat"]
    near, k = marks.kernels(words)
    found = dict(zip([words[i] for i in near], k.argmax(axis=1), strict=True))
    assert found == {b"quiffle": 0, b"quixffle": 0, b"zorgbblat": 1, b"zorgxblat": 1}
    assert sentences(b"Q u i f f l e now. i.d.i-o-t, x\nEnd") == [[b"quiffle"], [b"q", b"u", b"i", b"f", b"f", b"l", b"e", b"now"], [b"idiot", b"x"], [b"end"]]


def test_kernels_against_brute_force():
    from itertools import combinations

    def raw(w):
        w, f = b"\2" + w + b"\3", {}
        for c in combinations(range(len(w)), 4):
            if c[-1] - c[0] < 6:
                key = bytes(w[i] for i in c)
                f[key] = f.get(key, 0) + 0.6 ** (c[-1] - c[0] - 3)
        return f

    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    owner, key, value, norm = feature_map(words)
    maps = [raw(w) for w in words]
    np.testing.assert_allclose(norm, [sum(v * v for v in f.values()) ** 0.5 for f in maps])
    dense = [dict(zip(key[owner == i].tolist(), value[owner == i].tolist(), strict=True)) for i in range(len(words))]
    for i in range(0, 60, 7):
        for j in range(60):
            want = sum(v * maps[j].get(k, 0) for k, v in maps[i].items())
            if want:
                got = sum(v * dense[j].get(k, 0) for k, v in dense[i].items())
                assert abs(got - want / norm[i] / norm[j]) < 1e-9


def plain_kernel(a, b):
    """The normalised kernel of two words by all their subsequences."""
    from itertools import combinations

    def raw(w):
        w, f = b"\2" + w + b"\3", {}
        for c in combinations(range(len(w)), 4):
            if c[-1] - c[0] < 6:
                key = bytes(w[i] for i in c)
                f[key] = f.get(key, 0) + 0.6 ** (c[-1] - c[0] - 3)
        return f

    f, g = raw(a), raw(b)
    n = (sum(v * v for v in f.values()) * sum(v * v for v in g.values())) ** 0.5
    return sum(v * g.get(k, 0) for k, v in f.items()) / n if n else 0.0


def test_document_scores_against_plain_kernels():
    docs, labels = case(150)
    toxic = np.array([t for _, _, t, _ in labels])
    texts = [t.encode() for _, t, _ in docs]
    s = train(texts, toxic, np.ones(len(texts)))
    marks = s.landmarks.words
    assert marks
    some = texts[:15] + [b"", b"q u i f f l e", b"quifffffle zorg blat.", b"aaaaaaa quiquiffleffle abababab"]
    row = {}
    for w in {w for t in some for x in sentences(t) for w in x}:
        k = [plain_kernel(w, m) for m in marks]
        row[w] = np.array([x if x >= 0.42 else 0.0 for x in k])
    for t, got in zip(some, s.score(some), strict=True):
        best = s.bias
        for x in sentences(t):
            rows = [row[w] for w in x if row[w].any()]
            if rows:
                best = max(best, float(np.max(rows, axis=0) @ s.weights) + s.bias)
        assert abs(got - 1 / (1 + np.exp(-(s.scale[0] * best + s.scale[1])))) < 1e-4


def test_no_word_near_a_landmark_is_passed_over():
    rng = random.Random(2)
    marks = Landmarks([bytes(rng.choice(b"abcde") for _ in range(rng.randrange(4, 9))) for _ in range(12)])
    words = [bytes(rng.choice(b"abcde") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    near, k = marks.kernels(words)
    found = {i: r for i, r in zip(near.tolist(), k, strict=True)}
    for i, w in enumerate(words):
        want = np.array([plain_kernel(w, m) for m in marks.words])
        clear = np.abs(want - 0.42) > 1e-5
        got = found.get(i, np.zeros(len(want)))
        np.testing.assert_allclose(got[clear], np.where(want >= 0.42, want, 0)[clear], atol=1e-5)


def test_training_without_signal():
    assert choose_landmarks([b"a b c"], np.array([0])) == []
    assert train([], np.zeros(0, int), np.zeros(0)).score([b"x", b""]) == [0.5, 0.5]
