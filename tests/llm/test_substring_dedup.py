import hashlib
import random
import re

from pyspark.sql import functions as F

from sandloom.llm.substring_dedup import FingerprintIndex, cut, substring_dedup


def brute(rows):
    words = {}
    for i, t, *_ in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words, key=lambda k: -(1 << 63) if k is None else k):
        w = words[i]
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[i].update(range(s, s + 20))
            seen.add(key)
    out = []
    for i, *_ in rows:
        kept = " ".join(w for k, w in enumerate(words[i]) if k not in gone[i])
        out.append((i, len(words[i]), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{k}é" for k in range(60)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (19, 20, 21, 45, 80)]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w), "x"))
    rows += [(200, rows[4][1], "x"), (201, rows[4][1], "x"), (5, rows[5][1], "x"), (202, None, "x"), (203, "", "x"), (204, "same " * 3000, "x"), (205, "short one", "x"), (206, "short one", "x"), (None, rows[9][1], "x"), (207, " ".join(passages[4] * 30), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    want = brute(rows)
    for batches, bits in ((3, 25), (6, 6), (1, 25)):
        got = sorted((tuple(r) for r in substring_dedup(docs, batches=batches, bloom_bits=bits, most_runs=2).collect()), key=str)
        assert got == want
    assert substring_dedup(docs.limit(0)).count() == 0


def test_index_is_incremental_opens_again_and_compacts(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(80)]
    passages = [[rng.choice(vocab) for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(50))]
        if i % 3 == 0:
            w[5:5] = passages[rng.randrange(12)]
        rows.append((i, " ".join(w)))
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    want = {r[0]: r for r in brute(rows)}
    folder, cut_points = f"file://{tmp_path}/index", (0, 30, 31, 70, 120)
    looked_at = set()
    for a, b in zip(cut_points, cut_points[1:], strict=False):
        index = FingerprintIndex(spark, folder, buckets=3, most_runs=2)  # another session would go on in the same way
        late, copies = index.add(frame(rows[a:b]), frame(rows[:a]) if a else None)
        got = cut(frame(rows[a:b]), late, copies).collect()
        assert {r.doc_id: tuple(r) for r in got} == {i: want[i] for i in range(a, b)}
        assert all(len(runs) <= 2 for runs in index.state["runs"].values())
        looked_at.add(index.state["version"])
        one, other = index.tables["anchors"][0], index.tables["anchors"][-1].select("h", F.col("doc").alias("d"))
        plan = one.join(other.hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        index.close()
    assert len(looked_at) == 4
    # what is in the index is enough to judge a batch that repeats only passages already seen twice: no text of before is read
    index = FingerprintIndex(spark, folder)
    assert index.buckets == 3
    twice = max(passages, key=lambda p: sum(" ".join(p) in t for _, t in rows))
    assert sum(" ".join(twice) in t for _, t in rows) >= 2
    late, copies = index.add(frame([(500, " ".join(twice))]), None)
    assert {(r.doc, r.start + k) for r in late.collect() for k in range(r.n)} == {(500, k) for k in range(21)} and copies.count() == 0
    index.delete()


def test_rows_of_one_id_are_judged_by_themselves(spark):
    word = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    passage = word("p", 25)
    rows = [(1, passage + " " + word("a", 10)), (2, passage + " " + word("a", 10)), (2, word("u", 40)), (None, word("n", 60)), (None, word("m", 5) + " " + passage), (None, None), (3, word("c", 30)), (3, word("c", 30)), (4, word("c", 30))]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # the null id comes first, so its passage stays; the copies of it in 1 and 2 go; unique words of either id stay
    want = [(1, 35, 25), (2, 35, 35), (2, 40, 0), (None, 60, 0), (None, 30, 0), (None, 0, 0), (3, 30, 0), (3, 30, 0), (4, 30, 30)]
    assert got == sorted(want, key=str)
