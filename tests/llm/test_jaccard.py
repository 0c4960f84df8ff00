import random
import re

import numpy as np

from sandloom.llm import jaccard
from sandloom.llm.jaccard import allocate, bands, jaccard_components, shingles, signatures


def brute(rows):
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same = {}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                if i is None or j is None:
                    same.setdefault(frozenset(s), j if i is None else i)
                    continue
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else find(same[frozenset(s)]) if frozenset(s) in same else None) for i, s in sets), key=str)


def rows_of(rng, n):
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1]
            w = (w or "x").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            rows.append((i, " ".join(w)))
        elif kind < 0.7:
            own = [rng.choice(vocab) for _ in range(rng.randrange(3, 30))]
            rows.append((i, " ".join(own[:5] + passage + own[5:])))
        else:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 30, 100, 300])))))
    return rows


def test_components_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, t, "n") for i, t in rows_of(rng, 500)]
    rows += [(900, None, "n"), (901, "", "n"), (902, "  \n", "n"), (903, "One two\tthree", "n"), (904, "one TWO three", "n"), (None, "one two three", "n"), (None, "lonely words here", "n"), (905, "É two three four five", "n"), (906, "é two three four five", "n"), (rows[3][0], rows[3][1], "n"), (907, "big " * 20_000, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    assert got == brute(rows)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_hot_families_over_batch_boundaries(spark):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):  # many near copies of one text and few of another, so that tasks salt their signatures
        w = list(base) if i % 5 else [*base[:30], *[f"x{k}" for k in range(40)]]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "2")
        got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    finally:
        spark.conf.set(name, before)
    assert got == brute(rows)


def test_a_mark_counts_in_the_next_batch_too():
    import pyarrow as pa

    def run(*cuts):
        r, b = [5, 5, 5, 5, 6, 6], [int(jaccard.MARK), 10, 11, 12, 10, 11]
        rows = pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(b, pa.int64())], ["r", "b"])
        bounds = [0, *cuts, 6]
        return [row for x in jaccard._reduce(rows.slice(i, j - i) for i, j in zip(bounds, bounds[1:], strict=False)) for row in x.to_pylist()]

    for cuts in ((), (1,), (2,), (1, 2, 3)):
        got = run(*cuts)
        assert {(x["a"], x["b"]) for x in got if x["g"] == 5 and x["wide"]} == {(10, 11), (10, 12)}


def test_a_similar_pair_shares_a_signature_or_both_are_left_over():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        r = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, len(r) // 4) + 1))
        s = np.unique(np.concatenate([r[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, len(r) // 4) + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(r, s))
        if not both or 100 * both < 80 * (len(r) + len(s) - both):
            continue
        sig, key, short = signatures([r, s], np.array([1, 2]))
        met = len(set(sig[key == 1].tolist()) & set(sig[key == 2].tolist())) > 0
        assert met or {1, 2} <= set(short.tolist())


def test_band_layouts_cover_the_largest_difference():
    edges = bands(10_000)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        m, double, most = allocate(int(a), int(b) - 1)
        assert m + double > most and m >= 1 and 0 <= double <= m
    assert any(allocate(int(a), int(b) - 1)[1] for a, b in zip(edges[:6], edges[1:7], strict=True))


def test_shingles_of_short_texts_differ_by_length():
    a, b, c, d = shingles([b"a b c", b"a b c d", b"", b"A B\nC"])
    assert len(a) == len(b) == 1 and a[0] != b[0] and len(c) == 0 and (a == d).all()
    assert jaccard.WORDS == 5


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    ruled = 0
    for _ in range(3000):
        n = int(rng.integers(1, 700))
        r = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        cut = int(rng.integers(0, len(r) // 2 + 1))
        s = np.unique(np.concatenate([r[cut:], rng.integers(0, 2**63, int(rng.integers(0, len(r) // 2 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(r, s))
        linked = both > 0 and 100 * both >= 80 * (len(r) + len(s) - both)
        open_ = jaccard.may_link(len(r), jaccard.parity(r), len(s), jaccard.parity(s))
        assert open_ or not linked
        ruled += not open_
    assert ruled > 500


def test_signatures_leave_a_task_in_small_batches(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 1})())
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices("abcdefghij", k=200)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts)], ["doc_id", "text"])
    sizes = [b.num_rows for b in jaccard._emit([batch])]
    assert sum(sizes) > 1 << 16 and max(sizes) <= 1 << 16, sizes


def test_partners_share_at_least_as_many_signatures_as_needed():
    rng = np.random.default_rng(9)
    above = 0
    for _ in range(1500):
        n = int(rng.integers(1, 900))
        r = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, len(r) // 5 + 1))
        s = np.unique(np.concatenate([r[drop:], rng.integers(0, 2**63, int(rng.integers(0, len(r) // 5 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(r, s))
        if not both or 100 * both < 80 * (len(r) + len(s) - both):
            continue
        sig, key, short = signatures([r, s], np.array([1, 2]))
        need = jaccard.needs([r, s])
        shared = len(set(sig[key == 1].tolist()) & set(sig[key == 2].tolist()))
        assert {k for k, x in zip((1, 2), need.tolist(), strict=True) if not x} == set(short.tolist())
        assert shared >= max(need.tolist())
        above += min(need.tolist()) > 1
    assert above > 100


def counted(monkeypatch):
    """Rows of each table that is written from now on, by label."""
    rows, real = {}, jaccard.spill

    def spill(df, label):
        out = real(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "spill", spill)
    return rows


def test_a_common_line_alone_sends_no_set_to_the_join_by_prefix(spark, monkeypatch):
    rng = random.Random(13)
    line = " ".join(f"line{k}" for k in range(14))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) + f" {line} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " and more") for i in range(5)]
    seen = counted(monkeypatch)
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute(rows)
    assert seen["torn"] > 0 and seen["rest"] < 12, seen


def test_sets_of_one_family_meet_once_in_the_join_by_prefix(spark, monkeypatch):
    shared = [(e, i, 100, 3 * e + i % 3, i // 2) for i in range(60) for e in range(20) if (i + e) % 7]
    alone = [(100 + i // 2, i, 100, 0, i // 2) for i in range(60)]
    frame = spark.createDataFrame(shared + alone, "e long, doc_id long, n long, place long, root long")
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = jaccard._merged(frame).collect()
    by = {}
    for r in got:
        by.setdefault(r.e, {})[r.doc_id] = r
    assert sum(len(x) ** 2 for x in by.values()) < 2 * 60**2 < sum((sum(1 for x in shared if x[0] == e)) ** 2 for e in range(20)) / 5
    for e in {x[0] for x in shared + alone}:  # sets that had an element in common have a key in common, at no later place
        mine = {x[1]: x[3] for x in shared + alone if x[0] == e}
        assert any(all(i in x and x[i].place <= at for i, at in mine.items()) for x in by.values())
    large = max(by.values(), key=len).values()
    assert {r.blocks for r in large} == {4} and {r.block for r in large} == {0, 1, 2, 3}


def test_families_under_the_threshold_in_several_blocks(spark, monkeypatch):
    rng = random.Random(14)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(90):  # most pairs lie just under the threshold, some above
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "_gather", lambda minima, sizes, links, linked, checked, *_: (links, linked, checked))
    got = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute(rows)
