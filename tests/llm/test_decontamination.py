import itertools
import random
import re

from sandloom.llm.decontamination import EVEN, MASKS, THIRD, decontaminate


def test_the_masks_hit_every_stretch_with_four_changes():
    seeds = [sum(1 << (o + p) for o in m) for m in MASKS for p in range(20 - max(m))]
    for places in itertools.combinations(range(20), 4):
        changed = sum(1 << p for p in places)
        assert any(not seed & changed for seed in seeds)


def brute(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t, *_ in docs:
        d = words(t)
        for j, s, *_ in items:
            w = words(s)
            n = len(w)
            width = n if n < 9 else min(n, 20)
            need = n if n < 9 else -(-width * 4 // 5)
            for start in range(-n, len(d)) if n else ():
                same = [int(0 <= start + k < len(d) and d[start + k] == w[k]) for k in range(n)]
                best = max(sum(same[k : k + width]) for k in range(n - width + 1))
                if best >= need:
                    b, _, at = out.get((i, j), (0, width, start))
                    out[i, j] = (max(b, best), width, min(at, start))
    return sorted(((i, j, *v) for (i, j), v in out.items()), key=str)


def case():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 7, 12, 20, 33]))), "x") for k in range(25)] + [(50, None, "x"), (51, "", "x")]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(80))]
        if i % 2:
            p = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(5)):
                if p:
                    p[rng.randrange(len(p))] = "changed"
            w[len(w) // 2 : len(w) // 2] = p
        docs.append((i, ", ".join(w).upper() if i % 3 == 0 else " ".join(w), None))
    return [*docs, (900, None, "x"), (901, "", "x"), (1, docs[1][1], "y"), (902, "pad " * 30_000 + items[3][1], "x")], items


def test_against_brute_force_on_both_paths(spark):
    docs, items = case()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert len(want) > 30
    for rows in (1 << 19, 1):
        assert sorted((tuple(r) for r in decontaminate(d, b, broadcast_rows=rows).collect()), key=str) == want
    assert decontaminate(d.limit(0), b).count() == decontaminate(d, b.limit(0)).count() == 0


def test_the_masks_hit_every_item_length_from_9_to_20():
    for n in range(9, 21):
        masks = MASKS + (THIRD,) if n < EVEN else MASKS
        seeds = [sum(1 << (o + p) for o in m) for m in masks for p in range(n - max(m))]
        for places in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            changed = sum(1 << p for p in places)
            assert any(not seed & changed for seed in seeds), (n, places)


def test_items_of_9_to_15_words_with_every_placement_of_changes(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (9, 10, 11, 12, 15)] + [(30, " ".join(f"i30x{k}" for k in range(30)))]
    docs = []
    for n, text in items[:-1]:
        for places in itertools.combinations(range(n), n - -(-n * 4 // 5)):
            docs.append((len(docs), "before " + " ".join("changed" if k in places else w for k, w in enumerate(text.split())) + " after"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for rows in (1 << 19, 1):
        got = sorted((tuple(r) for r in decontaminate(d, b, broadcast_rows=rows).collect()), key=str)
        assert got == brute(docs, items) and len(got) == len(docs)
