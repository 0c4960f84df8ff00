"""Collocations against counts by hand, and against DuckDB."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sandloom.llm import collocations as C

from ..compare import oracle, rows

SCHEMA = "doc_id long, text string, lang string"


def brute(table, minimum=10, half=50, most=2000):
    f, n = [Counter(), Counter(), Counter()], Counter()
    for _, text, lang in table:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[k - 1].update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    got = {}
    for m in (2, 3):
        for key, a in f[m - 1].items():
            if a >= minimum:
                cuts = []
                for k in range(1, m):
                    l, r = f[k - 1][key[: k + 1]], f[m - k - 1][(key[0], *key[k + 1 :])]  # noqa: E741
                    cuts.append((Fraction(10**6 * a * a, l * r).__floor__(), k, l, r))
                s, _, l, r = min(cuts)  # noqa: E741
                inside = m == 2 and any(c >= minimum and 100 * c >= half * a for k3, c in f[2].items() if k3[0] == key[0] and key[1:] in (k3[1:3], k3[2:4]))
                if not inside:
                    got.setdefault(key[0], []).append((-s, -a, " ".join(key[1:]).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in got.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:most]))


def run(spark, table, more=(), **kw):
    return sorted(tuple(r) for r in C.collocations(spark.createDataFrame(table, SCHEMA).select("*", *more), **kw).collect())


def sample():
    rnd = random.Random(5)
    words = ["the", "of", "New", "York", "CITY", "ü", "x-y", "ÀB", "a"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b"]) for _ in range(k))
    table = [(i, text(rnd.randrange(60)), rnd.choice(["en", "de", None, "und", ""])) for i in range(60)]
    table += [(1, "new york city " * 30, "en")] * 3 + [(2, "a a a a a a a a a a a a a", "es"), (3, None, "en"), (4, "", None), (None, "only once", "fr"), (5, "word " * 20000, "long")]
    return table


@pytest.mark.parametrize("kw", [{}, {"minimum": 3, "most": 5}, {"half": 101}])
def test_against_counts(spark, kw):
    table = sample()
    assert run(spark, table, **kw) == brute(table, **kw)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    table = sample()[:40]
    assert run(spark, table, [F.lit(1).alias(c) for c in ("a", "l", "r", "n", "phrase", "h", "score", "rank", "w1", "piece")]) == brute(table)


def test_both_ways_of_looking_counts_up(spark):
    counts = spark.createDataFrame([("en", f"w{i}", i) for i in range(50)], "lang string, phrase string, a long")
    asked = spark.createDataFrame([("en", f"w{i % 50} x{i}", f"w{i % 50}") for i in range(200)], "lang string, phrase string, w1 string")
    got = [sorted(tuple(r) for r in C._with_count(asked, "w1", counts, "l", 1225, hot).collect()) for hot in (1000, 30, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 200


def test_bitmaps_shift_over_blocks_and_stop_at_holes():
    at = np.array([0] * 40 + [-1] + [0, 1, 1, -1] + [1, 0], dtype=np.int64)
    maps = C.Bitmaps(at, np.array([True, True]))
    node, word, block, mask = maps.extend(maps.word, maps.block, maps.mask)
    code, _, _, count = C._phrases(node, word, mask, 2)
    assert dict(zip(code.tolist(), count.tolist(), strict=True)) == {0: 39, 1: 1, 3: 1, 2: 1}


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert rows(C.query(spark, folder).toPandas()) == rows(oracle(C.SQL, folder))


def test_words_become_columns_once_a_shard_not_for_each_piece(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"a{i % 7} b{i % 5}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([text, text])], ["lang", "text"])
    full = C.Bloom(6, np.array([2**64 - 1], dtype=np.uint64))
    plain, calls = C._named, []
    monkeypatch.setattr(C, "_named", lambda words: calls.append(len(words)) or plain(words))
    counts = []
    for most in (4, 1 << 16):
        counts.append(Counter())
        for out in C._mine([batch], words_map=full, pairs_map=full, most=most):
            for key, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                counts[-1][key] += n
    ws = text.split()
    assert counts[0] == counts[1] == Counter(f"{' '.join(ws[i : i + k])}\t{lang}" for lang in ("en", "de") for k in (2, 3) for i in range(len(ws) - k + 1))
    assert len(calls) == 2, "one shard, two runs"


def test_pairs_are_counted_in_little_memory():
    import tracemalloc

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    batches, want = [], Counter()
    for _ in range(4):
        ws = [rnd.choice(words) for _ in range(250_000)]
        want.update(zip(ws, ws[1:]))
        batches.append(pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(ws)])], ["lang", "text"]))
    full = C.Bloom(6, np.array([2**64 - 1], dtype=np.uint64))
    counted = []

    def held():
        for b in C._count_pairs(iter(batches), words_map=full):
            counted.append(b)
            yield

    tracemalloc.start()
    for _ in held():
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    n = sum(int(np.frombuffer(x, np.uint8, offset=len(x) // 5 * 4).sum()) for b in counted for x in b.column(1).to_pylist())
    assert n == sum(want.values())
    assert most < 50, most  # 64 MB where phrases and counts lay apart, 39 now


def test_one_python_worker_a_core_and_small_batches_only_meanwhile(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, plans = spark.conf.get(name), []
    spill, of_slots = C.spill, C.Bloom.of_slots.__func__

    def seen(df):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), spark.conf.get(name)))

    monkeypatch.setattr(C, "spill", lambda df, label: (seen(df), spill(df, label))[1])

    def watched(cls, keys, *rest, **more):
        seen(keys)
        return of_slots(cls, keys, *rest, **more)

    monkeypatch.setattr(C.Bloom, "of_slots", classmethod(watched))
    C.frequent(spark.createDataFrame([("en", "a b " * 20)], "lang string, text string"), 10)
    # What of_slots is given gets a function of batches on top, in the same stage unless an exchange lies between.
    assert len(plans) == 4 and all(int(rows) <= 1024 for _, rows in plans)
    for plan, _ in plans:
        stage = plan.split("Exchange")
        assert all(part.count("MapInArrow") <= 1 for part in stage), plan
    assert all("MapInArrow" not in plan.split("Exchange")[0] for plan in (plans[1][0], plans[2][0])), "a second worker a core"
    assert spark.conf.get(name) == before
