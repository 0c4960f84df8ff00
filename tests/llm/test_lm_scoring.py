import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from sandloom.llm.lm_scoring import ORDER, Lookup, lm_scores


def held(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1


def brute(rows):
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(x for i, t, *_ in rows if not held(i) for x in tok(t))
    n, v = sum(counts.values()), len(counts)
    tries = [defaultdict(Counter) for _ in range(ORDER + 1)]
    stream = lambda t: b"\n" * ORDER + " ".join(tok(t)[:-1]).encode() + b"\n"
    for i, t, *_ in rows:
        if not held(i):
            s = stream(t)
            for p in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    tries[k][s[p - k : p]][s[p]] += 1

    def logp(ctx, x):
        out, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            c = tries[k].get(ctx[ORDER - k :])
            if not c:
                continue
            left = {b: m for b, m in c.items() if b not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if x in left:
                    return out + math.log10(left[x] / total)
                out += math.log10(len(left) / total)
            excluded = set(c)
        return out - math.log10(256 - len(excluded))

    res = []
    for i, t, *_ in rows:
        s = stream(t)
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tok(t))
        res.append((i, held(i), len(tok(t)), sum(x in counts for x in tok(t)), n, base, sum(logp(s[p - ORDER : p], s[p]) for p in range(ORDER, len(s)))))
    return res


def test_against_brute_force_with_and_without_whole_tables(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice(["th", "er", "on", "é", "Q"]) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40))), 1) for i in range(60)]
    rows += [(60, None, 1), (61, "", 1), (None, "zz Top", 1), (3, rows[3][1], 1), (62, "long " * 3000, 1), (63, "\x00 \t\n never-seen-漢", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[6]))
    for most in (1 << 20, 8):
        got = sorted((tuple(r) for r in lm_scores(docs, table_most=most, words_most=most).collect()), key=lambda r: (str(r[0]), r[6]))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)
    assert lm_scores(docs.limit(0)).count() == 0
    lonely = lm_scores(docs.filter("doc_id = 62").withColumn("doc_id", next(i for i in range(99) if held(i)) * 1 + docs.doc_id * 0)).first()
    assert lonely.train_tokens == 0 and lonely.n_known == 0 and lonely.score < 0


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**62, 5000)).astype(np.uint64)
    t = Lookup(keys[::2], np.arange(len(keys[::2])))
    values, found = t.find(keys)
    assert found[::2].all() and not found[1::2].any() and (values[::2] == np.arange(len(keys[::2]))).all()
