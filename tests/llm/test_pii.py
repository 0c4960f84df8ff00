"""Personal data against Python's regular expressions, and disclosing terms against counts by hand."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sandloom.llm import pii

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), m.group().lower() if kind == "email" else m.group() if kind == "ip" else d))
    return sorted(out)


def terms(table, support=3, threshold=0.9, reach=60):
    """doc index -> {(start, end): action}, from the rule as the module states it."""
    near, words, total = [], Counter(), 0
    for i, (_, text) in enumerate(table):
        text = text or ""
        total += len(re.findall(r"[^\x20\x09-\x0D]+", text))
        words.update(w for w in re.split(r"[^a-zà-ÿ'’-]+", text.lower()))
        found = base(text)
        for k, kind in enumerate(PLAIN):
            # A card has 14 digits: shorter runs of digits bound no context.
            marks = [m.span() for m in re.finditer(PLAIN[kind], text, re.ASCII) if kind != "card" or len(re.sub("[^0-9]", "", m.group())) >= 14]
            for s, kk, e, value in found:
                if kk != k:
                    continue
                lo = max([b for _, b in marks if b <= s], default=0)
                hi = min([a for a, _ in marks if a >= e], default=len(text))
                for a, b in ((max(lo, s - reach), s), (e, min(hi, e + reach))):
                    side = text[a:b]
                    if b == s and a > lo:
                        cut = re.match(r"[^\x20\x09-\x0D]+", side)
                        a += cut.end() if cut else 0
                    if a == e and b < hi:
                        b -= len(re.search(r"[^\x20\x09-\x0D]*$", side).group())
                    toks = [(m.group(), a + m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text[a:b])]
                    for j, (t, at) in enumerate(toks):
                        m = re.search(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]*", t)
                        if m and not re.search("[@0-9]", t):
                            around = (toks[j - 1][0].lower() if j else "", toks[j + 1][0].lower() if j + 1 < len(toks) else "")
                            near.append((i, f"{kind}:{value}", m.group().lower(), at + m.start(), at + m.end(), around))
    n_tc, surround, n_c, n_gc, n_g = Counter(), defaultdict(set), Counter(), Counter(), Counter()
    for _, c, t, _, _, around in near:
        n_tc[c, t] += 1
        surround[c, t].add(around)
        n_c[c] += 1
        n_gc[c, t[:3]] += 1
    for w, k in words.items():
        n_g[w[:3]] += k
    share = lambda part, whole, c: 1 + math.log(min(part / whole, 1)) / math.log(max(total, n_c[c] + 1) / n_c[c])
    out = defaultdict(dict)
    for i, c, t, s, e, _ in near:
        if len(surround[c, t]) >= support and share(n_tc[c, t], words[t], c) >= threshold:
            action = "generalised" if len(t) > 3 and share(n_gc[c, t[:3]], n_g[t[:3]], c) < threshold else "removed"
            out[i][s, e] = max(action, out[i].get((s, e), ""))
    return out


def run(spark, table, more=(), **kw):
    rows = pii.personal_data(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(table)], SCHEMA).select("*", *more), **kw).collect()
    return {r.doc_id: ([tuple(b) for b in r.base], {(t.start, t.end): t.action for t in r.terms}) for r in rows}


TRICKY = [
    "a@b.c@d.e a@b.c_x@e.f .@x.y x@y x@y. @y.z a%b+c@d-e.f.g..h ü.a@b.co ä@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3 99999999999999999999.1.1.1 1.1.1.1", "4539 1488 0343 6467 and 4539-1488-0343-6467-1 0000 0000 0000 00 5 45391488034364671234567",
    "+1 (377) 555-0271 +49-30-1234567 +1 +12345678901234567 +1.2.3.4.5.6.7.8.9.0 ++4912345678901", "😀 x@y.zz 😀😀 10.0.0.1 ÀÉ +1 (377) 555-0271", "", None, " \t\n", "12 34 56 78 90 12 34 56 78 90",
]


def planted():
    rnd = random.Random(3)
    common = ["the", "of", "and", "house", "Garden", "über", "it's", "walk", "day", "zerberize"]
    say = lambda k: " ".join(rnd.choice(common) for _ in range(k))
    table = [(None, say(60)) for _ in range(40)]
    table += [(None, f"{say(rnd.randrange(3, 30))} zerberus {say(rnd.randrange(3))} Hauke, ha.uke@mail.example.com {say(20)}") for _ in range(6)]
    return table + [table[-1]] * 5 + [(None, f"once only x{i}@y.org seen {say(9)}") for i in range(4)]


def test_base_against_plain_patterns(spark):
    got = run(spark, [(None, t) for t in TRICKY])
    for i, t in enumerate(TRICKY):
        assert got[i][0] == [(list(PLAIN)[k], s, e) for s, k, e, _ in base(t or "")], t


def test_random_texts(spark):
    rnd = random.Random(11)
    table = [(None, "".join(rnd.choice("aB9 1.2-+@()_%\n5ü") for _ in range(rnd.randrange(400)))) for _ in range(300)]
    got = run(spark, table)
    for i, (_, t) in enumerate(table):
        assert got[i][0] == [(list(PLAIN)[k], s, e) for s, k, e, _ in base(t)], t


@pytest.mark.parametrize("kw", [{}, {"support": 2, "threshold": 0.6}])
def test_disclosing_terms(spark, kw):
    table = planted()
    want, got = terms(table, **kw), run(spark, table, **kw)
    assert {i: t for i, (_, t) in got.items() if t} == dict(want)
    assert set(want) >= set(range(40, 51)) and not set(want) & set(range(40))
    text = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(table)], SCHEMA), **kw).collect()}
    assert text[0] == table[0][1] and "[email]" in text[40] and "auke" not in text[40] and "zerberus" not in text[40]


def test_long_texts(spark):
    texts = ["a" * 2_000_000, "1" * 2_000_000, "+1" + " " * 1_000_000, "a.b" * 500_000, "x@y" + ".z" * 300_000, "1.2." * 400_000, "1 2@b.c +1 (377) 555-0271 " * 3000]
    got = run(spark, [(None, t) for t in texts])
    assert [len(got[i][0]) for i in range(7)] == [0, 0, 0, 0, 1, 400_000 * 2 // 4, 6000] and got[4][0][0] == ("email", 0, 3 + 600_000)


def test_null_repeated_and_clashing(spark):
    assert run(spark, []) == {}
    rows = spark.createDataFrame([(None, "a@b.cc"), (None, "a@b.cc"), (1, None)], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("base", "terms", "row_id", "entity", "term", "n_words", "h_email")])
    got = pii.personal_data(rows).collect()
    assert sorted((r.doc_id is None, len(r.base)) for r in got) == [(False, 0), (True, 1), (True, 1)]


def test_query_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pii.query(spark, folder).collect():
        b = base(docs[r.doc_id])
        shown = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e, _ in b)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in b) for k in range(4)]
        assert [x for x in r.spans.split(",") if not x.startswith("term") and x] == [x for x in shown.split(",") if x]
