import hashlib
import re

from sandloom.llm.exact_dedup import ExactIndex, ExtendibleIndex, exact_dedup, normalise

ROWS = [(1, "a  b", "x"), (2, "a b", "y"), (3, " a b", None), (4, None, "z"), (5, "", "z"), (6, "a\tb", "z"), (6, "a\tb", "z"), (None, "q", "z"), (7, "w" * 50_000, "z"), (8, "  é", "z"), (9, " \n\né", "z")]


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def test_against_brute_force_and_collisions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    for bits in (64, 2, 0):  # few bits: every bucket chains different texts under one key
        got = exact_dedup(docs, hash_bits=bits, bucket_capacity=2).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_normalise():
    for t in ("", " ", "\n \n", "a", " a ", "a\x0b\x0cb\x1cc", " x"):
        assert normalise(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_directory_doubles_and_keeps_everything():
    index = ExtendibleIndex(capacity=4)
    keys = [(i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for i in range(500)]
    for n, k in enumerate(keys):
        index.add(k, b"%d" % n, b"", n, 1)
        index.add(k, b"%d" % n, b"", n + 1000, 2)
    found = {k: chain for _, (_, held) in index.buckets() for k, chain in held.items()}
    assert index.depth >= 7 and len(index.directory) == 1 << index.depth
    assert all(found[k] == [[b"%d" % n, b"", n, 3]] for n, k in enumerate(keys))
    assert all(len(held) <= 4 for _, (_, held) in index.buckets())


def test_index_is_opened_again_split_and_asked(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    many = [(i, f"text {i % 700}  of many", "x") for i in range(1000)]
    schema = "doc_id long, text string, v string"
    ExactIndex.create(spark, path, bucket_capacity=4, rows_per_owner=60)
    ExactIndex.open(spark, path).add(spark.createDataFrame(many[:100], schema))
    before = {tuple(r) for r in ExactIndex.open(spark, path).directory().collect()}
    ExactIndex.open(spark, path).add(spark.createDataFrame([*many[100:], *ROWS], schema))
    index = ExactIndex.open(spark, path)
    after = {tuple(r) for r in index.directory().collect()}
    assert index.versions() == [1, 2] and max(d for d, _ in after) > max(d for d, _ in before)
    # The buckets cover every key once, hold what their prefix says, and none holds too many keys.
    assert sum(2.0**-d for d, _ in after) == len({p >> (d - 5) for d, p in after}) / 32
    held = {}
    for r in index.buckets().collect():
        assert (r.depth, r.prefix) in after and (r.key & 0xFFFFFFFFFFFFFFFF) >> (64 - r.depth) == r.prefix
        held.setdefault((r.depth, r.prefix), set()).add(r.key)
    assert max(map(len, held.values())) <= 4
    texts = [r.content for r in index.contents().collect()]
    assert len(texts) == len(set(texts)) == index.buckets().count()  # a text's bytes are stored once
    asked = [*many, *ROWS, (5000, "nobody has this", "x")]
    got = index.lookup(spark.createDataFrame(asked, schema)).collect()
    known = {(i, d): (k, n) for i, k, n, _, d in brute([*many, *ROWS])}
    assert len(got) == len(asked)
    assert all((r.keep_id, r.group_size) == known.get((r.doc_id, r.text_sha256), (None, None)) for r in got)
    assert [r.doc_id for r in got if r.group_size is None] == [5000]


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = ExactIndex.create(spark, path, hash_bits=0)  # every text in one chain
    index.add(spark.createDataFrame(ROWS[:5], "doc_id long, text string, v string"))
    (tmp_path / "index" / "v=2" / "part=buckets").mkdir(parents=True)
    again = ExactIndex.open(spark, path)
    assert again.versions() == [1]
    again.add(spark.createDataFrame(ROWS[5:], "doc_id long, text string, v string"))
    assert again.versions() == [1, 3]
    want = {(d, k, n) for _, k, n, _, d in brute(ROWS)}
    assert {(r.digest.hex(), r.keep_id, r.group_size) for r in again.buckets().collect()} == want


def test_texts_of_one_digest_are_an_error():
    index = ExtendibleIndex()
    index.add(1, b"a", b"d", 1, 1)
    try:
        index.add(1, b"b", b"d", 2, 1)
    except ValueError:
        return
    raise AssertionError
