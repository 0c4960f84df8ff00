"""What the review of round 4 found."""

import random

import pytest

from sandloom.operators import lookup


@pytest.mark.parametrize(("most", "few"), [(1 << 16, 512), (1 << 16, 0), (5, 0)])
def test_f1_terms_are_found_while_prompts_are_read(spark, monkeypatch, most, few):
    """All terms that a prompt contains; a glossary of few terms makes no shuffle of the prompts' words."""
    rng = random.Random(2)
    parts = ["a", "ab", "Ab", "é", "ph", "light", "நீர்", "x" * 40, "x" * 31, " ", " ", "  ", "\n", " ", "\x1c", ".", "-"]
    made = lambda n: "".join(rng.choices(parts, k=rng.randint(1, n)))
    prompts = [(i, made(25)) for i in range(150)] + [(150, None), (151, ""), (152, "b" * 300 + "ph" + "b" * 300)]
    glossary = [(i, made(4), f"t{i}") for i in range(150)] + [(200, "ph", "old"), (201, " PH ", "new"), (202, None, "none"), (203, "light", None)]
    monkeypatch.setattr(lookup, "TERMS", most)
    monkeypatch.setattr(lookup, "FEW_TERMS", few)
    monkeypatch.setattr(lookup, "KNOWN_WORDS", 20)
    monkeypatch.setattr(lookup, "PAIRS", 30)
    got = lookup.glossary_matches(spark.createDataFrame(prompts, "prompt_id long, prompt string"), spark.createDataFrame(glossary, "seq long, english string, tamil string"))
    last = {}
    for _, english, tamil in glossary:
        if english is not None and (e := english.lower().strip(" \t\n\x0b\f\r")):
            last[e] = tamil
    want = sorted(((p, e, t) for p, text in prompts if text for e, t in last.items() if e in text.lower()), key=str)
    assert last["ph"] == "new" and len(want) > 1000
    assert sorted(map(tuple, got.collect()), key=str) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert most == 5 or ("Exchange" not in plan and "Generate" not in plan)


def test_f1_neither_texts_nor_many_words_are_broadcast(spark, monkeypatch, tmp_path):
    """Files of some MB may hold more rows than the driver does, so Spark isn't left to go by their size."""
    small = spark.createDataFrame([(1, "a"), (2, "one two three"), (3, "igh")], "small_id long, small string")
    large = spark.createDataFrame([(i, f"light and {i} one two three") for i in range(20)], "large_id long, large string")
    small.write.parquet(f"{tmp_path}/small")
    large.write.parquet(f"{tmp_path}/large")
    small, large = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("small", "large"))
    for most, merges in ((1, 2), (1 << 18, 1)):
        monkeypatch.setattr(lookup, "NAMED_WORDS", most)
        got = lookup.contained_pairs(small, large)
        assert got._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == merges
        assert {tuple(r) for r in got.collect()} == {(s, i) for s in (1, 2, 3) for i in range(20)}
