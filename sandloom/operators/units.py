"""Content units of a textbook: headings, examples, exercises and their questions, activities, tables, laws, prose."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifest import keep_first

# The shapes of units.
EXERCISE = re.compile(r"(?i)Exercise\s+\d+\.\d+")
EXAMPLE = re.compile(r"(?i)\b((?:Problem|Example)\s+\d+\.\d+(?:\.\d+)?)\b")
HEADING = re.compile(r"^(\d+\.\d+(?:\.\d+)?)\s+([A-Z][a-zA-Z\s]+?)(?=\s[A-Z]|\s[a-z]{2,}ing|\s[a-z]{2,}ed|\sis|\sare|\s=|\s[a-z]{3,})")
ACTIVITY = re.compile(r"(?i)\b(ACTIVITY\s+\d+)\b")
STEP = re.compile(r"(?i)^(?:(?:Aim|Procedure|Observation|Materials Required):|\s*(?:[A-Za-z]|\d+\.)?\s*(?:Draw|Find|Measure|Take|Place|Keep|Fill|Cut|Make|Observe)\b)")
TABLE = re.compile(r"\b(Table\s+\d+\.\d+)\s+([A-Z][a-zA-Z\s]+?)(?=\s[A-Z]|\s[a-z]{3,})")
LAW = re.compile(r"(?i)\b([A-Z][a-zA-Z\s]+(?:Law|Theorem|Principle|Rule|Effect))\b")
LAW_WORD = re.compile(r"(?i)(?:Law|Theorem|Principle|Rule|Effect)\b")
NO_LETTER = re.compile(r"(?i)[^a-z\s]")
FIRST = re.compile(r"(?i)\b[A-Z]")
QUESTION = re.compile(r"(?m)^\s*(?:\d+\.|[a-z]\))\s+")
FORMULA_HEAVY = ["Example/Problem", "Exercise Sub-Question", "Exercise Block", "Concept/Law", "Heading"]
DESCRIPTIVE = ["Descriptive Unit", "Activity", "Activity Instruction"]


def law(block: str) -> str | None:
    """What LAW finds first, in one pass: LAW itself looks through the rest of a run of letters from each of its words.

    A match lies in a run of letters and spaces; it begins at the run's first word and ends with the last of the words that
    may end it. Where that doesn't do, no later place of the run does.
    """
    at = 0
    while m := LAW_WORD.search(block, at):
        end = stop.start() if (stop := NO_LETTER.search(block, m.end())) else len(block)
        begin = next((i for i in range(m.start() - 1, at - 1, -1) if NO_LETTER.match(block[i])), at - 1) + 1
        if first := FIRST.search(block, begin, end):
            last = None
            while m and m.end() <= end:
                last = m.end() if m.start() >= first.start() + 2 else last
                m = LAW_WORD.search(block, m.end())
            if last:
                return block[first.start() : last]
        at = end
    return None


def _kind(block: str):
    """(type, name, whether following prose belongs to it) of a block that begins a unit, or None."""
    if m := EXERCISE.search(block):
        return "Exercise Block", m[0], True
    if m := EXAMPLE.search(block):
        return "Example/Problem", m[1], True
    if m := HEADING.match(block):
        return "Heading", f"{m[1]} {m[2].strip()}", False
    if (m := ACTIVITY.search(block)) or STEP.search(block):
        return "Activity Instruction", "Activity Step", False
    if m := TABLE.search(block):
        return "Table", f"{m[1]} {m[2].strip()}", False
    if (name := law(block)) and len(name) < 50:
        return "Concept/Law", name.strip(), False
    return None


def _units(kind: str, name: str, text: str, emit_law: bool):
    if kind == "Exercise Block":
        asked = list(QUESTION.finditer(text))
        if not asked or text[: asked[0].start()].strip():
            yield kind, name
        for m in asked:
            yield "Exercise Sub-Question", m[0].strip()
    elif kind == "Descriptive Unit":
        if len(text.split()) >= 40 and len(re.split("[.!?]+", text)) >= 4 and sum(c.isascii() and c.isalpha() for c in text) > len(text) / 2:
            yield kind, name
    elif kind != "Concept/Law" or emit_law:
        yield kind, name


def extract_units(text: str, emit_law: bool = True, activity_goes_on: bool = False) -> list[tuple[str, str]]:
    """(type, name) in order. Exercises and examples go on over the prose that follows them, and with activity_goes_on, the
    stateful variant, activities too: their prose is no unit of its own."""
    out: list[tuple[str, str]] = []
    open_: list | None = None
    for block in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        found = _kind(block)
        if found is None and open_ is not None and open_[3]:
            open_[2] += "\n\n" + block
            continue
        if open_ is not None:
            out += _units(*open_[:3], emit_law)
        kind, name, goes_on = found or ("Descriptive Unit", "Paragraph", False)
        open_ = [kind, name, block, goes_on or (activity_goes_on and kind == "Activity Instruction")]
    if open_ is not None:
        out += _units(*open_[:3], emit_law)
    return out


def unit_inventory(docs: DataFrame, key: str = "doc_id", text: str = "text", emit_law: bool = True, activity_goes_on: bool = False) -> DataFrame:
    """key, seq, unit_type, unit_name; a document's units of one type and name once, the first."""

    def run(frames):
        for pdf in frames:
            rows = [(k, i, *u) for k, t in zip(pdf["k"], pdf["t"], strict=True) for i, u in enumerate(extract_units(t or "", emit_law, activity_goes_on))]
            yield pd.DataFrame(rows, columns=[key, "seq", "unit_type", "unit_name"])

    found = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, seq int, unit_type string, unit_name string")
    return keep_first(found, [key, "unit_type", "unit_name"], ["seq"])


def inventory_counts(units: DataFrame, grade: str, subject: str) -> DataFrame:
    """grade, subject, n_units, formula_heavy, descriptive by grade, by subject and over all (the others null)."""
    sets = units.groupingSets([[grade], [subject], []], grade, subject)
    return sets.agg(F.count("*").alias("n_units"), F.count_if(F.col("unit_type").isin(FORMULA_HEAVY)).alias("formula_heavy"), F.count_if(F.col("unit_type").isin(DESCRIPTIVE)).alias("descriptive"))


def flat_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, unit_type, unit_name, n of every place where a unit's shape stands, without regard to blocks: what earlier, flat
    extractors counted, kept for comparison with unit_inventory()."""
    shapes = {"Exercise": r"(?i)(Exercise\s+\d+\.\d+)", "Example/Problem": r"(?i)\b((?:Problem|Example)\s+\d+\.\d+(?:\.\d+)?)", "Activity": r"(?i)\b(ACTIVITY\s+\d+)", "Table": r"\b(Table\s+\d+\.\d+)"}
    found = [docs.select(key, F.lit(kind).alias("unit_type"), F.explode(F.regexp_extract_all(F.col(text), F.lit(shape), 1)).alias("unit_name")) for kind, shape in shapes.items()]
    return reduce(DataFrame.unionByName, found).groupBy(key, "unit_type", "unit_name").agg(F.count("*").alias("n"))
