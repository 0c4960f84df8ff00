import math

import pytest
from pyspark.sql import functions as F

from sandloom.functions import text as T
from sandloom.functions import vector as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.tokens, "தமிழ்", ["தம", "ழ"]),
        (T.tokens, "It's a_b 2,5!", ["it", "s", "a_b", "2", "5"]),
        (T.word_count, " a  b\nc ", 3),
        (T.chunk_problem, "x $" + " y" * 18, "too short"),
        (T.chunk_problem, "x $" + " y" * 40, "unbalanced math"),
        (T.chunk_problem, "w" * 46 + " y" * 10, "overlong word"),
        (T.chunk_problem, "y " * 2100, "too long"),
        (T.chunk_problem, None, "empty"),
        (T.difficulty, "what is light", "Beginner"),
        (T.difficulty, "explain light", "Advanced"),
        (T.difficulty, "one two three four five", "Intermediate"),
        (T.intent, "Draw a cell", "Image"),
        (T.practice_mode, "latest questions", False),
        (T.exam_mode, "latest", True),
        (T.wants_more, "please go  on", True),
        (T.wants_more, "nextdoor", False),
        (T.safe_prompt, "a WEAPON", False),
        (T.language, "abc தமிழ்", "ta"),
        (T.language, "abc", "en"),
        (T.clean_term, "12. - atom  core -", "atom core"),
        (T.tidy_brackets, "( Hardware ) [ x ]", "(Hardware) [x]"),
        (T.page_number_block, " - 12 - ", True),
        (T.page_metadata_block, "set in book.indd", True),
        (T.block_type, "1.2 Force", "heading"),
        (T.block_type, "- item", "list"),
        (T.block_type, "Plain text.", "paragraph"),
        (T.block_role, "Worked Example 3", "example"),
        (T.bucket, "add\\x", "web"),
        (T.bucket, "books/Tamil/x", "tamil"),
        (T.loan_word_score, "நீர் (water)", 5),
        (T.loan_word_score, "நீர் water", 3),
        (T.join_lines, "photosyn-\nthesis is\nslow\n\nNext -\nline", "photosynthesis is slow\nNext line"),
        (T.loader_whitespace, " a \t b\n\n\n\nc", "a b\n\nc"),
        (T.without_phrases, "xLEFT COLUMNy", "xy"),
        (T.mojibake_repair, "தமிழ்".encode().decode("cp437") * 5, "தமிழ்" * 5),
        (T.ocr_filter, "§§§§ab", ""),
        (T.ocr_filter, "§§§", "§§§"),
        (T.nfc, "é", "é"),
        (T.tamil_vowels, "ெகா", "கொ"),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_subjects_and_types(spark):
    assert one(spark, "solve the force", T.subjects) == ["math", "maths", "mathematics", "science"]
    assert one(spark, "resolved", T.subjects) == []
    assert one(spark, "2+3", T.subjects) == ["math", "maths", "mathematics"]
    got = spark.createDataFrame([("a quiz", ["guide"])], "q string, a array<string>").select(T.content_types("q", "a").alias("t")).first().t
    assert got == ["guide", "previous_year", "teacher_notes", "firecrawl_education", "textbook"]


def test_headers_terms_and_paths(spark):
    assert tuple(one(spark, "Unit IV :  Light ", T.chapter_header)) == ("IV", "Light")
    assert tuple(one(spark, "1.2.3: Speed", T.section_header)) == ("1.2.3", "Speed")
    assert one(spark, "12 Speed", T.section_header) is None
    assert tuple(one(spark, "அணு - atom", T.bilingual_term)) == ("அணு", "atom")
    assert tuple(one(spark, "atom அணு core", T.bilingual_term)) == ("அணு", "atom core")
    m = one(spark, "books\\class_8\\science\\tamil\\textbook\\term_2\\Class_8_Science_Tamil_2025.pdf", T.path_metadata)
    assert (m.class_level, m.subject, m.medium, m.term, m.year) == (8, "science", "ta", 2, 2024)


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = d.select(V.cosine("a", "b").alias("c"), V.cosine("a", "z").alias("zero"), V.normalized("a").alias("n")).first()
    assert math.isclose(r.c, 24 / 25) and r.zero == 0 and r.n == [0.6, 0.8]


def test_subjects_golden(spark):
    said = {"find 3x when": "math", "2 x": "math", "x + y": "math", "7*8": "math", "box 3xy": "", "the ratio of": "math", "rations": "", "photosynthesis in a cell": "science", "சமன்பாடு": "math", "force and area": "math,science", "hello there": ""}
    d = spark.createDataFrame([(q,) for q in said], "q string").select("q", T.subjects("q").alias("s"))
    for r in d.collect():
        want = [*(["math", "maths", "mathematics"] if "math" in said[r.q] else []), *(["science"] if "science" in said[r.q] else [])]
        assert r.s == want, r.q


def test_knowledge_page_functions(spark):
    d = spark.range(1).select(T.wiki_links(F.lit("a [[B c]] [[D]] [x]")).alias("l"), T.manual_region(F.lit("x<!-- MANUAL:START -->kept\n<!-- MANUAL:END -->")).alias("m"), T.manual_region(F.lit("<!-- MANUAL:END -->")).alias("n"), T.signature_changes(F.lit("+def f(a):\n def g():\n-  class A(B):\n+import os\n+important")).alias("s"))
    r = d.first()
    assert r.l == ["B c", "D"] and r.m == "kept\n" and r.n is None and r.s == ["+def f(a):", "-  class A(B):", "+import os"]


def test_paths_golden(spark):
    paths = {
        "books/class_7/Maths/English/guide/term_2/CBSE 2023 reprint.pdf": (7, "maths", "en", "guide", 2, 2023, "CBSE", "2023 Edition (Reprint)"),
        "class 9/science": (9, "science", "en", "textbook", 0, 2024, "Tamil Nadu Textbook and Educational Services Corporation", "2024 Edition"),
        "up/class_8_science_2019_tamil_guide.pdf": (8, "science", "ta", "guide", 0, 2019, "Tamil Nadu Textbook and Educational Services Corporation", "2019 Edition"),
        "loose.pdf": (None, "science", "en", "textbook", 0, 2024, "Tamil Nadu Textbook and Educational Services Corporation", "2024 Edition"),
    }
    for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.path_metadata("p").alias("m")).collect():
        assert tuple(r.m) == paths[r.p], r.p
    assert tuple(spark.range(1).select(T.glossary_path(F.lit("Class_8/Science/Term_1/Tamil")).alias("m")).first().m) == ("Class 8", "Science", "Term 1", "Tamil")
    assert spark.range(1).select(T.classifier_text(F.lit("Atom-அணு 1"), "ta").alias("t")).first().t == "அணு "
