"""Text functions on columns: all run inside the JVM but for nfc() and mojibake_repair()."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import add, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

TAMIL = "\\x{0B80}-\\x{0BFF}"
WORD = r"\p{L}\p{N}_"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def tokens(c) -> Column:
    """Lower-cased runs of letters, digits and underscores; combining marks separate."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"([{WORD}]+)"), 1)


def words(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(\S+)"), 1)


def word_count(c) -> Column:
    return F.size(words(c))


def has_any(c, needles: list[str]) -> Column:
    """Whether any needle is a substring."""
    return reduce(or_, [F.contains(col(c), F.lit(n)) for n in needles])


def count_any(c, needles: list[str]) -> Column:
    """How many of the needles are substrings."""
    return reduce(add, [F.contains(col(c), F.lit(n)).cast("int") for n in needles])


def whole_words(ws: list[str]) -> str:
    """A pattern, without look-around, that any of these words meets as a whole word."""
    return f"(^|[^{WORD}])({'|'.join(ws)})($|[^{WORD}])"


def subjects(question, available: Column | None = None) -> Column:
    """Subjects that a question's words point to; the available ones if none."""
    q = F.lower(col(question))
    math = q.rlike("|".join([whole_words(L.MATH_WORDS + L.MATH_WHOLE), *L.MATH_TAMIL, *L.MATH_SHAPES]))
    science = q.rlike("|".join([whole_words(L.SCIENCE_WORDS), *L.SCIENCE_TAMIL]))
    none = F.array().cast("array<string>")
    found = F.concat(F.when(math, F.array(*map(F.lit, L.MATH_SUBJECTS))).otherwise(none), F.when(science, F.array(F.lit("science"))).otherwise(none))
    return F.when(F.size(found) > 0, found).otherwise(none if available is None else available)


def subject_match(wanted, chunk_subject) -> Column:
    """All spellings of mathematics are one subject; others are equal or contained in the chunk's."""
    a, b = F.lower(col(wanted)), F.lower(col(chunk_subject))
    return (a.isin(L.MATH_SUBJECTS) & b.isin(L.MATH_SUBJECTS)) | (a == b) | F.contains(b, a)


def content_types(question, allowed) -> Column:
    """Allowed content types, and five more for a question that asks for assessment."""
    more = F.array_union(col(allowed), F.array(*map(F.lit, L.ASSESSMENT_TYPES)))
    return F.when(has_any(F.lower(col(question)), L.ASSESSMENT), more).otherwise(col(allowed))


def intent(question, explicit: Column | None = None) -> Column:
    """What was asked for explicitly, else by the question's words."""
    by_words = F.when(has_any(F.lower(col(question)), L.IMAGE_WORDS), "Image").otherwise("Chat")
    return by_words if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), by_words)


def difficulty(question) -> Column:
    q = F.lower(col(question))
    n = word_count(q)
    return F.when(has_any(q, L.HARD) | (n > 8), "Advanced").when(has_any(q, L.EASY) | (n <= 4), "Beginner").otherwise("Intermediate")


def confused(question) -> Column:
    return has_any(F.lower(col(question)), L.CONFUSED)


def exam_mode(question) -> Column:
    return has_any(F.lower(col(question)), L.EXAM)


def practice_mode(question) -> Column:
    return has_any(F.lower(col(question)), L.PRACTICE) & ~exam_mode(question)


def follow_up(question) -> Column:
    return confused(question) | has_any(F.lower(col(question)), L.FOLLOW_UP)


def wants_more(question) -> Column:
    return F.lower(col(question)).rlike(whole_words(L.MORE_WORDS))


def safe_prompt(c) -> Column:
    return ~has_any(F.lower(col(c)), L.BLOCKED)


def template_id(question, is_math: Column) -> Column:
    """Which prompt template answers: follow-up, exam, practice, math, or the default."""
    return F.when(follow_up(question), "follow_up").when(exam_mode(question), "exam").when(practice_mode(question), "practice").when(is_math, "math").otherwise("default")


def blank_page(text, drawings, images) -> Column:
    return (F.length(strip(text)) < 15) & (col(drawings) < 3) & (col(images) == 0)


def copyright_page(c) -> Column:
    return count_any(F.lower(col(c)), L.COPYRIGHT) >= 3


def page_number_block(c) -> Column:
    return strip(c).rlike(r"^(\d+|-\s*\d+\s*-)$")


def page_metadata_block(c) -> Column:
    return F.lower(strip(c)).rlike("|".join(f"({p})" for p in L.PAGE_METADATA))


def searchable(c) -> Column:
    return F.length(strip(c)) > 100


def longest_word(c) -> Column:
    return F.aggregate(words(c), F.lit(0), lambda a, w: F.greatest(a, F.length(w)))


def chunk_problem(text, missing: Column | None = None) -> Column:
    """The first rule that a chunk breaks, in this order, or 'ok'."""
    s = strip(text)
    n = F.length(s)
    dollars = F.length(col(text)) - F.length(F.replace(col(text), F.lit("$"), F.lit("")))
    out = F.when(col(text).isNull() | (n == 0), "empty").when(n < 50, "too short").when(n > 4000, "too long").when(dollars % 2 == 1, "unbalanced math")
    if missing is not None:
        out = out.when(missing, "missing metadata")
    return out.when(longest_word(text) > 45, "overlong word").otherwise("ok")


def noise_ratio(c) -> Column:
    """Share of characters that no text of a textbook would have."""
    allowed = r"[\p{L}\p{N}_\s.,?!\-()+=*/÷<>≤≥^√%±×≠≈≡∝∞∠⊥∥△°\x{0B80}-\x{0BFF}\x{0370}-\x{03FF}\x{2200}-\x{22FF}\x{25A0}-\x{25FF}\x{00BC}-\x{00BE}\x{2070}-\x{209F}\\{}\[\]]"
    return F.length(F.regexp_replace(col(c), allowed, "")) / F.greatest(F.length(col(c)), F.lit(1))


def ocr_filter(c) -> Column:
    """Empty if more than 15 % of five or more characters are noise."""
    return F.when((F.length(col(c)) >= 5) & (noise_ratio(c) > 0.15), "").otherwise(F.coalesce(col(c), F.lit("")))


def script_ratio(c, ranges: str = TAMIL) -> Column:
    """Share of characters within the ranges of a character class."""
    kept = F.length(F.regexp_replace(col(c), f"[^{ranges}]", ""))
    return F.when(F.length(col(c)) > 0, kept / F.length(col(c))).otherwise(F.lit(0.0))


def language(c) -> Column:
    """'ta' if over 5 % or at least three characters are Tamil."""
    n = F.length(F.regexp_replace(col(c), f"[^{TAMIL}]", ""))
    return F.when((script_ratio(c) > 0.05) | (n >= 3), "ta").otherwise("en")


def lines(c) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")


def junk_chunk(c, ranges: str = TAMIL, least: float = 0.15) -> Column:
    """Too little of the script, no lines, or over 60 % of lines longer than three characters with hardly any."""
    ls = lines(c)
    junk = F.size(F.filter(ls, lambda x: (script_ratio(x, ranges) < 0.10) & (F.length(x) > 3)))
    return (script_ratio(c, ranges) < least) | (F.size(ls) == 0) | (junk / F.greatest(F.size(ls), F.lit(1)) > 0.6)


def keep_script_lines(c, ranges: str = TAMIL) -> Column:
    """Lines with enough of the script or under ten characters, joined by spaces; the text itself if none is left."""
    kept = F.filter(lines(c), lambda x: (script_ratio(x, ranges) >= 0.10) | (F.length(x) < 10))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(col(c))


def descriptive(c) -> Column:
    """At least 40 words in four sentences, over half of it ASCII letters."""
    letters = F.length(F.regexp_replace(col(c), "[^a-zA-Z]", ""))
    return (word_count(c) >= 40) & (F.size(F.split(col(c), "[.!?]+")) >= 4) & (letters > F.length(col(c)) * 0.5)


def chunk_whitespace(c) -> Column:
    """White space within lines to one space, runs of line feeds to two."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"[^\S\n]+", " "), r"\n+", "\n\n"))


def loader_whitespace(c) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def join_hyphens(c) -> Column:
    """Words that a hyphen splits over two lines, of Latin or of Tamil letters."""
    x = F.regexp_replace(col(c), r"([a-zA-Z]+)-\s*\n\s*([a-zA-Z]+)", "$1$2")
    return F.regexp_replace(x, f"([{TAMIL}]+)-\\s*\\n\\s*([{TAMIL}]+)", "$1$2")


def join_lines(c) -> Column:
    """join_hyphens, then lines of a paragraph joined by spaces, a hyphen at an end going, paragraphs by a line feed."""
    ls = F.transform(F.split(join_hyphens(c), "\n"), strip)

    def piece(x, following):
        without = F.substring(x, F.lit(1), F.length(x) - 1)
        return F.when((x == "") | following.isNull(), x).when(following == "", F.concat(x, F.lit("\n"))).when(x.endswith("-"), without).otherwise(F.concat(x, F.lit(" ")))

    # The lines are bound to a name by an array of one element, so that they are made once and not wherever they are used.
    pieces = F.transform(F.array(ls), lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), piece))
    return strip(F.regexp_replace(F.array_join(F.get(pieces, F.lit(0)), ""), " {2,}", " "))


def nfc(c) -> Column:
    """Unicode's canonical composition, for which Spark has no function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(col(c))


def tamil_vowels(c) -> Column:
    """NFC, then vowel signs that stand split around a letter put together behind it."""
    x = nfc(c)
    for left, right, to in (("ெ", "ா", "ொ"), ("ே", "ா", "ோ"), ("ெ", "ள", "ௌ")):
        x = F.regexp_replace(x, f"{left}([\\x{{0B85}}-\\x{{0BCD}}]){right}", f"$1{to}")
    return x


def clean_term(c) -> Column:
    """A glossary term without its number and dashes around it."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), r"^\d+\.\s*", ""), r"^-\s*", ""), r"-\s*$", "")
    return strip(F.regexp_replace(x, r"\s+", " "))


def is_tamil(c) -> Column:
    return col(c).rlike(f"[{TAMIL}]")


def is_english(c) -> Column:
    return col(c).rlike("[a-zA-Z]")


def bilingual_term(c) -> Column:
    """struct(tamil, english): split at the first dash if that parts the scripts, else word by word."""
    c = col(c)
    left, right = F.substring_index(c, "-", 1), F.when(F.contains(c, F.lit("-")), F.expr("null").cast("string")).otherwise(F.lit(""))
    right = F.when(F.contains(c, F.lit("-")), F.substring(c, F.length(left) + 2, F.length(c))).otherwise(right)
    ws = words(c)
    by_word_t, by_word_e = F.array_join(F.filter(ws, is_tamil), " "), F.array_join(F.filter(ws, lambda w: ~is_tamil(w) & is_english(w)), " ")
    both = is_tamil(c) & is_english(c)
    t_first, e_first = is_tamil(left) & is_english(right), is_english(left) & is_tamil(right)
    tamil = F.when(both & t_first, left).when(both & e_first, right).when(both, by_word_t).when(is_tamil(c), c).otherwise("")
    english = F.when(both & t_first, right).when(both & e_first, left).when(both, by_word_e).when(~is_tamil(c) & is_english(c), c).otherwise("")
    return F.struct(clean_term(tamil).alias("tamil"), clean_term(english).alias("english"))


def chapter_header(c) -> Column:
    """struct(number, title) of a chapter's heading, or null."""
    x = strip(F.regexp_replace(col(c), r"\s+", " "))
    p = f"(?i)^({'|'.join(L.CHAPTER_WORDS)})\\s*([ivxlcdm]+|\\d+)\\s*:?\\s*(.*)$"
    return F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 2).alias("number"), F.regexp_extract(x, p, 3).alias("title")))


def section_header(c) -> Column:
    """struct(number, title) of a heading such as 1.2 or 1.2.3, or null."""
    x = strip(F.regexp_replace(col(c), r"\s+", " "))
    p = r"^(\d+\.\d+(?:\.\d+)?)\s*:?\s*(.*)$"
    return F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).alias("number"), strip(F.regexp_extract(x, p, 2)).alias("title")))


def block_type(c, given: Column | None = None) -> Column:
    x = col(c)
    upper = (F.upper(x) == x) & (F.lower(x) != x)
    head = (F.length(x) < 120) & (x.rlike(r"^(\d+\.\d+|\d+\.|[IVXLCDM]+\.)") | upper)
    return F.when(head, "heading").when(x.rlike(r"^(•|-|\d+\))"), "list").otherwise(F.lit("paragraph") if given is None else F.coalesce(given, F.lit("paragraph")))


def block_role(c) -> Column:
    x, out = F.lower(col(c)), None
    for role, needles in L.ROLES.items():
        hit = (F.length(x) < 60) & has_any(x, needles)
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("general")


def with_context(path, text) -> Column:
    return F.when(F.coalesce(col(path), F.lit("")) != "", F.concat(F.lit("[Context: "), col(path), F.lit("]\n\n"), col(text))).otherwise(col(text))


def tidy_brackets(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"\(\s*([^()]*?)\s*\)", r"($1)"), r"\[\s*([^\[\]]*?)\s*\]", r"[$1]")


def classifier_text(c, language: str = "en") -> Column:
    """Lower-cased letters of the language and spaces: Latin a to z, or with language 'ta' the Tamil block and white space."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z ]" if language == "en" else f"[^{TAMIL}\\s]", "")


def mojibake_count(c) -> Column:
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit("α«"), F.lit("")))) / 2).cast("int")


def mojibake_repair(c) -> Column:
    """Texts with more than ten marks of UTF-8 read as code page 437 are read again; those that can't be stay."""

    def fix(x):
        if x is None or x.count("α«") <= 10:
            return x
        try:
            return x.encode("cp437").decode("utf-8")
        except UnicodeError:
            return x

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fix)

    return run(col(c))


def residual_corruption(c) -> Column:
    return F.contains(col(c), F.lit("�")) | (mojibake_count(c) > 10)


def without_phrases(c, phrases: list[str] | None = None) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p), F.lit("")), L.BANNED_PHRASES if phrases is None else phrases, col(c))


def keywords(c, stops: list[str], least: int = 1) -> Column:
    """Distinct tokens that aren't stop words and are long enough."""
    return F.filter(F.array_except(tokens(c), F.array(*map(F.lit, stops))), lambda t: F.length(t) >= least)


def common_words(a, b, least: int = 3) -> Column:
    return F.filter(F.array_intersect(tokens(a), tokens(b)), lambda t: F.length(t) >= least)


def cache_key(*parts) -> Column:
    """One key of all that an answer depends on."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.lower(strip(col(p).cast("string"))), F.lit("")) for p in parts]), 256)


def loan_word_score(c) -> Column:
    """3 if an ASCII word stands outside parentheses, else 5."""
    return F.when(F.regexp_replace(col(c), r"\([^)]*\)", "").rlike("[a-zA-Z]{2,}"), 3).otherwise(5)


def wiki_links(c) -> Column:
    """What stands in double square brackets, in order."""
    return F.regexp_extract_all(col(c), F.lit(r"\[\[(.*?)\]\]"), 1)


def manual_region(c, start: str = "<!-- MANUAL:START -->", end: str = "<!-- MANUAL:END -->") -> Column:
    """The text between the first start mark and the next end mark, or null."""
    tail = F.substring(col(c), F.locate(start, col(c)) + len(start), F.length(col(c)))
    found = (F.locate(start, col(c)) > 0) & (F.locate(end, tail) > 0)
    return F.when(found, F.substring_index(tail, end, 1))


def signature_changes(diff) -> Column:
    """Lines of a diff that add or remove a function, a class or an import, in order."""
    shape = r"^[+-]\s*(def\s+\w+\(.*?\):|class\s+\w+|import\s+|from\s+.*?\s+import\s+)"
    return F.filter(F.split(col(diff), "\n"), lambda x: x.rlike(shape))


def keep_manual(new, old) -> Column:
    """A generated page with the manual region of the page that it replaces, before its related pages or at its end."""
    head = "## Related Documentation"
    block = F.concat(F.lit("## Manual Notes\n<!-- MANUAL:START -->"), F.coalesce(manual_region(old), F.lit("")), F.lit("\n<!-- MANUAL:END -->\n\n"))
    return F.when(F.contains(col(new), F.lit(head)), F.replace(col(new), F.lit(head), F.concat(block, F.lit(head)))).otherwise(F.concat(strip(new), F.lit("\n\n"), block))


def bucket(source) -> Column:
    s = F.lower(F.replace(col(source), F.lit("\\"), F.lit("/")))
    return F.when(s.startswith("add/") | (s == "add"), "web").when(F.contains(s, F.lit("tamil")), "tamil").otherwise("book")


def path_metadata(path) -> Column:
    """class_level, subject, medium, content_type, term, year, publisher and edition of a book's path.

    A class folder tells most: behind it stand the subject, the medium and the content type. Without one the file's name
    must have the shape class, subject, term or year, medium, type; else class_level is null.
    """
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    low = F.lower(p)
    parts = F.filter(F.transform(F.split(low, "/"), lambda x: F.trim(x)), lambda x: x != "")
    name, whole_name = F.element_at(parts, -1), F.element_at(F.split(p, "/"), -1)
    part = lambda c, pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    at = F.array_position(F.transform(parts, lambda x: x.rlike(r"^class[_\s-]?\d+$")), F.lit(True)).cast("int")
    folder = lambda k: F.when((at > 0) & (at + k <= F.size(parts)), F.get(parts, at + k - 1))
    shape = r"^class[_\s]?(\d+)[_\s]?([a-z_]+?)[_\s]?(?:term[_\s]?([1-3])|fullyear|(\d{4}))[_\s]?(tamil|english)[_\s]?(textbook|guide|previous[_\s-]?year|teacher[_\s-]?notes)"
    told = lambda k: part(name, shape, k)
    kind = F.coalesce(folder(3), told(6), F.lit("textbook"))
    kinds = F.when(kind.contains("textbook"), "textbook").when(kind.contains("guide"), "guide").when(kind.contains("prev") | kind.contains("year"), "previous_year").when(kind.contains("teacher"), "teacher_notes").when(kind.contains("firecrawl"), "firecrawl_education").otherwise("textbook")
    medium = F.when(has_any(low, ["tamil"]), "ta").otherwise("en")
    term = F.coalesce(part(low, r"term[_\s-]?([1-3])", 1).cast("int"), F.lit(0))
    dated = r"(^|[^\p{L}\p{N}_])(20\d{2})($|[^\p{L}\p{N}_])"
    year = F.coalesce(part(whole_name, dated, 2), part(p, dated, 2), told(4), F.lit("2024")).cast("int")
    publisher = F.when(low.contains("samacheer"), L.PUBLISHERS[1]).when(low.contains("cbse"), L.PUBLISHERS[2]).otherwise(L.PUBLISHERS[0])
    edition = F.concat(year.cast("string"), F.lit(" Edition"), F.when(name.contains("reprint"), " (Reprint)").otherwise(""))
    return F.struct(
        F.coalesce(part(folder(0), r"(\d+)", 1), told(1)).cast("int").alias("class_level"),
        F.coalesce(folder(1), told(2), F.lit("science")).alias("subject"),
        medium.alias("medium"),
        kinds.alias("content_type"),
        term.alias("term"),
        year.alias("year"),
        publisher.alias("publisher"),
        edition.alias("edition"),
    )


def glossary_path(path) -> Column:
    """class, subject, term and medium of a glossary's path, as its report names them."""
    low = F.lower(col(path))
    number = lambda word: F.regexp_extract(low, f"{word}_(\\d+)", 1)
    named = lambda word, title, none: F.when(number(word) != "", F.concat(F.lit(title + " "), number(word))).otherwise(none)
    subject = F.when(low.contains("math"), "Maths").when(low.contains("science"), "Science").otherwise("Unknown")
    medium = F.when(low.contains("tamil"), "Tamil").when(low.contains("english"), "English").otherwise("Unknown")
    return F.struct(named("class", "Class", "Unknown").alias("class"), subject.alias("subject"), named("term", "Term", "Full Year").alias("term"), medium.alias("medium"))
