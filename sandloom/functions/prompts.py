"""Prompts for an answering model: the wording by language and kind of question, and how they are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import grounding
from . import lexicon as L
from . import text as T

OPENING = {
    "en": "You are a patient teacher. The student is in grade {grade}, at the level {level}.",
    "ta": "நீங்கள் பொறுமையான ஆசிரியர். மாணவர் வகுப்பு {grade}, நிலை {level}.",
}
RULES = {
    "en": "Use nothing but the passages below. Say nothing of how they were found. Encourage the student. Write formulas between dollar signs. Give examples from daily life.",
    "ta": "கீழே உள்ள பகுதிகளை மட்டுமே பயன்படுத்தவும். அவை எவ்வாறு கிடைத்தன என்று கூற வேண்டாம். மாணவரை ஊக்கப்படுத்தவும். சூத்திரங்களை $ குறிகளுக்குள் எழுதவும்.",
}
FORMS = {
    "en": {
        "follow_up": "This goes on from an earlier answer: reply directly and briefly, without headings.",
        "exam": "Answer for an exam, under these headings: Question; Key points; Remember; Common mistake; Learning tip; Practice.",
        "practice": "Set exercises: three with choices, two with gaps, one true or false, one open. Keep the answers back.",
        "math": "Solve in numbered steps and say why each is taken, under these headings: Question; Understand; Steps; Final answer; Remember; Common mistake; Learning tip; New word; Practice.",
        "default": "Explain under these headings: Question; Definition; Explanation; Everyday example; Key points; Did you know; Remember; Learning tip; New word; Practice.",
    },
    "ta": {
        "follow_up": "இது முந்தைய பதிலின் தொடர்ச்சி: தலைப்புகள் இன்றி நேரடியாகவும் சுருக்கமாகவும் பதிலளிக்கவும்.",
        "exam": "தேர்வுக்கான பதில், இந்தத் தலைப்புகளில்: கேள்வி; முக்கியப் புள்ளிகள்; நினைவில் கொள்க; பொதுவான தவறு; குறிப்பு; பயிற்சி.",
        "practice": "பயிற்சி வினாக்கள்: மூன்று தேர்வு வினாக்கள், இரண்டு கோடிட்ட இடங்கள், ஒரு சரி/தவறு, ஒரு சிறு வினா. விடைகளைக் காட்ட வேண்டாம்.",
        "math": "எண்ணிட்ட படிகளில் காரணத்துடன் தீர்க்கவும், இந்தத் தலைப்புகளில்: கேள்வி; புரிதல்; படிகள்; விடை; நினைவில் கொள்க; பொதுவான தவறு; குறிப்பு; புதிய சொல்; பயிற்சி.",
        "default": "இந்தத் தலைப்புகளில் விளக்கவும்: கேள்வி; வரையறை; விளக்கம்; அன்றாட உதாரணம்; முக்கியக் குறிப்புகள்; உங்களுக்குத் தெரியுமா; நினைவில் கொள்க; குறிப்பு; புதிய சொல்; பயிற்சி.",
    },
}
STATEMENTS = {
    "en": {"none": "This topic isn't in the textbooks at hand. Shall I explain it in general?", "strong": "According to your textbook,", "partial": "Going by what the textbooks say,"},
    "ta": {"none": "இந்தத் தலைப்பு பாடப்புத்தகங்களில் இல்லை. பொதுவாக விளக்கட்டுமா?", "strong": "உங்கள் பாடப்புத்தகத்தின்படி,", "partial": "பாடப்புத்தகத் தகவல்களின்படி,"},
}
CLOSING = {"en": "Begin with: {statement}", "ta": "இவ்வாறு தொடங்கவும்: {statement}"}
USER = {"en": ("Passages:", "Question: "), "ta": ("பகுதிகள்:", "கேள்வி: ")}
DEFAULT_GRADE = 6


def _choose(key: Column, options: dict) -> Column:
    out = None
    for k, v in options.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def _fill(text: str, **values) -> Column:
    """text with {name} replaced by columns."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def system_prompt(language: Column, template: Column, grade: Column, level: Column, ground: Column) -> Column:
    grade = grade.cast("string")
    parts = {
        lang: F.concat_ws(
            "\n\n",
            _fill(OPENING[lang], grade=grade, level=level),
            F.lit(RULES[lang]),
            _choose(template, FORMS[lang]),
            _fill(CLOSING[lang], statement=_choose(ground, STATEMENTS[lang])),
        )
        for lang in OPENING
    }
    return _choose(language, parts)


def user_prompt(language: Column, question: Column, context: Column) -> Column:
    parts = {lang: F.concat(F.lit(head + "\n---\n"), context, F.lit("\n---\n\n" + ask), question) for lang, (head, ask) in USER.items()}
    return _choose(language, parts)


def build_prompts(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """request_id, language, grade, level, template, grounding, system, user of requests (request_id, question) and the
    passages chosen for them: ranked has request_id, rank, class_level, subject, score, text.

    The grade is that of the first passage that has one; mathematics is what most passages are about, or without any what
    the question says; a confused student is a beginner; the mean score says how firmly the answer stands.
    """
    own = F.array_sort(F.collect_list(F.struct("rank", "class_level", "subject", "score", "text")))
    got = ranked.groupBy("request_id").agg(own.alias("p"))
    j = requests.join(got, "request_id", "left").withColumn("p", F.coalesce("p", F.expr("array()").cast(got.schema["p"].dataType)))
    n = F.size("p")
    grades = F.filter(F.transform("p", lambda x: x["class_level"]), lambda g: g.isNotNull() & (g != 0))
    grade = F.coalesce(F.get(grades, F.lit(0)), F.lit(DEFAULT_GRADE))
    math_n = F.size(F.filter("p", lambda x: x["subject"].isin(L.MATH_SUBJECTS)))
    said = T.has_any(F.lower("question"), ["math", "solve", "தீர்"])
    is_math = F.when(n > 0, math_n > n / 2).otherwise(said)
    # To nine places: a mean of exactly 0.7 is not to miss the threshold by what a sum of doubles is off.
    mean = F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["score"]) / F.greatest(n, F.lit(1)), 9)
    level = F.when(T.confused("question"), "Beginner").otherwise(T.difficulty("question"))
    j = j.select("request_id", "question", T.language("question").alias("language"), grade.cast("int").alias("grade"), level.alias("level"), T.template_id("question", is_math).alias("template"), grounding(mean, n).alias("grounding"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("context"))
    system = system_prompt(F.col("language"), F.col("template"), F.col("grade"), F.col("level"), F.col("grounding"))
    return j.select("request_id", "language", "grade", "level", "template", "grounding", system.alias("system"), user_prompt(F.col("language"), F.col("question"), F.col("context")).alias("user"))
