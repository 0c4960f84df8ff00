"""Corrections and glossary look-ups; links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.io import scratch


def plain(c):
    """Lower case, marks out."""
    return T.strip(F.regexp_replace(F.lower(T.col(c)), r"[^\p{L}\p{N}_\s]", ""))


def match_corrections(queries: DataFrame, corrections: DataFrame, shared: int = 2, contained: bool = True) -> DataFrame:
    """query_id, correction_id: the first approved correction (smallest id) that shares at least two keywords with the
    query, or of which one contains the other. queries: query_id, question; corrections: correction_id, issue.

    Keywords meet by an equi-join, and containment by contained_pairs(), so there is no cross join.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: ~w.isin(["", *L.CORRECTION_STOPS])))
    q = queries.select("query_id", plain("question").alias("q_text"))
    c = corrections.select("correction_id", plain("issue").alias("c_text"))
    q_words, c_words = q.select("query_id", F.explode(words(F.col("q_text"))).alias("w")), c.select("correction_id", F.explode(words(F.col("c_text"))).alias("w"))
    pairs = q_words.join(c_words, "w").groupBy("query_id", "correction_id").agg(F.count("*").alias("n")).filter(F.col("n") >= shared).select("query_id", "correction_id")
    if contained:
        inside = contained_pairs(q.select(F.col("query_id").alias("small_id"), F.col("q_text").alias("small")), c.select(F.col("correction_id").alias("large_id"), F.col("c_text").alias("large")))
        pairs = pairs.unionByName(inside.select(F.col("small_id").alias("query_id"), F.col("large_id").alias("correction_id")))
        inside = contained_pairs(c.select(F.col("correction_id").alias("small_id"), F.col("c_text").alias("small")), q.select(F.col("query_id").alias("large_id"), F.col("q_text").alias("large")))
        pairs = pairs.unionByName(inside.select(F.col("large_id").alias("query_id"), F.col("small_id").alias("correction_id")))
    return pairs.groupBy("query_id").agg(F.min("correction_id").alias("correction_id"))


GRAM, NAMED_WORDS = 3, 1 << 18


def contained_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """small_id, large_id of all pairs where small's text is a substring of large's; both have an id and a text column.

    A text of three words or more is met by the rarest of its inner words, which are whole words of the text around it. Of
    shorter ones the longest word lies in a word of the text around it: it is looked for among the distinct words, by its
    rarest three-character gram, or by itself if it has one or two characters. Texts without a word are contained in
    nothing. The distinct words and their counts are written once, so are the words to look for; these are broadcast up to
    NAMED_WORDS, and the words of the texts are shuffled beyond. Spark would go by the size of the files, which are packed,
    and broadcast many more; so joins with many words, and that with the texts, are told to merge.
    """
    spark, path = large.sparkSession, scratch(large.sparkSession, "contained")
    parts = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))
    held = large.select("large_id", F.explode(F.array_distinct(parts(F.col("large")))).alias("word"))
    ws = small.select("small_id", parts(F.col("small")).alias("ws"))
    held.groupBy("word").agg(F.count("*").alias("df")).write.parquet(f"{path}/words")
    counts = spark.read.parquet(f"{path}/words")
    many = counts.count() * 8 > NAMED_WORDS  # a word has some eight grams
    merged = lambda d: d.hint("merge") if many else d
    inner = ws.filter(F.size("ws") >= 3).select("small_id", F.explode(F.array_distinct(F.slice("ws", F.lit(2), F.size("ws") - 2))).alias("word"))
    rarest = inner.join(merged(counts), "word", "left").groupBy("small_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), F.col("word"))).alias("word"))
    longest = F.aggregate("ws", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    short = ws.filter(F.size("ws").between(1, 2)).select("small_id", longest.alias("key"))
    vocab = counts.filter(F.length("word") >= GRAM).select("word", F.explode(grams(F.col("word"), GRAM)).alias("gram"))
    gram_df = vocab.groupBy("gram").agg(F.count("*").alias("df"))
    one = short.filter(F.length("key") >= GRAM).select("small_id", "key", F.explode(grams(F.col("key"), GRAM)).alias("gram"))
    one = one.join(merged(gram_df), "gram", "left").groupBy("small_id", "key").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), F.col("gram"))).alias("gram"))
    inside = one.join(merged(vocab), "gram").filter(F.contains("word", F.col("key"))).select("small_id", "word").distinct()
    for n in range(1, GRAM):
        tiny = short.filter(F.length("key") == n)
        pieces = counts.filter(F.length("word") >= n).select("word", F.explode(grams(F.col("word"), n)).alias("key"))
        inside = inside.unionByName(tiny.join(merged(pieces), "key").select("small_id", "word"))
    rarest.select("small_id", "word").unionByName(inside).write.parquet(f"{path}/asked")
    asked = spark.read.parquet(f"{path}/asked")
    met = held.join(F.broadcast(asked) if asked.count() <= NAMED_WORDS else asked.hint("merge"), "word").select("small_id", "large_id").distinct()
    both = met.join(small, "small_id").join(large.hint("merge"), "large_id")
    return both.filter(F.contains("large", F.col("small"))).select("small_id", "large_id")


TERMS, TERM_CHARS, FEW_TERMS, KEY, KNOWN_WORDS, PAIRS = 1 << 16, 1 << 22, 512, 32, 1 << 16, 1 << 16


class _Terms(dict):
    """Numbers of the terms that a text contains. As a dict: a word -> the keys in it, for words that were met lately.

    A term's key is its longest word, up to KEY characters of it. It lies in a word of any text that contains the term; a
    term that is more than its key is then looked for in the text itself, one without a word in every text. Up to FEW_TERMS
    terms are all looked for in the text, which is faster.
    """

    def __init__(self, terms: list[str]):
        self.terms, self.keys, self.whole, self.more, self.wordless = terms, {}, {}, {}, []
        for i, term in enumerate(terms):
            word = max(term.split(), key=len, default="")[:KEY]
            if not word:
                self.wordless.append(i)
                continue
            k = self.keys.setdefault(word, len(self.keys))
            if word == term:
                self.whole[k] = i
            else:
                self.more.setdefault(k, []).append(i)
        self.lengths = sorted({len(key) for key in self.keys})

    def __missing__(self, word: str) -> tuple[int, ...]:
        keys, n = self.keys, len(word)
        got = tuple({keys[x] for m in self.lengths if m <= n for i in range(n - m + 1) if (x := word[i : i + m]) in keys})
        if n <= 2 * KEY:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = got
        return got

    def within(self, text: str) -> list[int]:
        if len(self.terms) <= FEW_TERMS:
            return [i for i, term in enumerate(self.terms) if term in text]
        keys = set().union(*map(self.__getitem__, set(text.split())))
        sure = [self.whole[k] for k in keys if k in self.whole]
        return sure + [i for i in [*self.wordless, *(i for k in keys if k in self.more for i in self.more[k])] if self.terms[i] in text]


def glossary_matches(prompts: DataFrame, glossary: DataFrame) -> DataFrame:
    """prompt_id, english, tamil of all glossary terms that a prompt contains, in lower case; the last entry of a term wins.

    prompts: prompt_id, prompt; glossary: seq, english, tamil. Up to TERMS terms of TERM_CHARS characters together go to all
    tasks, which look for them in the prompts as they read these: nothing is shuffled or written. More take contained_pairs().
    """
    import pyarrow as pa

    terms = glossary.select(F.lower(T.strip("english")).alias("english"), "tamil", "seq").filter("english <> ''").groupBy("english").agg(F.max_by("tamil", "seq").alias("tamil"))
    large = prompts.select(F.col("prompt_id").alias("large_id"), F.lower("prompt").alias("large"))
    n, chars = terms.agg(F.count("*"), F.sum(F.length("english") + F.coalesce(F.length(F.col("tamil").cast("string")), F.lit(0)))).first()
    if n > TERMS or (chars or 0) > TERM_CHARS:
        small = terms.select(F.col("english").alias("small_id"), F.col("english").alias("small"))
        return contained_pairs(small, large).select(F.col("large_id").alias("prompt_id"), F.col("small_id").alias("english")).join(terms, "english").select("prompt_id", "english", "tamil")
    rows = terms.toArrow().combine_chunks()
    shared = prompts.sparkSession.sparkContext.broadcast((rows["english"].combine_chunks(), rows["tamil"].combine_chunks()))

    def find(batches):
        english, tamil = shared.value
        known = _Terms(english.to_pylist())
        for batch in batches:
            at, term = [], []
            for i, text in enumerate(batch.column(1)):
                found = known.within(text.as_py())
                at += [i] * len(found)
                term += found
                if len(term) >= PAIRS or (term and i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), english.take(pa.array(term)), tamil.take(pa.array(term))], ["prompt_id", "english", "tamil"])
                    at, term = [], []

    kind = dict(prompts.dtypes)["prompt_id"], dict(terms.dtypes)["tamil"]
    return large.filter("large is not null").mapInArrow(find, f"prompt_id {kind[0]}, english string, tamil {kind[1]}")


def broken_links(pages: DataFrame, pattern: str = r'href="([^"]+)"') -> DataFrame:
    """page_id, link of links to no page of the table: pages with page_id, url, html."""
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))).alias("link"))
    return links.join(pages.select(F.col("url").alias("link")).distinct(), "link", "left_anti").select("page_id", "link")


def broken_wiki_links(pages: DataFrame, free_prefix: str = "Module ") -> DataFrame:
    """title, link of wiki links to no page of the table (title, text); links that begin with free_prefix may point anywhere."""
    links = pages.select("title", F.explode(F.array_distinct(T.wiki_links("text"))).alias("link"))
    return links.filter(~F.col("link").startswith(free_prefix)).join(pages.select(F.col("title").alias("link")).distinct(), "link", "left_anti").select("title", "link")


def usable_terms(glossary: DataFrame, tamil: str = "tamil", english: str = "english") -> DataFrame:
    """Entries with more than one character on both sides; orphans go."""
    return glossary.filter((F.length(F.coalesce(tamil, F.lit(""))) > 1) & (F.length(F.coalesce(english, F.lit(""))) > 1))


def glossary_file_stats(terms: DataFrame, files: DataFrame) -> DataFrame:
    """file, n_terms, n_flagged, flagged_ratio, failure of every file: terms has file and needs_review."""
    n = terms.groupBy("file").agg(F.count("*").alias("n_terms"), F.count_if("needs_review").alias("n_flagged"))
    j = files.join(n, "file", "left").fillna(0, ["n_terms", "n_flagged"])
    ratio = F.when(F.col("n_terms") > 0, F.col("n_flagged") / F.col("n_terms")).otherwise(0.0)
    failure = F.when(F.col("n_terms") == 0, "0 terms found").when(ratio > 0.5, F.format_string(">50%% terms flagged (%d/%d)", "n_flagged", "n_terms"))
    return j.select("file", "n_terms", "n_flagged", ratio.alias("flagged_ratio"), failure.alias("failure"))
