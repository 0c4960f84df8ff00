"""Pages: blocks, reading order, chapters and sections, logical blocks, glossary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from .chunking import own_path
from .folds import ordered_fold


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, seq, tag, text of the block elements of a page's html, tags taken out, blanks left out."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)<(?:h[1-6]|p|li|td|title)[^>]*>.*?</(?:h[1-6]|p|li|td|title)>"), 0)
    at = pages.select("page_id", F.posexplode(found).alias("seq", "raw"))
    text = T.strip(F.regexp_replace(F.regexp_replace("raw", "(?s)<[^>]*>", " "), r"\s+", " "))
    return at.select("page_id", "seq", F.regexp_extract("raw", r"^<(h[1-6]|p|li|td|title)", 1).alias("tag"), text.alias("text")).filter("text <> ''")


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, seq, text of the lines that aren't blank."""
    at = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "raw"))
    return at.select("doc_id", "seq", T.strip("raw").alias("text")).filter("text <> ''")


def document_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, text of the blocks between blank lines."""
    at = docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("block_no", "raw"))
    return at.select("doc_id", "block_no", T.strip("raw").alias("text")).filter("text <> ''")


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, word."""
    return docs.select("doc_id", F.posexplode(T.words("text")).alias("word_no", "word"))


def joined_pages(pages: DataFrame, by: str, order: str, text: str, mark: str = "\n") -> DataFrame:
    """by, text: the texts of a file's pages in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return pages.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x[text], F.lit(""))), mark).alias("text"))


def margins(blocks: DataFrame, top: float = 0.08, bottom: float = 0.92) -> DataFrame:
    """Blocks (y0, y1, page_height) that aren't wholly in the header or footer."""
    return blocks.filter(~((F.col("y1") < top * F.col("page_height")) | (F.col("y0") > bottom * F.col("page_height"))))


def without_qr_captions(blocks: DataFrame, codes: DataFrame, reach: float = 100.0) -> DataFrame:
    """Blocks but for captions near a QR box of their page: codes have file, page, x0, y0, x1, y1 of images."""
    wide = F.col("x1") - F.col("x0")
    boxes = codes.filter((wide / (F.col("y1") - F.col("y0"))).between(0.95, 1.05) & wide.between(40, 120)).select(F.col("file").alias("qf"), F.col("page").alias("qp"), F.col("x0").alias("qx0"), F.col("x1").alias("qx1"), F.col("y1").alias("qy1"))
    near = (F.col("file") == F.col("qf")) & (F.col("page") == F.col("qp")) & (F.abs(F.col("y0") - F.col("qy1")) < reach) & (F.col("x0") < F.col("qx1")) & (F.col("x1") > F.col("qx0"))
    return blocks.join(boxes, near & T.has_any(F.lower(T.strip("text")), L.QR_CAPTION), "left_anti")


def captions(images: DataFrame, blocks: DataFrame, reach: float = 120.0) -> DataFrame:
    """Each image (file, page, image_no, box) with the first block of its page below or above within reach; null if none."""
    b = blocks.select(F.col("file").alias("bf"), F.col("page").alias("bp"), "block_no", F.col("y0").alias("by0"), "text")
    near = (F.col("file") == F.col("bf")) & (F.col("page") == F.col("bp")) & (F.abs(F.col("by0") - F.col("y1")) < reach)
    return images.join(b, near, "left").groupBy("file", "page", "image_no").agg(F.min_by("text", "block_no").alias("caption"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """position of each block of a page (file, page, block_no, box, page_width), two columns read one after the other
    between full-width dividers, which split the page into bands; a page with no divider and fewer than two blocks in a
    column is read from top to bottom."""
    mid, width = F.col("page_width") / 2, F.col("x1") - F.col("x0")
    side = F.when(width > 0.65 * F.col("page_width"), "full").when((F.col("x1") < 1.15 * mid) & (F.col("x0") < mid), "left").when((F.col("x0") > 0.85 * mid) & (F.col("x1") > mid), "right").otherwise("full")
    page = Window.partitionBy("file", "page")
    b = blocks.withColumn("side", side)
    for s in ("full", "left", "right"):
        b = b.withColumn(f"n_{s}", F.sum((F.col("side") == s).cast("int")).over(page))
    plain = (F.col("n_full") == 0) & ((F.col("n_left") < 2) | (F.col("n_right") < 2))
    above = F.sum((F.col("side") == "full").cast("int")).over(page.orderBy("y0", "block_no").rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("band", F.when(plain, 0).otherwise(F.coalesce(above, F.lit(0))))
    turn = F.when(plain, 0).when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    return b.withColumn("position", F.row_number().over(page.orderBy("band", turn, "y0", "x0", "block_no"))).drop("n_full", "n_left", "n_right")


def chapters(blocks: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """chapter_seq (0 before the first header), chapter_no and chapter_title of each block; a header without a title takes
    the next block's text if that is under 80 characters."""
    w = Window.partitionBy(key).orderBy(order)
    b = blocks.withColumn("header", T.chapter_header("text")).withColumn("next_text", F.lead("text").over(w))
    title = F.when(F.col("header.title") != "", F.col("header.title")).when(F.length("next_text") < 80, F.col("next_text")).otherwise("")
    b = b.withColumn("title", F.when(F.col("header").isNotNull(), title)).withColumn("number", F.col("header.number"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return b.select(
        *blocks.columns,
        F.sum(F.col("header").isNotNull().cast("int")).over(so_far).alias("chapter_seq"),
        F.coalesce(F.last("number", ignorenulls=True).over(so_far), F.lit("0")).alias("chapter_no"),
        F.coalesce(F.last("title", ignorenulls=True).over(so_far), F.lit("General")).alias("chapter_title"),
    )


def sections(blocks: DataFrame, key: str = "doc_id", order: str = "seq", scope: list[str] | None = None) -> DataFrame:
    """section_path of each block: the last main section, and the last subsection since; carried on over the book, or
    within `scope` columns (say the page)."""
    within = [key, *(scope or [])]
    so_far = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("h", T.section_header("text"))
    name = F.concat_ws(" ", "h.number", "h.title")
    deep = F.length("h.number") - F.length(F.replace(F.col("h.number"), F.lit("."), F.lit(""))) == 2
    b = b.withColumn("main", F.when(F.col("h").isNotNull() & ~deep, name)).withColumn("sub", F.when(F.col("h").isNotNull() & deep, name))
    b = b.withColumn("main_no", F.count("main").over(so_far))
    in_main = Window.partitionBy(*within, "main_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.coalesce(F.last("main", ignorenulls=True).over(so_far), F.lit("General"))
    return b.withColumn("section_path", F.concat_ws(" > ", top, F.last("sub", ignorenulls=True).over(in_main))).drop("h", "main", "sub", "main_no")


def logical_blocks(blocks: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """key, seq, role, section_path, text: neighbouring blocks (text, section_path) that belong together.

    A group begins at a heading, where the path changes, and at a block with a role of its own, unless the last block with a
    role since the last such beginning had the same one. It has the role and path of its first block.
    """
    w = Window.partitionBy(key).orderBy(order)
    b = blocks.select(F.col(key).cast("long").alias(key), order, "text", "section_path", T.block_role("text").alias("role"), (T.block_type("text") == "heading").alias("heading"))
    b = b.withColumn("path", own_path(key, order))
    hard = F.lag("path").over(w).isNull() | F.col("heading") | (F.lag("path").over(w) != F.col("path"))
    b = b.withColumn("part", F.sum(hard.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    special = F.nullif(F.col("role"), F.lit("general"))
    earlier = Window.partitionBy(key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.last(special, ignorenulls=True).over(earlier)).withColumn("first", F.row_number().over(Window.partitionBy(key, "part").orderBy(order)) == 1)
    begins = F.col("first") | (special.isNotNull() & ~special.eqNullSafe(F.col("before")))
    b = b.withColumn("no", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    g = b.groupBy(key, "no").agg(F.first("path").alias("section_path"), rows.alias("rows"))
    return g.select(key, F.col("no").cast("int").alias("seq"), F.col("rows")[0]["role"].alias("role"), "section_path", F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("text"))


def _line_bands(words: list[tuple]) -> list[list[tuple]]:
    """Words (x0, y0, x1, y1, word) in lines: a line is what lies within 0.4 median heights of its first word."""
    heights = sorted(w[3] - w[1] for w in words)
    reach = heights[len(heights) // 2] * 0.4
    bands, anchor = [], None
    for w in sorted(words, key=lambda w: (w[1] + w[3]) / 2):
        y = (w[1] + w[3]) / 2
        if anchor is None or abs(y - anchor) > reach:
            bands.append([])
            anchor = y
        bands[-1].append(w)
    return bands


def last_pages(page_words: DataFrame, n: int = 15) -> DataFrame:
    """Rows of the last n pages of each file, where a glossary stands: files of fewer pages whole."""
    last = page_words.groupBy("file").agg(F.max("page").alias("_last"))
    return page_words.join(last, "file").filter(F.col("page") > F.col("_last") - n).drop("_last")


def glossary_columns(page_words: DataFrame, gap: float = 20.0) -> DataFrame:
    """file, page, seq, text of the columns of the lines of a page of words (file, page, x0, y0, x1, y1, word); header words go.

    A page's words fit in memory, so a page is one group.
    """
    import pandas as pd

    def page(pdf):
        rows, words = [], list(pdf[["x0", "y0", "x1", "y1", "word"]].itertuples(index=False, name=None))
        for band in _line_bands(words):
            if not (line := " ".join(w[4] for w in band).strip()) or line.lower() in L.GLOSSARY_HEADERS:
                continue
            now: list[tuple] = []
            for w in sorted(band, key=lambda w: w[0]):
                if now and w[0] - now[-1][2] > gap:
                    rows.append(" ".join(x[4] for x in now))
                    now = []
                now.append(w)
            rows.append(" ".join(x[4] for x in now))
        return pd.DataFrame({"file": pdf["file"].iloc[0], "page": pdf["page"].iloc[0], "seq": range(len(rows)), "text": rows})

    return page_words.groupBy("file", "page").applyInPandas(page, "file string, page int, seq int, text string")


class _Pairs:
    """Pairs terms of one language with the next of the other; one that finds none goes out alone, for review."""

    def __init__(self, key):
        self.key, self.waiting = key, None

    def _alone(self) -> list:
        if self.waiting is None:
            return []
        lang, term = self.waiting
        self.waiting = None
        return [(*self.key, term if lang == "t" else "", term if lang == "e" else "", True)]

    def step(self, row) -> list:
        t, e = row.tamil or "", row.english or ""
        if t and e:
            return [*self._alone(), (*self.key, t, e, False)]
        if not t and not e:
            return []
        lang, term = ("t", t) if t else ("e", e)
        if self.waiting and self.waiting[0] != lang:
            other = self.waiting[1]
            self.waiting = None
            return [(*self.key, t or other, e or other, True)]
        out = self._alone()
        self.waiting = (lang, term)
        return out

    def end(self) -> list:
        return self._alone()


def glossary_pairs(columns: DataFrame) -> DataFrame:
    """file, page, tamil, english, needs_review of the columns (file, page, seq, text) of a glossary."""
    terms = columns.withColumn("term", T.bilingual_term("text")).select("file", "page", "seq", F.col("term.tamil").alias("tamil"), F.col("term.english").alias("english"))
    return ordered_fold(terms, ["file", "page"], ["seq"], _Pairs, "file string, page int, tamil string, english string, needs_review boolean")
