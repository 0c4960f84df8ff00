"""Chunkers: closed forms where a chunk's place is known beforehand, folds where it depends on the chunks before."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def word_windows(docs: DataFrame, size: int = 400, overlap: int = 60, least: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, n_words, chunk: windows of `size` words every size - overlap words; those under `least` characters go."""
    ws = docs.select(key, T.words(F.coalesce(F.col(text), F.lit(""))).alias("ws")).filter(F.size("ws") > 0)
    at = ws.select(key, "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - 1, F.lit(size - overlap))).alias("start"))
    out = at.select(key, "start", F.slice("ws", F.col("start") + 1, size).alias("part"))
    return out.select(key, "start", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk")).filter(F.length("chunk") >= least)


def sentences(text) -> Column:
    """Split behind . ! or ? and white space, stripped, without blanks."""
    marked = F.regexp_replace(T.col(text), r"([.!?])\s+", "$1\u001e")
    return F.filter(F.transform(F.split(marked, "\u001e"), T.strip), lambda s: s != "")


def sentence_groups(docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, group_no, n_sentences, chunk."""
    s = docs.select(key, sentences(text).alias("s")).filter(F.size("s") > 0)
    at = s.select(key, "s", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(s) - 1) div {n} as int)"))).alias("group_no"))
    part = F.slice("s", F.col("group_no") * n + 1, n)
    return at.select(key, "group_no", F.size(part).alias("n_sentences"), F.array_join(part, " ").alias("chunk"))


def pack_sentences(parts: list[str], most: int, carry: int = 10, drop_empty: bool = True) -> list[str]:
    """Greedy chunks of at most `most` words; a new chunk begins with the last `carry` words of the one before."""
    out, now = [], []
    for s in parts:
        ws = s.split()
        if len(now) + len(ws) > most:
            if now or not drop_empty:
                out.append(" ".join(now))
            now = now[-carry:] + ws if carry else list(ws)
        else:
            now += ws
    return [*out, " ".join(now)] if now else out


def pack_chars(parts: list[str], most: int = 300) -> list[str]:
    """Greedy chunks while the text so far and the next sentence together stay under `most` characters."""
    out, now = [], ""
    for s in parts:
        if len(now) + len(s) < most:
            now += s + " "
        else:
            if now.strip():
                out.append(now.strip())
            now = s + " "
    return [*out, now.strip()] if now.strip() else out


def pack_full_stops(text: str, most: int = 300) -> list[str]:
    """The English packer: parts between full stops with a space behind them, which are lost, greedily joined by a space while
    the text so far and the next part stay under `most` characters. The very first part's own space counts; empty chunks go."""
    out, now = [], ""
    for part in text.split(". "):
        fits = len(now) + len(part) < most
        if not fits:
            out.append(now)
        now = f"{now} {part}" if fits else part
    return [c for c in map(str.strip, [*out, now]) if c]


def recursive_split(text: str, size: int = 300, overlap: int = 50, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest mark that works, neighbours sharing up to `overlap`."""
    mark = next((m for m in marks if m == "" or m in text), "")
    rest = marks[marks.index(mark) + 1 :]
    parts = list(text) if mark == "" else [p for p in text.split(mark) if p]
    out, good = [], []

    def merge(pieces):
        now, total = [], 0
        for p in pieces:
            extra = len(mark) if now else 0
            if now and total + extra + len(p) > size:
                out.append(mark.join(now).strip())
                while now and (total > overlap or total + len(mark) + len(p) > size):
                    total -= len(now[0]) + (len(mark) if len(now) > 1 else 0)
                    now.pop(0)
            total += len(p) + (len(mark) if now else 0)
            now.append(p)
        if now:
            out.append(mark.join(now).strip())

    for p in parts:
        if len(p) <= size:
            good.append(p)
        else:
            merge(good)
            good = []
            out.extend(recursive_split(p, size, overlap, rest) if rest else [p])
    merge(good)
    return [x for x in out if x]


def cut_points(sizes: list[int], target: int, overlap: int = 0, walls: frozenset[int] = frozenset(), repeats: frozenset[int] | None = None) -> list[tuple[int, int]]:
    """Ranges of units that go into one chunk: as many as fit into `target`, none over a wall (a unit that must begin a chunk).

    A chunk begins with the unit before its first one if that is under `overlap` and its first one is among `repeats` (all, if
    none are given).
    """
    out, start, filled = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i in walls or filled + n > target):
            out.append((start, i))
            back = i not in walls and sizes[i - 1] < overlap and (repeats is None or i in repeats)
            start, filled = (i - 1, sizes[i - 1]) if back else (i, 0)
        filled += n
    return [*out, (start, len(sizes))] if sizes else []


def split_large(text: str, target: int = 500, overlap: int = 75) -> list[str]:
    """Lines packed to `target` words, a short last one repeated; a line that is longer begins a chunk and is packed by its sentences."""
    units, walls, lines = [], set(), set()
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(line.split()) > target:
            walls.add(len(units))
            units += re.split(r"(?<=[.!?])\s+", line)
        else:
            lines.add(len(units))
            units.append(line)
    cuts = cut_points([len(u.split()) for u in units], target, overlap, frozenset(walls), frozenset(lines))
    return ["\n".join(units[a:b]) for a, b in cuts]


def pack_blocks(texts: list[str], target: int, overlap: int) -> list[str]:
    """Neighbouring blocks of one section as chunks; a block that is larger stands alone and is split."""
    if len(texts) == 1 and len(texts[0].split()) > target:
        return split_large(texts[0], target, overlap)
    return ["\n\n".join(texts[a:b]) for a, b in cut_points([len(t.split()) for t in texts], target, overlap)]


def own_path(key: str, order: str, path: str = "section_path") -> Column:
    """A block without a path takes the next one's; '' where none follows."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.coalesce(F.first(F.nullif(F.col(path), F.lit("")), ignorenulls=True).over(ahead), F.lit(""))


def curriculum_chunks(blocks: DataFrame, key: str = "doc_id", order: str = "seq", target: int = 500, overlap: int = 75) -> DataFrame:
    """key, chunk_no, section_path, role, chunk of blocks (key, order, text, section_path, role), about `target` words each.

    Windows find the stretches of blocks that may share a chunk: those of one path, a block over `target` being one by
    itself. Only the packing of a stretch is a fold.
    """
    w = Window.partitionBy(key).orderBy(order)
    b = blocks.select(F.col(key).cast("long").alias(key), order, F.coalesce("text", F.lit("")).alias("text"), "role", "section_path")
    b = b.withColumn("path", own_path(key, order)).withColumn("large", F.size(F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), 1)) > target)
    new = F.lag("path").over(w).isNull() | (F.lag("path").over(w) != F.col("path")) | F.col("large") | F.lag("large").over(w)
    b = b.withColumn("stretch", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    # Words as str.split() parts them. Only their numbers, and texts that have to be split, go to Python.
    n_words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(?U)([^\s\x1C-\x1F]+)"), 1))

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cuts(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda ns: [{"a": a, "b": b} for a, b in cut_points([int(n) for n in ns], target, overlap)])

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_large(t, target, overlap))

    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    s = b.groupBy(key, "stretch").agg(F.first("path").alias("section_path"), F.when(F.max("large"), F.max("role")).otherwise("general").alias("role"), F.transform(rows, lambda x: x["text"]).alias("texts"))
    s = s.withColumn("sizes", F.transform("texts", n_words))
    alone = (F.size("texts") == 1) & (F.col("sizes")[0] > target)
    s = s.select(key, "stretch", "section_path", "role", "texts", split(F.when(alone, F.col("texts")[0])).alias("split"), cuts(F.when(~alone, F.col("sizes")).otherwise(F.expr("array()"))).alias("cuts"))
    together = F.transform("cuts", lambda r: F.array_join(F.slice(F.col("texts"), r["a"] + 1, r["b"] - r["a"]), "\n\n"))
    at = s.select(key, "stretch", "section_path", "role", F.posexplode(F.coalesce("split", together)).alias("piece", "text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("stretch", "piece")) - 1
    return at.select(key, number.alias("chunk_no"), "section_path", "role", T.with_context("section_path", "text").alias("chunk"))


def guide_chunks(text: str, target: int = 500, least: int = 30) -> list[str]:
    """Question and answer blocks of a guide; what is under `least` characters goes, a long block is split, its later parts naming the question."""
    out = []
    for raw in re.split(r"(?i)(?=(?:question|q\d+|கேள்வி|\d+\.\s+)\s*:?)", text):
        block = re.sub(r"\n+", "\n\n", re.sub(r"[^\S\n]+", " ", raw)).strip()
        if len(block) < least:
            continue
        if len(block.split()) <= target:
            out.append(block)
        else:
            first = block.split("\n")[0]
            out += [t if k == 0 else f"[Parent Question: {first}]\n\n(Continued) {t}" for k, t in enumerate(split_large(block, target))]
    return out


def map_text(docs: DataFrame, split, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_no, chunk for a function of a whole text that gives its chunks."""

    def run(frames):
        for pdf in frames:
            rows = [(k, i, c) for k, t in zip(pdf["k"], pdf["t"], strict=True) for i, c in enumerate(split(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, chunk_no int, chunk string")


def python_sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def lm_token_blocks(tokens: DataFrame, block: int, key: str = "doc_id", ids: str = "ids", source: str = "source") -> DataFrame:
    """source, block_no, input_ids, labels: a source's token ids laid end to end in order of key and cut into blocks.

    Labels are the ids. The last block is dropped if it is short, unless it is the only one. Only a document's length
    goes into the running totals; its ids are cut where blocks end, and each block gathers its pieces.
    """
    from .ranking import running_total

    n = tokens.select(key, source, F.size(ids).cast("long").alias("n"), F.col(ids).alias("ids")).filter("n > 0")
    at = running_total(n, source, key, "n", "end").withColumn("begin", F.col("end") - F.col("n"))
    hit = at.select("*", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))).alias("block_no"))
    lo = F.greatest(F.col("block_no") * block, F.col("begin"))
    hi = F.least((F.col("block_no") + 1) * block, F.col("end"))
    piece = hit.select(source, "block_no", lo.alias("lo"), F.slice("ids", (lo - F.col("begin") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    whole = piece.groupBy(source, "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda x: x["piece"])).alias("input_ids"))
    return whole.filter((F.size("input_ids") == block) | (F.col("block_no") == 0)).select(source, "block_no", "input_ids", F.col("input_ids").alias("labels"))


def lm_blocks(tokens: DataFrame, block: int, key: str = "doc_id", length: str = "n_tokens", source: str = "source") -> DataFrame:
    """source, block_no, n_tokens of the blocks that a source's documents make laid end to end in order of key.

    The last block is dropped if it is short, unless it is the only one. No token is moved: blocks follow from sums.
    """
    total = tokens.groupBy(source).agg(F.sum(length).cast("long").alias("total"))
    full = F.expr(f"total div {block}")
    n = F.when(full > 0, full).otherwise(F.when(F.col("total") > 0, F.lit(1).cast("long")))
    return total.select(source, "total", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block_no")).select(source, "block_no", F.least(F.col("total"), F.lit(block).cast("long")).alias("n_tokens"))
