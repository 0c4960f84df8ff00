"""Mind maps: triples, steps and outlines to nodes and edges; inputs of the text classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import scratch


def triples(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, subject, relation, object of lines `a | r | b` with three parts, none blank."""
    at = rows.select(key, F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    p = F.transform(F.split("line", r"\|"), T.strip)
    at = at.select(key, "seq", p.alias("p")).filter((F.size("p") == 3) & ~F.exists("p", lambda x: x == ""))
    return at.select(key, "seq", F.col("p")[0].alias("subject"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("object"))


def graph_of(triple: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, node_id, label; ids by first mention) and edges (key, source, target, label)."""
    named = triple.select(key, F.posexplode(F.array("subject", "object")).alias("side", "label"), "seq")
    first = named.groupBy(key, "label").agg(F.min(F.struct("seq", "side")).alias("at"))
    nodes = first.withColumn("node_id", F.row_number().over(Window.partitionBy(key).orderBy("at"))).select(key, "node_id", "label")
    a, b = nodes.select(key, F.col("node_id").alias("source"), F.col("label").alias("subject")), nodes.select(key, F.col("node_id").alias("target"), F.col("label").alias("object"))
    return nodes, triple.join(a, [key, "subject"]).join(b, [key, "object"]).select(key, "source", "target", F.col("relation").alias("label"))


def steps(rows: DataFrame, key: str, text: str, n_words: int = 3) -> DataFrame:
    """key, step, label: sentences of a process, each by its first words; step from 1."""
    parts = F.filter(F.transform(F.split(text, r"[.\n]+"), T.strip), lambda s: s != "")
    at = rows.select(key, F.posexplode(parts).alias("i", "s"))
    return at.select(key, (F.col("i") + 1).alias("step"), F.array_join(F.slice(T.words("s"), 1, n_words), " ").alias("label"))


def step_edges(step: DataFrame, key: str) -> DataFrame:
    """key, source, target of neighbouring steps."""
    nxt = F.lead("step").over(Window.partitionBy(key).orderBy("step"))
    return step.select(key, F.col("step").alias("source"), nxt.alias("target")).filter("target is not null")


def outline_edges(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, parent, child of a nested JSON outline {topic: {sub: {...}}}: names stripped, a child named like its parent
    (in any case) skipped, its children going to that parent; the first of equal siblings wins."""
    import pandas as pd

    def walk(node, parent, out):
        if isinstance(node, dict):
            for name, below in node.items():
                n = str(name).strip()
                if parent is not None and n.lower() == parent.lower():
                    walk(below, parent, out)
                    continue
                if parent is not None and (parent, n) not in out:
                    out[parent, n] = None
                walk(below, n, out)
        elif isinstance(node, list):
            for x in node:
                walk(x, parent, out)
        elif node is not None and parent is not None and str(node).strip() and str(node).strip().lower() != parent.lower():
            out[parent, str(node).strip()] = None

    def run(frames):
        from json import loads

        for pdf in frames:
            rows_ = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                edges: dict = {}
                try:
                    walk(loads(t[t.index("{") : t.rindex("}") + 1]), None, edges)
                except (ValueError, AttributeError):
                    edges = {}
                rows_ += [(k, i, *e) for i, e in enumerate(edges)]
            yield pd.DataFrame(rows_, columns=[key, "seq", "parent", "child"])

    return rows.select(F.col(key).cast("long").alias("k"), F.col(json).alias("t")).mapInPandas(run, f"{key} long, seq int, parent string, child string")


def numbered(rows: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """Adds out: the place of each row in the order of all, from `first` on; `order` tells all rows apart.

    Rows are dealt by ranges of the order, numbered in their range and moved on by the sizes of the ranges before, of which
    the driver gets one number a range.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    before, at = [], first - 1
    for r in sorted(parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before.append((r._part, at))
        at += r.n
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_local", local).join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def vocabulary(rows: DataFrame, key: str, text: str) -> DataFrame:
    """term, term_id: ids from 2 by first appearance in order of key and place."""
    t = rows.select(key, F.posexplode(T.words(T.classifier_text(text))).alias("pos", "term")).groupBy("term").agg(F.min(F.struct(key, "pos")).alias("at"))
    return numbered(t, ["at"], "term_id", first=2).select("term", "term_id")


def encode_padded(rows: DataFrame, vocab: DataFrame, key: str, text: str, length: int = 25) -> DataFrame:
    """key, ids: the last `length` word ids, zeros before them; words that vocab lacks are 1."""
    t = rows.select(key, F.posexplode_outer(T.words(T.classifier_text(text))).alias("pos", "term"))
    coded = t.join(vocab, "term", "left").select(key, "pos", F.when(F.col("term").isNotNull(), F.coalesce("term_id", F.lit(1).cast("long"))).alias("_code"))
    ids = coded.groupBy(key).agg(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("pos", "_code")), lambda x: x["_code"].isNotNull())), lambda x: x["_code"]).alias("ids"))
    last = F.when(F.size("ids") > length, F.slice("ids", -length, length)).otherwise(F.col("ids"))
    return ids.select(key, F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), length - F.size("ids"))), last).alias("ids"))


def synthetic_sentences(subjects: list[str], verbs: list[str], objects: list[str], spark) -> DataFrame:
    """sentence: all combinations of the given words."""
    out = spark.range(1)
    for c, xs in (("s", subjects), ("v", verbs), ("o", objects)):
        out = out.select("*", F.explode(F.array(*map(F.lit, xs))).alias(c))
    return out.select(F.concat_ws(" ", "s", "v", "o").alias("sentence"))


def question_keywords(question) -> Column:
    """Latin words of a question of three letters or more that aren't stop words, in lower case; a repeated word stays repeated."""
    from ..functions import lexicon as L

    words = F.transform(F.regexp_extract_all(T.col(question), F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(L.RELEVANCE_STOPS))


def excerpt_sentences(text) -> Column:
    """Split behind . ! ?, a line end or a danda, where white space follows (so at blank lines, not at every line); without short ones."""
    marked = F.regexp_replace(T.strip(T.col(text)), "([.!?\\n\u0964\u0965])\\s+", "$1\u001e")
    return F.filter(F.transform(F.split(marked, "\u001e"), T.strip), lambda s: F.length(s) > 10)


def relevant_sentences(text, query_words: Column, window: int = 5, tamil: Column | None = None) -> Column:
    """The window around the sentence with most query words (and a half for a defining word, in either language); without
    any, the first ones; without a sentence, the first 800 characters. Where `tamil` holds, whose scans have no clean
    sentence ends, the first 1200 characters."""
    from ..functions import lexicon as L

    s = excerpt_sentences(text)
    score = F.transform(s, lambda x: F.size(F.filter(query_words, lambda w: F.contains(F.lower(x), w))) + F.when(F.lower(x).rlike(T.whole_words(L.CUES)), 0.5).otherwise(0.0) + F.when(T.has_any(x, L.TAMIL_CUES), 0.5).otherwise(0.0))
    best = F.array_position(score, F.array_max(score)).cast("int") - 1
    start = F.greatest(best - 1, F.lit(0))
    picked = F.slice(s, start + 1, best + window - start)
    first = F.array_join(F.slice(s, 1, window), " ")
    whole = F.lit(False) if tamil is None else F.coalesce(tamil, F.lit(False))
    return F.when(whole, F.substring(T.col(text), 1, L.EXCERPT_TAMIL)).when(F.size(s) == 0, F.substring(T.col(text), 1, L.EXCERPT_FALLBACK)).when((F.size(query_words) == 0) | (F.array_max(score) == 0), first).otherwise(F.array_join(picked, " "))
