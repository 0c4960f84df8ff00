"""Readers and writers."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file_path (below root), modified, size, content, file_hash of all files below root that have the pattern."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return raw.select(relative(F.col("path"), root).alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("file_hash"))


def relative(path, root: str):
    """The part of a path below root, with forward slashes."""
    tail = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring(tail, F.locate(base, tail) + len(base), F.length(tail))


def books(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """files() with the metadata that a book's path tells; `problem` says why a path doesn't tell enough."""
    found = files(spark, root, pattern)
    m = found.withColumn("m", T.path_metadata("file_path")).select("*", "m.*").drop("m")
    return m.withColumn("problem", F.when(F.col("class_level").isNull(), "no class level in path"))


def text_files(spark: SparkSession, roots: list[str], pattern: str = "*.txt") -> DataFrame:
    """source (path below its root), text: UTF-8, or Latin-1 where that isn't valid."""
    out = None
    for root in roots:
        f = files(spark, root, pattern)
        part = f.select(F.col("file_path").alias("source"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def chunk_files(spark: SparkSession, root: str, pattern: str = "*_chunks.json") -> DataFrame:
    """file_path, seq, text, chunk (JSON) of chunk files of any of their forms: {"chunks": [...]}, a list of texts, a list of
    objects (by chunk_id if all have one), an object by number."""

    def parse(content: bytes):
        x = json.loads(content)
        if isinstance(x, dict):
            x = x["chunks"] if isinstance(x.get("chunks"), list) else [v for _, v in sorted(x.items(), key=lambda kv: (not kv[0].lstrip("-").isdigit(), int(kv[0]) if kv[0].lstrip("-").isdigit() else 0, kv[0]))]
        if x and all(isinstance(c, dict) and isinstance(c.get("chunk_id"), int) for c in x):
            x = sorted(x, key=lambda c: c["chunk_id"])
        return [(i, c if isinstance(c, str) else str(c.get("text", "")), json.dumps(c, ensure_ascii=False)) for i, c in enumerate(x)]

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(p, *row) for p, c in zip(pdf["file_path"], pdf["content"], strict=True) for row in parse(c)], columns=["file_path", "seq", "text", "chunk"])

    return files(spark, root, pattern).select("file_path", "content").mapInPandas(run, "file_path string, seq int, text string, chunk string")


def csv_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key (lower case), value of a CSV file with a header; the last row of a key wins."""
    rows = spark.read.option("header", True).csv(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return rows.filter(F.col(key).isNotNull()).groupBy(F.lower(T.strip(key)).alias(key)).agg(F.max_by(value, "_at").alias(value))


def read_strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a record that isn't JSON instead of passing over it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def parquet_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved index, or an empty one where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def save_chunks(chunks: DataFrame, path: str, by: tuple[str, ...] = ("medium", "class_level")) -> None:
    """Chunks with their vectors, partitioned so that readers prune by language and class."""
    chunks.repartition(*by).write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy(*by).parquet(path)


def save_index(chunks: DataFrame, path: str) -> None:
    """postings, bounds, doc_stats, term_stats and corpus_stats below path, each language being a corpus; bm25_index.Index reads them."""
    from ..operators.bm25_index import write_index

    write_index(chunks, path, key="chunk_id", by="medium")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: below spark.checkpoint.dir; where that is unset, in a folder of our own if Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/sandloom-local"
    return f"{root.rstrip('/')}/work/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def save_csv_by(rows: DataFrame, path: str, keys: list[str]) -> None:
    """All rows, and once more for each key column in folders by its value."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/all")
    for k in keys:
        rows.withColumn("_key", F.col(k)).write.mode("overwrite").option("header", True).partitionBy("_key").csv(f"{path}/by_{k}")


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A report table of a small aggregate; more than `most` rows are an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows for a report")
    line = lambda xs: "| " + " | ".join(map(str, xs)) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *[line(r) for r in got]])


def wide_vectors(vectors: DataFrame, dim: int, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The vector as columns dim_0, dim_1, ... rounded."""
    rest = [c for c in vectors.columns if c != vector]
    return vectors.select(*rest, *[F.round(F.col(vector)[i].cast("double"), digits).alias(f"dim_{i}") for i in range(dim)])


def read_jdbc(spark: SparkSession, url: str, table: str, where: str | None = None, split: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database; Spark hands `where` on to it. With `split`, a numeric column, it is read in parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split:
        lo, hi = reader.load().agg(F.min(split), F.max(split)).first()
        if lo is not None and hi > lo:
            reader = reader.option("partitionColumn", split).option("lowerBound", str(lo)).option("upperBound", str(hi)).option("numPartitions", str(parts))
    rows = reader.load()
    return rows.filter(where) if where else rows


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def update_jdbc(changed: DataFrame, url: str, table: str, key: str, **options: str) -> None:
    """Rows of changed in the place of those with their key, and new ones beside them: the merged table is written under another
    name first, then over the old one."""
    spark = changed.sparkSession
    old = read_jdbc(spark, url, table, **options)
    names = {c.lower(): c for c in old.columns}
    new = changed.select(*[F.col(c).alias(names[c.lower()]) for c in changed.columns])
    write_jdbc(old.join(new.select(names[key.lower()]), names[key.lower()], "left_anti").select(*old.columns).unionByName(new), url, f"{table}_new", "overwrite", **options)
    write_jdbc(read_jdbc(spark, url, f"{table}_new", **options), url, table, "overwrite", truncate="true", **options)


def corpus(spark: SparkSession, paths: list[str], form: str = "text", column: str = "text") -> DataFrame:
    """source, text: lines of text files, or a column of CSV files with a header; blank lines go."""
    if form not in ("text", "csv"):
        raise ValueError(f"a corpus is text or csv, not {form}")
    rows = spark.read.text(paths).withColumnRenamed("value", "text") if form == "text" else spark.read.option("header", True).option("multiLine", True).csv(paths).withColumn("text", F.col(column))
    return rows.select(F.col("_metadata.file_name").alias("source"), "text").filter("text is not null and trim(text) <> ''")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """What lies at path; made and written there first if nothing does. A half-written folder counts as nothing."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_session(rows: DataFrame, path: str) -> None:
    """Adds records to a session's JSON lines."""
    rows.write.mode("append").json(path)
