"""Hybrid retrieval for a batch of requests as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..sources.io import scratch
from .hybrid import FusedLists, fused_top
from .lexical import bm25
from .mindmap import numbered
from .ranking import rrf


def term_rule(class_id, term, chunk_term) -> Column:
    """Classes 6 and 7 ask for the same term, class 8 for term 0, others for any; without class or term, any."""
    c, t = T.col(class_id), T.col(term)
    return F.when(c.isNull() | t.isNull(), F.lit(True)).when(c.isin(6, 7), T.col(chunk_term) == t).when(c == 8, T.col(chunk_term) == 0).otherwise(F.lit(True))


def metadata_filter(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of a request and a chunk that it may use.

    requests: request_id, question, medium, class_id, term, subject ('auto' or one), allowed array. chunks: chunk_id,
    medium, class_level, term, subject, content_type. Joined on the language, so a partitioned table is pruned by it.
    """
    req = requests.withColumn("wanted", F.when(F.col("subject") == "auto", T.subjects("question")).otherwise(F.array("subject"))).withColumn("types", T.content_types("question", "allowed"))
    req = req.withColumn("types", F.when(F.coalesce(F.col("include_previous_years"), F.lit(False)), F.array_union("types", F.array(F.lit("previous_year")))).otherwise(F.col("types"))) if "include_previous_years" in req.columns else req
    r = req.select("request_id", "question", F.col("medium").alias("r_medium"), F.col("class_id").alias("r_class"), F.col("term").alias("r_term"), "wanted", "types")
    subject, kind = F.coalesce("subject", F.lit("science")), F.coalesce("content_type", F.lit("textbook"))
    ok = (
        (F.col("r_medium") == F.col("medium"))
        & (F.col("r_class").isNull() | (F.col("r_class") == F.col("class_level")))
        & ((F.size("wanted") == 0) | F.exists("wanted", lambda s: T.subject_match(s, subject)))
        & term_rule("r_class", "r_term", F.coalesce("term", F.lit(0)))
        & F.array_contains("types", kind)
    )
    return chunks.join(r, ok)


def answerable(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests that have a candidate: a semi-join on metadata alone, which stops at a request's first match."""
    slim = chunks.select("medium", "class_level", "term", "subject", "content_type").distinct()
    return requests.join(metadata_filter(requests, slim).select("request_id").distinct(), "request_id", "left_semi")


METADATA = ["medium", "class_level", "term", "subject", "content_type"]


def hybrid_retrieve(requests: DataFrame, chunks: DataFrame, top_k: int = 3, digits: int = 8, depth: int | None = None) -> DataFrame:
    """request_id, chunk_id, content_type, dense_rank, sparse_rank, rrf, position, fallback_used: 2 * top_k candidates.

    requests also have vector and fallback_language; chunks have text and embedding (null counts as cosine 0), and each id
    once. BM25 takes its statistics from all chunks of a language; ranks are places among all chunks that pass the filter,
    ties going to chunk_id; ties of the fused score go to the dense rank. A request without any candidate is asked again in
    its fallback language: which these are is found first, from the distinct metadata of chunks. Only the first `depth` of
    either ranking are looked at; if what they leave out could still matter, a request goes on with deeper ones.
    """
    direct = answerable(requests, chunks).select("request_id").withColumn("_direct", F.lit(True))
    asked = requests.join(direct, "request_id", "left").withColumn("fallback_used", F.col("_direct").isNull())
    asked = asked.withColumn("medium", F.when(F.col("fallback_used"), F.col("fallback_language")).otherwise(F.col("medium"))).drop("_direct").filter("medium is not null and request_id is not null")
    spark, path = chunks.sparkSession, scratch(chunks.sparkSession, "hybrid")
    # Ids of any type become numbers in their order, so ties are those of the ids.
    numbered(asked, ["request_id"], "request").write.parquet(f"{path}/asked")
    cell = F.to_json(F.struct(*METADATA), {"ignoreNullFields": "false"})
    numbered(chunks.select("chunk_id", *METADATA, "embedding"), ["chunk_id"], "chunk").withColumn("cell", cell).write.parquet(f"{path}/chunks")
    asked, known = spark.read.parquet(f"{path}/asked"), spark.read.parquet(f"{path}/chunks")
    tier = F.when(F.coalesce("content_type", F.lit("")).isin(L.PRIMARY_TYPES), 0).otherwise(1).cast("int")
    allowed = metadata_filter(asked.withColumn("request_id", F.col("request")), known.select("cell", *METADATA).distinct()).select(F.col("request_id").alias("request"), "cell", tier.alias("tier"))
    allowed.write.parquet(f"{path}/allowed")
    texts = chunks.select("chunk_id", "text", "medium").join(known.select("chunk_id", "chunk"), "chunk_id")
    scores = bm25(asked.select("request", "medium", "question"), texts.select("chunk", "text", "medium"), "request", "question", "chunk", "text", by="medium")
    lists = FusedLists(asked.select("request", "vector"), known.select("chunk", "cell", "embedding"), spark.read.parquet(f"{path}/allowed"), scores, digits)
    top, _ = fused_top(lists, 2 * top_k, depth)
    out = top.join(asked.select("request", "request_id", "fallback_used"), "request").join(known.select("chunk", "chunk_id", "content_type"), "chunk")
    return out.select("request_id", "chunk_id", "content_type", "dense_rank", "sparse_rank", "rrf", "position", "fallback_used")


__all__ = ["answerable", "hybrid_retrieve", "metadata_filter", "rrf", "term_rule"]
