"""The corpus pipeline: documents to packed sequences in five stages.

Every stage works on all rows that the one before kept. All but the last return the columns of documents.
Stages judge rows, not ids: a row is dropped for its own text, whatever other rows have the same doc_id or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandloom.llm._common import ROW, all_but_first, by_row, drop_rows, keyed, spill, table
from sandloom.llm.decontamination import decontaminate
from sandloom.llm.exact_dedup import exact_dedup
from sandloom.llm.jaccard import jaccard_components
from sandloom.llm.packing import pack_documents
from sandloom.llm.quality import quality_scores


def small_batches(spark, rows: int = 1000) -> None:
    """From now on whole texts go to Python at most `rows` at a time: a batch lies outside the JVM's heap and in the worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject (score >= 0.3). Labels are found by doc_id."""
    small_batches(spark)
    rows = keyed(docs)
    return drop_rows(rows, quality_scores(rows, table(spark, sf_dir, "labels"), carry=ROW).filter("predicted = 0"))


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the one with the smallest doc_id.

    A null doc_id counts as the largest; of rows with the same doc_id one stays.
    """
    small_batches(spark)
    rows = keyed(docs)
    same = exact_dedup(by_row(rows), batches=1).filter("group_size > 1").select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group_id"))
    return drop_rows(rows, all_but_first(rows, same))


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that 0.8-similar sets of five-word shingles hold together: the smallest doc_id.

    A null doc_id counts as the largest; rows with the same or no doc_id are held together by their texts alone.
    """
    small_batches(spark)
    rows = keyed(docs)
    return drop_rows(rows, all_but_first(rows, jaccard_components(by_row(rows)).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group_id"))))


def decontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark passage."""
    small_batches(spark)
    rows = keyed(docs)
    return drop_rows(rows, decontaminate(by_row(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(ROW)))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("decontamination", decontaminated), ("best_fit_packing", packed)]

#: Classifier, tokenizer and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), name)
    return docs
