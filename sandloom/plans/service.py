"""What a service built on the engine calls: each takes and gives DataFrames, state being Parquet tables below a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, lookup, manifest, retrieval
from ..sources import io

FEEDBACK = "session_id string, query string, answer string, rating string, citation_errors boolean, timestamp timestamp"
CORRECTIONS = "id long, issue string, status string, correction string, created_at timestamp, approved_at timestamp"


class Service:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def chunks(self) -> DataFrame:
        """Read anew each time, so a newly saved index is seen."""
        return self.spark.read.parquet(f"{self.root}/chunks")

    def ingest(self, chunks: DataFrame) -> DataFrame:
        """Save the chunks that pass the rules, with a hash that never collides as their id; returns those that don't, with the reason."""
        keyed = chunks.withColumn("chunk_id", F.sha2(F.concat_ws("\u001f", "file_path", F.col("page").cast("string"), F.col("seq").cast("string")), 256))
        judged = keyed.withColumn("reason", T.chunk_problem("text", F.col("class_level").isNull() | F.col("medium").isNull() | F.col("subject").isNull()))
        io.save_chunks(judged.filter("reason = 'ok'").drop("reason"), f"{self.root}/chunks")
        return judged.filter("reason <> 'ok'")

    def retrieve(self, requests: DataFrame, top_k: int = 3) -> DataFrame:
        """Corrected answers for requests that an approved correction answers, ranked chunks for the others."""
        fixes = self.corrections().filter("status = 'approved'").select(F.col("id").alias("correction_id"), "issue", "correction")
        hit = lookup.match_corrections(requests.select(F.col("request_id").alias("query_id"), "question"), fixes)
        fixed = hit.join(fixes, "correction_id").select(F.col("query_id").alias("request_id"), "correction")
        rest = requests.join(fixed, "request_id", "left_anti")
        ranked = retrieval.hybrid_retrieve(rest, self.chunks(), top_k)
        return ranked.withColumn("correction", F.lit(None).cast("string")).unionByName(fixed, allowMissingColumns=True)

    def record_feedback(self, rows: DataFrame) -> None:
        io.append(rows, f"{self.root}/feedback")

    def dashboard(self) -> DataFrame:
        return evaluation.feedback_stats(io.parquet_or_empty(self.spark, f"{self.root}/feedback", FEEDBACK))

    def corrections(self) -> DataFrame:
        """The last state of each report."""
        log = io.parquet_or_empty(self.spark, f"{self.root}/corrections", CORRECTIONS + ", at timestamp")
        return evaluation.latest(log, ["id"], ["at"]).drop("at")

    def report(self, rows: DataFrame) -> None:
        """rows: id, issue."""
        now = F.current_timestamp()
        io.append(rows.select("id", "issue", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("correction"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("approved_at"), now.alias("at")), f"{self.root}/corrections")

    def review(self, rows: DataFrame) -> None:
        """rows: id, status, correction."""
        new = self.corrections().drop("status", "correction", "approved_at").join(rows.select("id", "status", "correction"), "id")
        at = F.current_timestamp()
        io.append(new.select("id", "issue", "status", "correction", "created_at", F.when(F.col("status") == "approved", at).alias("approved_at"), at.alias("at")), f"{self.root}/corrections")

    def scan(self, books_root: str, known: DataFrame, pattern: str = "*.pdf") -> DataFrame:
        """Books below a folder with their status against a manifest (file_path, file_hash); unusable paths are 'invalid'."""
        found = io.books(self.spark, books_root, pattern).drop("content")
        status = manifest.detect_changes(found.select("file_path", "file_hash"), known)
        joined = found.join(status.select("file_path", "status"), "file_path")
        return joined.withColumn("status", F.when(F.col("problem").isNotNull(), "invalid").otherwise(F.col("status")))
