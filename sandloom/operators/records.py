"""Small operators over chunks, figures, scans and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import term_rule


def strict_filter(chunks: DataFrame, medium: str, class_id: int, subject: str, term: int, content_type: str) -> DataFrame:
    """Chunks that are equal in all four columns, by the same rule for terms."""
    same = (F.col("medium") == medium) & (F.col("class_level") == class_id) & (F.lower("subject") == subject.lower()) & (F.col("content_type") == content_type)
    return chunks.filter(same & term_rule(F.lit(class_id), F.lit(term), F.col("term")))


def figures(images: DataFrame, least: float = 30.0) -> DataFrame:
    """Images (x0, y0, x1, y1) that are neither decoration (a side under `least`) nor of a QR code's shape and size."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    code = (w / h).between(0.95, 1.05) & w.between(40, 120)
    return images.filter((w >= least) & (h >= least) & ~code)


def table_chunks(tables: DataFrame) -> DataFrame:
    """chunk_id, text, page, role, chapter_no, chapter_title of tables (document_id, page, seq, content)."""
    head = F.format_string("[Table Reference (Page %d)]\n\n", F.col("page").cast("int"))
    return _reference_chunks(tables, "tbl", "table", F.concat(head, F.coalesce("content", F.lit(""))))


def figure_chunks(pictures: DataFrame) -> DataFrame:
    """The same of figures (document_id, page, seq, caption, ocr_text)."""
    text = F.format_string("[Figure Reference (Page %d) Caption: %s]\n[Diagram Text: %s]", F.col("page").cast("int"), F.coalesce("caption", F.lit("")), F.coalesce("ocr_text", F.lit("")))
    return _reference_chunks(pictures, "fig", "figure", text)


def _reference_chunks(rows: DataFrame, mark: str, role: str, text: Column) -> DataFrame:
    name = F.concat_ws("_", F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")), F.lit(mark), F.col("page").cast("string"), F.col("seq").cast("string"))
    return rows.select(name.alias("chunk_id"), text.alias("text"), "page", F.lit(role).alias("role"), F.lit("0").alias("chapter_no"), F.lit("Tables and Diagrams").alias("chapter_title"))


def file_inventory(files: DataFrame) -> DataFrame:
    """kind, name, n of files (file_path, content): extensions with their counts, all files, top folders, and what
    requirements files depend on (n is 1 for folders and dependencies, which are sets)."""
    name = F.element_at(F.split("file_path", "/"), -1)
    f = files.select("file_path", name.alias("name"), F.col("content").cast("string").alias("text"))
    ext = F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
    by_ext = f.groupBy(F.lit("extension").alias("kind"), ext.alias("name")).agg(F.count("*").alias("n"))
    total = f.agg(F.count("*").alias("n")).select(F.lit("files").alias("kind"), F.lit("").alias("name"), "n")
    modules = f.filter(F.contains("file_path", F.lit("/"))).select(F.lit("module").alias("kind"), F.substring_index("file_path", "/", 1).alias("name"), F.lit(1).cast("long").alias("n")).distinct()
    line = f.filter("name = 'requirements.txt'").select(F.explode(F.split("text", "\n")).alias("line")).filter((T.strip("line") != "") & ~F.col("line").startswith("#"))
    needs = line.select(F.lit("dependency").alias("kind"), T.strip(F.substring_index("line", "==", 1)).alias("name"), F.lit(1).cast("long").alias("n")).distinct()
    return by_ext.unionByName(total).unionByName(modules).unionByName(needs)


def distinct_values(rows: DataFrame, by: str, value: str, default: str) -> DataFrame:
    """by, values: the distinct values of a group in lower case, sorted, nulls as the default."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(F.lower(F.coalesce(F.col(value), F.lit(default))))).alias("values"))


def pair_rows(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """The n-th row of each group of left with the n-th of right; what one side has more is left out."""
    number = lambda d, side: d.select(by, F.col(order).alias(side), F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("n"))
    return number(left, "left_id").join(number(right, "right_id"), [by, "n"])


def mean_confidence(words: DataFrame, by: str, confidence: str = "confidence", percent: bool = True) -> DataFrame:
    """by, confidence: mean of those above 0, as a share; null if there is none."""
    c = F.when(F.col(confidence) > 0, F.col(confidence) / (100.0 if percent else 1.0))
    return words.groupBy(by).agg(F.avg(c).alias("confidence"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, median: the upper of two middle values, by rank rather than by a collected list."""
    w = Window.partitionBy(by)
    ranked = rows.select(by, F.col(value).alias("median"), F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    return ranked.filter(F.col("r") == F.expr("n div 2") + 1).select(by, "median")


def chunk_report(chunks: DataFrame, term: str) -> DataFrame:
    """One row: n_chunks, n_garbled, n_with_term, n_words."""
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_if(T.residual_corruption("text")).alias("n_garbled"),
        F.count_if(F.contains(F.lower("text"), F.lit(term.lower()))).alias("n_with_term"),
        F.coalesce(F.sum(T.word_count("text")), F.lit(0)).cast("long").alias("n_words"),
    )


def resolution_times(queue: DataFrame, created: str = "created_at", approved: str = "approved_at") -> DataFrame:
    """One row: n, mean, median and largest seconds from report to approval."""
    s = queue.filter(F.col(approved).isNotNull()).select(((F.unix_micros(approved) - F.unix_micros(created)) / 1e6).alias("s"))
    return s.agg(F.count("*").alias("n"), F.avg("s").alias("mean_s"), F.expr("percentile(s, 0.5)").alias("median_s"), F.max("s").alias("max_s"))


def citation(book, page, section) -> Column:
    """A source line such as [Book, p. 12, Section]; what is missing is left out, and so is page 0."""
    p = F.when(T.col(page) > 0, F.concat(F.lit("p. "), T.col(page).cast("string")))
    return F.concat(F.lit("["), F.concat_ws(", ", T.col(book), p, F.nullif(T.col(section), F.lit(""))), F.lit("]"))


def context_of(ranked: DataFrame, by: str, text: str, n: int = 5, rank: str = "rank") -> DataFrame:
    """by, context: the first n texts, blank lines between them."""
    best = F.slice(F.array_sort(F.collect_list(F.struct(rank, text))), 1, n)
    return ranked.filter(F.col(rank) <= n).groupBy(by).agg(F.array_join(F.transform(best, lambda x: x[text]), "\n\n").alias("context"))


def principal_components(vectors: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Adds `components`, the vector in the space of the k main axes of all."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("components", vector_to_array("_p")).drop("_v", "_p")
