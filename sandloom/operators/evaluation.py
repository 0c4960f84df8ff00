"""Retrieval metrics, history of runs, agreement of raters, classifier metrics, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def retrieval_metrics(cases: DataFrame, ks: tuple[int, ...] = (1, 5, 10), precision_k: int = 5, dedupe: bool = False) -> DataFrame:
    """Adds recall_k, precision_k, mrr, ndcg_k to rows with arrays `retrieved` (in order) and `expected`.

    Retrieved zeros and nulls count as missing pages. A page that is retrieved twice gains twice, so ndcg may pass 1,
    unless dedupe is set. With a column n_expected, `expected` may hold only those that are among the retrieved: it then never
    grows with the table.
    """
    n = F.col("n_expected") if "n_expected" in cases.columns else F.size("expected")
    got = F.filter("retrieved", lambda p: p.isNotNull() & (p != 0))
    got = F.array_distinct(got) if dedupe else got
    first = lambda k: F.slice("_got", 1, k)
    hit = lambda p: F.array_contains("expected", p)
    gain = F.aggregate(F.transform(first(precision_k), lambda p, i: F.when(hit(p), 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(precision_k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    at = F.array_position(F.transform("_got", hit), F.lit(True))
    out = cases.withColumn("_got", got)
    for k in ks:
        out = out.withColumn(f"recall_{k}", F.arrays_overlap(first(k), "expected").cast("double"))
    out = out.withColumn(f"precision_{precision_k}", F.size(F.filter(first(precision_k), hit)) / F.lit(float(precision_k)))
    out = out.withColumn("mrr", F.when(at > 0, 1.0 / at).otherwise(0.0))
    return out.withColumn(f"ndcg_{precision_k}", F.when(n > 0, gain / ideal).otherwise(0.0)).drop("_got")


def run_deltas(history: DataFrame, metrics: list[str], order: str = "timestamp") -> DataFrame:
    """Each run's metrics with delta_<m> to the run before and status_<m>: Improved, Declined or Unchanged."""
    w = Window.orderBy(order)
    for m in metrics:
        d = F.col(m) - F.lag(m).over(w)
        status = F.when(d > 0, "Improved").when(d < 0, "Declined").when(d == 0, "Unchanged")
        history = history.withColumn(f"delta_{m}", d).withColumn(f"status_{m}", status)
    return history


def quadratic_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, kappa. Weights are squared distances of the labels' places among all labels that either rater used."""
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    labels = p.select(F.col("a").alias("label")).union(p.select("b")).distinct()
    placed = labels.withColumn("i", F.row_number().over(Window.orderBy("label")))
    cell = p.groupBy("a", "b").agg(F.count("*").alias("o"))
    side = lambda c: p.groupBy(c).agg(F.count("*").alias(f"n_{c}")).join(placed.select(F.col("label").alias(c), F.col("i").alias(f"i_{c}")), c)
    grid = side("a").crossJoin(side("b"))  # labels by labels, not rows by rows
    full = grid.join(cell, ["a", "b"], "left").withColumn("w", (F.col("i_a") - F.col("i_b")) * (F.col("i_a") - F.col("i_b")))
    total = p.agg(F.count("*").alias("n"))
    s = full.crossJoin(total).agg(F.max("n").alias("n"), F.sum(F.col("w") * F.coalesce("o", F.lit(0))).alias("seen"), F.sum(F.col("w") * F.col("n_a") * F.col("n_b") / F.col("n")).alias("chance"))
    return s.select("n", F.when(F.col("chance") > 0, 1 - F.col("seen") / F.col("chance")).otherwise(1.0).alias("kappa"))


def disagreements(pairs: DataFrame, a: str, b: str, least: int = 1) -> DataFrame:
    return pairs.withColumn("diff", F.abs(F.col(a) - F.col(b))).filter(F.col("diff") >= least)


def classifier_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, and precision, recall, f1 weighted by the classes' shares."""
    cell = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    real = cell.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = cell.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said"))
    c = real.join(said, "c", "left").withColumn("precision", F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)).withColumn("recall", F.col("tp") / F.col("support"))
    c = c.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    part = lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support")
    return c.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), part("precision").alias("precision"), part("recall").alias("recall"), part("f1").alias("f1"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """One row: total, correct, incorrect (whatever isn't 'correct'), citation_errors, pct_correct."""
    n, ok = F.count("*"), F.count_if(F.col("rating") == "correct")
    return feedback.agg(n.alias("total"), ok.alias("correct"), (n - ok).alias("incorrect"), F.count_if("citation_errors").alias("citation_errors"), F.when(n > 0, F.round(100.0 * ok / n, 1)).otherwise(0.0).alias("pct_correct"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    rest = [c for c in rows.columns if c not in by]
    s = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return s.select(*by, *[F.col(f"s.{c}").alias(c) for c in rest])


def grounding(score_average: Column, n: Column) -> Column:
    return F.when(n == 0, "none").when(score_average >= 0.7, "strong").otherwise("partial")


def judge_json(answer) -> Column:
    """struct(faithfulness, citation_accuracy, hallucination_rate) of a judge's answer: the first {...} in it; 0, 0, 1 by default."""
    raw = F.from_json(F.regexp_extract(T.col(answer), r"(?s)(\{.*\})", 1), "faithfulness double, citation_accuracy double, hallucination_rate double")
    return F.struct(F.coalesce(raw["faithfulness"], F.lit(0.0)).alias("faithfulness"), F.coalesce(raw["citation_accuracy"], F.lit(0.0)).alias("citation_accuracy"), F.coalesce(raw["hallucination_rate"], F.lit(1.0)).alias("hallucination_rate"))


def top_disagreements(pairs: DataFrame, a: str, b: str, key: str, n: int = 5, least: int = 1) -> DataFrame:
    """The n largest disagreements, ties to the smaller key: a report's head."""
    return disagreements(pairs, a, b, least).orderBy(F.desc("diff"), key).limit(n)


def run_averages(cases: DataFrame, metrics: list[str], run: str = "run_id") -> DataFrame:
    """run, n and the mean of each metric, 0 for a run whose cases have none; a run without cases isn't there."""
    return cases.groupBy(run).agg(F.count("*").alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"avg_{m}") for m in metrics])


def shifted_accuracy(rows: DataFrame, labels: str = "labels", predicted: str = "predicted") -> DataFrame:
    """One row: n, accuracy of next-token predictions: the prediction at a place is for the label at the next one."""
    pairs = F.arrays_zip(F.slice(F.col(labels), F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))).alias("t"), F.slice(F.col(predicted), F.lit(1), F.greatest(F.size(predicted) - 1, F.lit(0))).alias("p"))
    hit = rows.select(F.size(pairs).alias("n"), F.size(F.filter(pairs, lambda x: x["t"] == x["p"])).alias("hit"))
    return hit.agg(F.sum("n").alias("n"), F.when(F.sum("n") > 0, F.sum("hit") / F.sum("n")).otherwise(0.0).alias("accuracy"))


def answer_grades(chunks: DataFrame, by: str, order: str, grade: str, score: str) -> DataFrame:
    """by, grade (that of the first chunk that has one above 0, else 6), grounding by the mean score."""
    first = F.min_by(F.when(F.col(grade) != 0, F.col(grade)), F.when(F.col(grade).isNotNull() & (F.col(grade) != 0), F.col(order)))
    g = chunks.groupBy(by).agg(F.coalesce(first, F.lit(6)).alias("grade"), F.avg(score).alias("mean"), F.count("*").alias("n"))
    return g.select(by, "grade", grounding(F.col("mean"), F.col("n")).alias("grounding"))


def quiz_average(attempts: DataFrame, by: str, score: str) -> DataFrame:
    """by, n, average: what a dashboard shows of a student's quizzes, rounded to whole points.

    A mean of exactly half a point goes up, in whatever order the scores were added: what sums of doubles are off is rounded away first.
    """
    return attempts.groupBy(by).agg(F.count("*").alias("n"), F.round(F.round(F.avg(score), 9)).cast("long").alias("average"))
