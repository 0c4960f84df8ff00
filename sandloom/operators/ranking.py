"""Fusion and selection of rankings; every order is total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L


def rrf(rankings: list[DataFrame], by: str, key: str, k: int = L.RRF_K) -> DataFrame:
    """by, key, rrf: sum over rankings (by, key, rank from 1) of 1 / (k + rank)."""
    parts = [r.select(by, key, (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy(by, key).agg(F.sum("part").alias("rrf"))


def _pieces(rows: DataFrame, by: str, value: str, descending: bool, pieces: int) -> DataFrame:
    """Adds _by (the group) and _piece: pieces of a group that quantiles of value cut, in order; rows of one value are in one
    piece, rows without one in the first, or the last if descending."""
    cuts = rows.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(value, [k / pieces for k in range(1, pieces)], 10_000).alias("_cuts"))
    piece = F.size(F.filter("_cuts", lambda c: (c > F.col(value)) if descending else (c < F.col(value))))
    return rows.join(cuts, rows[by].eqNullSafe(cuts["_by"])).withColumn("_piece", F.when(F.col(value).isNull() | F.col("_cuts").isNull(), pieces if descending else 0).otherwise(piece)).drop("_cuts")


def running_total(rows: DataFrame, by: str, order: str, value: str, out: str, descending: bool = False, ties: str | None = None, pieces: int = 64) -> DataFrame:
    """Adds the sum of value over a group's rows up to each one, in order of `order`, then `ties`; null orders come first.

    A group may be most of the table, so it isn't summed in one task: quantiles of the order cut it into pieces, which are
    summed apart, and what comes before a piece follows from the pieces' own sums.
    """
    placed = _pieces(rows, by, order, descending, pieces)
    sizes = placed.groupBy("_by", "_piece").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_by").alias("_g"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    first = F.col(order).desc() if descending else F.col(order).asc()
    inner = Window.partitionBy("_by", "_piece").orderBy(first, *([F.col(ties)] if ties else [])).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inner", F.sum(value).over(inner)).join(before, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p")))
    return summed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_before") + F.col("_inner")).alias(out))


def full_rank(rows: DataFrame, by: str, value: str, ties: str, descending: bool = False, pieces: int = 64, out: str = "rank") -> DataFrame:
    """Adds each row's place, from 1, among all rows of its group by value, then ties."""
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running_total(one, by, value, "_one", out, descending, ties, pieces).drop("_one")


def tier_merge(ranked: DataFrame, by: str, order: list[Column], top_k: int, primary: list[str] | None = None, kind: str = "content_type") -> DataFrame:
    """The first 2 * top_k of each group, primary content types before all others; adds position."""
    tier = F.when(F.col(kind).isin(L.PRIMARY_TYPES if primary is None else primary), 0).otherwise(1)
    w = Window.partitionBy(by).orderBy(tier, *order)
    return ranked.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= 2 * top_k)


def strict_tier_merge(ranked: DataFrame, by: str, order: list[Column], top_k: int, tiers: list[str], kind: str = "content_type") -> DataFrame:
    """Tier after tier, each with at most top_k rows, a next tier only while fewer than top_k are taken; adds tier, position."""
    at = F.array_position(F.array(*map(F.lit, tiers)), F.col(kind)).cast("int")
    own = ranked.withColumn("tier", at).filter("tier > 0")
    own = own.withColumn("in_tier", F.row_number().over(Window.partitionBy(by, "tier").orderBy(*order))).filter(F.col("in_tier") <= top_k)
    before = F.count("*").over(Window.partitionBy(by).orderBy("tier").rangeBetween(Window.unboundedPreceding, -1))
    out = own.withColumn("before", before).filter(F.col("before") < top_k)
    return out.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("tier", "in_tier"))).drop("before", "in_tier")


def with_fallback(primary: DataFrame, fallback: DataFrame, by: str) -> DataFrame:
    """primary, and fallback's rows of those groups that have none there; adds fallback_used. One plan, no driver branch."""
    rest = fallback.join(primary.select(by).distinct(), by, "left_anti")
    return primary.withColumn("fallback_used", F.lit(False)).unionByName(rest.withColumn("fallback_used", F.lit(True)))


def interleave(ranked: DataFrame, by: str, bucket: Column, order: list[Column], k: int, buckets: list[str]) -> DataFrame:
    """The k best of each bucket, in turns: first of each bucket, second of each, and so on; adds bucket, position."""
    own = ranked.withColumn("bucket", bucket).filter(F.col("bucket").isin(buckets))
    own = own.withColumn("turn", F.row_number().over(Window.partitionBy(by, "bucket").orderBy(*order))).filter(F.col("turn") <= k)
    at = F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket"))
    return own.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("turn", at)))


def bucketed_retrieve(scored: DataFrame, by: str, k: int = 3, web_only: bool = False, relaxed: float = L.RELAXED_BY) -> DataFrame:
    """Rows of scored (by, language, bucket, score, key `doc_id`, seen) in the order shown, with bucket and position.

    A question in Tamil asks the Tamil and the web bucket, any other the book and the web bucket; with web_only, the web
    alone. Rows already seen and rows under their bucket's threshold go; k of each bucket stay. Where a Tamil question has
    fewer than k from the web, its web threshold is lowered by `relaxed`. Buckets take turns, the primary one first.
    """
    primary = F.when(F.col("language") == "ta", "tamil").otherwise("book")
    own = scored.filter(~F.coalesce("seen", F.lit(False))).filter((F.col("bucket") == "web") | (F.lit(not web_only) & (F.col("bucket") == primary)))
    least = F.when(F.col("bucket") == "web", L.THRESHOLDS["web"]).when(F.col("bucket") == "tamil", L.THRESHOLDS["tamil"]).otherwise(L.THRESHOLDS["book"])
    # The rows that a lower threshold lets in come after all others of their bucket, so lowering it only fills up.
    lowered = F.when((F.col("bucket") == "web") & (F.col("language") == "ta"), least - relaxed).otherwise(least)
    turn = F.row_number().over(Window.partitionBy(by, "bucket").orderBy(F.desc("score"), "doc_id"))
    kept = own.filter(F.col("score") >= F.round(lowered, 6)).withColumn("turn", turn).filter(F.col("turn") <= k)
    first = F.when(F.col("bucket") == "web", 1).otherwise(0)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("turn", first))).drop("turn")


def two_stage(candidates: DataFrame, by: str, first: str, second: str, wide: int = 20, k: int = 5, key: str = "doc_id") -> DataFrame:
    """The `wide` best of each group by the first score, of these the k best by the second, ties to the smaller key; adds rank."""
    pool = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(first), key))).filter(F.col("_r") <= wide).drop("_r")
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(second), key))).filter(F.col("rank") <= k)


def rerank(candidates: DataFrame, by: str, score: Column | None, k: int, threshold: float = L.RERANK_THRESHOLD, original: str = "position", key: str = "doc_id") -> DataFrame:
    """By a scorer's column, those at the threshold or above, k at most; without a scorer the original order, uncut by it."""
    if score is None:
        w = Window.partitionBy(by).orderBy(original, key)
        return candidates.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), original, key)
    return candidates.withColumn("rerank_score", score).filter(F.col("rerank_score") >= threshold).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
