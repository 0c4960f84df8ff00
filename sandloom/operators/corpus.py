"""Statistics and splits of language-model corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def script_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """language, n_tokens, pct: distinct words with a character of the language's range; ranges may share characters."""
    words = rows.select(F.explode(T.words(text)).alias("w")).distinct()
    total = words.agg(F.count("*").alias("total"))
    parts = [words.agg(F.count_if(F.col("w").rlike(f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]")).alias("n_tokens")).select(F.lit(name).alias("language"), "n_tokens") for name, (lo, hi) in L.SCRIPTS.items()]
    return reduce(DataFrame.unionByName, parts).crossJoin(total).select("language", "n_tokens", F.when(F.col("total") > 0, F.round(100.0 * F.col("n_tokens") / F.col("total"), 4)).otherwise(0.0).alias("pct"))


def new_pieces(base: DataFrame, other: DataFrame, piece: str = "piece") -> DataFrame:
    """base, and other's pieces that it lacks."""
    return base.select(piece).distinct().union(other.select(piece).distinct().join(base.select(piece), piece, "left_anti"))


def hash_split(key: str, share: float = 0.8, seed: int = 42) -> Column:
    """'train' or 'test' by a hash of the key: the same row always goes to the same side."""
    return F.when(F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.lit(1000)) < int(share * 1000), "train").otherwise("test")


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def spot_check(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in an order that a hash of key and seed gives."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
