"""Models from outside as protocols, with stand-ins that always give the same."""

from __future__ import annotations

import hashlib
import time
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Token hashes with signs, summed and normalised: the same text always has the same vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class OverlapScorer:
    """Share of the query's words that the text has."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set(q.lower().split()), set(t.lower().split())
            out.append(len(a & b) / len(a) if a else 0.0)
        return out


def embed(rows: DataFrame, text: str, model: Embedder, prefix: str = "", out: str = "embedding") -> DataFrame:
    """Adds the model's vector; prefix is 'query: ' or 'passage: ' for models that want it."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(model.encode([prefix + (x or "") for x in s]).astype(np.float32)))

    return rows.withColumn(out, run(text))


def with_retry(call, tries: int = 3, wait: float = 1.0, double: bool = True, sleep=time.sleep):
    """call(), again after wait, 2 * wait, 4 * wait, ... seconds (or always wait) when it fails; the last failure is raised.

    For calls out of a task to a service: Spark's own retries would repeat the whole task.
    """

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:  # whatever a service's client raises
                if n == tries - 1:
                    raise
                sleep(wait * (2**n if double else 1))

    return run


def score_with(model: Scorer, query, text, default: float = -1.0) -> Column:
    """The model's scores, a batch a call; if a batch fails its rows are scored one by one, with the default where one fails."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        qs, ts = q.fillna("").tolist(), t.fillna("").tolist()
        try:
            return pd.Series([float(x) for x in model.score(qs, ts)], dtype="float64")
        except Exception:  # a model from outside may fail in any way: find the rows that make it fail
            pass

        def one(a, b):
            try:
                return float(model.score([a], [b])[0])
            except Exception:  # the caller asked for the default then
                return default

        return pd.Series([one(a, b) for a, b in zip(qs, ts, strict=True)], dtype="float64")

    return run(query, text)


class Judge(Protocol):
    def judge(self, question: str, answer: str, context: str) -> str: ...


def judge_with(model: Judge, question, answer, context) -> Column:
    """struct(faithfulness, citation_accuracy, hallucination_rate) of what the model says; 0, 0, 1 where it fails or says no JSON."""
    from .evaluation import judge_json

    @F.pandas_udf("string")
    def run(q: pd.Series, a: pd.Series, c: pd.Series) -> pd.Series:
        def one(*x):
            try:
                return model.judge(*x)
            except Exception:  # a failing judge counts as one that says nothing
                return ""

        return pd.Series([one(*x) for x in zip(q.fillna(""), a.fillna(""), c.fillna(""), strict=True)], dtype="object")

    return judge_json(run(question, answer, context))


def reranking_text(chapter, section, text) -> Column:
    head = F.concat_ws(" | ", F.concat(F.lit("Chapter: "), chapter), F.concat(F.lit("Section: "), section))
    return F.when(head != "", F.concat(head, F.lit("\n"), text)).otherwise(text)
