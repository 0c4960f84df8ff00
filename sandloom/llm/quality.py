"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins; each feature has a table with a value for each bin, and the best pairs of
features have a table for each pair of bins. Boosting goes round the features in a cycle: each gets a shallow tree on its
own bins, fitted to what is left, and its table takes a small step; the pairs follow in the same manner. A score is the
logistic of a sum of table look-ups.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, parts, spill, table

FEATURES = ["log_words", "word_length", "upper", "digits", "marks", "shouts", "bars", "symbols", "foreign", "distinct_words", "repeats", "same_lines", "line_length", "variety"]
_SYMBOLS = list(b"#$%&*+/<=>@\\^_`{}~")
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    k = len(words)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    different = set(words)
    return [
        float(np.log1p(k)),
        n / max(1, k),
        upper / max(1, upper + lower),
        int(c[48:58].sum()) / n,
        int(c[_MARKS].sum()) / n,
        int(c[33]) / n,
        int(c[124]) / n,
        int(c[_SYMBOLS].sum()) / n,
        int(c[128:].sum()) / n,
        len(different) / max(1, k) * (1 + k / 2000) ** 0.25,
        sum(map(eq, words, words[1:])) / max(1, k - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        len(different) / max(1, k),
    ]


def _feature_rows(batches):
    import pyarrow as pa

    for b, texts_ in parts(batches):
        x = np.array([features(t) for t in texts_], dtype=np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1])), *b.columns[2:]], ["doc_id", *FEATURES, *b.schema.names[2:]])


def _tree(gain: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton values of a tree of at most `leaves` leaves over ordered bins, splits chosen best first."""
    parts = [(0, len(gain))]
    value = lambda a, b: gain[a:b].sum() / (weight[a:b].sum() + ridge)
    worth = lambda a, b: gain[a:b].sum() ** 2 / (weight[a:b].sum() + ridge)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            a, b = p
            if b - a > 1:
                g, w = np.cumsum(gain[a:b])[:-1], np.cumsum(weight[a:b])[:-1]
                G, W = gain[a:b].sum(), weight[a:b].sum()
                s = g**2 / (w + ridge) + (G - g) ** 2 / (W - w + ridge) - worth(a, b)
                k = int(s.argmax())
                best = max(best, (float(s[k]), p, a + k + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gain))
    for a, b in parts:
        out[a:b] = value(a, b)
    return out


class AdditiveModel:
    """fit() on features and labels 0/1; score() gives probabilities of 1."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rounds: int = 120, rate: float = 0.1, leaves: int = 3, ridge: float = 3.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.rate, self.leaves, self.ridge = bins, pair_bins, pairs, rounds, rate, leaves, ridge
        self.edges, self.coarse, self.tables, self.pairs, self.start = [], [], [], {}, 0.0

    @staticmethod
    def _cuts(x: np.ndarray, k: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.arange(1, k) / k)) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, k = len(y), x.shape[1]
        share = (y.sum() + 0.5) / (n + 1)
        self.start = float(np.log(share / (1 - share)))
        self.edges = [self._cuts(x[:, j], self.bins) for j in range(k)]
        self.coarse = [self._cuts(x[:, j], self.pair_bins) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs = {}
        if n < 2 or y.min() == y.max():
            return self
        at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(n, self.start)
        for _ in range(self.rounds):
            for j in range(k):
                p = 1 / (1 + np.exp(-total))
                m = len(self.tables[j])
                step = self.rate * _tree(np.bincount(at[j], y - p, m), np.bincount(at[j], p * (1 - p), m), self.leaves, self.ridge)
                self.tables[j] += step
                total += step[at[j]]
        rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-total))
        worth = {}
        for a in range(k):
            for b in range(a + 1, k):
                cell, m = rough[a] * (len(self.coarse[b]) + 1) + rough[b], (len(self.coarse[a]) + 1) * (len(self.coarse[b]) + 1)
                worth[a, b] = float((np.bincount(cell, y - p, m) ** 2 / (np.bincount(cell, p * (1 - p), m) + self.ridge)).sum())
        best = sorted(worth, key=lambda q: -worth[q])[: self.n_pairs]
        self.pairs = {q: np.zeros((len(self.coarse[q[0]]) + 1, len(self.coarse[q[1]]) + 1)) for q in best}
        for _ in range(self.rounds // 4):
            for (a, b), t in self.pairs.items():
                p = 1 / (1 + np.exp(-total))
                cell = rough[a] * t.shape[1] + rough[b]
                g, w = np.bincount(cell, y - p, t.size).reshape(t.shape), np.bincount(cell, p * (1 - p), t.size).reshape(t.shape)
                # a shallow tree: the first feature is split in two where the best splits of both halves by the second gain most
                steps = []
                for cut in range(1, max(2, t.shape[0])):
                    step, gain = np.zeros(t.shape), 0.0
                    for rows in (slice(0, cut), slice(cut, None)):
                        if g[rows].size:
                            step[rows] = _tree(g[rows].sum(0), w[rows].sum(0), 2, self.ridge)
                            gain += float((step[rows][0] * g[rows].sum(0)).sum())
                    steps.append((gain, cut, step))
                step = max(steps, key=lambda x: x[:2])[2]
                t += self.rate * step
                total += self.rate * step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in self.pairs.items():
            total += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, threshold: float = 0.3, carry: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Fitted on at most train_rows labelled rows (the ones with the smallest hash of doc_id) whose crc32(doc_id) mod 5 is not
    0; null labels are left out, repeated ones count once, and of labels that disagree 0 counts. Null and empty texts have features of 0 and a score like any other; without usable
    labels, every score is the share of ones, 0.5 if there are none. Repeated rows get equal scores. An empty table gives an
    empty result; other columns are not looked at. `carry` names a column of longs that is handed on with each row.
    """
    spark = docs.sparkSession
    more = [carry] if carry else []
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    kind = ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES), *(f"{c} long" for c in more)])
    rows = spill(source.mapInArrow(_feature_rows, kind), "quality-features")
    usable = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").filter(crc_mod("l_id") != 0).groupBy("l_id").agg(F.min("label").alias("label"))
    known = rows.join(usable, rows.doc_id == usable.l_id).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(train_rows).toArrow()
    x = np.stack([known[f].to_numpy() for f in FEATURES], axis=1) if known.num_rows else np.zeros((0, len(FEATURES)))
    model = spark.sparkContext.broadcast(AdditiveModel().fit(x, known["label"].to_numpy().astype(float)))

    def score(batches):
        import pyarrow as pa

        for b in batches:
            s = model.value.score(np.stack([b.column(k + 1).to_numpy() for k in range(len(FEATURES))], axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *b.columns[1 + len(FEATURES) :]], ["doc_id", "score", *more])

    scored = rows.mapInArrow(score, ", ".join(["doc_id long", "score double", *(f"{c} long" for c in more)]))
    return scored.select("doc_id", (crc_mod() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def query(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
