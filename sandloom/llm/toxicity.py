"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words is the inner product of their subsequences of four characters that span at most six, the word's
beginning and end counting as a character each; one that skips g characters counts LAMBDA**g. So "id-iot" and "idxiot" stay near "idiot". Kernels are normalised, and values below
FLOOR count as 0. A row of single characters ("i d i o t") is taken as one word. A sentence meets a landmark by the best of
its words; the vector of these values, whitened by the landmarks' own kernel matrix (Nyström), goes to a linear machine
with squared hinge loss. Sentences of toxic documents are labelled by the document at first and relabelled in rounds: the
sentence that scores highest stands for its document. A document's score is the logistic of its highest sentence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, parts, table, texts

LAMBDA, FLOOR = 0.6, 0.42
SPAN, KEY_BITS = 6, 32  # a subsequence is four bytes, so keys don't collide
#: Offsets of the second, third and fourth character.
_SHAPES = tuple((i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j))
_SPELLED = re.compile(rb"(?<!\S)(?:\S[\x20\x09-\x0D]){2,}\S(?!\S)")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_STOPS = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n")


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence, lower-cased and without marks, also inside; spelled-out words joined."""
    out = []
    text = text.lower()
    for m in _SPELLED.findall(text):
        out.append([b"".join(m.translate(None, _MARKS).split()) or b"-"])
    return out + [w for s in _STOPS.split(text) if (w := s.translate(None, _MARKS).split())]


def occurrences(words: list[bytes]):
    """(word, hashed subsequence, weight) of every occurrence in many words at once, shape by shape."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    blob = np.frombuffer(b"\3\2".join([b"", *words, b""])[1:] + b"\0" * 8, np.uint8)[: -8 - 1]
    blob = np.concatenate([blob, np.zeros(8, np.uint8)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))
    for i, j, k in _SHAPES:
        at = np.flatnonzero(left > k)
        key = (blob[at] << np.uint64(24)) | (blob[at + i] << np.uint64(16)) | (blob[at + j] << np.uint64(8)) | blob[at + k]
        yield owner[at], key.astype(np.int64), LAMBDA ** (k - 3)


def feature_map(words: list[bytes]):
    """(word, subsequence, value) with the values of each word normalised, and the words' norms."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    rows = [((o << KEY_BITS) | k, np.full(len(o), w)) for o, k, w in occurrences(words)]
    both, weight = np.concatenate([r for r, _ in rows]), np.concatenate([w for _, w in rows])
    cell, back = np.unique(both, return_inverse=True)
    value = np.bincount(back, weight, len(cell))
    owner = cell >> KEY_BITS
    norm = np.sqrt(np.bincount(owner, value**2, len(words)))
    return owner, cell & ((1 << KEY_BITS) - 1), value / norm[owner], norm


class Landmarks:
    """Normalised kernels of words with fixed landmark words."""

    def __init__(self, words: list[bytes]):
        self.words = words
        owner, key, value, _ = feature_map(words)
        self.keys, back = np.unique(key, return_inverse=True)
        self.may = np.zeros(1 << 16, dtype=bool)
        self.may[self._short(self.keys)] = True
        self.matrix = np.zeros((len(self.keys) + 1, len(words)), dtype=np.float32)
        self.matrix[back + 1, owner] = value

    @staticmethod
    def _short(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 13) & 0xFFFF

    def place(self, key: np.ndarray) -> np.ndarray:
        """The row of each subsequence in the matrix, 0 for those that no landmark has."""
        out = np.zeros(len(key), dtype=np.int64)
        some = np.flatnonzero(self.may[self._short(key)])
        at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == key[some], at + 1, 0)
        return out

    def kernels(self, words: list[bytes]):
        """Which words come near a landmark, and their kernels with all landmarks."""
        n = len(words)
        total, who, where, weight = np.zeros(n), [], [], []
        for owner, key, w in occurrences(words):
            p = self.place(key)
            total += np.bincount(owner, minlength=n) * w * w
            who.append(owner[p > 0])
            where.append(p[p > 0])
            weight.append(np.full(len(who[-1]), w))
        # By Cauchy and Schwarz a kernel is at most the norm of the word's part within the landmarks' subsequences over the
        # word's norm, whose square is no less than the sum of the squared weights of all occurrences.
        cell, back = np.unique(np.concatenate(who) * len(self.matrix) + np.concatenate(where), return_inverse=True)
        inside = np.bincount(cell // len(self.matrix), np.bincount(back, np.concatenate(weight), len(cell)) ** 2, n)
        near = np.flatnonzero((inside >= FLOOR**2 * total * (1 - 1e-9)) & (total > 0))
        if not len(near):
            return near, np.zeros((0, len(self.words)), np.float32)
        owner, key, value, _ = feature_map([words[i] for i in near])
        k = np.zeros((len(near), len(self.words)), np.float32)
        p = self.place(key)
        live = np.flatnonzero(p)
        for at in range(0, len(live), 200_000):
            part = live[at : at + 200_000]
            begin = np.flatnonzero(np.concatenate([[True], owner[part][1:] != owner[part][:-1]]))
            k[owner[part][begin]] += np.add.reduceat(self.matrix[p[part]] * value[part, None].astype(np.float32), begin, axis=0)
        k[k < FLOOR] = 0
        some = k.any(axis=1)
        return near[some], k[some]


class Scorer:
    """Landmarks and machine; keeps the kernel rows of words that it has seen, up to `most` words."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float, scale: tuple[float, float], most: int = 400_000):
        self.landmarks, self.weights, self.bias, self.scale, self.most = Landmarks(landmarks) if landmarks else None, weights, bias, scale, most
        self.rows: dict[bytes, np.ndarray | None] = {}

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.most:
            self.rows, new = {}, list(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            near, k = self.landmarks.kernels(part)
            self.rows.update(dict.fromkeys(part))
            for j, row in zip(near.tolist(), k, strict=True):
                self.rows[part[j]] = row

    def vectors(self, texts_: list[bytes]) -> list[np.ndarray]:
        """For each text, a row for each of its sentences that comes near a landmark."""
        split = [sentences(t) for t in texts_]
        if self.landmarks is None:
            return [np.zeros((0, 0), np.float32) for _ in texts_]
        self.learn({w for s in split for x in s for w in x})
        get, out = self.rows.__getitem__, []
        for s in split:
            rows = [np.max(r, axis=0) for x in s if (r := [y for y in map(get, x) if y is not None])]
            out.append(np.array(rows, np.float32).reshape(-1, len(self.landmarks.words)))
        return out

    def decision(self, vectors: np.ndarray) -> float:
        return max(self.bias, float((vectors @ self.weights).max() + self.bias)) if len(vectors) else self.bias

    def score(self, texts_: list[bytes]) -> list[float]:
        a, b = self.scale
        return [float(1 / (1 + np.exp(-np.clip(a * self.decision(v) + b, -40, 40)))) for v in self.vectors(texts_)]


def squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine by Newton steps: |w|^2 / 2 + cost * sum weight * max(0, 1 - y (z w + b))^2."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xs, ys, ws = x[on], y[on], weight[on]
        new = np.linalg.solve(ridge + 2 * cost * (xs * ws[:, None]).T @ xs, 2 * cost * xs.T @ (ws * ys))
        if np.abs(new - w).max() < 1e-8:
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a x + b))), lightly shrunk."""
    m = np.stack([x, np.ones(len(x))], axis=1)
    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -30, 30)))
        g = m.T @ (weight * (y - p)) - 1e-2 * c
        h = (m * (weight * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        c += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(c[0], 0.0)), float(c[1])


def choose_landmarks(texts_: list[bytes], toxic: np.ndarray, most: int = 64, hard: int = 24) -> list[bytes]:
    """Words that mark toxic documents, no two too near each other, and those clean words that come nearest to them."""
    count = [Counter(), Counter()]
    for t, y in zip(texts_, toxic, strict=True):
        count[int(y)].update({w for s in sentences(t) for w in s if len(w) >= 3})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))

    def z(w: bytes) -> float:
        p1, p0 = (count[1][w] + 0.5) / (n1 + 1), (count[0][w] + 0.5) / (n0 + 1)
        p = (count[1][w] + count[0][w] + 1) / (n1 + n0 + 2)
        return (p1 - p0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5

    ranked = sorted((w for w, c in count[1].items() if c >= 3 and z(w) > 3), key=lambda w: (-z(w), w))[:2000]
    owner, key, value, _ = feature_map(ranked)
    bounds = np.searchsorted(owner, np.arange(len(ranked) + 1))
    keys, key = np.unique(key, return_inverse=True)
    held = np.zeros((most, len(keys)), np.float32)
    chosen: list[bytes] = []
    for w, a, b in zip(ranked, bounds[:-1], bounds[1:], strict=True):
        if b > a and (held[: len(chosen), key[a:b]] @ value[a:b] < 0.7).all():
            held[len(chosen), key[a:b]] = value[a:b]
            chosen.append(w)
        if len(chosen) == most:
            break
    if not chosen:
        return []
    clean = [w for w, c in count[0].most_common(40_000) if c >= 2 and z(w) < 1]
    near, k = Landmarks(chosen).kernels(clean)
    order = np.argsort(-k.max(axis=1), kind="stable")[:hard] if len(near) else []
    return chosen + [clean[near[i]] for i in order]


def train(texts_: list[bytes], toxic: np.ndarray, weight: np.ndarray, rounds: int = 4) -> Scorer:
    """From labelled documents; weight: how many documents each stands for."""
    share = (weight * toxic).sum() / max(1e-9, weight.sum()) if len(toxic) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    marks = choose_landmarks(texts_, toxic)
    if not marks or toxic.min() == toxic.max():
        return Scorer([], np.zeros(0), 0.0, (0.0, prior))
    blank = Scorer(marks, np.zeros(len(marks)), 0.0, (1.0, 0.0))
    vectors = blank.vectors(texts_)
    own = np.array([blank.landmarks.kernels([m])[1][0] for m in marks], dtype=float)
    values, axes = np.linalg.eigh((own + own.T) / 2)
    live = values > 1e-3
    white = axes[:, live] / np.sqrt(values[live])
    z = [v.astype(float) @ white for v in vectors]
    pick = [int(v.max(axis=1).argmax()) if len(v) else None for v in vectors]
    for _ in range(rounds):
        xs, ys, ws = [np.zeros((1, white.shape[1]))], [-1.0], [10.0]
        for zi, y, p, k in zip(z, toxic, pick, weight, strict=True):
            if y and p is not None:
                xs.append(zi[p : p + 1])
                ys.append(1.0)
                ws.append(1.0)
            elif not y and len(zi):
                xs.append(zi)
                ys += [-1.0] * len(zi)
                ws += [float(min(k, 5.0))] * len(zi)
        w, b = squared_hinge(np.concatenate(xs), np.array(ys), np.array(ws))
        pick = [int((zi @ w).argmax()) if len(zi) else None for zi in z]
    scorer = Scorer(marks, white @ w, b, (1.0, 0.0))
    d = np.array([scorer.decision(v) for v in vectors])
    scorer.scale = logistic(d, toxic.astype(float), weight)
    return scorer


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, train_bytes: int = 64 << 20, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Trained on at most train_rows toxic and train_rows other labelled documents (those with the smallest hash of doc_id)
    whose crc32(doc_id) mod 5 is not 0, and on no more than train_bytes of text of each kind (documents that would go beyond are
    passed over); null labels are left out, repeated ones count once, and of labels that disagree 1 counts. Null and empty texts have no sentences and the lowest
    score. Without usable labels of both kinds, every score is the share of ones. Repeated rows get equal scores. An empty
    table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("label")).filter("label in (0, 1)").filter(crc_mod("l_id") != 0).groupBy("l_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    some = usable.filter("label = 1").orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows).union(usable.filter("label = 0").orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows))
    source = texts(docs)
    # at most 2 * train_rows ids are broadcast
    mine = source.join(F.broadcast(some), source.doc_id == some.l_id)
    each = mine.groupBy("label", "l_id").agg(F.sum(F.octet_length("text")).alias("size")).select("label", "l_id", "size", F.xxhash64("l_id").alias("h")).collect()
    left, fit = {0: train_bytes, 1: train_bytes}, []
    for r in sorted(each, key=lambda r: (r.h, r.l_id)):
        if r.size <= left[r.label]:
            left[r.label] -= r.size
            fit.append(r.l_id)
    known = mine.filter(F.col("l_id").isin(fit)).select("text", "label").orderBy("label", F.xxhash64("text"), "text").toArrow()
    y = known["label"].to_numpy().astype(int)
    each = {k: sizes.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    scorer = train([t.encode() for t in known["text"].to_pylist()], y, np.array([each[k] for k in y.tolist()]))
    model = spark.sparkContext.broadcast((scorer.landmarks.words if scorer.landmarks else [], scorer.weights, scorer.bias, scorer.scale))

    def score(batches):
        import pyarrow as pa

        s = Scorer(*model.value)
        for b, t in parts(batches, rows=512):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.score(t), pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(score, "doc_id long, score double").select("doc_id", (crc_mod() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
