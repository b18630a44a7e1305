"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: words, and runs of one to three word shapes (letter case, digits,
punctuation; a word that repeats its predecessor has a shape of its own). Each indicator is scaled by its
class log-count ratio, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become
probabilities through a sigmoid fitted on a fifth of the sample that the descent does not see.

The fit reads at most ``max_rows`` labelled rows (documented bound); scoring is one pass without a shuffle.
Defined results: null and empty texts have no features and get the score of the offset alone; without
examples of both classes every score is the smoothed share of the class; labels, ids and other columns
are never inputs of a score; a text is read whole however long it is; repeated rows are scored alike and count as one example; empty tables
are scored as empty tables; a column of the output's name is replaced and all other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import arrow_map, texts

REPEAT = np.uint64(0x5851F42D4C957F2D)
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shape(word: str) -> str:
    """Upper case A, lower case a, other letters x, digits 9, each run once; punctuation stays, runs up to three."""
    out: list[str] = []
    for ch in word:
        if ch.isalpha():
            c = "A" if ch.isupper() else "a" if ch.islower() else "x"
        elif ch.isdigit():
            c = "9"
        else:
            c = ch
        if not out or out[-1] != c or (not c.isalnum() and out[-3:] != [c] * 3):
            out.append(c)
    return "".join(out)


def word_code(word: str) -> int:
    return xxhash.xxh3_64_intdigest("w" + word.strip(".,;:!?\"'()[]").lower())


def shape_code(word: str) -> int:
    return xxhash.xxh3_64_intdigest("s" + shape(word))


class Grams:
    """Word and shape n-grams of a text as codes."""

    def __init__(self):
        self.shapes, self.words = linear.Cache(shape_code), linear.Cache(word_code)

    def shape_grams(self, words: list[str]) -> list[np.ndarray]:
        s = np.fromiter(map(self.shapes.__getitem__, words), np.uint64, len(words))
        w = np.array(words, object)
        s[1:][w[1:] == w[:-1]] = REPEAT
        return [s, s[:-1] * P1 + s[1:] * P2 ^ (s[:-1] >> np.uint64(31)), s[:-2] * P1 + s[1:-1] * P2 + s[2:] * P3 ^ (s[1:-1] >> np.uint64(29))]

    def codes(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        return np.unique(np.concatenate([w, *self.shape_grams(words)]))


@dataclass
class Model:
    codes: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def scorer(self) -> Callable[[str], float]:
        grams, n = Grams(), len(self.codes)
        at = linear.Cache(lambda w: int(linear.index(self.codes, np.array([word_code(w)], np.uint64))[0]))
        weights = np.append(self.weights, 0.0)

        def f(text: str) -> float:
            words, margin = text.split(), self.offset
            if words and n:
                hit = np.zeros(n + 1, bool)
                hit[np.fromiter(map(at.__getitem__, words), np.int64, len(words))] = True
                for g in grams.shape_grams(words):
                    hit[linear.index(self.codes, g)] = True
                margin += float(weights[hit].sum())
            return float(linear.sigmoid(np.float64(self.slope * margin + self.shift)))

        return f


def dual_descent(rows: linear.Rows, scale: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Hinge-loss weights (of scaled indicators) and offset by dual coordinate descent; y is -1 or 1."""
    n, w, b = rows.n, np.zeros(rows.width), 0.0
    ends = np.concatenate([[0], np.cumsum(rows.lens)])
    cols = [rows.cols[ends[i] : ends[i + 1]] for i in range(n)]
    vals = [scale[x] for x in cols]
    square = np.array([float(v @ v) + 1.0 for v in vals])
    alpha, rng = np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n).tolist():
            x, v = cols[i], vals[i]
            g = y[i] * (float(w[x] @ v) + b) - 1.0
            a = alpha[i]
            new = min(max(a - g / square[i], 0.0), c)
            if new != a:
                worst = max(worst, abs(new - a) * square[i] ** 0.5)
                step = (new - a) * y[i]
                w[x] += step * v
                b += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = linear.MAX_ROWS, max_features: int = linear.MAX_FEATURES) -> Model:
    sample = linear.labelled_sample(docs, labels, label, key, text, max_rows)
    by = {r["y"] > 0: r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = by.get(True, 0), by.get(False, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0, float(np.log((n1 + 1) / (n0 + 1))))
    grams = Grams()
    codes, p, q = linear.choose(linear.count_features(sample, lambda t: grams.codes(t)), n1, n0, max_features)
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))

    def rows(batches):
        for b in batches:
            found = [linear.index(codes, grams.codes(t)) for t in texts(b.column(1))]
            made = pa.array([x[x < len(codes)].tolist() for x in found], pa.list_(pa.int32()))
            calibrate = pa.array([xxhash.xxh3_64_intdigest(t or "") % 5 == 0 for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), made, calibrate], names=["y", "cols", "calibrate"])

    got = arrow_map(sample, rows, "y int, cols array<int>, calibrate boolean").toPandas()
    got = got.sort_values(["y", "cols"], key=lambda c: c if c.name == "y" else c.map(lambda x: (len(x), *x[:8])), kind="stable")
    y = np.where(got["y"].to_numpy() > 0, 1.0, -1.0)
    late = got["calibrate"].to_numpy(bool)
    for part in (late, ~late):
        if len({*y[part].tolist()}) < 2:
            late = np.zeros(len(y), bool)  # too few rows to set some apart
    lists = [np.asarray(x, np.int64) for x in got["cols"]]
    early = [x for x, z in zip(lists, late, strict=True) if not z]
    w, b = dual_descent(linear.Rows(early, len(codes)), ratio, y[~late])
    margin = linear.Rows(lists, len(codes)).dot(w * ratio) + b
    pick = late if late.any() else ~late
    slope, shift = linear.platt(margin[pick], y[pick])
    return Model(codes, w * ratio, b, slope, shift)


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return linear.score(docs, lambda: shared.value.scorer(), text, output, keep)
