"""What the two text classifiers share: a bounded labelled sample, counted features, sparse rows, scoring.

A featurizer has ``codes(text) -> uint64 array`` (distinct feature codes of a whole text) and
``scorer(codes, weights) -> f(text) -> float``, the sum of the weights of the text's features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from subsieve.runtime import cut

from .common import arrow_map, beside, fold, texts

#: Labelled rows that a fit reads at most, and features that a model holds at most.
MAX_ROWS, MAX_FEATURES = 20_000, 4096
FOLDS, HELD_OUT = 5, 0


class Cache(dict):
    """word -> value of ``f``, for a bounded number of words."""

    def __init__(self, f: Callable, most: int = 300_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.f(word)
        return out


def held_out(key: str = "doc_id"):
    return fold(key, FOLDS) == HELD_OUT


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled rows outside the held-out fold, picked by a hash of their ids.

    Null ids, null labels and ids without a document are no examples; an id with several labels counts as its
    largest, and one with several documents or rows as its least text. The pick is bounded by ``max_rows``, so it is
    broadcast; only picked texts are shuffled."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y is not null").filter(fold("k", FOLDS) != HELD_OUT)
    part = max_rows / max(known.count(), 1)
    if part < 0.8:
        known = known.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(1.2 * part * (1 << 30)))
    pick = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return cut(rows.join(F.broadcast(pick), "k").groupBy("k").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text"))


def count_features(sample: DataFrame, codes: Callable[[str], np.ndarray], flush: int = 1_000_000) -> DataFrame:
    """(code, positive, negative): in how many sample texts of each class a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out():
            all_ = list(seen[0].keys() | seen[1].keys())
            made = [pa.array(all_, pa.int64()), *(pa.array([seen[y][c] for c in all_], pa.int64()) for y in (1, 0))]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays(made, names=["code", "positive", "negative"])

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                seen[y > 0].update(codes(t).view(np.int64).tolist())
                if len(seen[0]) + len(seen[1]) > flush:
                    yield out()
        yield out()

    return arrow_map(sample, run, "code bigint, positive bigint, negative bigint").groupBy("code").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def choose(counts: DataFrame, n1: int, n0: int, max_features: int = MAX_FEATURES, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (sorted) of the features with the largest chi-square, and their counts in both classes."""
    p, q = F.col("positive"), F.col("negative")
    n = float(n1 + n0)
    chi = n * F.pow(p * float(n0) - q * float(n1), 2.0) / ((p + q) * (n - p - q + 1.0) * max(n1, 1) * max(n0, 1))
    best = counts.filter(p + q >= min(least, max(1, int(n) // 50))).orderBy(chi.desc(), "code").limit(max_features).toPandas()
    codes = best["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], best["positive"].to_numpy(np.float64)[order], best["negative"].to_numpy(np.float64)[order]


def index(codes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of ``found`` in the sorted ``codes``; len(codes) where absent."""
    if not len(codes):
        return np.zeros(len(found), np.int64)
    at = np.searchsorted(codes, found)
    at[at == len(codes)] = 0
    return np.where(codes[at] == found, at, len(codes))


class Rows:
    """Sparse rows of indicator features."""

    def __init__(self, lists: list, width: int):
        self.width, self.n = width, len(lists)
        self.lens = np.array([len(x) for x in lists], np.int64)
        self.cols = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.lens)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.cols], minlength=self.n)

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=g[self.row], minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of a sigmoid from margins to probabilities, by Newton steps with smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, np.log((n1 + 1) / (n0 + 1))
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = (h * margin**2).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-6
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum()
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        a = min(max(a, 1e-3), 50.0)
    return float(a), float(b)


def score(docs: DataFrame, scorer: Callable[[], Callable[[str], float]], text: str, output: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a score of each whole text. No shuffle."""
    source, keep, schema = beside(docs, text, keep, [StructField(output, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = scorer()
        for b in batches:
            made = pa.array([f(t) for t in texts(b.column(b.num_columns - 1))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], made], names=[*keep, output])

    return arrow_map(source, run, schema)
