"""Toxicity: a counterfactual-regularised logistic model.

Features are indicators of words, of word beginnings of four to six letters, and of beginnings that several
different words of a text share. In each labelled text that
names an identity group, the identity terms are swapped for those of another group of the same kind, and
the fit penalises the squared change of the score between the two texts. A group's name that merely keeps
company with toxic texts then gains no weight, and neutral mentions stay clean.

The fit reads at most ``max_rows`` labelled rows (documented bound); scoring is one pass without a shuffle.
Defined results: null and empty texts get the score of the offset alone; without examples of both classes
every score is the smoothed share of the class; labels, ids and other columns are never inputs of a score; a text is read whole however long it is; repeated rows are scored alike and count as one example; empty tables
are scored as empty tables; a column of the output's name is replaced and all other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import arrow_map, texts

#: Identity terms by kind (fixed values); a swap takes another term of the same kind.
IDENTITY = {
    "gender": "women men woman man girls boys trans transgender nonbinary frauen männer femmes hommes mujeres hombres".split(),
    "faith": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists catholic catholics atheist atheists sikh sikhs".split(),
    "origin": "black white asian african european american latino hispanic arab mexican chinese indian turkish polish immigrant immigrants refugee refugees foreigners".split(),
    "orientation": "gay lesbian straight bisexual homosexual heterosexual queer".split(),
    "condition": "deaf blind disabled autistic elderly young old".split(),
}
KIND = {t: terms for terms in IDENTITY.values() for t in terms}
WORDS = re.compile(r"[^\W\d_]+").findall
STRIP = " \t\r\n.,;:!?\"'()[]{}<>*#%&$|-_/\\~`+=^@"


STRIPPED = linear.Cache(lambda w: w.strip(STRIP).lower(), 120_000)


def swap(text: str, turn: int) -> str | None:
    """The lower-cased text with each identity term replaced by the term ``turn`` places on in its kind; None without terms."""
    hit = False

    def other(m: re.Match) -> str:
        nonlocal hit
        terms = KIND.get(m[0])
        if not terms:
            return m[0]
        hit = True
        return terms[(terms.index(m[0]) + 1 + turn % (len(terms) - 1)) % len(terms)]

    out = re.sub(r"[^\W\d_]+", other, text.lower())
    return out if hit else None


def word_codes(word: str) -> tuple[int, ...]:
    """Codes of a word and of its beginnings."""
    w = word.strip(STRIP).lower()
    names = {f"w{w}", *(f"p{w[:k]}" for k in (4, 5, 6) if len(w) >= k)} if w else ()
    return tuple(xxhash.xxh3_64_intdigest(x) for x in sorted(names))


#: A beginning that so many different words of a text share is a feature of its own.
SHARED = (2, 3, 5)


def shared_codes(times: Counter) -> set[int]:
    return {(c + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for c, n in times.items() if n > 1 for k in SHARED if n >= k}


def codes(text: str, cache: linear.Cache) -> np.ndarray:
    times: Counter = Counter()
    for found in map(cache.__getitem__, set(map(STRIPPED.__getitem__, text.split()))):
        times.update(found)
    every = times.keys() | shared_codes(times)
    return np.fromiter(every, np.uint64, len(every))


@dataclass
class Model:
    codes: np.ndarray
    weights: np.ndarray
    offset: float

    def scorer(self) -> Callable[[str], float]:
        weight = dict(zip(self.codes.tolist(), self.weights.tolist(), strict=True))
        wanted = {c for c in weight} | {(c - k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for c in weight for k in SHARED}
        cache = linear.Cache(lambda word: tuple(c for c in word_codes(word) if c in wanted))

        def f(text: str) -> float:
            times: Counter = Counter()
            for found in map(cache.__getitem__, set(map(STRIPPED.__getitem__, text.split()))):
                if found:
                    times.update(found)
            return float(linear.sigmoid(np.float64(self.offset + sum(weight.get(c, 0.0) for c in sorted(times.keys() | shared_codes(times))))))

        return f


def train(rows: linear.Rows, y: np.ndarray, swapped: linear.Rows, origin: np.ndarray, fairness: float = 1.0, ridge: float = 0.5, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Minimise log loss + ridge |w|^2 / 2 + fairness * sum (f(x) - f(swapped x))^2 over log odds f, by Adam on all rows.

    ``origin[i]`` is the row that swapped row i was made from."""
    w = np.zeros(rows.width)
    b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(rows.width + 1), np.zeros(rows.width + 1)
    for t in range(1, steps + 1):
        f = rows.dot(w)
        g = linear.sigmoid(f + b) - y
        back = g.copy()
        gw = ridge * w
        if swapped.n:
            gap = 2 * fairness * (f[origin] - swapped.dot(w))
            back += np.bincount(origin, weights=gap, minlength=rows.n)
            gw = gw - swapped.t_dot(gap)
        grad = np.append(gw + rows.t_dot(back), g.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1))
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_rows: int = linear.MAX_ROWS, max_features: int = 2048, fairness: float = 1.0) -> Model:
    sample = linear.labelled_sample(docs, labels, label, key, text, max_rows)
    by = {r["y"] > 0: r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = by.get(True, 0), by.get(False, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))
    cache = linear.Cache(word_codes)
    chosen, _, _ = linear.choose(linear.count_features(sample, lambda t: codes(t, cache)), n1, n0, max_features)
    terms = np.array([xxhash.xxh3_64_intdigest(f"w{t}") for t in KIND], np.uint64)
    chosen = np.union1d(chosen, terms)  # identity terms always have a weight, so that the penalty can act on it

    def rows(batches):
        pick = lambda t: (lambda x: np.sort(x[x < len(chosen)]).tolist())(linear.index(chosen, codes(t, cache)))
        for b in batches:
            ts = texts(b.column(1))
            other = [swap(t, xxhash.xxh3_64_intdigest(t) % 997) for t in ts]
            made = [[pick(t) for t in ts], [None if o is None else pick(o) for o in other]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in made)], names=["y", "cols", "other"])

    got = arrow_map(sample, rows, "y int, cols array<int>, other array<int>").toPandas()
    origin = np.flatnonzero(got["other"].notna().to_numpy())
    every = linear.Rows(list(got["cols"]), len(chosen))
    swapped = linear.Rows([got["other"].iloc[i] for i in origin], len(chosen))
    w, b = train(every, (got["y"].to_numpy() > 0).astype(float), swapped, origin, fairness)
    return Model(chosen, w, b)


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of toxicity for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return linear.score(docs, lambda: shared.value.scorer(), text, output, keep)
