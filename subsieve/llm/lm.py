"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the words of a text (lower-cased A-Z, between ASCII white space) and one end. The commonest words
are classes of their own and all others share ``TAILS`` classes by their ending, so

    p(token | before) = p(class | two classes before) * p(token | class),

the second factor being 1 for a class of one word, else the add-one share of the token in its class with one
slot for unseen words. p(class | ...) is log-bilinear: the context classes' vectors, each turned by the matrix
of its place, add up to a prediction whose products with all classes' vectors, plus biases, are log odds.

Counts cover all training texts (a distributed aggregation; the table of all words stays distributed).
Training passes once over all training texts: each partition runs minibatches of noise-contrastive estimation
in numpy from the same start, with noise from the class frequencies and shared within a minibatch, and the
partitions' parameters are averaged by their tokens. As the context is two classes, the exact log normaliser
of every context is made once by batched matrix products, and every token's log-probability is normalised.

Scoring is one pass over the texts with a bounded table of the commonest words; tokens beyond it are joined
with the table of all words by a shuffle.

Defined results: null text counts as empty and is scored as its end alone; rows are scored one by one,
whatever ids they have, repeated rows alike; a text is read whole however long it is; with no training text counts
are 0 and the base score of a token is log10(1 / 1); an empty table is scored as an empty table; columns of the
names that scoring adds are replaced and all others stay, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from subsieve.runtime import cut

from .common import arrow_map, blobs, fold
from .linear import Cache

#: Classes of one word, and classes that all other words share.
HEADS, TAILS = 448, 64
DIM, NOISE, BATCH = 16, 16, 4096
#: Commonest words that every worker holds, at most.
KNOWN = 300_000
END = b" "  # no word can be this
FOLDS, HELD_OUT = 7, 2


def tail_class(word: bytes) -> int:
    return HEADS + zlib.crc32(word[-2:]) % TAILS


def held_out(key: str = "doc_id") -> Column:
    return fold(key, FOLDS) == HELD_OUT


@dataclass
class Params:
    """context: (classes + 1) x DIM, the last for before the text; turn: 2 x DIM x DIM; output: classes x DIM; bias: classes."""

    context: np.ndarray
    turn: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 5) -> Params:
        rng, n = np.random.default_rng(seed), len(share)
        return cls(rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32), np.stack([np.eye(DIM), np.eye(DIM)]).astype(np.float32) * np.float32(0.5), rng.normal(0, 0.1, (n, DIM)).astype(np.float32), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.turn, self.output, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> Params:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Params(*out)


class Trainer:
    """Minibatches of noise-contrastive estimation with AdaGrad steps."""

    def __init__(self, start: Params, share: np.ndarray, seed: int, rate: float = 0.05):
        self.p = Params(*(x.copy() for x in start.parts()))
        self.rate, self.rng = np.float32(rate), np.random.default_rng(seed)
        self.cum, self.log_noise = np.cumsum(share), (np.log(share) + math.log(NOISE)).astype(np.float32)
        self.seen = [np.full(x.shape, 0.1, np.float32) for x in self.p.parts()]

    @staticmethod
    def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        """One minibatch: classes two and one before, and the classes themselves."""
        p, n = self.p, len(w)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), len(self.cum) - 1)
        ca, cb, out, other = p.context[a], p.context[b], p.output[w], p.output[noise]
        h = ca @ p.turn[0] + cb @ p.turn[1]
        true = np.einsum("ij,ij->i", h, out) + p.bias[w] - self.log_noise[w]
        false = h @ other.T + (p.bias[noise] - self.log_noise[noise])
        gt = np.float32(0.5) * (1 - np.tanh(true / 2))
        gf = np.float32(-0.5) * (1 + np.tanh(false / 2))
        dh = gt[:, None] * out + gf @ other
        g_out = self._scatter(w, gt[:, None] * h, len(p.bias))
        np.add.at(g_out, noise, gf.T @ h)
        g_bias = np.bincount(w, gt, len(p.bias)).astype(np.float32)
        np.add.at(g_bias, noise, gf.sum(0))
        g_context = self._scatter(np.concatenate([a, b]), np.concatenate([dh @ p.turn[0].T, dh @ p.turn[1].T]), len(p.context))
        g_turn = np.stack([ca.T @ dh, cb.T @ dh])
        for x, g, s in zip(p.parts(), (g_context, g_turn, g_out, g_bias), self.seen, strict=True):
            g = g / np.float32(math.sqrt(n))
            s += g * g
            x += self.rate * g / np.sqrt(s)

    def run(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        size = max(256, min(BATCH, len(w) // 16))  # a short text collection still gets some steps
        for k in range(0, len(w), size):
            self.step(a[k : k + size], b[k : k + size], w[k : k + size])


def log_normaliser(p: Params) -> np.ndarray:
    """(classes + 1) x (classes + 1): log of the sum over all classes, for each pair of context classes."""
    first, second = p.context @ p.turn[0], p.context @ p.turn[1]
    out = np.empty((len(first), len(first)), np.float32)
    for i, h in enumerate(first):
        logits = (second + h) @ p.output.T + p.bias
        top = logits.max(1, keepdims=True)
        out[i] = top[:, 0] + np.log(np.exp(logits - top).sum(1))
    return out


@dataclass
class Vocabulary:
    """The commonest words with their counts, the classes' sizes, and the corpus totals."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def __post_init__(self):
        self.classes = HEADS + TAILS

    def place(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def heads(self) -> dict[bytes, int]:
        """Classes of one word: the end first, then the commonest."""
        return {w: i for i, w in enumerate([END, *(w for w in self.words if w != END)][:HEADS])}

    def class_of(self) -> Cache:
        heads = self.heads()
        return Cache(lambda w: heads[w] if w in heads else tail_class(w))

    def share(self) -> np.ndarray:
        """Add-one share of the classes among all training tokens; classes that no word has get next to nothing."""
        used = np.where((np.arange(self.classes) < len(self.heads())) | (np.arange(self.classes) >= HEADS), 1.0, 1e-6)
        return (self.class_tokens + used) / (self.class_tokens.sum() + used.sum())


def count_words(train: DataFrame, text: str = "text", flush: int = 400_000) -> DataFrame:
    """(word binary, c): tokens of all texts, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(made, names=["word", "c"])

        for b in batches:
            rows = blobs(b.column(0))
            for raw in rows:
                seen.update(raw.lower().split())
                if len(seen) > flush:
                    yield out()
            seen[END] += len(rows)
        if seen:
            yield out()

    return arrow_map(train.select(F.col(text).alias("text")), run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0")


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """What every worker needs of the table of all words."""
    level = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r["b"], r["n"], r["c"]) for r in counts.groupBy(level.alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()), reverse=True)
    least, held = None, 0
    for b, n, _ in bins:
        if held + n > known:
            break
        least, held = b, held + n
    top = counts.filter(level >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    if END not in {bytes(w) for w in top["word"]}:  # every text has it, whatever its rank
        top = pd.concat([top, counts.filter(F.col("word") == F.lit(END)).toPandas()])
    top = top.assign(word=[bytes(w) for w in top["word"]]).sort_values(["c", "word"], ascending=[False, True])
    v = Vocabulary(top["word"].tolist(), top["c"].to_numpy(np.int64), sum(c for *_, c in bins), sum(n for _, n, _ in bins), np.zeros(HEADS + TAILS), np.zeros(HEADS + TAILS))
    heads = v.heads()
    by_word = dict(zip(v.words, v.counts.tolist(), strict=True))
    for w, i in heads.items():
        v.class_tokens[i] = by_word.get(w, 0)
    tail = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in heads], "word binary")), "word", "left_anti")
    suffix = F.when(F.length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))
    for r in tail.groupBy(F.pmod(F.crc32(suffix), F.lit(TAILS)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        v.class_tokens[HEADS + r["k"]], v.class_words[HEADS + r["k"]] = r["c"], r["n"]
    return v


def contexts(classes: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two before, one before and itself, for every token of several texts; ``before`` stands for what precedes a text."""
    pad = np.array([before, before], np.int64)
    joined = np.concatenate([x for c in classes for x in (pad, c)])
    is_token = np.concatenate([x for c in classes for x in (np.zeros(2, bool), np.ones(len(c), bool))])
    at = np.flatnonzero(is_token)
    return joined[at - 2], joined[at - 1], joined[at]


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text") -> Params:
    """Parameters after one pass over all texts, averaged over partitions."""
    share = vocab.share()
    start = Params.start(share)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        class_of, trainer, tokens, held = v.class_of(), Trainer(p, share, TaskContext.get().partitionId()), 0, []
        end = class_of[END]

        def learn() -> None:
            trainer.run(*contexts(held, v.classes))
            held.clear()

        size = 0
        for b in batches:
            for raw in blobs(b.column(0)):
                words = raw.lower().split()
                c = np.empty(len(words) + 1, np.int64)
                c[:-1] = np.fromiter(map(class_of.__getitem__, words), np.int64, len(words))
                c[-1] = end
                held.append(c)
                size += len(c)
                tokens += len(c)
                if size > 16 * BATCH:
                    learn()
                    size = 0
        if held:
            learn()
        if tokens:
            yield packed(trainer.p.flat() * tokens, tokens)

    total, tokens = added(arrow_map(docs.select(F.col(text).alias("text")), run, SUMS))
    return start.filled(total / tokens) if tokens else start


#: Rows of parameters that meet in one task, or on the driver at last.
TOGETHER = 64
SUMS = "sums binary, tokens bigint"


def packed(sums: np.ndarray, tokens: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.astype("<f8").tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["sums", "tokens"])


def added(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of all rows (sums, tokens), ``TOGETHER`` of them at a time until so few are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = 0.0, 0
        for b in batches:
            for sums, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total, tokens = total + np.frombuffer(sums, "<f8"), tokens + n
        if tokens:
            yield packed(total, tokens)

    rows = cut(rows)
    while (n := rows.count()) > TOGETHER:
        rows = cut(arrow_map(rows.repartition(-(-n // TOGETHER), F.xxhash64("sums")), run, SUMS))
    got = rows.orderBy("tokens", F.xxhash64("sums")).collect()
    return sum((np.frombuffer(r["sums"], "<f8") for r in got), np.zeros(0) if not got else 0.0), sum(r["tokens"] for r in got)


@dataclass
class Scorer:
    """Log10 probabilities of classes in context."""

    p: Params

    def __post_init__(self):
        self.first, self.second = ((self.p.context @ t).T.copy() for t in self.p.turn)
        self.output = self.p.output.T.copy()
        self.norm = log_normaliser(self.p)

    def log10(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = self.p.bias[w] - self.norm[a, b]
        for f, g, o in zip(self.first, self.second, self.output, strict=True):
            s += (f[a] + g[b]) * o[w]
        return s.astype(np.float64) / math.log(10)


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, scorer: Scorer, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, n_known, train_tokens, base_score and score of each whole text."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    shared = docs.sparkSession.sparkContext.broadcast((vocab, scorer))
    total = vocab.tokens + vocab.distinct + 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value
        place, class_of, heads = v.place(), v.class_of(), v.heads()
        known = len(v.words)
        cls = np.array([class_of[w] for w in v.words] or [0], np.int64)
        base = np.append(np.log10((v.counts + 1.0) / total), 0.0)
        room = v.class_tokens + v.class_words + 1.0
        inner = np.append([0.0 if w in heads else math.log10((c + 1.0) / room[k]) for w, c, k in zip(v.words, v.counts.tolist(), cls.tolist(), strict=False)], 0.0)
        end = place.get(END, known)
        part, row = TaskContext.get().partitionId() << 33, 0
        lost: list[bytes] = []

        def find(word: bytes) -> int:
            lost.append(word)
            return known

        for b in batches:
            ids, sums, tails, classes = [], [], [], []
            for raw in blobs(b.column(b.num_columns - 1)):
                words = raw.lower().split()
                lost.clear()
                at = np.fromiter((i if (i := place.get(w)) is not None else find(w) for w in words), np.int64, len(words))
                c = np.empty(len(words) + 1, np.int64)
                c[:-1] = cls[np.minimum(at, len(cls) - 1)]
                if lost:
                    c[:-1][at == known] = [class_of[w] for w in lost]
                c[-1] = class_of[END]
                classes.append(c)
                ids.append(part + row)
                row += 1
                sums.append((len(words) + 1, len(words) - len(lost) + (end < known), float(base[at].sum()) + (float(base[end]) if end < known else math.log10(1.0 / total)), float(inner[at].sum())))
                tails.append(Counter(lost))
            if classes:
                logs = np.concatenate([model.log10(*contexts(classes[k : k + 200], v.classes)) for k in range(0, len(classes), 200)])
                ends = np.cumsum([len(c) for c in classes])
                logs = np.add.reduceat(logs, np.append(0, ends[:-1])).tolist()
            else:
                logs = []
            flat = [(i, w, n) for i, t in zip(ids, tails, strict=True) for w, n in t.items()]
            n, m = len(ids), len(flat)
            columns = [*b.columns[: len(keep)]]
            made = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in columns]
            made += [pa.array([*ids, *(i for i, _, _ in flat)], pa.int64()), pa.array([None] * n + [w for _, w, _ in flat], pa.binary()), pa.array([None] * n + [x for *_, x in flat], pa.int64())]
            made += [pa.array([s[k] for s in sums] + [None] * m, kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            made.append(pa.array([s[3] + x for s, x in zip(sums, logs, strict=True)] + [None] * m, pa.float64()))
            yield pa.RecordBatch.from_arrays(made, names=[f"k{i}" for i in range(len(keep))] + NAMES)

    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    schema = StructType([*source.schema.fields[:-1], *(StructField(n, t) for n, t in zip(NAMES, (LongType(), BinaryType(), LongType(), LongType(), LongType(), DoubleType(), DoubleType()), strict=True))])
    found = cut(arrow_map(source, run, schema))
    whole, rare = found.filter("__word is null"), found.filter("__word is not null").select("__row", F.col("__word").alias("word"), "__n")
    # words beyond the table: their counts, and their shares of their classes
    rooms = docs.sparkSession.createDataFrame([(i, float(a + b + 1)) for i, (a, b) in enumerate(zip(vocab.class_tokens[HEADS:], vocab.class_words[HEADS:], strict=True))], "k int, room double")
    suffix = F.when(F.length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))
    joined = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("k", F.pmod(F.crc32(suffix), F.lit(TAILS)).cast("int")).join(F.broadcast(rooms), "k")
    n, c = F.col("__n"), F.col("c")
    late = joined.groupBy("__row").agg(F.sum(F.when(c > 0, n).otherwise(0)).alias("known"), F.sum(n * F.log10((c + 1.0) / total)).alias("base"), F.sum(n * F.log10((c + 1.0) / F.col("room"))).alias("inner"))
    out = whole.join(late, "__row", "left")
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("inner", F.lit(0.0))).alias("score"),
    )


#: The columns that scoring adds; others of these names (compared without case) are replaced.
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
NAMES = ["__row", "__word", "__n", "n_tokens", "n_known", "base_score", "score"]


def fit(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Vocabulary, Scorer]:
    """Counts of all words of all ``docs``, what workers need of them, and the trained model."""
    counts = cut(count_words(docs, text))
    vocab = vocabulary(counts)
    return counts, vocab, Scorer(train(docs, vocab, text))
