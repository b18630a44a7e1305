"""Near-duplicate detection by Order MinHash with verification by banded alignment.

Two texts are linked if an alignment in order covers 0.8 of the longer text's words by common five-word shingles
(words lower-cased A-Z, between ASCII white space; a shingle's second occurrence is apart from its first), or if
the Jaccard index of their sets of shingles is 0.8 or more, which knows neither order nor repetition. A text of one
to four words has itself as its one shingle; a text without words links only to equal texts.

1. Equal texts (by md5) form a class with one representative; only representatives go on.
2. Order MinHash: each of ``HASHES`` functions picks the ``PICK`` least occurrence-labelled shingles of a text
   and keeps them in text order; the ordered tuple is one sketch value. For texts whose passages are moved or
   repeated, each function also picks the ``FREE_PICK`` least of the text's distinct shingles, and these by their
   code are a second value: equal with a chance of J ** FREE_PICK in any order (0.41 at J = 0.8, so 24 functions
   miss such a link with a chance of 3e-6). In texts that are alike in order, scattered edits leave a lower J; the
   first values then agree with a chance of about J ** PICK each (J = 0.6: missed with 0.003; 0.5: 0.04; edits in
   one word of ten: J = 0.42). Texts of at most ``SHORT`` distinct shingles have a second set of sketches with two
   shingles each.
3. Texts with an equal sketch value are a bucket. No bucket is expanded into all its pairs: its members are
   compared with a representative (the least id), and verified links are joined to components. Larger buckets
   whose members stay apart are compared with another member, in a few rounds. Last, what is still apart is
   compared exactly: all pairs across components within buckets of at most ``SMALL`` members, and between the
   texts of larger buckets (those that share a common passage, say) all pairs that the prefix filter leaves,
   which is exact for the index of 0.8. Within a component no link is needed.
4. A pair is verified by chaining its common shingles in order, within the band that the threshold leaves open.
   What the alignment refuses, texts with moved passages, is then tested by its exact Jaccard index.
5. Components by minimum propagation with pointer jumping on tables in the shared folder; no fingerprints,
   links or components come to the driver.

Defined results: null text counts as a text of its own kind, equal to other nulls; empty texts are equal; very long
texts are read whole; null ids rank last as class names; rows with equal id and text are one row of the class;
``deduplicate`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsieve.runtime import cut

from .common import arrow_map, blobs, fresh
from .linear import Cache

WORDS, SIMILARITY = 5, 0.8
HASHES, PICK, FREE_PICK = 24, 3, 4
SHORT, SHORT_HASHES, SHORT_PICK = 80, 16, 2
#: Rounds of comparison: by representatives, the last in all pairs that are still open.
ROUNDS = 3
#: Members of a bucket whose open pairs are tested directly; the texts of larger ones go through the prefix filter.
SMALL = 8
#: Up to so many texts that take part in a pair are found in the documents by a broadcast of their keys (16 bytes
#: each), beyond it by a shuffled semi join.
BROADCAST_KEYS = 2_000_000

ODD = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WORDS + 1)], np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


SEEDS = scramble(np.arange(1, HASHES + SHORT_HASHES + 1, dtype=np.uint64) * ODD)
_words = Cache(xxhash.xxh3_64_intdigest, 120_000)


def shingles(raw: bytes) -> np.ndarray:
    """Code of each five-word shingle in text order; of all words together for one to four words."""
    words = raw.lower().split()
    n = len(words)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return scramble((w * POWERS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else w
    return scramble(sum(w[k : n - WORDS + 1 + k] * POWERS[k] for k in range(WORDS)))


def labelled(s: np.ndarray) -> np.ndarray:
    """Codes that tell apart the first, second, ... occurrence of a shingle."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.append(True, t[1:] != t[:-1])
    if new.all():
        return s
    start = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    out = np.empty_like(s)
    out[order] = t + (np.arange(len(t)) - start).astype(np.uint64) * ODD
    return out


def values(codes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return ((codes ^ seed) * POWERS[: codes.shape[1]]).sum(1, dtype=np.uint64)


def minhash(s: np.ndarray, seeds: np.ndarray, ordered: int, free: int) -> np.ndarray:
    """For shingles in text order, none twice, a value per seed of the ``ordered`` least in text order and one of the
    ``free`` least by code; none of a kind whose number is 0."""
    n, out = len(s), []
    step = max(1, 32_768 // n)
    for j in range(0, len(seeds), step):
        seed = seeds[j : j + step, None]
        h = (s[None, :] ^ seed) * ODD
        h ^= h >> np.uint64(32)
        least = sorted({k - 1 for k in (ordered, free) if k})
        at = np.argpartition(h, least, axis=1)[:, : least[-1] + 1] if n > least[-1] + 1 else np.argsort(h, axis=1)
        if ordered:
            out.append(values(s[np.sort(at[:, :ordered], axis=1)], seed))
        if free:
            out.append(values(np.sort(s[at[:, :free]], axis=1), ~seed))
    return scramble(np.concatenate(out))


def sketch(raw: bytes) -> np.ndarray:
    """All sketch values of a text, each once; function j's values are apart from every other function's."""
    s = shingles(raw)
    if not len(s):
        return s
    labels, once = labelled(s), first_places(s)
    out = []
    for seeds, ordered, free in [(SEEDS[:HASHES], PICK, FREE_PICK), (SEEDS[HASHES:], SHORT_PICK, SHORT_PICK)][: 1 + (len(once) <= SHORT)]:
        out += [minhash(s, seeds, ordered, free)] if len(once) == len(s) else [minhash(labels, seeds, ordered, 0), minhash(once, seeds, 0, free)]
    return np.unique(np.concatenate(out))


def first_places(s: np.ndarray) -> np.ndarray:
    """Distinct shingles in the order of their first occurrence."""
    return s[np.sort(np.unique(s, return_index=True)[1])]


def chain(places: np.ndarray) -> np.ndarray:
    """Where a longest increasing run of ``places`` (no two equal) stands among them."""
    if (places[1:] > places[:-1]).all():
        return np.arange(len(places))
    tails: list[int] = []  # the least last place of a run of each length, and where it stands
    ends: list[int] = []
    before = []
    for k, x in enumerate(places.tolist()):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [x], [k]
    out, k = [], ends[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of the longer text's words that an alignment covers, of two lists of labelled shingles in text order.

    The alignment is a longest chain of common shingles in both orders, within the band that a share of ``least``
    can touch; a shingle covers its five words. Below ``least`` the result may be too low."""
    na, nb = len(a) + WORDS - 1, len(b) + WORDS - 1
    need = least * max(na, nb)
    if need > min(na, nb):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if WORDS * len(i) < need:
        return 0.0
    off = j - i
    band = (off >= need - na) & (off <= nb - need)
    i, j = i[band], j[band]
    if not len(i):
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    run = chain(j)
    return min(WORDS + int(np.minimum(WORDS, np.diff(x[run])).sum()) for x in (i, j)) / max(na, nb)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Jaccard index of two sorted sets; 0 where their sizes alone keep it under ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def listed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's labelled shingles in order, and its distinct shingles."""
    s = shingles(raw)
    return labelled(s) if len(s) else s, np.unique(s)


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    """Whether two ``listed`` texts are linked; the same in both directions."""
    if not len(x[0]) or not len(y[0]):
        return False
    if (len(x[0]), x[0].tobytes()) > (len(y[0]), y[0].tobytes()):
        x, y = y, x
    return aligned(x[0], y[0], least) >= least or jaccard(x[1], y[1], least) >= least


def _codes(key: str, text: str) -> list[Column]:
    """A row's id with nulls last, and its text's md5; a null text has a code of its own."""
    return [F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id")).alias("row"), F.unhex(F.coalesce(F.md5(F.col(text)), F.lit("00"))).alias("md5")]


def sketched(texts_: DataFrame) -> DataFrame:
    """(md5, row, values) of (row, md5, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(raw).view(np.int64) for raw in blobs(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], names=["row", "md5", "values"])

    kind = texts_.schema["row"].dataType.simpleString()
    return arrow_map(texts_, run, f"row {kind}, md5 binary, values array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): of each node of (a, b) edges the least node that it is linked to.

    Each round, nodes take the least label among their neighbours' labels and their own, then the label of
    that label; stars and chains settle in about log2(diameter) rounds."""
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")))
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("new"), "comp")
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        after = cut(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("comp"), (F.least("new", F.coalesce("far", "new")) != F.col("comp")).alias("moved")))
        labels = after.select("node", "comp")
        if not after.filter("moved").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after more (a, b) links between nodes; only the components that these join are gone through."""
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    joined = cut(links.join(a, "a").join(b, "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not joined.limit(1).count():
        return labels
    moved = components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return cut(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def verified(pairs: DataFrame, texts_: DataFrame) -> DataFrame:
    """The (a, b) pairs with a flag ``ok``; texts_ has (node, text) of every node in a pair.

    Texts travel rather than shingle codes, which are longer and do not compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for b in batches:
            ok = []
            for x, y in zip(blobs(b.column(2)), blobs(b.column(3)), strict=True):
                if x != last:
                    last, kept = x, listed(x)
                ok.append(similar(kept, listed(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    left = pairs.join(texts_.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    full = left.join(texts_.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return arrow_map(full.select("a", "b", "ta", "tb"), run, "a bigint, b bigint, ok boolean")


def linked(base: DataFrame, reps: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in buckets, after all the comparisons that step 3 asks for."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.col("node").alias("comp"))
    wanted = reps.join(nodes, "node", "left_semi").select("md5", "row", "node")
    wanted = F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted
    texts_ = cut(base.join(wanted, ["md5", "row"]).dropDuplicates(["md5", "row"]).select("node", "text"))
    pairs = members.filter("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    done = labels = None
    for turn in range(ROUNDS + 1):
        tested = cut(verified(pairs, texts_))
        done = tested.select("a", "b") if done is None else done.union(tested.select("a", "b"))
        links = tested.filter("ok").select("a", "b")
        labels = merged(labels, links) if turn else cut(nodes.join(components(links), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
        if turn == ROUNDS:
            return labels
        inside = members.join(labels, "node").select("bucket", "node", "comp")
        # few buckets are open after the first round: written first, they are broadcast if small, and hot buckets stay where they are
        spread = cut(inside.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low != high").select("bucket", "n"))
        if not spread.limit(1).count():
            return labels
        apart = cut(inside.join(spread, "bucket"))
        if turn < ROUNDS - 1:  # the next representative of a bucket is one of its members by a hash that changes each round
            rank = F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), "node", "comp")
            rep = cut(apart.filter(F.col("n") > SMALL).groupBy("bucket").agg(F.min(rank).alias("r")).select("bucket", F.col("r.node").alias("a"), F.col("r.comp").alias("ca")))
            next_ = apart.join(rep, "bucket").filter("comp != ca").select("a", F.col("node").alias("b"))
        else:
            small = apart.filter(F.col("n") <= SMALL)
            other = small.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca"))
            within = small.join(other, "bucket").filter("comp < ca").select("a", F.col("node").alias("b"))
            next_ = within.union(by_prefix(cut(apart.filter(F.col("n") > SMALL).select("node", "comp").distinct()), texts_))
        fresh = next_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(fresh.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))


def by_prefix(nodes: DataFrame, texts_: DataFrame) -> DataFrame:
    """(a, b): all pairs of ``nodes`` (node, comp) of different components that can have the similarity, by the prefix filter.

    Order each text's distinct shingles from those that fewest nodes hold outside their commonest component; two texts
    with the Jaccard index t share one of the first n - ceil(t n) + 1, and the places of the first shared one bound what
    they can share. Shingles of one component only stand first and are in no pair, so they are counted and not joined;
    passages that many texts hold stand last. A shingle's commonest component is on one side of the join only, so the
    pairs within a component that are met are no more than those across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [first_places(shingles(raw)).view(np.int64) for raw in blobs(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int64()))], names=["node", "comp", "codes"])

    coded = arrow_map(texts_.join(nodes, "node").select("node", "comp", "text"), run, "node bigint, comp bigint, codes array<bigint>")
    rows = cut(coded.select("node", "comp", F.size("codes").alias("n"), F.explode("codes").alias("code")))
    inside = rows.groupBy("code", "comp").agg(F.count("*").alias("k"))
    held = inside.groupBy("code").agg((F.sum("k") - F.max("k")).alias("others"), F.max_by("comp", F.struct("k", "comp")).alias("home")).filter("others > 0")
    own = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("others", "code"))
    first = rows.join(held, "code").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1)
    left = cut(first.select("node", "comp", "n", "code", "place", "home"))
    right = left.filter("comp != home").select("code", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("cb"), F.col("place").alias("at"))
    # from their first common shingle on, two texts share no more than what the shorter rest holds
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + 1
    near = most >= (F.col("n") + F.col("m")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
    across = (F.col("comp") == F.col("home")) | (F.col("comp") < F.col("cb"))
    return left.join(right, "code").filter(across & near).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, md5, class_row, class_md5) of each distinct (id, text): ``row`` is struct(no, id), class_* the least of the class."""
    base = docs.select(*_codes(key, text), F.col(text).alias("text"))
    rows = cut(sketched(base))
    # one representative of each text; two texts share a node number with a chance of n^2 / 2^65
    reps = cut(rows.groupBy("md5").agg(F.min("row").alias("row"), F.first("values").alias("values")).withColumn("node", F.xxhash64("md5")))
    entries = reps.select("node", F.explode("values").alias("bucket"))
    stars = entries.groupBy("bucket").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    members = cut(entries.join(stars.select("bucket", "rep"), "bucket").select("bucket", "node", "rep"))
    nodes = cut(members.select("node").distinct())
    labels = linked(base, reps, members, nodes)
    whole = reps.join(labels, "node", "left").select("md5", "row", F.coalesce("comp", "node").alias("comp"))
    least = whole.groupBy("comp").agg(F.min(F.struct("row", "md5")).alias("least"))
    named = whole.join(least, "comp").select("md5", F.col("least.row").alias("class_row"), F.col("least.md5").alias("class_md5"))
    return rows.select("row", "md5").join(named, "md5")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that with the least id."""
    c = cut(classes(docs, key, text))
    own, code = fresh(docs, "row", "md5")
    kept = c.filter((F.col("row") == F.col("class_row")) & (F.col("md5") == F.col("class_md5"))).select(F.col("row").alias(own), F.col("md5").alias(code)).distinct()
    row, md5 = _codes(key, text)
    out = docs.withColumns({own: row, code: md5}).join(kept, [own, code]).dropDuplicates([own, code])
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])
