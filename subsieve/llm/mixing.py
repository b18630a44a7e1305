"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Shares. Each source's target is its weight's part of all words, at most ``most`` times its own words; what
   is cut off goes to the others by weight until none is above.
2. Blocks. Each source is cut into blocks by a hash of its documents, their number in proportion to its words.
   A source's draw is so many whole passes over its blocks, then blocks in a seeded random order until the
   target is met; the block that the target falls in is cut into finer blocks, again and again, and of the
   last cell those documents are taken that fill the rest best, largest first.
3. Tree. The sources' block quotas, as one count vector, are split between the two halves of the output shards
   by a multivariate hypergeometric draw, each half again, down to single shards: every shard's counts are
   exact, add up to the quotas, and are distributed as if all draws had been shuffled and dealt. A shard then
   takes the next that many blocks of each source's random order: disjoint, and covering the quota.
4. Within its shard a document's place is random (``local_places`` tells it, ``shuffled`` brings rows into that order).

Only counts per source and block come to the driver: at most ``max_blocks`` plus one per source; more than
``max_sources`` sources is an error rather than a silent cut. The plan (one row per source and block) is
broadcast; documents are never shuffled. Everything follows from the seed and the data, so reruns agree.

Defined results: a null source is a source, last in order; null and empty texts have no words, and a document
without words is taken whenever its block is; a source without words has target 0; repeated rows are rows of their
own, any of them standing for any other; a very long document is taken whole or not; an empty table gives an empty mix; ``mixed`` keeps all
columns and finds other names for its own where they clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsieve.runtime import cut

from .common import fresh, n_words

#: Documents that a block holds on average, at least, and that the last cell of a source holds at most.
BLOCK, CELL = 32, 64
#: Parts that a block is cut into, at most.
FANOUT = 4096


def cyclic(weights: tuple[float, ...]) -> Callable[[int], float]:
    """Weights by place: the given ones, repeating."""
    return lambda i: weights[i % len(weights)]


def shares(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Targets that share ``total`` by weight, none above ``most`` times its size."""
    cap = most * sizes.astype(float)
    out, open_ = np.zeros(len(sizes)), sizes > 0
    left = float(total)
    while open_.any() and left > 0:
        want = left * weights / weights[open_].sum()
        full = open_ & (want >= cap)
        if not full.any():
            out[open_] = want[open_]
            break
        out[full] = cap[full]
        left -= float(cap[full].sum())
        open_ &= ~full
    return out


def split_tree(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: ``quota`` parted by a tree of multivariate hypergeometric draws."""
    out = np.zeros((shards, len(quota)), np.int64)

    def part(node: int, first: int, n: int, counts: np.ndarray) -> None:
        if n == 1:
            out[first] = counts
            return
        left = n // 2
        draw = int(counts.sum()) * left // n
        rng = np.random.default_rng([seed, 1, node])
        got = rng.multivariate_hypergeometric(counts, draw, method="marginals") if counts.sum() else counts
        part(2 * node, first, left, got)
        part(2 * node + 1, first + left, n - left, counts - got)

    part(1, 0, shards, quota.astype(np.int64))
    return out


def fill(sizes: list[int], room: float) -> list[bool]:
    """Which of some documents, tried from the largest, to take so that they come near ``room``."""
    order, left = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), room
    out = [False] * len(sizes)
    for i in order:
        if sizes[i] <= left:
            out[i], left = True, left - sizes[i]
    rest = [i for i in order if not out[i] and sizes[i] < 2 * left]
    if rest:  # one more if that is nearer
        out[rest[-1]] = True
    return out


def row_hash(key: str, source: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col(source).cast("string"), F.col(text))


def digit(h: Column, level: int, n: Column) -> Column:
    """Block of a row among ``n``, independent from level to level."""
    return F.pmod(F.xxhash64(h, F.lit(level)), n.cast("bigint"))


@dataclass
class Plan:
    """What each source gets. All tables are small and are broadcast: ``sources`` (s, source_size, target, blocks, place),
    ``whole`` (place, block, draws), ``single`` (place, h, one), ``cells`` by depth: (place, block, fan) and (place, path, cell)."""

    sources: DataFrame
    whole: DataFrame
    single: DataFrame
    cells: dict[int, tuple[DataFrame, DataFrame]]

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with s and h) and their source's size, target, place and number of blocks."""
        return rows.join(F.broadcast(self.sources.withColumnRenamed("s", "_s")), F.col("s").eqNullSafe(F.col("_s"))).drop("_s")

    def draws(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with s and h) and ``draws``: the shards that take the row, one entry per copy. No shuffle."""
        out = self.placed(rows).withColumn("block", digit(F.col("h"), 0, F.col("blocks"))).join(F.broadcast(self.whole), ["place", "block"], "left")
        out, added = out.join(F.broadcast(self.single), ["place", "h"], "left"), [F.col("one")]
        for depth, (fan, cells) in self.cells.items():
            out = out.join(F.broadcast(fan), ["place", "block"], "left").withColumn("path", F.array_join(_path().cast("array<string>"), ","))
            out = out.join(F.broadcast(cells), ["place", "path"], "left").drop("path", "fan")
            added.append(F.col(f"cell{depth}"))
        one, none = F.coalesce(*added), F.array().cast("array<int>")
        return out.withColumn("draws", F.concat(F.coalesce("draws", none), F.when(one.isNotNull(), F.array(one)).otherwise(none))).drop("block", "place", "blocks", *(["one"] + [f"cell{d}" for d in self.cells]))


def slim_rows(docs: DataFrame, seed: int, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> tuple[DataFrame, bool]:
    """(n, id, s, h, size) of all documents, as a table in the shared folder, and whether rows are repeated.

    ``n`` tells rows apart (``row`` if that does), and ``h`` is a hash of id, source and text. Rows equal in these have
    hashes of their own by their number among their equals, which is counted in ranges of ``n``."""
    own = F.col(row) if row else F.monotonically_increasing_id()
    slim = cut(docs.select(own.alias("n"), F.col(key).alias("id"), F.col(source).cast("string").alias("s"), row_hash(key, source, text, seed).alias("h"), n_words(text).alias("size")))
    repeated = cut(slim.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"))
    if not repeated.limit(1).count():
        return slim, False
    equal = cut(slim.join(repeated, "h", "left_semi").select("n", "h", F.shiftright("n", 33).alias("range")))
    counts = equal.groupBy("h", "range").agg(F.count("*").alias("held"))
    begins = counts.select("h", "range", (F.sum("held").over(Window.partitionBy("h").orderBy("range")) - F.col("held")).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("h", "range").orderBy("n")) - 1
    told = equal.withColumn("nth", nth).join(begins, ["h", "range"]).select("n", (F.col("begin") + F.col("nth")).alias("nth"))
    return cut(slim.join(told, "n", "left").withColumn("h", F.when(F.col("nth") > 0, F.xxhash64("h", "nth")).otherwise(F.col("h"))).drop("nth")), True


def make_plan(slim: DataFrame, weight: Callable[[int], float], shards: int, seed: int, most: int, max_blocks: int = 1 << 16, max_sources: int = 1_000_000) -> Plan:
    """The plan over (id, s, h, size) rows; ``weight`` gives the weight of the source at a place in code point order, null last."""
    spark = slim.sparkSession
    sums = slim.groupBy("s").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    got = sorted(((r["s"] is None, r["s"] or "", r["words"], r["n"]) for r in sums))
    names = [None if null else s for null, s, *_ in got]
    words = np.array([w for _, _, w, _ in got], np.int64)
    total = int(words.sum())
    weights = np.array([weight(i) for i in range(len(got))], float)
    target = shares(words, weights, total, most)
    rows_ = np.array([n for *_, n in got], np.int64)
    blocks = np.maximum(1, np.minimum(rows_ // BLOCK, (words / max(total, 1) * max_blocks).astype(np.int64)))
    schema = "s string, source_size bigint, target double, blocks bigint, place int"
    sources = spark.createDataFrame([(s, int(w), float(t), int(b), i) for i, (s, w, t, b) in enumerate(zip(names, words, target, blocks, strict=True))], schema)
    plan = Plan(sources, None, None, {})
    at = plan.placed(slim)

    passes = np.minimum(most, np.floor(target / np.maximum(words, 1) + 1e-9)).astype(np.int64)
    rest = np.maximum(0.0, target - passes * words)
    rest[passes == most] = 0
    # level 0: blocks; then the block that the target falls in, in finer blocks
    counted = at.withColumn("block", digit(F.col("h"), 0, F.col("blocks"))).groupBy("place", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    cells = {i: [] for i in range(len(got))}
    for r in counted.collect():
        cells[r["place"]].append((r["block"], r["words"], r["n"]))
    draws: list[tuple] = []  # (place, path, copies): path "" stands for the whole of level 0
    order: list[list[tuple]] = []
    partial: dict[int, tuple] = {}
    for i in range(len(got)):
        mine = sorted(cells[i])
        sequence = []
        for e in range(int(passes[i])):
            sequence += [mine[j][0] for j in np.random.default_rng([seed, 2, i, e]).permutation(len(mine))]
        left = rest[i]
        for j in np.random.default_rng([seed, 2, i, int(passes[i])]).permutation(len(mine)) if left > 0 else ():
            b, w, n = mine[j]
            if w <= left:
                sequence.append(b)
                left -= w
            else:
                if left > 0:
                    partial[i] = (b, left, n)
                    sequence.append(-1)  # the block cut in finer blocks
                break
        order.append(sequence)
    counts = split_tree(np.array([len(x) for x in order], np.int64), shards, seed) if got else np.zeros((shards, 0), np.int64)
    where: dict[tuple[int, int], list[int]] = {}
    last: dict[int, int] = {}
    for i, sequence in enumerate(order):
        for b, shard in zip(sequence, np.repeat(np.arange(shards), counts[:, i]).tolist(), strict=True):
            if b < 0:
                last[i] = shard
            else:
                where.setdefault((i, b), []).append(shard)
    plan.whole = spark.createDataFrame([(i, b, x) for (i, b), x in where.items()], "place int, block bigint, draws array<int>")

    # the finer cells: per source one cell is cut again until it holds few documents; the others are taken whole or not
    chosen: list[tuple] = []  # (place, h, shard) of documents, and (place, path, shard) of cells, by depth
    taken: dict[int, list[tuple]] = {}
    fans: dict[int, list[tuple]] = {}
    open_ = {i: (b, [], [], left, n) for i, (b, left, n) in partial.items()}  # block, fan and path, words still wanted, documents
    while open_:
        depth, after = len(next(iter(open_.values()))[1]) + 1, {}
        flat = {i for i, (*_, n) in open_.items() if n <= CELL}
        inside = _inside(at, open_)
        if flat:
            units: dict[int, list] = {i: [] for i in flat}
            ends = F.broadcast(spark.createDataFrame([(i,) for i in flat], "place int"))
            for r in inside.join(ends, "place", "left_semi").groupBy("place", "h").agg(F.sum("size").alias("words")).collect():
                units[r["place"]].append((r["h"], r["words"]))
            for i, found in units.items():
                found.sort()
                chosen += [(i, h, last[i]) for (h, _), z in zip(found, fill([w for _, w in found], open_[i][3]), strict=True) if z]
        deeper = {i: max(2, min(FANOUT, n // BLOCK)) for i, (*_, n) in open_.items() if i not in flat}
        if deeper:
            cells = {i: [] for i in deeper}
            fan = F.broadcast(spark.createDataFrame([*deeper.items()], "place int, parts int"))
            sub = inside.join(fan, "place").withColumn("cell", digit(F.col("h"), depth, F.col("parts")))
            for r in sub.groupBy("place", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect():
                cells[r["place"]].append((r["cell"], r["words"], r["n"]))
            for i, mine in cells.items():
                b, fan_, path, left, before = open_[i]
                fan_ = [*fan_, deeper[i]]
                fans.setdefault(depth, []).append((i, b, fan_))
                mine.sort()
                for j in np.random.default_rng([seed, 3, i, depth]).permutation(len(mine)):
                    c, w, n = mine[j]
                    if w <= left:
                        taken.setdefault(depth, []).append((i, ",".join(map(str, [*path, c])), last[i]))
                        left -= w
                    else:
                        if left > 0:
                            after[i] = (b, fan_, [*path, c], left, n)
                        break
        open_ = after
    plan.single = spark.createDataFrame(chosen, "place int, h bigint, one int")
    for depth, found in taken.items():
        plan.cells[depth] = (spark.createDataFrame(fans[depth], "place int, block bigint, fan array<int>"), spark.createDataFrame(found, f"place int, path string, cell{depth} int"))
    return plan


def mix(docs: DataFrame, weight: Callable[[int], float], shards: int = 24, seed: int = 20, most: int = 3, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(n, id, s, h, size, source_size, target, draws) of each document: its source and words, and the shards that take it."""
    slim, _ = slim_rows(docs, seed, key, source, text)
    return make_plan(slim, weight, shards, seed, most).draws(slim)


#: Copies that one window of the local shuffle holds on average, at most.
WINDOW = 50_000


def local_places(rows: DataFrame, shards: int, seed: int = 20) -> DataFrame:
    """``rows`` of ``mix`` with ``places``: where each copy stands in its shard after the shard's own shuffle.

    Copies go by a random number; a shard's numbers are cut into equal ranges, each shuffled and numbered in a window of
    its own that starts where the ranges before it end."""
    rows = cut(rows)
    parts = max(1, -(-(rows.agg(F.sum(F.size("draws"))).first()[0] or 0) // (shards * WINDOW)))
    copies = rows.select("n", "h", F.posexplode("draws").alias("copy", "shard")).withColumn("at", order_in_shard(seed))
    copies = copies.withColumn("part", F.least((F.col("at") / float(1 << 63) * parts).cast("int"), F.lit(parts - 1)))
    counts = copies.groupBy("shard", "part").agg(F.count("*").alias("held"))
    begins = counts.select("shard", "part", (F.sum("held").over(Window.partitionBy("shard").orderBy("part")) - F.col("held")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at", "n")) - 1
    placed = copies.withColumn("place", place).join(begins, ["shard", "part"]).withColumn("place", F.col("begin") + F.col("place"))
    taken = placed.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "place"))), lambda x: x["place"]).alias("places"))
    return rows.join(taken, "n", "left").withColumn("places", F.coalesce("places", F.array().cast("array<bigint>")))


def order_in_shard(seed: int) -> Column:
    """The random number that a shard's copies (h, copy) are ordered by."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h", "copy"), 1)


def _path() -> Column:
    """A row's cell at each level of ``fan``."""
    return F.transform("fan", lambda n, i: F.pmod(F.xxhash64(F.col("h"), (i + 1).cast("int")), n.cast("bigint")))


def _inside(at: DataFrame, cells: dict[int, tuple]) -> DataFrame:
    """Rows of ``at`` in one cell per source."""
    table = at.sparkSession.createDataFrame([(i, b, fan, path) for i, (b, fan, path, *_) in cells.items()], "place int, block bigint, fan array<int>, path array<bigint>")
    rows = at.withColumn("block", digit(F.col("h"), 0, F.col("blocks"))).join(F.broadcast(table), ["place", "block"])
    return rows.filter(_path() == F.col("path")).drop("fan", "path")


def mixed(docs: DataFrame, weight: Callable[[int], float], shards: int = 24, seed: int = 20, most: int = 3, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mix, one row per copy, with the column ``shard`` (and ``place``, a random number to order a shard by)."""
    slim, repeated = slim_rows(docs, seed, key, source, text)
    shard, place, n = fresh(docs, "shard", "place", "n")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if repeated:  # only a written number tells equal rows apart
        held = cut(docs.withColumn(n, F.monotonically_increasing_id()))
        slim, _ = slim_rows(held, seed, key, source, text, row=n)
        rows = held.select(row, F.col(n).alias("n")).join(slim.select("n", "s", "h"), "n")
    else:
        rows = docs.select(row, F.col(source).cast("string").alias("s"), row_hash(key, source, text, seed).alias("h"))
    plan = make_plan(slim, weight, shards, seed, most)
    out = plan.draws(rows).select("row", "h", F.posexplode("draws").alias("copy", "shard"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(shard), order_in_shard(seed).alias(place))


def shuffled(mixture: DataFrame, shard: str = "shard", place: str = "place") -> DataFrame:
    """A mixture by shard, each shard's rows in random order: ranges of (shard, place), so that a large shard is
    several tasks' and a small one a part of a task's."""
    return mixture.repartitionByRange(shard, place).sortWithinPartitions(shard, place)
