"""Workloads: generate, sample, count, sort, permute."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsieve.functions import bloom
from subsieve.functions.bits import Bits
from subsieve.plans.partition import bit_counts
from subsieve.runtime import cut, ship
from subsieve.schema import WIDTH


def _uniform(seed: int, *salt):
    """A number in [0, 1) that depends only on the seed and the salt, so that a lost partition is made again alike."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *salt), 11) / float(1 << 53)


def zipf_weights(n: int, s: float) -> list[float]:
    """Cumulative weights of the ranks 0..n-1; the weight of rank r is floor(n / (r + 1)) ** s, the generator's."""
    out, total = [], 0.0
    for r in range(n):
        total += float(n // (r + 1)) ** s
        out.append(total)
    return out


def _mixed(*parts) -> np.ndarray:
    """Numbers in [0, 1) that depend only on the parts, which are broadcast against each other."""
    x = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(32))
    return (x >> np.uint64(11)) / float(1 << 53)


#: Rounds of drawing again before the rest of a set is drawn from the tags that are left.
ROUNDS = 24


def draw_sets(ids: np.ndarray, counts: np.ndarray, seed: int, space: int, weights: np.ndarray | None) -> list[list[int]]:
    """For each id ``count`` distinct tags under ``space``, drawn one after the other, uniformly or by cumulative weights.

    Tags are drawn until enough are distinct. Sets that are still short after some rounds, where a few heavy tags
    come again and again, get the rest by exponential keys over the tags that are left: the same distribution."""
    sets: list[dict[int, None]] = [{} for _ in ids]
    open_ = np.arange(len(ids))
    for turn in range(ROUNDS):
        if not len(open_):
            break
        u = _mixed(seed, ids[open_, None], turn, np.arange(int(counts[open_].max()))[None, :])
        drawn = (u * space).astype(np.int64) if weights is None else np.minimum(np.searchsorted(weights, u * weights[-1], "right"), space - 1)
        for i, row in zip(open_.tolist(), drawn.tolist(), strict=True):
            have = sets[i]
            for tag in row:
                if len(have) == counts[i]:
                    break
                have[tag] = None
        open_ = open_[[len(sets[i]) < counts[i] for i in open_.tolist()]]
    for i in open_.tolist():
        weight = np.ones(space) if weights is None else np.diff(weights, prepend=0.0)
        late = -np.log1p(-_mixed(seed, ids[i], ROUNDS, np.arange(space))) / weight
        late[list(sets[i])] = np.inf
        for tag in np.argsort(late, kind="stable")[: int(counts[i]) - len(sets[i])].tolist():
            sets[i][tag] = None
    return [list(s) for s in sets]


def generate(spark: SparkSession, n: int, least: int = 1, most: int = 10, tags: str = "uniform", space: int = 100_000, zipf_s: float = 1.0, k: int = bloom.K, ifaces: tuple[int, int] = (0, 0), trees: tuple[int, int] | None = None, dictionary: list[list[int]] | None = None, dictionary_count: int = 0, seed: int = 1) -> DataFrame:
    """n rows (id, tags, b0..b2, iface, tree): a set of ``least``..``most`` distinct random tags, uniform or Zipf over
    ``space`` (``tags="bits"``: as many times k random positions instead), united with sets of a dictionary."""
    if tags != "bits" and most > space:
        raise ValueError("a set can't have more distinct tags than there are")
    rows = spark.range(n)
    count = (F.lit(least) + F.floor(_uniform(seed, F.col("id"), F.lit("n")) * (most - least + 1))).cast("int")
    draw = lambda i, what: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.lit(what), i), 11) / float(1 << 53)
    if tags == "bits":
        positions = F.transform(F.sequence(F.lit(1), count * k), lambda i: F.floor(draw(i, "bit") * WIDTH).cast("int"))
        out, bits = rows.withColumn("tags", F.array().cast("array<bigint>")), Bits.from_positions(positions)
    else:
        ship(spark)
        weights = np.array(zipf_weights(space, zipf_s)) if tags == "zipf" else None
        shared = spark.sparkContext.broadcast((seed, space, weights))

        def drawn(batches):
            for b in batches:
                made = draw_sets(b.column(0).to_numpy(), b.column(1).to_numpy(), *shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "tags"])

        out = rows.select("id", count.alias("count")).mapInArrow(drawn, "id bigint, tags array<bigint>")
        bits = bloom.encode(F.col("tags"), k)
    if dictionary and dictionary_count:
        listed = F.array(*(F.array(*map(F.lit, d)) for d in dictionary))
        taken = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(dictionary_count)), lambda i: F.get(listed, F.floor(draw(i, "dict") * len(dictionary)).cast("int"))))
        bits = bits | Bits.from_positions(taken)
    between = lambda lo_hi, what: (F.lit(lo_hi[0]) + F.floor(_uniform(seed, F.col("id"), F.lit(what)) * (lo_hi[1] - lo_hi[0] + 1))).cast("int")
    return out.select("id", "tags", *bits.columns(), between(ifaces, "iface").alias("iface"), (between(trees, "tree") if trees else F.lit(None).cast("int")).alias("tree"))


def sample(rows: DataFrame, k: int, n: int | None = None, order: str = "id", seed: int = 1) -> DataFrame:
    """Exactly k of the first n rows (of all by default) by ``order``, each choice equally likely; k >= n takes them all."""
    first = rows if n is None else rows.orderBy(order).limit(n)
    if n is not None and k >= n:
        return first
    return first.withColumn("_h", F.xxhash64(F.lit(seed), F.col(order))).orderBy("_h", order).limit(k).drop("_h")


def frequencies(filters: DataFrame) -> DataFrame:
    """(pos, freq, pct) of all positions, in one pass."""
    counts = filters.agg(F.count("*").alias("n"), bit_counts(Bits.of()).alias("counts"))
    freq = F.coalesce(F.col("freq"), F.lit(0))
    return counts.select("n", F.posexplode("counts").alias("pos", "freq")).select("pos", freq.alias("freq"), F.when(F.col("n") > 0, 100.0 * freq / F.col("n")).alias("pct"))


def permutation(freqs: DataFrame, rarest_first: bool = True) -> list[int]:
    """New place of every position when ordered by frequency (ties by position)."""
    order = sorted((r["freq"] if rarest_first else -r["freq"], r["pos"]) for r in freqs.collect())
    out = [0] * WIDTH
    for new, (_, old) in enumerate(order):
        out[old] = new
    return out


def permute(rows: DataFrame, new_of: list[int]) -> DataFrame:
    """``rows`` with permuted sets; all else as it was."""
    moved = dict(zip(("b0", "b1", "b2"), Bits.of().permute(new_of).columns(), strict=True))
    return rows.select(*(moved.get(c, F.col(f"`{c}`")) for c in rows.columns))  # all words from the old ones at once


def sort_descending(rows: DataFrame, first: int | None = None) -> DataFrame:
    """From the greatest set to the least in the order of the 0/1 texts; only the ``first`` so many if that is given."""
    out = rows.orderBy(Bits.of().to_ascii().desc())
    return out if first is None else out.limit(first)


def sorted_in_partitions(rows: DataFrame, pid: str = "pid") -> DataFrame:
    """``rows`` with each partition's sets together, from the greatest to the least, to be written or cached so."""
    return rows.repartition(pid).sortWithinPartitions(pid, Bits.of().to_ascii().desc())


def out_of_order(rows: DataFrame, place: str) -> DataFrame:
    """The rows, by their order in the column ``place`` (0, 1, ...), whose set is greater than the one before it: none
    if the rows are sorted from the greatest."""
    after = rows.select((F.col(place) + 1).alias(place), *(F.col(c).alias(f"p{c[1:]}") for c in ("b0", "b1", "b2")))
    return rows.join(after, place).filter(Bits.of("p").less(Bits.of())).drop("p0", "p1", "p2")


def popcount_range(rows: DataFrame) -> DataFrame:
    """(sets, least, most, mean) of the numbers of bits."""
    n = Bits.of().popcount()
    return rows.agg(F.count("*").alias("sets"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"))


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... by ``order``.

    A sort by ranges is written down; the ranges' counts, one row each, give where every range begins, and places within
    a range are numbered in a window of its own."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(begins), "_range").select(*rows.columns, (F.col("_begin") + F.col("_place")).alias("place"))
