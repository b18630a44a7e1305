"""Balanced partitions of sets: each has at most so many sets, and all its sets share at least one bit.

Level by level, every group that is too large is split on the bit whose frequency is nearest to half of it.
Where even that bit parts off less than an eighth, the group is split many ways at once: each set goes to the
commonest of its bits. A group that is small enough but has no common bit is finished in one go, in one task
as it is small: its commonest bit (the lowest of equals) parts off a partition, and again on the rest.

One aggregation per level counts all bits of all groups; the pivots stay in a table and are joined back, so
neither filters nor groups come to the driver. Ids say nothing; compare groups only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits, common_all
from subsieve.runtime import cut, ship
from subsieve.schema import WIDTH, words

WORDS = words()


def bit_counts(b: Bits) -> Column:
    """Aggregate: an array with the frequency of every position."""
    return F.array(*(F.sum(F.when(b.test(p), 1).otherwise(0)) for p in range(b.width)))


def less_counts(counts: Column, part: Column) -> Column:
    """The frequencies of a group without one of its parts, both arrays by position."""
    return F.zip_with(counts, part, lambda a, b: a - b)


def pivots(groups: DataFrame) -> DataFrame:
    """(group, pivot, order) of groups (group, n, counts) to be split: the bit to split on, or, where no bit parts off
    an eighth, all bits from the commonest. Groups of equal sets have no row."""
    bits = groups.select("group", "n", F.posexplode("counts").alias("pos", "freq")).filter((F.col("freq") > 0) & (F.col("freq") < F.col("n")))
    half = F.struct(F.abs(F.col("freq") - F.floor(F.col("n") / 2)), "pos")
    less = F.least(F.col("freq"), F.col("n") - F.col("freq"))
    best = bits.groupBy("group").agg(F.min_by("pos", half).alias("pivot"), (F.max(less) * 8 < F.first("n")).alias("wide"), F.collect_list(F.struct((-F.col("freq")).alias("f"), F.col("pos").alias("p"))).alias("all"))
    return best.select("group", "pivot", F.when(F.col("wide"), F.transform(F.array_sort("all"), lambda x: x["p"])).alias("order"))


def cover(pdf: pd.DataFrame) -> pd.DataFrame:
    """One small group's sets with the number of the partition they end in: greedy, by the commonest bit of the rest."""
    raw = np.ascontiguousarray(pdf[WORDS].to_numpy(np.int64), "<i8").view(np.uint8).reshape(len(pdf), -1)
    bits = np.unpackbits(raw, axis=1, bitorder="little").astype(bool)
    out, left, k = np.zeros(len(pdf), int), np.ones(len(pdf), bool), 0
    while left.any():
        counts = bits[left].sum(0)
        common = counts.max()
        part = left & bits[:, int(counts.argmax())] if 0 < common < left.sum() else left
        out[part] = k
        left, k = left & ~part, k + 1
    return pdf.assign(group=pdf["group"] + [f"c{x:06d}" for x in out])


def balanced_partitions(filters: DataFrame, max_size: int = 1000, max_levels: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rows, masks): ``filters`` with ``pid``, and (pid, m0..m2, size) of every partition.

    Equal sets always share a partition and count as one; an empty set is in a partition of empty sets, whose
    mask is empty and in every query."""
    b = Bits.of()
    open_ = cut(filters.select(*WORDS).distinct().withColumn("group", F.lit("")))
    closed, apart = None, None
    for _ in range(max_levels):
        groups = cut(open_.groupBy("group").agg(F.count("*").alias("n"), bit_counts(b).alias("counts")).withColumn("common", F.exists("counts", lambda c: c == F.col("n"))))
        at = pivots(groups.filter(F.col("n") > max_size)).join(groups.filter(F.col("n") > max_size).select("group"), "group", "right")
        told = cut(groups.select("group", "n", "common").join(at, "group", "left"))
        joined = open_.join(told, "group", "left")
        ready = joined.filter("pivot is null")
        done, rest = (x.select("group", *WORDS) for x in (ready.filter("common"), ready.filter("not common")))
        closed, apart = (x if y is None else y.unionByName(x) for x, y in ((done, closed), (rest, apart)))
        if not told.filter("pivot is not null").limit(1).count():
            break
        first = F.get(F.filter("order", lambda p: b.test(p)), F.lit(0))
        side = F.when(F.col("order").isNotNull(), F.concat(F.lit("w"), F.lpad(F.coalesce(first, F.lit(999)).cast("string"), 3, "0"))).when(b.test(F.col("pivot")), "1").otherwise("0")
        open_ = cut(joined.filter("pivot is not null").select(*WORDS, F.concat("group", side).alias("group")))
    ship(filters.sparkSession)
    covered = apart.groupBy("group").applyInPandas(cover, "group string, b0 bigint, b1 bigint, b2 bigint")
    closed = cut(closed.unionByName(covered))
    names = cut(closed.select("group").distinct().withColumn("pid", F.monotonically_increasing_id()))  # once written, ids stay
    placed = cut(closed.join(names, "group").drop("group"))
    return filters.join(placed, WORDS), common_all(placed, ["pid"])


#: Sets with one head that a task of the prefix split takes, at most, where longer heads can tell them apart.
HEAD_SETS = 200_000


def cut_runs(texts: np.ndarray, max_size: int) -> np.ndarray:
    """Number of the run of each text, of 0/1 texts from the greatest to the least.

    A run is cut where neighbours share least within what it may hold, the first such place, so that the runs' prefixes
    are long; a rest that one run may hold is one run."""
    width = max(map(len, texts), default=1)
    chars = np.array(texts, f"S{width}").view(np.uint8).reshape(len(texts), -1)
    differ = chars[1:] != chars[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), width)  # of each text and the next
    out, start, run = np.empty(len(texts), np.int64), 0, 0
    while start < len(texts):
        end = len(texts)
        if end - start > max_size:
            near = shared[start : start + max_size - 1]
            # texts that are all alike go on to the end of the window
            end = start + 1 + (int(near.argmin()) if len(near) and near.min() < width else len(near))
        out[start:end] = run
        start, run = end, run + 1
    return out


def leading_runs(filters: DataFrame, max_size: int = 100, min_ones: int = 2) -> DataFrame:
    """``filters`` with ``pid``: runs, in descending order of the sets, that share a prefix holding more than
    ``min_ones`` 1-bits (or the set itself), of at most ``max_size`` sets.

    Runs are cut apart within heads, the prefixes up to the bit after ``min_ones`` 1-bits, as no run spans two of
    them. Heads that too many sets share are made longer by a 1-bit, until a task can hold each."""
    text = Bits.of().to_ascii()
    ones = Bits.of().positions()
    dealt = cut(filters.withColumns({"_text": text, "_head": F.substring(text, F.lit(1), F.coalesce(F.get(ones, F.lit(min_ones)) + 1, F.lit(WIDTH)))}))
    for depth in range(min_ones + 1, WIDTH):
        large = cut(dealt.groupBy("_head").agg(F.count("*").alias("_n")).filter((F.col("_n") > HEAD_SETS) & (F.length("_head") < WIDTH)).select("_head", F.lit(True).alias("_large")))
        if not large.limit(1).count():
            break
        longer = F.substring("_text", F.lit(1), F.coalesce(F.get(ones, F.lit(depth)) + 1, F.lit(WIDTH)))
        dealt = cut(dealt.join(large, "_head", "left").withColumn("_head", F.when(F.col("_large"), longer).otherwise(F.col("_head"))).drop("_large"))
    ship(filters.sparkSession)
    kind = filters.schema.simpleString()[len("struct<") : -1]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_text", ascending=False, kind="stable")
        return pdf.assign(run=cut_runs(pdf["_text"].to_numpy(), max_size)).drop(columns="_text")

    runs = cut(dealt.groupBy("_head").applyInPandas(split, f"{kind}, _head string, run bigint"))
    names = cut(runs.select("_head", "run").distinct().withColumn("pid", F.monotonically_increasing_id()))
    return runs.join(names, ["_head", "run"]).select(*filters.columns, "pid")


def prefixes(split: DataFrame) -> DataFrame:
    """(pid, m0..m2, length, size) of a prefix split: the bits of the prefix that all sets of a run share."""
    text = Bits.of().to_ascii()
    ends = split.groupBy("pid").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count("*").alias("size"))
    length = Bits.parse(F.col("lo")).leftmost_diff(Bits.parse(F.col("hi")))
    kept = Bits.parse(F.col("lo")).between(0, F.col("length"))
    return ends.withColumn("length", length.cast("int")).select("pid", *kept.columns("m"), "length", "size")
