"""Sharding by a k-d tree over metadata, with leaves of near equal bytes.

The root holds all rows; a node that stands for k shards is split at the weighted quantile k//2 / k of its
bytes along its widest dimension (extent over the whole table's extent), until each leaf stands for one
shard. All nodes of a level are searched at once: each pass deals the rows of the cells that hold the cuts
to ``BINS`` bins, sums their bytes by distributed aggregation and keeps, per node, the bin that the cut
falls in. Ties along the dimension go on by the hash of the row's group and then by the hash of its id, so
a cut is never stuck on a value that a third of the rows share.

Rows of one group (the query's: equal texts) have the same dimensions and stay in one shard, unless the
group is larger than ``group_share`` of a shard's bytes and a cut falls in it; such a group is split, as no
near equal shards could hold it.

The driver holds a few numbers per shard. A row's shard is a function of the row and the tree, applied by
broadcast joins with the tree's levels (one row per node), without a shuffle.

Defined results: null dimensions sort below all others, null and empty texts have no bytes; repeated rows are of one
group; a very long text is one row, so its shard may exceed the others by it; an empty table has an empty tree; more
shards than distinct rows leave shards empty; a column of the output's name is replaced and all others stay,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subsieve.runtime import cut

from .common import fresh

BINS = 2048
#: Rows that one numbering window holds on average, at most.
SLOT_ROWS = 50_000


def code(c: Column) -> Column:
    """A non-negative integer in the order of the first six bytes of a string; 0 for null."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("bigint") + 1, F.lit(0))


def number(c: Column) -> Column:
    """A non-negative integer in the order of non-negative numbers; 0 for null."""
    return F.coalesce(F.greatest(c.cast("bigint"), F.lit(0)) + 1, F.lit(0))


def hashed(*c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*c), 1)


@dataclass
class Tree:
    """``levels[i]``: (node, dim, v, g, t) of the nodes split at depth i; rows from (v, g, t) on go right. Node 1 is the root."""

    n_shards: int
    levels: list[list[tuple]] = field(default_factory=list)
    shard: dict[int, int] = field(default_factory=dict)


@dataclass
class _Cell:
    """Where a node's cut lies: rows with the fixed values whose ``stage`` value is from lo to hi."""

    dim: int
    goal: float
    stage: int
    lo: int
    hi: int
    below: float = 0.0
    fixed: tuple = ()


def _walk(rows: DataFrame, levels: list[list[tuple]], dims: int) -> DataFrame:
    """``rows`` (v array, g, t, node: 1) with the column node after the given levels."""
    out = rows
    for level in levels:
        cuts = F.broadcast(rows.sparkSession.createDataFrame(level, "node bigint, d int, cv bigint, cg bigint, ct bigint"))
        v = F.col("v")[F.col("d")]
        right = (v > F.col("cv")) | ((v == F.col("cv")) & ((F.col("g") > F.col("cg")) | ((F.col("g") == F.col("cg")) & (F.col("t") >= F.col("ct")))))
        out = out.join(cuts, "node", "left").withColumn("node", F.when(F.col("d").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("bigint"))).drop("d", "cv", "cg", "ct")
    return out


def _narrow(rows: DataFrame, cells: dict[int, _Cell]) -> dict[int, tuple]:
    """For each cell the bin that its cut falls in: (bytes before it, its bytes, least and greatest of stage, g, t)."""
    table = [(n, c.dim, c.stage, c.lo, float(c.hi - c.lo + 1), c.hi, c.goal, c.below, *(c.fixed + (0, 0))[:2]) for n, c in cells.items()]
    spark = rows.sparkSession
    at = F.broadcast(spark.createDataFrame(table, "node bigint, d int, stage int, lo bigint, width double, hi bigint, goal double, below double, fv bigint, fg bigint"))
    v = F.col("v")[F.col("d")]
    j = rows.join(at, "node").withColumn("x", F.when(F.col("stage") == 0, v).when(F.col("stage") == 1, F.col("g")).otherwise(F.col("t")))
    j = j.filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")) & ((F.col("stage") == 0) | (v == F.col("fv"))) & ((F.col("stage") < 2) | (F.col("g") == F.col("fg"))))
    binned = j.withColumn("bin", ((F.col("x") - F.col("lo")).cast("double") / F.col("width") * BINS).cast("int"))
    sums = binned.groupBy("node", "bin").agg(F.sum("size").cast("double").alias("w"), F.first("goal").alias("goal"), F.first("below").alias("below"), *(f(c).alias(f"{n}_{c}") for c in ("x", "g", "t") for n, f in (("min", F.min), ("max", F.max))))
    upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    last = F.row_number().over(Window.partitionBy("node").orderBy(F.col("bin").desc())) == 1
    crossing = sums.withColumn("upto", upto).withColumn("last", last).filter((F.col("upto") - F.col("w") < F.col("goal")) & ((F.col("upto") >= F.col("goal")) | F.col("last")))
    return {r["node"]: (r["upto"] - r["w"], r["w"], r["min_x"], r["max_x"], r["min_g"], r["max_g"], r["min_t"], r["max_t"]) for r in crossing.collect()}


def grow(rows: DataFrame, dims: int, n_shards: int, group_share: float = 0.02) -> Tree:
    """The tree over ``rows``: v (array of ``dims`` order-preserving integers), g (group hash), t (id hash), size."""
    tree, width = Tree(n_shards), []
    span = {1: (0, n_shards)}
    total = 0.0
    while True:
        open_ = {n: k for n, (_, k) in span.items() if k > 1}
        if not open_:
            break
        at = _walk(rows, tree.levels, dims)
        extents = at.groupBy("node").agg(F.sum("size").cast("double").alias("w"), *(f(F.col("v")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))).collect()
        if not tree.levels:
            total = sum(r["w"] for r in extents)
            width = [max([r[f"hi{d}"] - r[f"lo{d}"] for r in extents], default=0) for d in range(dims)]
        cells = {}
        for r in extents:
            if (k := open_.get(r["node"], 0)) > 1:
                d = max(range(dims), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / max(1, width[d]), -d))
                cells[r["node"]] = _Cell(d, r["w"] * (k // 2) / k, 0, r[f"lo{d}"], r[f"hi{d}"])
        limit, cuts = group_share * total / n_shards, {}
        while cells:
            found, later = _narrow(at, cells), {}
            for n, c in cells.items():
                before, w, lo, hi, g0, g1, t0, t1 = found[n]
                if lo < hi:
                    later[n] = _Cell(c.dim, c.goal, c.stage, lo, hi, before, c.fixed)
                elif c.stage == 0 and (w > limit or g0 < g1):
                    later[n] = _Cell(c.dim, c.goal, 1, g0, g1, before, (lo,))
                elif c.stage == 1 and w > limit and t0 < t1:
                    later[n] = _Cell(c.dim, c.goal, 2, t0, t1, before, (*c.fixed, lo))
                else:  # one value: it goes to the side where it misses the goal by less
                    point = (*c.fixed, lo + int(c.goal - before > w / 2))
                    cuts[n] = (n, c.dim, *(point + (0, 0))[:3])
            cells = later
        tree.levels.append(list(cuts.values()))
        after = {}
        for n, (a, k) in span.items():
            if k > 1 and n in cuts:
                after |= {2 * n: (a, k // 2), 2 * n + 1: (a + k // 2, k - k // 2)}
            else:
                after[n] = (a, 1)
        span = after
        if not cuts:
            tree.levels.pop()
    tree.shard = {n: a for n, (a, _) in span.items()}
    return tree


def assign(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """``rows`` with their shard; no shuffle."""
    leaves = rows.sparkSession.createDataFrame(list(tree.shard.items()), "node bigint, shard int")
    return _walk(rows, tree.levels, dims).join(F.broadcast(leaves), "node").drop("node")


def prepared(docs: DataFrame, dims: list[Column], size: Column, group: Column, tie: Column) -> DataFrame:
    """``docs`` with the columns v, g, t, size and node that the tree reads (other columns must not have these names)."""
    return docs.withColumns({"v": F.array(*dims), "g": group, "t": tie, "size": size.cast("bigint"), "node": F.lit(1).cast("bigint")})


def numbered(rows: DataFrame, n_rows: int, n_shards: int, shard: str = "shard", tie: str = "t", order: tuple[str, ...] = (), output: str = "slot") -> DataFrame:
    """``rows`` with a gapless place in each shard. A shard's rows are numbered in as many windows as their count asks
    for, dealt by the hash ``tie``, and each window starts where the windows before it end."""
    parts = max(1, -(-n_rows // (n_shards * SLOT_ROWS)))
    bucket, count, before, within = fresh(rows, "bucket", "count", "before", "within")
    dealt = rows.withColumn(bucket, F.pmod(F.col(tie), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(shard, bucket).agg(F.count("*").alias(count))
    starts = counts.select(shard, bucket, (F.sum(count).over(Window.partitionBy(shard).orderBy(bucket)) - F.col(count)).alias(before))
    place = F.row_number().over(Window.partitionBy(shard, bucket).orderBy(tie, *order)) - 1
    kept = [F.col(f"`{c}`") for c in rows.columns if c != output]
    return dealt.withColumn(within, place).join(starts, [shard, bucket]).select(*kept, (F.col(within) + F.col(before)).cast("bigint").alias(output))


def shard_documents(docs: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, dims: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", output: str = "shard") -> DataFrame:
    """``docs`` with their shard, by ``n_shards`` or by as many as ``target_bytes`` asks for. ``dims`` maps columns to
    "code" (strings) or "number"; the text's bytes are always a dimension."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 8
    point = [*({"code": code, "number": number}[kind](F.col(c)) for c, kind in (dims or {}).items()), number(size)]
    if n_shards is None:
        n_shards = max(1, -(-(docs.agg(F.sum(size)).first()[0] or 0) // (target_bytes or 1 << 30)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that its columns' names can't clash
    read = {"v": F.array(*point), "g": hashed(F.col(text)), "t": hashed(F.col(key)), "size": size.cast("bigint"), "node": F.lit(1).cast("bigint")}
    columns = [c.alias(n) for n, c in read.items()]
    tree = grow(cut(docs.select(*columns)), len(point), n_shards)
    wide = docs.select(row, *columns)
    return assign(wide, tree, len(point)).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != output], F.col("shard").alias(output))
