"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code of ``bits`` bits is cut into m segments; two codes at distance d agree, in some segment, up to distance
floor(d / m). Searching all segments within radius s therefore meets every code at distance up to
m * (s + 1) - 1. The radius grows by one per round: queries probe the segment values at exactly the new radius
(an equi-join of probes with the index, no scan), candidates are verified on whole codes, and a query ends as
soon as its kth verified distance is covered. m follows the number of distinct codes in two steps (segments of
16 or about 22 bits; the method's authors advise about the logarithm of the number), so that the probes of a
radius grow with the queries alone. A value that very many codes have is dealt over several join keys. Once k codes
are verified, their kth distance bounds the rest of a query's search: candidates beyond it are not emitted, and the
last radius is used in only so many segments as that distance asks for.

Equal codes are one index entry that keeps its k least ids: more can be in no answer. Equal query codes are
searched once. A pair that several segments or radii would find is emitted only by the first one, decided by
arithmetic on the two codes, so nothing needs to be made distinct.

Defined results: rows with a null id or null vector are neither indexed nor asked; null, NaN and missing
elements give bit 0, as do those not above zero; ties in distance go by id; repeated ids are one entry per
row; a table with fewer than k rows answers with all of them, an empty one with none; columns beside id and code
are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsieve.runtime import cut

#: Codes with one value of a segment that wait at one join key.
HOT = 4096
#: Hot values, at most, whose table (16 bytes each) is broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOT = 1 << 18


def sign_code(vector: str | Column, bits: int = 64) -> Column:
    """A 64-bit integer whose bit i says whether element i is above zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bit = lambda i: F.when(F.coalesce((F.get(v, F.lit(i)) > 0) & ~F.isnan(F.get(v, F.lit(i)).cast("double")), F.lit(False)), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
    out = bit(0)
    for i in range(1, bits):
        out = out.bitwiseOR(bit(i))
    return F.when(v.isNotNull(), out)


def segments(bits: int, n_codes: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for an index of so many codes: 16 bits each, or 22 where more than 2 ** 20
    codes make values of 16 bits too common. A radius asks for equally many probes of a query at every size between."""
    m = max(1, round(bits / (16 if n_codes <= 1 << 20 else 21.4)))
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def masks(width: int, radius: int) -> Column:
    """An array of all values of ``width`` bits with ``radius`` ones: a literal while that is short, else made in the row."""
    if math.comb(width, radius) <= 100_000:
        return F.split(F.lit(",".join(str(sum(1 << i for i in c)) for c in combinations(range(width), radius))), ",").cast("array<bigint>")
    return F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << width) - 1).cast("bigint")), lambda x: F.bit_count(x) == radius)


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, key: str = "vec_id", code: str = "code") -> DataFrame:
    """(query id, neighbour id, distance, rank): the k nearest of ``rows`` for each of ``queries``; both have ``key`` and ``code``."""
    entries = rows.select(F.col(key).alias("id"), F.col(code).alias("c")).filter("id is not null and c is not null")
    # the k least ids of each code: a row's rank among its code's rows, cut at k before the shuffle
    rank = F.row_number().over(Window.partitionBy("c").orderBy("id"))
    index = cut(entries.withColumn("r", rank).filter(F.col("r") <= k).groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = cut(queries.select(F.col(key).alias("qid"), F.col(code).alias("q")).filter("qid is not null and q is not null"))
    n = index.count()
    segs = segments(bits, n)
    m = len(segs)
    parts = index.select("c", F.size("ids").alias("n"), F.posexplode(F.array(*(_segment(F.col("c"), *s) for s in segs))).alias("j", "value"))
    # a value that very many codes have is dealt over several keys, on which the probes of that value are repeated
    hot = cut(parts.groupBy("j", "value").agg(F.ceil(F.count("*") / HOT).cast("int").alias("deals")).filter("deals > 1"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot.hint("merge")
    parts = cut(parts.join(hot, ["j", "value"], "left").select("c", "n", "j", "value", F.pmod(F.xxhash64("c"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal")))
    active = asked.select("q", F.lit(bits).alias("far")).distinct()
    best = answers = None
    for s in range(max(w for _, w in segs) + 1):
        probes = None
        for j, (shift, width) in enumerate(segs):
            if s > width:
                continue
            # with radius s in segments 0..j and s - 1 in the others, all codes up to distance m * s + j are met
            own = _segment(F.col("q"), shift, width)
            p = active.filter(F.col("far") >= m * s + j).select("q", "far", own.alias("own"), F.explode(masks(width, s)).alias("mask"))
            p = p.select("q", "far", F.lit(j).alias("j"), F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
            probes = p if probes is None else probes.unionAll(p)
        dealt = probes.join(hot, ["j", "value"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
        found = dealt.hint("merge").join(parts, ["j", "value", "deal"])  # Catalyst takes the exploded side for small
        # segment distances decide which probe reports a pair: the first segment at radius s, none being nearer
        first = _distance(F.col("q"), F.col("c")) <= F.col("far")
        for j, (shift, width) in enumerate(segs):
            d = F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("c")), shift, width))
            first = first & F.when(F.lit(j) < F.col("j"), d > s).otherwise(d >= s)
        pairs = found.filter(first).select("q", "c", "n", _distance(F.col("q"), F.col("c")).alias("d"))
        # codes at rank beyond k by (distance, code) can't matter: k codes hold k ids at least
        pairs = pairs if best is None else pairs.unionByName(best.join(active, "q", "left_semi"))
        near = pairs.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy("d"))).filter(F.col("r") <= k).drop("r")
        upto = F.sum("n").over(Window.partitionBy("q").orderBy("d"))  # of equal distances all count
        near = near.withColumns({"upto": upto, "same": F.sum("n").over(Window.partitionBy("q", "d"))}).filter(F.col("upto") - F.col("same") < k)
        best = cut(near.select("q", "c", "n", "d", "upto"))
        state = best.groupBy("q").agg(F.max("upto").alias("held"), F.max("d").alias("last"))
        done = (F.coalesce("held", F.lit(0)) >= k) & (F.col("last") < m * (s + 1)) if s < max(w for _, w in segs) else F.lit(True)
        # the kth distance so far bounds what is still looked for
        after = cut(active.join(state, "q", "left").select("q", F.when(F.coalesce("held", F.lit(0)) >= k, F.col("last")).otherwise(F.col("far")).cast("int").alias("far"), F.coalesce(done, F.lit(False)).alias("done")))
        part = best.join(after.filter("done"), "q", "left_semi").select("q", "c", "d")
        answers = part if answers is None else answers.unionByName(part)
        best = best.drop("upto")
        active = after.filter("not done").select("q", "far")
        if not active.limit(1).count():
            break
    hits = answers.join(index, "c").select("q", "d", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy("d", "id")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(top, "q").select("qid", F.col("id"), F.col("d").cast("int").alias("distance"), F.col("rank").cast("int").alias("rank"))
