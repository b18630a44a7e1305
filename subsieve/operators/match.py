"""Containment joins between stored sets and queries, and the answers made of their pairs.

``filters`` and ``queries`` have the words b0..b2; filters carry any payload (keys, ids, tags), queries ``qid``
and any payload. Every strategy gives the same pairs:

nested_loop   broadcast nested loop over the smaller side while that side's size is known to be bounded, optionally
              behind a test of the two popcounts; beyond the bound it is the anchor join.
mask_routed   queries meet the common masks of balanced partitions (few: broadcast; many: by anchors), then join
              their partitions by id.
anchor        each set waits at its two rarest bits; queries go to those pairs of their bits that some set waits at.
              An equi-join; pairs with very many sets are dealt over several keys.
tag_anchor    each set waits at the exact tag that fewest queries hold; queries go to their tags. An equi-join
              with as many keys as there are tags, for large sides; needs ``tags`` on both and re-checks them.

``auto`` takes tag_anchor where both sides have exact tags, else nested_loop under the bound, else anchor. A
superset search is the subset join with the sides exchanged, so it has the same strategies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits
from subsieve.plans.partition import balanced_partitions
from subsieve.runtime import cut
from subsieve.schema import words

#: A side of a nested loop is broadcast only if Catalyst's size estimate, an upper bound here, is under this.
BROADCAST_BYTES = 64 << 20
#: An anchor with more sets than this is dealt over several join keys.
SALT_ROWS = 100_000
#: A query with more tags than this goes to them without carrying them along.
CARRIED_TAGS = 32
STRATEGIES = ("auto", "nested_loop", "mask_routed", "anchor", "tag_anchor")
WORDS = words()


def size_bound(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of a table; where that is unknown or above the bound, rows are counted (a
    distributed count) and taken at a width by their columns, lists and texts at 1,024 bytes."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate <= BROADCAST_BYTES:
        return estimate
    row = max(64, sum(_width(f.dataType.simpleString()) for f in df.schema.fields))
    return min(estimate, df.count() * row)


def _width(kind: str) -> int:
    """Bytes that a value takes, about; lists and strings are taken to be long."""
    return 8 if kind in ("bigint", "int", "double", "boolean") else 1024


def _bytes(df: DataFrame, tags: str) -> int:
    """Bytes of all rows, about, by one distributed sum: as JSON, and 16 more a tag."""
    row = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) + 16 * F.coalesce(F.size(tags), F.lit(0))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def _sides(filters: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with their words named q0..q2, so that a joined row has both sets."""
    clash = ({c for c in filters.columns} & {c for c in queries.columns}) - {*WORDS}
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}; rename them first")
    return filters, queries.withColumnsRenamed({f"b{k}": f"q{k}" for k in range(len(WORDS))})


def _condition(relation: str) -> Column:
    s, q = Bits.of("b"), Bits.of("q")
    return {"subset": s.subset_of(q), "superset": q.subset_of(s), "equal": s.equals(q)}[relation]


def nested_loop(filters: DataFrame, queries: DataFrame, relation: str = "subset", popcounts: bool = False) -> DataFrame:
    """All pairs tested, the smaller side broadcast behind a check of its size; beyond it, the anchor join.

    With ``popcounts`` both sides' numbers of bits are computed once a row, and only pairs that these allow are tested."""
    f, q = _sides(filters, queries)
    a, b = size_bound(f), size_bound(q)
    if min(a, b) > BROADCAST_BYTES:
        return anchor(filters, queries) if relation == "subset" else around(filters, queries)
    condition = _condition(relation)
    kept, asked = f, q
    if popcounts:
        kept, asked = f.withColumn("_pf", Bits.of("b").popcount()), q.withColumn("_pq", Bits.of("q").popcount())
        condition = ((F.col("_pf") <= F.col("_pq")) if relation == "subset" else (F.col("_pq") <= F.col("_pf"))) & condition
    return (F.broadcast(kept).join(asked, condition) if a < b else kept.join(F.broadcast(asked), condition)).select(*f.columns, *q.columns)


def equal(filters: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact lookup: an equi-join on the words."""
    f, q = _sides(filters, queries)
    return f.join(q, reduce(Column.__and__, (F.col(f"b{k}") == F.col(f"q{k}") for k in range(len(WORDS)))))


def route(masks: DataFrame, queries: DataFrame) -> DataFrame:
    """(pid, queries' columns): the partitions whose common mask a query holds. Masks are one row per partition."""
    m, q = Bits.of("m"), Bits.of("b")
    side = masks.select("pid", *words("m"))
    if size_bound(side) <= BROADCAST_BYTES:
        return queries.join(F.broadcast(side), m.subset_of(q)).drop(*words("m"))
    met = anchor(side.withColumnsRenamed({f"m{k}": f"b{k}" for k in range(len(WORDS))}), queries)
    return met.drop(*WORDS).withColumnsRenamed({f"q{k}": f"b{k}" for k in range(len(WORDS))}).select(*queries.columns, "pid")


def mask_routed(filters: DataFrame, queries: DataFrame, max_partition: int = 1000, partitioned: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Two stages: queries to partitions by mask, then an equi-join on the partition with the subset test as residual."""
    rows, masks = partitioned or balanced_partitions(filters, max_partition)
    routed = route(masks, queries).withColumnsRenamed({f"b{k}": f"q{k}" for k in range(len(WORDS))})
    out = rows.join(routed, "pid").filter(_condition("subset"))
    return out.select(*filters.columns, *[c for c in routed.columns if c != "pid"])


def _rarest(filters: DataFrame) -> list[int]:
    """Bit positions from the rarest to the commonest among the filters: 192 counters."""
    counts = filters.agg(*(F.sum(F.when(Bits.of().test(p), 1).otherwise(0)).alias(str(p)) for p in range(64 * len(WORDS)))).first()
    return sorted(range(64 * len(WORDS)), key=lambda p: (counts[p] or 0, p))


def anchor(filters: DataFrame, queries: DataFrame) -> DataFrame:
    """An equi-join on each set's two rarest bits (one bit for sets of one; empty sets are in every query).

    A query's bits first meet the pairs that sets wait at, at most 18,529 and so broadcast, and go on only to those
    whose second bit it has too."""
    f, q = _sides(filters, queries)
    order = _rarest(filters)
    place = F.array(*map(F.lit, [order.index(p) for p in range(len(order))]))
    bit = F.array(*map(F.lit, order))
    ranks = F.slice(F.array_sort(F.transform(Bits.of("b").positions(), lambda p: F.get(place, p))), 1, 2)
    kept = f.withColumn("_r", ranks).withColumns({"_x": F.coalesce(F.get(bit, F.get("_r", F.lit(0))), F.lit(-1)), "_y": F.coalesce(F.get(bit, F.get("_r", F.lit(1))), F.lit(-1))}).drop("_r")
    held = cut(kept.groupBy("_x", "_y").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_parts")))
    waiting = kept.join(F.broadcast(held), ["_x", "_y"]).withColumn("_s", F.pmod(F.xxhash64(*f.columns), F.col("_parts")).cast("int")).drop("_parts")
    moving = q.withColumn("_x", F.explode(F.concat(F.array(F.lit(-1)), Bits.of("q").positions()))).join(F.broadcast(held), "_x")
    moving = moving.filter((F.col("_y") < 0) | Bits.of("q").test(F.col("_y"))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return waiting.join(moving, ["_x", "_y", "_s"]).filter(_condition("subset")).select(*f.columns, *q.columns)


def around(filters: DataFrame, queries: DataFrame) -> DataFrame:
    """Superset pairs by anchors: the queries wait and the stored sets ask."""
    f, q = _sides(filters, queries)
    other = {c: c.replace("b", "q", 1) if c in WORDS else c.replace("q", "b", 1) for c in (*WORDS, *words("q"))}
    return anchor(queries, filters).select(*(F.col(other.get(c, c)).alias(c) for c in (*f.columns, *q.columns)))


def tag_anchor(filters: DataFrame, queries: DataFrame, key: list[str], tags: str = "tags", query_tags: str = "query_tags", words_too: bool = False) -> DataFrame:
    """An equi-join on each set's least asked tag, re-checked on the exact tags.

    ``key`` identifies a filter row. Sets without tags are in every query and are joined to all of them. Sets that
    fit a broadcast wait on every worker; else a tag at which very many wait is dealt over several keys, on which
    the queries that hold it are repeated. Queries of more than ``CARRIED_TAGS`` tags do not take their tags along
    to each of them, which grows with the square of their number: only their hash goes, and the rows of a hash
    that met a set are tested with it."""
    filters = cut(filters)
    small = _bytes(filters, tags) <= BROADCAST_BYTES
    near = F.broadcast if small else (lambda df: df)
    spread = filters.select(*key, F.explode(F.array_distinct(tags)).alias("_t"))
    asked = queries.select(F.explode(F.array_distinct(query_tags)).alias("_t")).join(near(spread.select("_t").distinct()), "_t").groupBy("_t").agg(F.count("*").alias("_n"))
    chosen = cut(spread.join(asked, "_t", "left").groupBy(*key).agg(F.min_by("_t", F.struct(F.coalesce("_n", F.lit(0)), "_t")).alias("_t")))
    whole = F.size(F.array_except(tags, query_tags)) == 0
    columns = [*filters.columns, *queries.columns]

    def met(waiting: DataFrame, moving: DataFrame) -> DataFrame:
        """The rows of ``moving`` at the sets that wait at one of their tags ``_t``."""
        if small:
            return moving.join(F.broadcast(waiting), "_t")
        held = chosen.groupBy("_t").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_parts"))
        dealt = waiting.join(held, "_t").withColumn("_s", F.pmod(F.xxhash64(*key), F.col("_parts")).cast("int")).drop("_parts")
        return dealt.join(moving.join(held, "_t").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"), ["_t", "_s"])

    few = queries.filter(F.size(query_tags) <= CARRIED_TAGS)
    found = met(filters.join(chosen, key), few.withColumn("_t", F.explode(F.array_distinct(query_tags)))).filter(whole).select(*columns)
    # equal hashes of different sets cost a test, not a result
    many = queries.filter(F.size(query_tags) > CARRIED_TAGS).withColumn("_h", F.xxhash64(query_tags))
    hits = cut(met(chosen, many.select("_h", F.explode(F.array_distinct(query_tags)).alias("_t"))).select("_h", *key).distinct().join(near(filters), key))
    hits = F.broadcast(hits) if _bytes(hits, tags) <= BROADCAST_BYTES else hits
    found = found.unionByName(many.join(hits, "_h").filter(whole).select(*columns))
    bare = filters.filter((F.size(tags) == 0) | F.col(tags).isNull())
    if not bare.limit(1).count():
        return found
    # sets without tags meet every query: they are dealt over as many keys as they are many, each of which all queries visit
    deals = max(1, -(-bare.count() // SALT_ROWS))
    dealt = bare.withColumn("_s", F.pmod(F.xxhash64(*key), F.lit(deals)).cast("int"))
    visiting = queries.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return found.unionByName(dealt.join(visiting, "_s").select(*found.columns))


def pairs(filters: DataFrame, queries: DataFrame, relation: str = "subset", strategy: str = "auto", **options) -> DataFrame:
    """Pairs (s, q) with s in the relation to q: ``subset``, ``superset`` or ``equal``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if relation == "equal":
        return equal(filters, queries)
    if relation == "superset":
        return around(filters, queries) if strategy == "anchor" else nested_loop(filters, queries, relation, **options)
    if strategy == "auto":
        strategy = "tag_anchor" if "key" in options and "tags" in filters.columns else "nested_loop"
    return {"nested_loop": nested_loop, "mask_routed": mask_routed, "anchor": anchor, "tag_anchor": tag_anchor}[strategy](filters, queries, **options)


def matching(filters: DataFrame, queries: DataFrame, found: bool = True, other: str | None = None) -> DataFrame:
    """Queries that hold at least one set (first match, no pairs made), or hold none. With ``other``, a column of
    ``filters``, a set whose value there is the query's ``qid`` does not count."""
    f, q = _sides(filters.select(*WORDS, *([other] if other else [])), queries)
    counts = F.col(other) != F.col("qid") if other else F.lit(True)
    if size_bound(f) > BROADCAST_BYTES:
        hit = anchor(f, queries).filter(counts).select("qid").distinct()
        return queries.join(hit, "qid", "left_semi" if found else "left_anti")
    out = q.join(F.broadcast(f), _condition("subset") & counts, "left_semi" if found else "left_anti")
    return out.withColumnsRenamed({f"q{k}": f"b{k}" for k in range(len(WORDS))})


def answers(queries: DataFrame, matched: DataFrame, unique: bool | str = False, key: str = "key") -> DataFrame:
    """(qid, keys) of every query, empty answers included: a bag of keys, or a sorted set of them. ``unique`` may be
    the name of a boolean column of ``queries`` that says so per query."""
    bag = F.collect_list(key)
    if isinstance(unique, str):
        each = matched.select("qid", key).join(queries.select("qid", F.col(unique).alias("_u")), "qid")
        got = each.groupBy("qid").agg(F.when(F.first("_u"), F.array_sort(F.collect_set(key))).otherwise(bag).alias("keys"))
    elif unique:
        got = matched.groupBy("qid").agg(F.array_sort(F.collect_set(key)).alias("keys"))
    else:
        got = matched.groupBy("qid").agg(bag.alias("keys"))
    return queries.select("qid").join(got, "qid", "left").select("qid", F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"))


def totals(answered: DataFrame) -> DataFrame:
    """(queries, keys): finished queries, also those without keys, and keys in all."""
    return answered.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).cast("bigint").alias("keys"))


def merged_keys(filters: DataFrame, key: str = "key") -> DataFrame:
    """One row per set with the sorted set of its keys."""
    return filters.groupBy(*WORDS).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def latest(filters: DataFrame, value: str, seq: str) -> DataFrame:
    """One row per set with the value that was put last."""
    return filters.groupBy(*WORDS).agg(F.max_by(value, seq).alias(value))
