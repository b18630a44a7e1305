"""Queries of the subset engine over the synthetic tables, and the DuckDB SQL that each must equal.

The SQL works on lists of positions or tags, never on packed words, so it shares nothing with the engine's
own arithmetic. Stored sets and queries are built from whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsieve.functions import bloom
from subsieve.functions.bits import Bits, common_all, union_all
from subsieve.operators import match, workload
from subsieve.operators.database import net
from subsieve.plans.partition import balanced_partitions, leading_runs, prefixes
from subsieve.schema import words
from subsieve.sources import binary, text
from subsieve.streaming.match_stream import drain, match_stream, to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = words()

# ---------------------------------------------------------------- tables as sets


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tag(kind: str, value: Column) -> Column:
    return bloom.tag_id(F.concat(F.lit(f"{kind}="), value.cast("string")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set per part: brand, type, size band."""
    p = read(spark, sf_dir, "part")
    tags = F.array_distinct(F.array(tag("brand", F.col("p_brand")), tag("type", F.col("p_type")), tag("size", F.floor(F.col("p_size") / 10))))
    return p.select(F.col("p_partkey").alias("key"), tags.alias("tags"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per order: all tags of its parts."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    spread = parts(spark, sf_dir).select(F.col("key").alias("l_partkey"), F.explode("tags").alias("t"))
    return lines.join(spread, "l_partkey").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_set("t")).alias("query_tags"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set per user: the kinds of events they have, at each tenth of a value's digits."""
    e = read(spark, sf_dir, "events")
    t = F.concat_ws("/", "event_type", F.floor(F.coalesce("value", F.lit(0.0)) / 20).cast("bigint").cast("string"))
    return e.groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set(bloom.tag_id(t))).alias("tags"))


def nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sets: nations and regions of suppliers; queries: those that a market segment's customers come from."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pair = F.array(tag("nation", F.col("n_name")), tag("region", F.col("r_name")))
    sup = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), pair.alias("tags"))
    cust = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = cust.groupBy(F.hash("c_mktsegment").alias("_h"), F.col("c_mktsegment").alias("segment")).agg(F.collect_set(tag("nation", F.col("n_name"))).alias("a"), F.collect_set(tag("region", F.col("r_name"))).alias("b"))
    return sup, asked.select("segment", F.concat("a", "b").alias("query_tags"))


def coded(df: DataFrame, tags: str) -> DataFrame:
    return df.select("*", *bloom.encode(F.col(tags)).columns())


#: The same tables for DuckDB: tags as integers and as positions.
TAG = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % 1048576)"
POSITIONS = "list_sort(list_distinct(flatten(list_transform({0}, lambda t: list_transform(range(0, 7), lambda i: ((((t + 73) * i + t + 3) % 4294967296) % 131071) % 65536 % 192)))))"
SQL_PARTS = f"""parts AS (SELECT p_partkey AS key, list_distinct([{TAG.format("'brand=' || p_brand")}, {TAG.format("'type=' || p_type")}, {TAG.format("'size=' || CAST(floor(p_size / 10.0) AS BIGINT)")}]) AS tags FROM part)"""
SQL_ORDERS = "orders_ AS (SELECT l_orderkey AS qid, list_sort(list(DISTINCT t)) AS query_tags FROM lineitem JOIN (SELECT key, unnest(tags) AS t FROM parts) p ON key = l_partkey GROUP BY l_orderkey)"
SQL_USERS = f"""users AS (SELECT user_id AS key, list_sort(list(DISTINCT {TAG.format("concat_ws('/', event_type, CAST(CAST(floor(coalesce(value, 0.0) / 20) AS BIGINT) AS VARCHAR))")})) AS tags FROM events GROUP BY user_id)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- joins and answers


COVER = f"""WITH {SQL_PARTS}, {SQL_ORDERS},
    kinds AS (SELECT tags, count(*) AS n, sum(key) AS s FROM (SELECT list_sort(tags) AS tags, key FROM parts) GROUP BY tags),
    asked AS (SELECT qid, unnest(query_tags) AS t FROM orders_),
    hits AS (SELECT qid, tags, first(n) AS n, first(s) AS s FROM (SELECT tags, unnest(tags) AS t, n, s FROM kinds) JOIN asked USING (t) GROUP BY qid, tags HAVING count(*) = len(tags))
    SELECT qid, CAST(coalesce(sum(n), 0) AS BIGINT) AS parts, CAST(coalesce(sum(s), 0) AS BIGINT) AS key_sum FROM orders_ LEFT JOIN hits USING (qid) GROUP BY qid"""


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each order covers, exactly: parts with equal tags are one stored set with its keys."""
    kinds = parts(spark, sf_dir).withColumn("tags", F.array_sort("tags")).groupBy("tags").agg(F.count("*").alias("n"), F.sum("key").alias("s"))
    asked = orders(spark, sf_dir)
    hits = match.tag_anchor(kinds, asked, ["tags"]).groupBy("qid").agg(F.sum("n").alias("parts"), F.sum("s").alias("key_sum"))
    return asked.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("parts", F.lit(0)).cast("bigint").alias("parts"), F.coalesce("key_sum", F.lit(0)).cast("bigint").alias("key_sum"))


@query(COVER)
def cover_exact(spark, sf_dir):
    return covered(spark, sf_dir)


BLOOM_COVER = f"""WITH {SQL_PARTS}, {SQL_ORDERS},
    kinds AS (SELECT {POSITIONS.format("tags")} AS p, count(*) AS n, sum(key) AS s FROM parts GROUP BY p),
    asked AS (SELECT qid, {POSITIONS.format("query_tags")} AS q FROM orders_),
    hits AS (SELECT qid, sum(n) AS n, sum(s) AS s FROM asked JOIN kinds ON list_has_all(q, p) GROUP BY qid)
    SELECT qid, CAST(coalesce(n, 0) AS BIGINT) AS matches, CAST(coalesce(s, 0) AS BIGINT) AS key_sum FROM asked LEFT JOIN hits USING (qid)"""


def bloom_cover(spark: SparkSession, sf_dir: str, strategy: str, **options) -> DataFrame:
    """Matches of the orders' bit sets among the parts' bit sets, false positives included."""
    asked = coded(orders(spark, sf_dir), "query_tags").select("qid", *WORDS)
    return cover_counts(asked, match.pairs(kinds(spark, sf_dir), asked, strategy=strategy, **options))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' distinct bit sets with number and sum of their keys."""
    return coded(parts(spark, sf_dir), "tags").groupBy(*WORDS).agg(F.count("*").alias("n"), F.sum("key").alias("s"))


def cover_counts(asked: DataFrame, found: DataFrame) -> DataFrame:
    hits = found.groupBy("qid").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return asked.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("matches"), F.coalesce("s", F.lit(0)).cast("bigint").alias("key_sum"))


@query(BLOOM_COVER)
def subset_nested_loop(spark, sf_dir):
    return bloom_cover(spark, sf_dir, "nested_loop")


@query(BLOOM_COVER)
def subset_popcounts(spark, sf_dir):
    """The nested loop behind a test of the numbers of bits."""
    return bloom_cover(spark, sf_dir, "nested_loop", popcounts=True)


@query(BLOOM_COVER)
def subset_mask_routed(spark, sf_dir):
    return bloom_cover(spark, sf_dir, "mask_routed", max_partition=100)


@query(BLOOM_COVER)
def subset_anchor(spark, sf_dir):
    return bloom_cover(spark, sf_dir, "anchor")


@query(BLOOM_COVER)
def subset_two_files(spark, sf_dir):
    """The two stages from files: partitions' masks and partitioned sets, written and read back."""
    rows, masks = balanced_partitions(kinds(spark, sf_dir).withColumn("keys", F.array("n", "s")), 100)
    names, path = workload.numbered(masks, "pid"), files(spark, "two")  # ids in files have 32 bits
    small = rows.join(names.select("pid", "place"), "pid").drop("pid").withColumnRenamed("place", "pid")
    text.partitioned_lines(small).write.text(f"{path}/sets")
    text.prefix_lines(names.drop("pid").withColumnRenamed("place", "pid").withColumn("length", F.lit(192))).write.text(f"{path}/prefixes")
    back = text.read_partitioned(spark, f"{path}/sets").withColumns({"n": F.get("keys", F.lit(0)), "s": F.get("keys", F.lit(1))}).drop("keys")
    asked = coded(orders(spark, sf_dir), "query_tags").select("qid", *WORDS)
    return cover_counts(asked, match.mask_routed(back, asked, partitioned=(back, text.read_prefixes(spark, f"{path}/prefixes"))))


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS words FROM benchmark),
    d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> ''))) AS w FROM documents)
    SELECT doc_id, item_id FROM (SELECT item_id, unnest(words) AS w, len(words) AS n FROM b) JOIN d USING (w) GROUP BY doc_id, item_id, n HAVING count(*) = n""")
def contamination(spark, sf_dir):
    """Benchmark items all of whose words a document has."""
    split = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), " "), lambda w: w != ""))
    items = read(spark, sf_dir, "benchmark").select("item_id", split(F.col("text")).alias("tags"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), split(F.col("text")).alias("query_tags"))
    return match.tag_anchor(items, docs, ["item_id"]).select(F.col("qid").alias("doc_id"), "item_id")


USER_PAIRS = f"WITH {SQL_USERS}, u AS (SELECT tags, CAST(count(*) AS BIGINT) AS n, min(key) AS least FROM users GROUP BY tags)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct user profiles with the number and the least id of their users."""
    return users(spark, sf_dir).groupBy("tags").agg(F.count("*").alias("n"), F.min("key").alias("least"))


def twice(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df, df.select(F.col("least").alias("qid"), F.col("tags").alias("query_tags"))


@query(USER_PAIRS + " SELECT b.least AS qid, CAST(sum(a.n) AS BIGINT) AS users_within FROM u a JOIN u b ON list_has_all(b.tags, a.tags) GROUP BY b.least")
def users_within(spark, sf_dir):
    """For each profile, the users whose profile it contains."""
    f, q = twice(profiles(spark, sf_dir))
    return match.tag_anchor(f, q, ["least"]).groupBy("qid").agg(F.sum("n").cast("bigint").alias("users_within"))


AROUND = USER_PAIRS + f", p AS (SELECT least, n, {POSITIONS.format('tags')} AS p FROM u) SELECT b.least AS qid, CAST(sum(a.n) AS BIGINT) AS users_around FROM p a JOIN p b ON list_has_all(a.p, b.p) GROUP BY b.least"


def around(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """Superset search: the users whose bit set contains the profile's."""
    f = coded(profiles(spark, sf_dir), "tags").select("least", "n", *WORDS)
    q = f.select(F.col("least").alias("qid"), *WORDS)
    return match.pairs(f, q, "superset", strategy=strategy).groupBy("qid").agg(F.sum("n").cast("bigint").alias("users_around"))


@query(AROUND)
def users_around(spark, sf_dir):
    return around(spark, sf_dir, "auto")


@query(AROUND)
def users_around_anchor(spark, sf_dir):
    return around(spark, sf_dir, "anchor")


def other_match(spark: SparkSession, sf_dir: str, found: bool) -> DataFrame:
    """Profiles that (don't) hold the bits of any other profile."""
    p = coded(profiles(spark, sf_dir), "tags").select("least", *WORDS)
    return match.matching(p, p.select(F.col("least").alias("qid"), *WORDS), found, other="least").select("qid")


OTHER = USER_PAIRS + f", p AS (SELECT least, {POSITIONS.format('tags')} AS p FROM u) SELECT least AS qid FROM p b WHERE {{}} EXISTS (SELECT 1 FROM p a WHERE a.least <> b.least AND list_has_all(b.p, a.p))"


@query(OTHER.format(""))
def users_semi(spark, sf_dir):
    return other_match(spark, sf_dir, True)


@query(OTHER.format("NOT"))
def users_anti(spark, sf_dir):
    return other_match(spark, sf_dir, False)


@query(f"""WITH {SQL_PARTS}, p AS (SELECT key, list_sort(tags) AS tags FROM parts)
    SELECT a.key AS key, CAST(count(*) AS BIGINT) AS same, min(b.key) AS least FROM p a JOIN p b ON a.tags = b.tags GROUP BY a.key""")
def parts_equal(spark, sf_dir):
    """Exact lookup of every part's set: parts with the same set, by one row per set."""
    p = coded(parts(spark, sf_dir), "tags")
    exact = p.withColumn("tags", F.array_sort("tags"))
    kinds = exact.groupBy(*WORDS, "tags").agg(F.count("*").alias("same"), F.min("key").alias("least"))
    found = match.pairs(kinds, exact.select(F.col("key").alias("qid"), F.col("tags").alias("query_tags"), *WORDS), "equal")
    return found.filter("tags = query_tags").select(F.col("qid").alias("key"), "same", "least")


def sup_tag(alias: str) -> str:
    return f"[{TAG.format(chr(39) + 'nation=' + chr(39) + f' || {alias}.n_name')}, {TAG.format(chr(39) + 'region=' + chr(39) + f' || {alias}.r_name')}]"


SUPPLIERS = f"""WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
    s AS (SELECT s_suppkey AS key, {sup_tag('n')} AS tags FROM supplier JOIN n ON s_nationkey = n_nationkey),
    c AS (SELECT c_mktsegment AS segment, list_distinct(flatten(list({sup_tag('n')}))) AS q FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY c_mktsegment),
    m AS (SELECT segment, key FROM c JOIN s ON list_has_all(q, tags))"""


@query(SUPPLIERS + " SELECT segment, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS keys FROM m GROUP BY segment")
def suppliers_unique(spark, sf_dir):
    """match_unique rendered: the sorted keys of each segment's answer."""
    f, q = nations(spark, sf_dir)
    q = q.withColumn("qid", F.xxhash64("segment"))
    found = match.tag_anchor(f, q.select("qid", "query_tags"), ["key"])
    got = match.answers(q, found, unique=True)
    return q.join(got, "qid").filter(F.size("keys") > 0).select("segment", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query(SUPPLIERS + " SELECT CAST((SELECT count(*) FROM c) AS BIGINT) AS queries, CAST((SELECT count(*) FROM m) AS BIGINT) AS keys")
def suppliers_totals(spark, sf_dir):
    """Finished queries and keys in all."""
    f, q = nations(spark, sf_dir)
    q = q.withColumn("qid", F.xxhash64("segment"))
    return match.totals(match.answers(q, match.tag_anchor(f, q.select("qid", "query_tags"), ["key"])))


# ---------------------------------------------------------------- scalar functions and counts

#: The 0/1 text of a list of positions.
SQL_ASCII = "list_aggregate(list_transform(range(0, 192), lambda i: CASE WHEN list_contains({0}, i) THEN '1' ELSE '0' END), 'string_agg', '')"
SQL_PART_BITS = f"WITH {SQL_PARTS}, p AS (SELECT key, {POSITIONS.format('tags')} AS p FROM parts)"


def part_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(parts(spark, sf_dir), "tags").select("key", *WORDS)


@query(
    SQL_PART_BITS
    + """ SELECT key, CAST(len(p) AS INT) AS popcount, CAST(len(list_filter(p, lambda x: x < 70)) AS INT) AS prefix_popcount, CAST(len(list_filter(p, lambda x: x >= 130)) AS INT) AS suffix_popcount,
    CAST(coalesce(list_min(p), 192) AS INT) AS first_bit, CAST(coalesce(list_min(list_filter(p, lambda x: x >= 64)), 192) AS INT) AS next_bit, CAST(coalesce(p[3], 192) AS INT) AS third_bit,
    list_aggregate(list_transform(range(0, 192), lambda i: CASE WHEN list_contains(p, i) THEN '1' ELSE '0' END), 'string_agg', '') AS ascii, list_contains(p, 100) AS has_100 FROM p"""
)
def bit_functions(spark, sf_dir):
    b = Bits.of()
    return part_bits(spark, sf_dir).select("key", b.popcount().alias("popcount"), b.prefix_popcount(70).alias("prefix_popcount"), b.suffix_popcount(130).alias("suffix_popcount"), b.next_bit(0).alias("first_bit"), b.next_bit(64).alias("next_bit"), b.kth_bit(2).alias("third_bit"), b.to_ascii().alias("ascii"), b.test(100).alias("has_100"))


SQL_NEIGHBOURS = f"""WITH {SQL_PARTS}, s AS (SELECT key, {POSITIONS.format('tags')} AS p FROM parts),
    j AS (SELECT a.key, a.p AS x, b.p AS y FROM s a JOIN s b ON b.key = a.key + 1),
    d AS (SELECT *, list_filter(range(0, 192), lambda i: list_contains(x, i) <> list_contains(y, i)) AS z FROM j)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_bits(spark, sf_dir)
    return p.join(p.select((F.col("key") - 1).alias("key"), *(F.col(c).alias(f"q{k}") for k, c in enumerate(WORDS))), "key")


@query(
    SQL_NEIGHBOURS
    + """ SELECT key, CAST(len(list_distinct(list_concat(x, y))) AS INT) AS either, CAST(len(list_intersect(x, y)) AS INT) AS both_, CAST(len(z) AS INT) AS one, CAST(coalesce(list_min(z), 192) AS INT) AS diff,
    coalesce(list_contains(y, list_min(z)), false) AS less, len(list_filter(x, lambda i: i < 64 AND NOT list_contains(y, i))) = 0 AS prefix_subset, len(list_filter(x, lambda i: i >= 150 AND NOT list_contains(y, i))) = 0 AS suffix_subset,
    len(list_filter(x, lambda i: i >= 50 AND i < 80 AND NOT list_contains(y, i))) = 0 AS range_subset, len(list_filter(z, lambda i: i < 20)) = 0 AS prefix_equal, list_has_all(y, x) AS subset FROM d"""
)
def bit_pairs(spark, sf_dir):
    x, y = Bits.of("b"), Bits.of("q")
    return neighbours(spark, sf_dir).select("key", (x | y).popcount().alias("either"), (x & y).popcount().alias("both_"), (x ^ y).popcount().alias("one"), x.leftmost_diff(y).alias("diff"), x.less(y).alias("less"), x.prefix_subset_of(y, 64).alias("prefix_subset"), x.suffix_subset_of(y, 150).alias("suffix_subset"), x.range_subset_of(y, 50, 80).alias("range_subset"), x.prefix_equal(y, 20).alias("prefix_equal"), x.subset_of(y).alias("subset"))


@query(
    SQL_NEIGHBOURS
    + f""" SELECT key, 0 AS cleared, 192 AS filled, {SQL_ASCII.format("list_append(x, 77)")} AS with_77, coalesce(list_contains(x, list_min(z)), false) AS greater,
    CAST(coalesce(list_sum(list_transform(list_filter(x, lambda i: i < 32), lambda i: 2::BIGINT ** i)), 0) AS BIGINT) AS low, CAST(coalesce(list_sum(list_transform(list_filter(x, lambda i: i >= 160), lambda i: 2::BIGINT ** (i - 160))), 0) AS BIGINT) AS high,
    CAST(coalesce(list_sum(list_transform(x, lambda i: i + 1)), 0) AS BIGINT) AS suffix_sum FROM d"""
)
def bit_edits(spark, sf_dir):
    """Clear, fill, set one bit, the reverse order, 32-bit views, and the sum of all suffix counts."""
    x, y = Bits.of("b"), Bits.of("q")
    views = x.uint32()
    total = F.aggregate(x.suffix_popcounts(), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return neighbours(spark, sf_dir).select("key", Bits.empty().popcount().alias("cleared"), Bits.full().popcount().alias("filled"), x.set_bit(77).to_ascii().alias("with_77"), x.greater(y).alias("greater"), views[0].alias("low"), views[5].alias("high"), total.alias("suffix_sum"))


@query(SQL_PART_BITS + ", f AS (SELECT unnest(p) AS pos, count(*) AS freq FROM p GROUP BY pos) SELECT CAST(i AS INT) AS pos, CAST(coalesce(freq, 0) AS BIGINT) AS freq, 100.0::DOUBLE * coalesce(freq, 0) / (SELECT count(*) FROM p) AS pct FROM range(0, 192) t(i) LEFT JOIN f ON pos = i")
def bit_frequency(spark, sf_dir):
    return workload.frequencies(part_bits(spark, sf_dir))


@query(SQL_PART_BITS + " SELECT CAST(len(p) AS INT) AS popcount, CAST(count(*) AS BIGINT) AS sets FROM p GROUP BY len(p)")
def popcounts(spark, sf_dir):
    return part_bits(spark, sf_dir).groupBy(Bits.of().popcount().alias("popcount")).agg(F.count("*").alias("sets"))


@query(SQL_PART_BITS + ", t AS (SELECT key, list_aggregate(list_transform(range(0, 192), lambda i: CASE WHEN list_contains(p, (i * 77 + 5) % 192) THEN '1' ELSE '0' END), 'string_agg', '') AS ascii FROM p) SELECT * FROM t")
def permuted(spark, sf_dir):
    """Position (77 i + 5) mod 192 moves to i."""
    new = [0] * 192
    for i in range(192):
        new[(i * 77 + 5) % 192] = i
    return workload.permute(part_bits(spark, sf_dir), new).select("key", Bits.of().to_ascii().alias("ascii"))


@query(SQL_PART_BITS + ", t AS (SELECT list_aggregate(list_transform(range(0, 192), lambda i: CASE WHEN list_contains(p, i) THEN '1' ELSE '0' END), 'string_agg', '') AS ascii, min(key) AS least FROM p GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY ascii DESC) AS BIGINT) AS place, ascii, least FROM t")
def sorted_sets(spark, sf_dir):
    """Distinct sets by descending bit order with their place, numbered by a distributed sort and per-partition offsets."""
    rows = part_bits(spark, sf_dir).groupBy(Bits.of().to_ascii().alias("ascii")).agg(F.min("key").alias("least"))
    return workload.numbered(rows, F.col("ascii").desc()).select((F.col("place") + 1).alias("place"), "ascii", "least")


@query(SQL_PART_BITS + ", t AS (SELECT DISTINCT " + SQL_ASCII.format("p") + " AS ascii FROM p) SELECT ascii FROM t ORDER BY ascii DESC LIMIT 20")
def greatest_sets(spark, sf_dir):
    """The first 20 sets in descending order (the feature of stopping early)."""
    return workload.sort_descending(part_bits(spark, sf_dir).select(*WORDS).distinct(), first=20).select(Bits.of().to_ascii().alias("ascii"))


@query(SQL_PART_BITS + " SELECT CAST(count(*) AS BIGINT) AS sets, CAST(min(len(p)) AS INT) AS least, CAST(max(len(p)) AS INT) AS most, avg(len(p)) AS mean FROM p")
def popcount_range(spark, sf_dir):
    return workload.popcount_range(part_bits(spark, sf_dir))


@query(SQL_PART_BITS + f", b AS (SELECT p_brand, unnest(p) AS i FROM p JOIN part ON key = p_partkey) SELECT p_brand, CAST(count(DISTINCT i) AS INT) AS union_bits, CAST((SELECT count(*) FROM (SELECT i FROM b b2 WHERE b2.p_brand = b.p_brand GROUP BY i HAVING count(*) = (SELECT count(*) FROM part WHERE part.p_brand = b.p_brand))) AS INT) AS common_bits FROM b GROUP BY p_brand")
def brand_masks(spark, sf_dir):
    """Union and intersection of each brand's sets."""
    b = part_bits(spark, sf_dir).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_brand"), "key")
    one, both = union_all(b, ["p_brand"]), common_all(b, ["p_brand"])
    return one.join(both, "p_brand").select("p_brand", Bits.of("b").popcount().alias("union_bits"), Bits.of("m").popcount().alias("common_bits"))


# ---------------------------------------------------------------- database, partitions, files, streams

CHANGES_SQL = """WITH e AS (SELECT event_type, user_id, event_id FROM events WHERE user_id IS NOT NULL),
    old AS (SELECT DISTINCT event_type, user_id FROM e WHERE event_id % 7 = 0),
    last AS (SELECT event_type, user_id, arg_max(CASE WHEN event_id % 5 < 3 THEN 'add' ELSE 'remove' END, event_id) AS op FROM e WHERE event_id % 7 > 3 GROUP BY event_type, user_id),
    kept AS (SELECT event_type, user_id FROM old ANTI JOIN last USING (event_type, user_id) UNION ALL SELECT event_type, user_id FROM last WHERE op = 'add')
    SELECT event_type, CAST(count(*) AS BIGINT) AS keys, CAST(sum(user_id) AS BIGINT) AS key_sum FROM kept GROUP BY event_type"""


def event_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events with the set of their type and the user as key, and the types' names and sets."""
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    set_ = bloom.encode(F.array(bloom.tag_id(F.col("event_type")))).columns()
    return e.select("event_id", *set_, F.col("user_id").alias("key")), e.select("event_type").distinct().select("event_type", *set_)


@query(CHANGES_SQL)
def changelog(spark, sf_dir):
    """A database of event types (sets) and users (keys): old rows, then adds and removes in event order; the last one wins."""
    e, names = event_sets(spark, sf_dir)
    old = e.filter("event_id % 7 = 0").select(*WORDS, "key").distinct()
    changes = e.filter("event_id % 7 > 3").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 < 3, "add").otherwise("remove").alias("op"), *WORDS, "key")
    return net(old, changes).join(names, WORDS).groupBy("event_type").agg(F.count("*").alias("keys"), F.sum("key").alias("key_sum"))


LIFE_SQL = """WITH e AS (SELECT event_type, user_id, event_id % 4 AS turn FROM events WHERE user_id IS NOT NULL),
    one AS (SELECT event_type, user_id FROM e WHERE turn = 0), two AS (SELECT event_type, user_id FROM e WHERE turn = 1),
    three AS (SELECT event_type, user_id FROM e WHERE turn = 2), kept AS ((SELECT * FROM one EXCEPT SELECT * FROM two) UNION SELECT * FROM three)
    SELECT event_type, CAST(count(*) AS BIGINT) AS keys, CAST(sum(user_id) AS BIGINT) AS key_sum, 2::BIGINT AS versions FROM kept GROUP BY event_type"""


@query(LIFE_SQL)
def database_life(spark, sf_dir):
    """Added and published by one object; removed by a second, added again by a third, published by a fourth."""
    from subsieve.operators.database import TagDatabase

    e, names = event_sets(spark, sf_dir)
    path, turn = files(spark, "db"), lambda k: e.filter(F.col("event_id") % 4 == k).select(*WORDS, "key")
    first = TagDatabase(spark, path)
    first.add(turn(0))
    first.consolidate()
    TagDatabase(spark, path).remove(turn(1))
    TagDatabase(spark, path).add(turn(2))
    last = TagDatabase(spark, path)
    last.consolidate()
    rows = last.snapshot().select(*WORDS, F.explode("keys").alias("key")).join(names, WORDS)
    return rows.groupBy("event_type").agg(F.count("*").alias("keys"), F.sum("key").alias("key_sum")).withColumn("versions", F.lit(len(last.versions)).cast("bigint"))


@query("SELECT event_type, arg_max(user_id, event_id) AS last_user FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def latest_values(spark, sf_dir):
    """One value per set, the one that was put last."""
    e, names = event_sets(spark, sf_dir)
    return match.latest(e, "key", "event_id").join(names, WORDS).select("event_type", F.col("key").alias("last_user"))


INVARIANTS = SQL_PART_BITS + " SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(sum(key) AS BIGINT) AS key_sum, CAST(sum(len(p)) AS BIGINT) AS bits, CAST(count(DISTINCT p) AS BIGINT) AS sets, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS too_short FROM p"


def invariants(rows: DataFrame, masks: DataFrame, most: int, ones: int) -> DataFrame:
    """Of a partitioning: rows, keys, bits inside and outside of their masks, sets; partitions over ``most`` sets and masks under ``ones`` bits."""
    b, m = Bits.of(), Bits.of("m")
    held = rows.join(masks, "pid").agg(F.count("*").alias("rows_"), F.sum("key").alias("key_sum"), F.sum((m.popcount() + b.minus(m).popcount()).cast("bigint")).alias("bits"))
    sets = rows.select("pid", *WORDS).distinct().groupBy("pid").agg(F.count("*").alias("n"))
    size = masks.join(sets, "pid").agg(F.sum("n").alias("sets"), F.sum((F.col("n") > most).cast("bigint")).alias("too_large"), F.sum((m.popcount() < ones).cast("bigint")).alias("too_short"))
    return held.join(F.broadcast(size), F.lit(True))


@query(INVARIANTS)
def partition_invariants(spark, sf_dir):
    """Balanced partitions of the parts' sets: every row in one, masks within their sets, sizes kept."""
    return invariants(*balanced_partitions(part_bits(spark, sf_dir), 50), 50, 1)


@query(INVARIANTS)
def prefix_invariants(spark, sf_dir):
    """The split by prefixes: runs of distinct sets in descending order that share more than two leading bits."""
    p = part_bits(spark, sf_dir)
    rows = p.join(leading_runs(p.select(*WORDS).distinct(), 40, 2), WORDS)
    return invariants(rows, prefixes(rows), 40, 3)


ROUND_TRIP = SQL_PART_BITS + f" SELECT key, {SQL_ASCII.format('p')} AS ascii FROM p"


def files(spark: SparkSession, name: str) -> str:
    import uuid

    from subsieve.runtime import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(ROUND_TRIP)
def text_round_trip(spark, sf_dir):
    """Write the parts as lines and read them back."""
    path = files(spark, "lines")
    text.filter_lines(part_bits(spark, sf_dir).withColumn("keys", F.array("key"))).write.text(path)
    return text.read_filters(spark, path).select(F.get("keys", F.lit(0)).alias("key"), Bits.of().to_ascii().alias("ascii"))


@query(ROUND_TRIP)
def binary_round_trip(spark, sf_dir):
    """Write the parts as binary records and read them back."""
    path = files(spark, "records").removeprefix("file://").removeprefix("file:")
    binary.write(binary.filter_records(part_bits(spark, sf_dir).withColumn("keys", F.array("key"))), path)
    return binary.read_filters(spark, f"file://{path}").select(F.get("keys", F.lit(0)).alias("key"), Bits.of().to_ascii().alias("ascii"))


@query(SQL_PART_BITS + f""", a AS (SELECT key, p, {SQL_ASCII.format('p')} AS ascii, {SQL_ASCII.format('list_filter(p, lambda i: i < 50)')} AS head FROM p)
    SELECT 'partitioned' AS kind, key % 7 AS pid, key, ascii FROM a UNION ALL SELECT 'prefix', key, key + 1, head FROM a UNION ALL SELECT 'query', NULL, NULL, ascii FROM a""")
def formats_round_trip(spark, sf_dir):
    """Partitioned sets, prefixes and queries: written as lines, converted to binary records, read back."""
    p, path = part_bits(spark, sf_dir).withColumn("keys", F.array("key")), files(spark, "formats")
    local = path.removeprefix("file://").removeprefix("file:")
    given = {
        "partitioned": text.partitioned_lines(p.withColumn("pid", F.col("key") % 7)),
        "prefixes": text.prefix_lines(p.select(F.col("key").alias("pid"), *Bits.of().between(0, 50).columns("m"), F.lit(50).alias("length"), (F.col("key") + 1).alias("size"))),
        "queries": text.query_lines(p),
    }
    for kind, lines in given.items():
        lines.write.text(f"{path}/{kind}")
        binary.convert(spark, kind, f"{path}/{kind}", f"{local}/{kind}-binary")
    ascii_, none = Bits.of().to_ascii().alias("ascii"), F.lit(None).cast("bigint")
    one = binary.read_partitioned(spark, f"file://{local}/partitioned-binary").select(F.lit("partitioned").alias("kind"), "pid", F.get("keys", F.lit(0)).alias("key"), ascii_)
    two = binary.read_prefixes(spark, f"file://{local}/prefixes-binary").select(F.lit("prefix").alias("kind"), "pid", F.col("size").alias("key"), Bits.of("m").to_ascii().alias("ascii"))
    return one.union(two).union(binary.read_queries(spark, f"file://{local}/queries-binary").select(F.lit("query").alias("kind"), none.alias("pid"), none.alias("key"), ascii_))


@query(SQL_PART_BITS + """, f AS (SELECT i AS pos, (SELECT count(*) FROM p WHERE list_contains(p, i)) AS freq FROM range(0, 192) t(i)), r AS (SELECT pos, row_number() OVER (ORDER BY freq, pos) - 1 AS place FROM f),
    b AS (SELECT key, unnest(p) AS pos FROM p), m AS (SELECT key, list(place) AS p FROM b JOIN r USING (pos) GROUP BY key) SELECT key, """ + SQL_ASCII.format("p") + " AS ascii FROM m")
def permuted_by_file(spark, sf_dir):
    """Positions from the rarest, written as a permutation file, read back and applied."""
    p, path = part_bits(spark, sf_dir), files(spark, "permutation")
    text.frequency_lines(workload.frequencies(p).orderBy("freq", "pos").coalesce(1)).write.text(path)
    return workload.permute(p, text.read_permutation(spark, path)).select("key", Bits.of().to_ascii().alias("ascii"))


@query(SQL_PART_BITS + f", d AS (SELECT {SQL_ASCII.format('p')} AS ascii, min(key) AS least, string_agg(CAST(key AS VARCHAR), ' ' ORDER BY key) AS keys FROM p GROUP BY ascii) SELECT 'query=' || least || ' ' || keys AS line, ascii FROM d")
def dictionary_lines(spark, sf_dir):
    """Distinct sets as a generator's dictionary, written from their last bit and read back, beside the result lines of their keys."""
    kept = match.merged_keys(part_bits(spark, sf_dir)).withColumn("least", F.array_min("keys"))
    path = files(spark, "dictionary")
    kept.select(F.concat(F.lit("+ "), F.col("least").cast("string"), F.lit(" "), F.reverse(Bits.of().to_ascii()))).write.text(path)
    lines = text.result_lines(kept.select(F.col("least").alias("qid"), "keys")).select(F.col("value").alias("line"), F.regexp_extract("value", "^query=([0-9]+)", 1).cast("bigint").alias("iface"))
    return lines.join(text.read_dictionary(spark, path), "iface").select("line", Bits.of().to_ascii().alias("ascii"))


STREAMED = SUPPLIERS + ", a AS (SELECT segment, list(key) AS k FROM m GROUP BY segment) SELECT segment, CAST(len(k) AS BIGINT) AS keys FROM a"


def streamed(spark: SparkSession, sf_dir: str, latency_ms: int) -> DataFrame:
    """The segments' queries as a stream against a published database; with a latency limit the stream is drained and stopped."""
    from subsieve.operators.database import TagDatabase
    from subsieve.schema import QUERIES as STREAM

    f, q = nations(spark, sf_dir)
    base = files(spark, "stream")
    db = TagDatabase(spark, f"{base}/db", latency_ms)
    db.add(coded(f, "tags").select("key", *WORDS))
    db.consolidate()
    named = q.withColumn("qid", F.xxhash64("segment"))
    exact = f.select("key", "tags")
    coded(named, "query_tags").select("qid", *WORDS).write.parquet(f"{base}/queries")
    stream = spark.readStream.schema(STREAM).parquet(f"{base}/queries")
    run = match_stream(db, stream, to_table(f"{base}/out"), f"{base}/checkpoint")
    drain(run) if latency_ms else run.awaitTermination()
    got = spark.read.parquet(f"{base}/out").select("qid", F.explode("keys").alias("key")).join(named, "qid").join(exact, "key")
    return got.filter(F.size(F.array_except("tags", "query_tags")) == 0).groupBy("segment").agg(F.count("*").alias("keys"))


@query(STREAMED)
def stream_match(spark, sf_dir):
    return streamed(spark, sf_dir, 0)


@query(STREAMED)
def stream_latency(spark, sf_dir):
    return streamed(spark, sf_dir, 200)


@query()
def generated(spark, sf_dir):
    """Zipf-tagged random sets, matched with themselves: a generator has no SQL."""
    g = workload.generate(spark, 2000, 1, 6, "zipf", space=500, zipf_s=1.0, seed=4)
    f = g.select(F.col("id").alias("key"), "tags")
    q = g.select(F.col("id").alias("qid"), F.col("tags").alias("query_tags"))
    return match.tag_anchor(f, q, ["key"]).groupBy("qid").agg(F.count("*").alias("n"))


@query()
def sampled(spark, sf_dir):
    """Exactly 500 of the first 1000 orders by key (the sampler's feature)."""
    return workload.sample(read(spark, sf_dir, "orders").select("o_orderkey"), 500, 1000, "o_orderkey")
