"""Line formats: ``+ <set> keys…``, ``f <pid> <set> keys…``, ``p <pid> <prefix> <size>``, ``! <set>``, ``p <old> …`` (permutation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits
from subsieve.schema import WIDTH


def _lines(spark: SparkSession, path: str, command: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w")).filter(F.col("w")[0] == command)


def _key(word: Column) -> Column:
    """A key, or an error that names what stands in its place."""
    return F.coalesce(word.try_cast("bigint"), F.raise_error(F.concat(F.lit("not a key: "), word)).cast("bigint"))


def _keys(start: int) -> Column:
    rest = F.slice("w", start + 1, F.greatest(F.size("w") - start, F.lit(0)))
    return F.transform(rest, _key).alias("keys")


def _word(i: int) -> Column:
    return F.get("w", F.lit(i))


def read_filters(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """(b0..b2, keys) of ``+`` lines; ``legacy`` lines have one key before the set."""
    at = 2 if legacy else 1
    keys = F.concat(F.transform(F.filter(F.array(_word(1)), lambda x: x.isNotNull()), _key), _keys(3)).alias("keys") if legacy else _keys(2)
    return _lines(spark, path, "+").select(*Bits.read_ascii(_word(at)).columns(), keys)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """(b0..b2, keys, pid) of ``f`` lines."""
    return _lines(spark, path, "f").select(*Bits.read_ascii(_word(2)).columns(), _keys(3), _word(1).cast("bigint").alias("pid"))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(pid, m0..m2, length, size) of ``p`` lines."""
    return _lines(spark, path, "p").select(_word(1).cast("bigint").alias("pid"), *Bits.read_ascii(_word(2)).columns("m"), F.length(_word(2)).alias("length"), _word(3).cast("bigint").alias("size"))


def read_queries(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """(b0..b2) of ``!`` lines; ``legacy`` lines are the generator's: numbers may precede a set written from its last bit."""
    if legacy:
        return _lines(spark, path, "!").select(*Bits.parse(F.reverse(F.element_at("w", -1))).columns())
    return _lines(spark, path, "!").select(*Bits.read_ascii(_word(1)).columns())


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(iface, b0..b2) of the generator's ``+ <iface> <set>`` lines, sets written from their last bit."""
    return _lines(spark, path, "+").select(_word(1).cast("bigint").alias("iface"), *Bits.parse(F.reverse(_word(2))).columns())


def read_permutation(spark: SparkSession, path: str) -> list[int]:
    """New place of each position: the n-th ``p`` line names the position that moves to n. Only those lines come to the driver."""
    old = [int(r[0][1]) for r in _lines(spark, path, "p").limit(WIDTH + 1).collect()]
    if sorted(old) != list(range(WIDTH)):
        raise ValueError(f"a permutation file must name each of {WIDTH} positions once")
    new = [0] * WIDTH
    for place, p in enumerate(old):
        new[p] = place
    return new


def _joined_keys() -> Column:
    return F.when(F.size("keys") > 0, F.concat(F.lit(" "), F.array_join(F.transform("keys", lambda x: x.cast("string")), " "))).otherwise(F.lit(""))


def filter_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("+ "), Bits.of().to_ascii(), _joined_keys()).alias("value"))


def partitioned_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("f "), F.col("pid").cast("string"), F.lit(" "), Bits.of().to_ascii(), _joined_keys()).alias("value"))


def prefix_lines(rows: DataFrame) -> DataFrame:
    prefix = F.substring(Bits.of("m").to_ascii(), F.lit(1), F.col("length"))
    return rows.select(F.concat_ws(" ", F.lit("p"), "pid", prefix, "size").alias("value"))


def query_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("! "), Bits.of().to_ascii()).alias("value"))


def frequency_lines(freqs: DataFrame) -> DataFrame:
    return freqs.select(F.concat_ws(" ", F.lit("p"), "pos", "freq", F.format_string("%.6g", "pct")).alias("value"))


def result_lines(answers: DataFrame) -> DataFrame:
    """``query=<n> k1 k2 …``"""
    return answers.select(F.concat(F.lit("query="), F.col("qid").cast("string"), _joined_keys()).alias("value"))
