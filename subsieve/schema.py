"""Column layouts. A set of bit positions 0..191 is three longs: bit i is weight 2^(i % 64) of word i // 64."""

from __future__ import annotations

from pyspark.sql import types as T

N_WORDS = 3
WIDTH = 64 * N_WORDS


def words(prefix: str = "b", n_words: int = N_WORDS) -> list[str]:
    return [f"{prefix}{k}" for k in range(n_words)]


def _longs(prefix: str) -> list[T.StructField]:
    return [T.StructField(c, T.LongType(), False) for c in words(prefix)]


FILTERS = T.StructType(_longs("b"))
QUERIES = T.StructType([T.StructField("qid", T.LongType(), False), *_longs("b"), T.StructField("unique", T.BooleanType())])
#: A database row: a set and the keys that it stands for (unsigned 32-bit, so LONG).
DATABASE = T.StructType([*_longs("b"), T.StructField("keys", T.ArrayType(T.LongType(), False), False)])
CHANGES = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), *_longs("b"), T.StructField("key", T.LongType(), False)])
PARTITIONED = T.StructType([*DATABASE.fields, T.StructField("pid", T.LongType())])
PARTITIONS = T.StructType([T.StructField("pid", T.LongType(), False), *_longs("m"), T.StructField("length", T.IntegerType()), T.StructField("size", T.LongType())])
PERMUTATION = T.StructType([T.StructField("old_pos", T.IntegerType(), False), T.StructField("new_pos", T.IntegerType(), False)])
FREQUENCY = T.StructType([T.StructField("pos", T.IntegerType(), False), T.StructField("freq", T.LongType(), False), T.StructField("pct", T.DoubleType())])
