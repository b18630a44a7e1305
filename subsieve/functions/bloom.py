"""Tags to bit sets: k hash positions per tag, as the workloads' generator makes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits
from subsieve.schema import N_WORDS

K = 7
TAG_SPACE = 1 << 20


def tag_id(text: Column, space: int = TAG_SPACE) -> Column:
    """An integer tag of a string: the first 32 bits of its md5, reduced."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(space))


def universal_hash(x: Column, a: Column) -> Column:
    """The generator's hash, with unsigned 32-bit wrap-around done in longs."""
    a, x = a.cast("bigint"), x.cast("bigint")
    wrapped = ((a + 73) * x + a + 3).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return wrapped % 131071 % 65536


def positions(tags: Column, k: int = K, n_words: int = N_WORDS) -> Column:
    """Distinct positions of an array of integer tags; null is no tags."""
    per_tag = F.transform(F.coalesce(tags, F.array().cast("array<bigint>")), lambda t: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (universal_hash(i, t) % (64 * n_words)).cast("int")))
    return F.array_distinct(F.flatten(per_tag))


def encode(tags: Column, k: int = K, n_words: int = N_WORDS) -> Bits:
    """The bit set of an array of integer tags. Matching on it has false positives, never false negatives."""
    return Bits.from_positions(positions(tags, k, n_words), n_words)
