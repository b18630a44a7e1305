"""Bit sets as column expressions: everything here is JVM-side and inside whole-stage codegen where Spark allows it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsieve.schema import N_WORDS, words

Pos = int | Column
LEAST = -(2**63)


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _shift(name: str, c: Column, by: Pos) -> Column:
    return F.call_function(name, c, (F.lit(by) if isinstance(by, int) else by).cast("int"))


def below(r: Pos, k: int) -> Column:
    """Word k of the set of all positions under r."""
    r = F.lit(r) if isinstance(r, int) else r
    return F.when(r <= 64 * k, _long(0)).when(r >= 64 * k + 64, _long(-1)).otherwise(F.bitwise_not(_shift("shiftleft", _long(-1), r - 64 * k)))


def trailing_zeros(x: Column) -> Column:
    """Place of the lowest 1-bit of a word, 64 for 0. The least long is apart, as ANSI subtraction from it overflows."""
    return F.when(x == LEAST, F.lit(63)).otherwise(F.bit_count(F.bitwise_not(x).bitwiseAND(x - 1)))


class Bits:
    """A bit set over columns. All words are longs; operations between sets need the same number of words."""

    def __init__(self, *parts: Column):
        self.words = list(parts)
        self.width = 64 * len(parts)

    # building

    @classmethod
    def of(cls, prefix: str = "b", n_words: int = N_WORDS, table: str = "") -> Bits:
        """The columns b0, b1, ... (of an aliased table)."""
        return cls(*(F.col(f"{table}.{c}" if table else c) for c in words(prefix, n_words)))

    @classmethod
    def empty(cls, n_words: int = N_WORDS) -> Bits:
        return cls(*[_long(0)] * n_words)

    @classmethod
    def full(cls, n_words: int = N_WORDS) -> Bits:
        return cls(*[_long(-1)] * n_words)

    @classmethod
    def from_positions(cls, positions: Column, n_words: int = N_WORDS) -> Bits:
        """From an array of positions; repeats are one, others than 0..width-1 are left out, null is empty."""

        def word(k: int) -> Column:
            own = F.filter(positions, lambda p: (p >= 64 * k) & (p < 64 * k + 64))
            return F.coalesce(F.aggregate(own, _long(0), lambda w, p: w.bitwiseOR(_shift("shiftleft", _long(1), p - 64 * k))), _long(0))

        return cls(*map(word, range(n_words)))

    @classmethod
    def from_literal(cls, positions: Sequence[int], n_words: int = N_WORDS) -> Bits:
        value = sum(1 << p for p in {*positions})
        signed = [(value >> 64 * k) & (2**64 - 1) for k in range(n_words)]
        return cls(*(_long(w - 2**64 if w >> 63 else w) for w in signed))

    @classmethod
    def parse(cls, text: Column, n_words: int = N_WORDS) -> Bits:
        """From 0/1 text, position 0 first: any other character counts as 0, what is missing too."""
        clean = F.rpad(F.regexp_replace(F.coalesce(text, F.lit("")), "[^1]", "0"), 64 * n_words, "0")
        return cls(*(F.conv(F.reverse(F.substring(clean, 64 * k + 1, 64)), 2, -10).cast("bigint") for k in range(n_words)))

    @classmethod
    def read_ascii(cls, text: Column, n_words: int = N_WORDS) -> Bits:
        """As a stream reader does: leading white space is skipped, the first other character ends the set."""
        return cls.parse(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([01]*)", 1), n_words)

    def columns(self, prefix: str = "b") -> list[Column]:
        return [w.alias(c) for w, c in zip(self.words, words(prefix, len(self.words)), strict=True)]

    def _with(self, other: Bits, f) -> Bits:
        return Bits(*(f(a, b) for a, b in zip(self.words, other.words, strict=True)))

    def set_bit(self, pos: Pos) -> Bits:
        pos = F.lit(pos) if isinstance(pos, int) else pos
        return Bits(*(w.bitwiseOR(F.when((pos >= 64 * k) & (pos < 64 * k + 64), _shift("shiftleft", _long(1), pos - 64 * k)).otherwise(_long(0))) for k, w in enumerate(self.words)))

    # algebra

    def __or__(self, other: Bits) -> Bits:
        return self._with(other, Column.bitwiseOR)

    def __and__(self, other: Bits) -> Bits:
        return self._with(other, Column.bitwiseAND)

    def __xor__(self, other: Bits) -> Bits:
        return self._with(other, Column.bitwiseXOR)

    def __invert__(self) -> Bits:
        return Bits(*map(F.bitwise_not, self.words))

    def minus(self, other: Bits) -> Bits:
        return self & ~other

    def between(self, left: Pos = 0, right: Pos | None = None) -> Bits:
        """The positions left..right-1 of the set."""
        out = self if right is None else Bits(*(w.bitwiseAND(below(right, k)) for k, w in enumerate(self.words)))
        return out if isinstance(left, int) and left == 0 else Bits(*(w.bitwiseAND(F.bitwise_not(below(left, k))) for k, w in enumerate(out.words)))

    # tests

    def is_empty(self) -> Column:
        return reduce(Column.bitwiseOR, self.words) == 0

    def test(self, pos: Pos) -> Column:
        """Whether a position is in the set; false outside 0..width-1."""
        if isinstance(pos, int):
            return F.getbit(self.words[pos // 64], F.lit(pos % 64)) == 1 if 0 <= pos < self.width else F.lit(False)
        out = F.when(pos < 0, F.lit(False))
        for k, w in enumerate(self.words):
            out = out.when(pos < 64 * k + 64, F.getbit(w, pos % 64) == 1)
        return out.otherwise(F.lit(False))

    def equals(self, other: Bits) -> Column:
        return reduce(Column.__and__, (a == b for a, b in zip(self.words, other.words, strict=True)))

    def subset_of(self, other: Bits) -> Column:
        return reduce(Column.__and__, (a.bitwiseAND(F.bitwise_not(b)) == 0 for a, b in zip(self.words, other.words, strict=True)))

    def range_subset_of(self, other: Bits, left: Pos, right: Pos) -> Column:
        return self.between(left, right).subset_of(other)

    def prefix_subset_of(self, other: Bits, right: Pos) -> Column:
        return self.range_subset_of(other, 0, right)

    def suffix_subset_of(self, other: Bits, left: Pos) -> Column:
        return self.between(left).subset_of(other)

    def prefix_equal(self, other: Bits, right: Pos) -> Column:
        return (self ^ other).between(0, right).is_empty()

    def leftmost_diff(self, other: Bits) -> Column:
        """First position in one set only; the width if they are equal."""
        return (self ^ other).next_bit(0)

    def less(self, other: Bits) -> Column:
        """Whether the first differing position belongs to the other: the order of the 0/1 texts."""
        return F.coalesce(other.test(self.leftmost_diff(other)), F.lit(False))

    def greater(self, other: Bits) -> Column:
        return other.less(self)

    # positions and counts

    def next_bit(self, pos: Pos = 0) -> Column:
        """First position of the set from ``pos`` on; the width if there is none."""
        rest = self if isinstance(pos, int) and pos == 0 else self.between(pos)
        out = F.lit(self.width)
        for k in range(len(self.words) - 1, -1, -1):
            out = F.when(rest.words[k] != 0, trailing_zeros(rest.words[k]) + 64 * k).otherwise(out)
        return out

    def positions(self) -> Column:
        """Array of the positions, ascending."""
        return F.filter(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda p: self.test(p))

    def kth_bit(self, k: Pos) -> Column:
        """Position of the k-th (from 0) 1-bit; the width if there are fewer."""
        return F.coalesce(F.get(self.positions(), F.lit(k) if isinstance(k, int) else k), F.lit(self.width))

    def popcount(self) -> Column:
        return reduce(Column.__add__, map(F.bit_count, self.words)).cast("int")

    def prefix_popcount(self, right: Pos) -> Column:
        return self.between(0, right).popcount()

    def suffix_popcount(self, left: Pos) -> Column:
        return self.between(left).popcount()

    def suffix_popcounts(self) -> Column:
        """Array: for each position the 1-bits from it on."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda p: self.suffix_popcount(p))

    def to_ascii(self, length: int | None = None) -> Column:
        """0/1 text, position 0 first, or its first ``length`` characters."""
        text = F.concat(*(F.reverse(F.lpad(F.bin(w), 64, "0")) for w in self.words))
        return text if length is None else F.substring(text, 1, length)

    def uint32(self) -> list[Column]:
        """The set as unsigned 32-bit values, lowest first."""
        return [x for w in self.words for x in (w.bitwiseAND(_long(0xFFFFFFFF)), F.shiftrightunsigned(w, 32))]

    def to_binary(self) -> Column:
        """Little-endian bytes: bit 0 is the lowest bit of byte 0."""
        text = self.to_ascii()
        return F.unhex(F.concat(*(F.lpad(F.conv(F.reverse(F.substring(text, 8 * i + 1, 8)), 2, 16), 2, "0") for i in range(self.width // 8))))

    @classmethod
    def from_binary(cls, raw: Column, n_words: int = N_WORDS) -> Bits:
        digits = F.hex(raw)

        def word(k: int) -> Column:
            return F.conv(F.concat(*(F.substring(digits, 16 * k + 2 * i + 1, 2) for i in range(7, -1, -1))), 16, -10).cast("bigint")

        return cls(*map(word, range(n_words)))

    def permute(self, new_of: Sequence[int]) -> Bits:
        """Position p moves to ``new_of[p]``, which must be a permutation of all positions."""
        if sorted(new_of) != list(range(self.width)):
            raise ValueError("a bit permutation must be a bijection of all positions")
        # one term per position: nested lambdas over words that lambdas made gave wrong bits here on Spark 4.1
        out = []
        for k in range(len(self.words)):
            terms = [F.shiftleft(F.getbit(self.words[old // 64], F.lit(old % 64)).cast("bigint"), new % 64) for old, new in enumerate(new_of) if new // 64 == k]
            out.append(reduce(Column.bitwiseOR, terms))
        return Bits(*out)


def union_all(df: DataFrame, by: Sequence[str], prefix: str = "b", n_words: int = N_WORDS) -> DataFrame:
    """The union of all sets of each group."""
    return df.groupBy(*by).agg(*(F.bit_or(c).alias(c) for c in words(prefix, n_words)))


def common_all(df: DataFrame, by: Sequence[str], prefix: str = "b", out: str = "m", n_words: int = N_WORDS) -> DataFrame:
    """The intersection and the number of all sets of each group."""
    return df.groupBy(*by).agg(*(F.bit_and(c).alias(o) for c, o in zip(words(prefix, n_words), words(out, n_words), strict=True)), F.count("*").alias("size"))
