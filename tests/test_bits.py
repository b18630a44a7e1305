import random
import struct

import pytest
from fixtures import OPERATIONS, B
from pyspark.sql import functions as F

from subsieve.functions import bloom
from subsieve.functions.bits import Bits, common_all, union_all


def text(positions):
    return "".join("1" if p in {*positions} else "0" for p in range(192))


@pytest.fixture(scope="module")
def pool():
    rng = random.Random(3)
    out = [[], [*range(192)], [0], [63], [64], [127], [128], [191], [63, 127, 191]]
    return out + [sorted(rng.sample(range(192), n)) for n in (1, 3, 20, 60, 100, 150, 190) for _ in range(3)]


def test_operations(spark, sets):
    names = {"equals": "equals", "subset_of": "subset_of", "prefix_less_than": "less", "leftmost_diff": "leftmost_diff", "prefix_subset_of": "prefix_subset_of", "suffix_subset_of": "suffix_subset_of", "range_subset": "range_subset_of"}
    a, b = ([(i, B[o[k]]) for i, o in enumerate(OPERATIONS)] for k in (1, 2))
    joined = sets(a).join(sets(b).withColumnsRenamed({f"b{k}": f"q{k}" for k in range(3)}), "id")
    x, y = Bits.of("b"), Bits.of("q")
    for i, (op, _, _, args, expected) in enumerate(OPERATIONS):
        joined = joined.withColumn(f"r{i}", F.when(F.col("id") == i, getattr(x, names[op])(y, *args)))
        if i % 20 == 19 or i == len(OPERATIONS) - 1:
            done = {r["id"]: r.asDict() for r in joined.collect()}
            for j in range(i - i % 20, i + 1):
                assert done[j][f"r{j}"] == OPERATIONS[j][4], OPERATIONS[j]
            joined = joined.drop(*[f"r{j}" for j in range(i - i % 20, i + 1)])


def test_next_bit(sets):
    df = sets([(0, [2, 29, 31, 70, 138, 189, 191]), (1, [])])
    at = [0, 1, 3, 30, 32, 71, 139, 190, 192]
    one, none = (r.asDict() for r in df.orderBy("id").select(*(Bits.of().next_bit(p).alias(str(p)) for p in [*at, 63, 64, 127, 128, 130])).collect())
    assert [one[str(p)] for p in at] == [2, 2, 29, 31, 70, 138, 189, 191, 192]
    assert {*none.values()} == {192}


def test_against_python(spark, sets, pool):
    rows = [(i, p) for i, p in enumerate(pool)]
    b = Bits.of()
    r = F.col("id").cast("int") * 7 % 193
    got = sets(rows).select("id", b.popcount().alias("n"), b.positions().alias("p"), b.to_ascii().alias("t"), b.to_binary().alias("raw"), b.prefix_popcount(r).alias("pre"), b.suffix_popcount(r).alias("suf"), b.next_bit(r).alias("next"), b.kth_bit(2).alias("third"), b.is_empty().alias("empty"), b.test(r).alias("has"), F.array(*b.uint32()).alias("u"), b.suffix_popcounts().alias("all_suf")).collect()
    for x in got:
        p = pool[x["id"]]
        at = x["id"] * 7 % 193
        value = sum(1 << i for i in p)
        assert (x["n"], x["p"], x["t"], bytes(x["raw"])) == (len(p), p, text(p), value.to_bytes(24, "little"))
        assert x["pre"] == sum(i < at for i in p) and x["suf"] == sum(i >= at for i in p)
        assert x["next"] == min((i for i in p if i >= at), default=192) and x["third"] == (p[2] if len(p) > 2 else 192)
        assert x["empty"] == (not p) and x["has"] == (at in p)
        assert x["u"] == [*struct.unpack("<6I", value.to_bytes(24, "little"))]
        assert x["all_suf"] == [sum(i >= k for i in p) for k in range(192)]


def test_round_trips(spark, sets, pool):
    df = sets([(i, p) for i, p in enumerate(pool)])
    b = Bits.of()
    for other in (Bits.parse(b.to_ascii()), Bits.from_binary(b.to_binary()), Bits.from_positions(b.positions()), b.permute([*range(191, -1, -1)]).permute([*range(191, -1, -1)])):
        assert not df.filter(~other.equals(b)).count()
    assert [*map(bytes, (r[0] for r in sets([(0, [0]), (1, []), (2, [191]), (3, [1]), (4, [9])]).orderBy("id").select(b.to_binary()).collect()))] == [bytes([1]) + bytes(23), bytes(24), bytes(23) + b"\x80", bytes([2]) + bytes(23), bytes([0, 2]) + bytes(22)]


def test_readers(spark):
    df = spark.createDataFrame([("  0110x11",), ("1x1",), (None,), ("",)], "t string")
    parsed = [(r.a, r.b) for r in df.select(Bits.read_ascii(F.col("t")).positions().alias("a"), Bits.parse(F.col("t")).positions().alias("b")).collect()]
    assert parsed[0] == ([1, 2], [3, 4, 7, 8]) and parsed[1] == ([0], [0, 2]) and parsed[2] == ([], []) and parsed[3] == ([], [])


def test_algebra(spark, sets, pool):
    a, b = pool[12], pool[20]
    df = sets([(0, a)]).crossJoin(sets([(0, b)]).drop("id").withColumnsRenamed({f"b{k}": f"q{k}" for k in range(3)}))
    x, y = Bits.of("b"), Bits.of("q")
    got = df.select((x | y).positions(), (x & y).positions(), (x ^ y).positions(), x.minus(y).positions(), (~x).popcount(), x.set_bit(63).positions(), x.less(y), x.greater(y), x.prefix_equal(y, 0), Bits.empty().popcount(), Bits.full().popcount(), Bits.from_literal([0, 63, 191]).positions()).first()
    s, t = {*a}, {*b}
    assert [*got] == [sorted(s | t), sorted(s & t), sorted(s ^ t), sorted(s - t), 192 - len(s), sorted(s | {63}), text(a) < text(b), text(a) > text(b), True, 0, 192, [0, 63, 191]]


def test_order_is_that_of_the_texts(sets, pool):
    df = sets([(i, p) for i, p in enumerate(pool)])
    j = df.crossJoin(df.withColumnsRenamed({"id": "o", "b0": "q0", "b1": "q1", "b2": "q2"}))
    assert not j.filter(Bits.of("b").less(Bits.of("q")) != (Bits.of("b").to_ascii() < Bits.of("q").to_ascii())).count()


def test_aggregates(sets):
    df = sets([(0, [1, 2, 190]), (0, [2, 3, 190]), (1, [5])])
    assert {r[0]: r[1] for r in union_all(df, ["id"]).select("id", Bits.of().positions()).collect()} == {0: [1, 2, 3, 190], 1: [5]}
    assert {r[0]: (r[1], r[2]) for r in common_all(df, ["id"]).select("id", Bits.of("m").positions(), "size").collect()} == {0: ([2, 190], 2), 1: ([5], 1)}


def test_permutation_must_be_a_bijection():
    with pytest.raises(ValueError):
        Bits.empty().permute([0] * 192)


def test_bloom(spark):
    def hash_(x, a):
        return ((a + 73) * x + a + 3) % 2**32 % 131071 % 65536

    tags = [[0, 1, 2**32 - 1], [], [123456789], None]
    df = spark.createDataFrame([(t,) for t in tags], "tags array<bigint>")
    got = [r[0] for r in df.select(bloom.encode(F.col("tags")).positions()).collect()]
    assert got == [sorted({hash_(i, t) % 192 for t in ts or [] for i in range(7)}) for ts in tags]
    assert spark.range(1).select(bloom.tag_id(F.lit("abc"), 2**32)).first()[0] == 2416005272
