import random

import numpy as np
import pytest
from fixtures import F, Q
from pyspark.sql import functions as fn

from subsieve.functions.bits import Bits
from subsieve.plans import partition
from subsieve.plans.partition import balanced_partitions, leading_runs, prefixes


def groups(rows):
    return sorted(sorted(r.k) for r in rows.groupBy("pid").agg(fn.collect_list("id").alias("k")).collect())


@pytest.mark.parametrize("given,most,want", [(Q[:3], 5, [[0, 1, 2]]), (F[:3], 5, [[0], [1, 2]]), ([*F[:10], sorted([*F[10], 182])], 3, [[0, 6, 10], [1, 2, 8], [3], [4, 9], [5, 7]])])
def test_known_groups(sets, given, most, want):
    rows, masks = balanced_partitions(sets([*enumerate(given)]), most)
    assert groups(rows) == want and masks.count() == len(want)


@pytest.mark.parametrize("most", [4])
def test_invariants(sets, most):
    rng = random.Random(most)
    given = [*F, *Q, *([sorted(rng.sample(range(192), rng.randrange(1, 30))) for _ in range(60)]), [1, 2], [1, 3], [2, 3]]
    rows, masks = balanced_partitions(sets([*enumerate(given)]), most)
    by = {}
    for r in rows.collect():
        by.setdefault(r.pid, []).append({*given[r.id]})
    got = {r.pid: ({*r.m}, r.size) for r in masks.select("pid", "size", Bits.of("m").positions().alias("m")).collect()}
    assert sum(map(len, by.values())) == len(given) and by.keys() == got.keys()
    for pid, members in by.items():
        distinct = {frozenset(m) for m in members}
        assert got[pid] == (set.intersection(*members), len(distinct)) and got[pid][0] and len(distinct) <= most


def test_equal_and_empty_sets(sets):
    rows, masks = balanced_partitions(sets([(0, [5]), (1, [5]), (2, [5]), (3, [])]), 1)
    assert groups(rows) == [[0, 1, 2], [3]] and masks.filter(Bits.of("m").is_empty()).count() == 1
    rows, masks = balanced_partitions(sets([]), 3)
    assert not rows.count() and not masks.count()


@pytest.mark.parametrize("head_sets", [200_000, 5])
def test_prefix_split(sets, monkeypatch, head_sets):
    monkeypatch.setattr(partition, "HEAD_SETS", head_sets)
    rng = random.Random(4)
    given = [sorted({0, 3, 5, *rng.sample(range(6, 192), 3)}) for _ in range(20)] + [[1, 2], [7, 9, 100, 150], [7, 9, 100, 151], [191]]
    rows = leading_runs(sets([*enumerate(given)]), max_size=6, min_ones=2).cache()
    text = lambda p: "".join("1" if i in p else "0" for i in range(192))
    runs = groups(rows)
    assert sorted(i for r in runs for i in r) == [*range(len(given))] and max(map(len, runs)) <= 6
    order = sorted(range(len(given)), key=lambda i: text(given[i]), reverse=True)
    for r in runs:
        places = sorted(order.index(i) for i in r)
        assert places == [*range(places[0], places[0] + len(r))]
        if len(r) > 1:
            shared = next(k for k in range(192) if len({text(given[i])[k] for i in r}) > 1)
            assert text(given[r[0]])[:shared].count("1") > 2
    sizes = sorted((r.size, r.length) for r in prefixes(rows).collect())
    assert [s for s, _ in sizes] == sorted(map(len, runs)) and all(n <= 192 for _, n in sizes)


def test_runs():
    texts = np.array(["1111", "1110", "1100", "1011", "1010", "1000", "0111"])
    assert partition.cut_runs(texts, 10).tolist() == [0] * 7 and partition.cut_runs(texts, 1).tolist() == [*range(7)]
    assert partition.cut_runs(texts, 4).tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert partition.cut_runs(np.array(["11"] * 5), 2).tolist() == [0, 0, 1, 1, 2]


def test_counts_without_a_part(sets):
    whole, part = sets([(0, [1, 2]), (1, [2, 5])]), sets([(1, [2, 5])])
    a, b = (df.agg(partition.bit_counts(Bits.of()).alias(n)) for df, n in ((whole, "a"), (part, "b")))
    got = a.join(b).select(partition.less_counts(fn.col("a"), fn.col("b"))).first()[0]
    assert {p: n for p, n in enumerate(got) if n} == {1: 1, 2: 1}
