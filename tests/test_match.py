import pytest
from fixtures import MATCHES, F, Q
from pyspark.sql import functions as fn

from subsieve.functions import bloom
from subsieve.operators import match
from subsieve.schema import words

FULL, EMPTY = [*range(192)], []


@pytest.fixture(scope="module")
def filters(sets):
    return sets([(j, f) for j, f in enumerate(F)], "key bigint").cache()


@pytest.fixture(scope="module")
def queries(sets):
    return sets([*enumerate(Q), (100, EMPTY), (101, FULL)], "qid bigint").cache()


def got(answers):
    return {r.qid: r["keys"] for r in answers.collect()}


EXPECTED = {**{i: m for i, m in enumerate(MATCHES)}, 100: [], 101: [*range(11)]}


@pytest.mark.parametrize("strategy,options", [("nested_loop", {}), ("mask_routed", {"max_partition": 3}), ("anchor", {}), ("auto", {})])
def test_subsets(filters, queries, strategy, options):
    found = match.pairs(filters, queries, strategy=strategy, **options)
    assert got(match.answers(queries, found, unique=True)) == EXPECTED


def test_other_relations(filters, queries):
    sup = match.pairs(filters, queries, "superset").groupBy("qid").agg(fn.array_sort(fn.collect_list("key")).alias("k"))
    want = {i: [j for j, f in enumerate(F) if {*q} <= {*f}] for i, q in [*enumerate(Q), (100, EMPTY), (101, FULL)]}
    assert {r.qid: r.k for r in sup.collect()} == {i: k for i, k in want.items() if k}
    same = match.pairs(filters, queries, "equal")
    assert sorted((r.qid, r.key) for r in same.collect()) == [(i, j) for i, q in enumerate(Q) for j, f in enumerate(F) if q == f]


def test_semi_and_anti(filters, queries):
    held = {r.qid for r in match.matching(filters, queries).collect()}
    rest = {r.qid for r in match.matching(filters, queries, False).collect()}
    assert held == {i for i, k in EXPECTED.items() if k} and rest == {i for i, k in EXPECTED.items() if not k}


def test_bag_and_set(sets):
    f = sets([(2, F[1]), (2, [13]), (3, F[1])], "key bigint")
    q = sets([(0, True, F[1]), (1, False, F[1]), (2, False, F[2])], "qid bigint, u boolean")
    found = match.pairs(f, q.drop("u"))
    assert {i: sorted(k) for i, k in got(match.answers(q, found)).items()} == {0: [2, 2, 3], 1: [2, 2, 3], 2: [2]}
    assert got(match.answers(q, found, True)) == {0: [2, 3], 1: [2, 3], 2: [2]}
    mixed = got(match.answers(q, found, "u"))
    assert mixed[0] == [2, 3] and sorted(mixed[1]) == [2, 2, 3]
    assert match.totals(match.answers(q, found)).first().asDict() == {"queries": 3, "keys": 7}


@pytest.mark.parametrize("strategy", ["nested_loop", "mask_routed", "anchor"])
def test_corners(sets, strategy):
    f = sets([(1, [0]), (2, [191])], "key bigint")
    q = sets([(0, [1, 10, 100, 190]), (1, [0, 10, 100, 190]), (2, [1, 10, 100, 191]), (3, [0, 10, 100, 191])], "qid bigint")
    assert got(match.answers(q, match.pairs(f, q, strategy=strategy), True)) == {0: [], 1: [1], 2: [2], 3: [1, 2]}
    single = sets([(i, [i]) for i in range(192)], "key bigint")
    nested = sets([(i, range(i + 1)) for i in range(192)], "key bigint")
    every = sets([(0, FULL)], "qid bigint")
    for many in (single, nested):
        assert got(match.answers(every, match.pairs(many, every, strategy=strategy), True)) == {0: [*range(192)]}


def test_empty_tables(sets, queries):
    none = sets([], "key bigint")
    for strategy in ("nested_loop", "mask_routed", "anchor"):
        assert all(not k for k in got(match.answers(queries, match.pairs(none, queries, strategy=strategy))).values())


def test_tag_anchor(spark, monkeypatch):
    rows = [(i, [i % 5, 10 + i % 3, 20 + i % 7]) for i in range(60)] + [(60, []), (61, None), (62, [0])]
    asked = [(i, [0, 1, 10, 11, 20 + i % 7, 21, 0]) for i in range(12)] + [(12, []), (13, None)]
    f = spark.createDataFrame(rows, "key bigint, tags array<bigint>")
    f = f.select("*", *bloom.encode(fn.col("tags")).columns())
    q = spark.createDataFrame(asked, "qid bigint, query_tags array<bigint>")
    q = q.select("*", *bloom.encode(fn.col("query_tags")).columns())
    want = sorted((j, i) for i, t in rows for j, s in asked if {*(t or [])} <= {*(s or [])})
    for salt in (100_000, 2):
        monkeypatch.setattr(match, "SALT_ROWS", salt)
        r = match.tag_anchor(f.drop(*words()), q.drop(*words()), ["key"])
        assert sorted((x.qid, x.key) for x in r.collect()) == want


def test_tag_anchor_of_long_queries(spark, monkeypatch):
    """Queries do not carry their tags to each of them: with them they shuffle over 4 MB. Pairs stay the same."""
    rows = [(i, [i * 7919 % 4000, i * 104729 % 4000, i % 40]) for i in range(300)] + [(300, []), (301, None)]
    asked = [(i, [(i + j * (i % 3 + 1)) * 31 % 4000 for j in range(1500)]) for i in range(8)] + [(8, [1, 2, 3]), (8, [1, 2, 3]), (3, [0] * 50), (9, []), (10, None)]
    f = spark.createDataFrame(rows, "key bigint, tags array<bigint>")
    q = spark.createDataFrame(asked, "qid bigint, query_tags array<bigint>")
    want = sorted((j, i) for i, t in rows for j, s in asked if {*(t or [])} <= {*(s or [])})
    assert len(want) > 2 * len(asked) + 20
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        done = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(done.apply, range(done.size()))}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for bound in (match.BROADCAST_BYTES, -1):
            monkeypatch.setattr(match, "BROADCAST_BYTES", bound)
            before = stages()
            assert sorted((x.qid, x.key) for x in match.tag_anchor(f, q, ["key"]).collect()) == want
            assert sum(n for k, n in stages().items() if k not in before) < 4e6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_sides_are_not_broadcast(filters, queries, monkeypatch):
    """Beyond the bound every strategy and relation goes by equi-joins, with the same pairs."""
    relations = [("subset", "nested_loop"), ("subset", "mask_routed"), ("subset", "auto"), ("superset", "auto"), ("subset", "anchor"), ("superset", "anchor")]
    small = {r: sorted(match.pairs(filters, queries, r).select("qid", "key").collect()) for r in ("subset", "superset")}
    monkeypatch.setattr(match, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(match, "SALT_ROWS", 2)
    for relation, strategy in relations:
        found = match.pairs(filters, queries, relation, strategy, **({"max_partition": 3} if strategy == "mask_routed" else {}))
        assert sorted(found.select("qid", "key").collect()) == small[relation], (relation, strategy)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, (relation, strategy)
    held = {r.qid for r in match.matching(filters, queries).collect()}
    assert held == {i for i, k in EXPECTED.items() if k}


def test_popcounts(filters, queries):
    for relation in ("subset", "superset"):
        assert sorted(match.nested_loop(filters, queries, relation, popcounts=True).select("qid", "key").collect()) == sorted(match.pairs(filters, queries, relation).select("qid", "key").collect())


def test_merged_and_latest(sets):
    f = sets([(1, 2, F[1]), (2, 3, F[1]), (3, 4, F[1]), (4, 9, F[2])], "seq bigint, key bigint")
    assert sorted(r["keys"] for r in match.merged_keys(f).collect()) == [[2, 3, 4], [9]]
    assert sorted(r.key for r in match.latest(f, "key", "seq").collect()) == [4, 9]
