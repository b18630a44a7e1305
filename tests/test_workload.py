import pytest
from fixtures import F, Q
from pyspark.sql import functions as fn

from subsieve.functions import bloom
from subsieve.functions.bits import Bits
from subsieve.operators import match, workload
from subsieve.sources import binary, text


@pytest.fixture(scope="module")
def rows(spark, sets):
    return sets([(j, f) for j, f in enumerate(F)]).withColumn("keys", fn.expr("transform(sequence(0, cast(id as int) % 4), x -> x * 1000000000L)")).withColumn("keys", fn.when(fn.col("id") == 5, fn.array().cast("array<bigint>")).otherwise(fn.col("keys"))).cache()


def as_set(df, cols):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*cols).collect())


W = ["b0", "b1", "b2"]


def test_text_round_trips(spark, rows, tmp_path):
    for kind, extra, cols in (("filter", {}, [*W, "keys"]), ("partitioned", {"pid": fn.col("id")}, [*W, "keys", "pid"]), ("query", {}, W)):
        path = str(tmp_path / kind)
        getattr(text, f"{kind}_lines")(rows.withColumns(extra)).write.text(path)
        back = getattr(text, {"filter": "read_filters", "partitioned": "read_partitioned", "query": "read_queries"}[kind])(spark, path)
        assert as_set(back, cols) == as_set(rows.withColumns(extra), cols)


def test_binary_round_trips(spark, rows, tmp_path):
    parts = rows.select(fn.col("id").alias("pid"), *Bits.of().between(0, 50).columns("m"), fn.lit(50).alias("length"), (fn.col("id") * 3).alias("size"))
    for kind, given, cols in (("filters", rows, [*W, "keys"]), ("partitioned", rows.withColumn("pid", fn.col("id")), [*W, "keys", "pid"]), ("queries", rows, W), ("prefixes", parts, ["pid", "m0", "m1", "m2", "length", "size"])):
        path = str(tmp_path / kind)
        read, write = binary.KINDS[kind]
        binary.write(getattr(binary, f"{write}_records")(given.repartition(3)), path)
        assert as_set(getattr(binary, read)(spark, path), cols) == as_set(given, cols)
        there, again = str(tmp_path / f"{kind}-text"), str(tmp_path / f"{kind}-again")
        binary.convert(spark, kind, path, there, to_binary=False)
        assert as_set(getattr(text, read)(spark, there), cols) == as_set(given, cols)
        binary.convert(spark, kind, there, again)
        assert as_set(getattr(binary, read)(spark, again), cols) == as_set(given, cols)


def test_legacy_lines(spark, tmp_path):
    bits = "".join("1" if p in F[0] else "0" for p in range(192))
    path = str(tmp_path / "x")
    spark.createDataFrame([(f"+ 7 {bits} 8 9",), (f"! 3 {bits[::-1]}",), (f"+ 5 {bits[::-1]}",)], "value string").coalesce(1).write.text(path)
    assert [r for r in text.read_filters(spark, path, legacy=True).select(Bits.of().positions().alias("p"), "keys").collect() if r.p == F[0]][0]["keys"] == [7, 8, 9]
    assert text.read_queries(spark, path, legacy=True).select(Bits.of().positions()).first()[0] == F[0]
    assert F[0] in [r[0] for r in text.read_dictionary(spark, path).select(Bits.of().positions()).collect()]


def test_permutation(spark, rows, tmp_path):
    freqs = workload.frequencies(rows)
    counts = [sum(p in f for f in F) for p in range(192)]
    assert [(r.pos, r.freq) for r in freqs.orderBy("pos").collect()] == [*enumerate(counts)]
    new = workload.permutation(freqs)
    path = str(tmp_path / "perm")
    old = sorted(range(192), key=new.__getitem__)
    spark.createDataFrame([("# comment",), *((f"p {o} 1 2",) for o in old)], "value string").coalesce(1).write.text(path)
    assert text.read_permutation(spark, path) == new
    moved = workload.permute(rows, new)
    assert [r[0] for r in moved.orderBy("id").select(Bits.of().positions()).collect()] == [sorted(new[p] for p in f) for f in F]
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("p 1 1 1",)], "value string").write.text(bad)
    with pytest.raises(ValueError):
        text.read_permutation(spark, bad)


def test_permuted_matching(sets):
    new = [(p * 5 + 3) % 192 for p in range(192)]
    f, q = sets([*enumerate(F)], "key bigint"), sets([*enumerate(Q)], "qid bigint")
    assert sorted(match.pairs(workload.permute(f, new), workload.permute(q, new)).select("qid", "key").collect()) == sorted(match.pairs(f, q).select("qid", "key").collect())


def test_sort_and_lines(rows):
    texts = ["".join("1" if p in f else "0" for p in range(192)) for f in F]
    assert [r[0] for r in workload.sort_descending(rows).select(Bits.of().to_ascii()).collect()] == sorted(texts, reverse=True)
    assert [r[0] for r in workload.sort_descending(rows, first=3).select(Bits.of().to_ascii()).collect()] == sorted(texts, reverse=True)[:3]
    lines = [r[0] for r in text.result_lines(rows.select(fn.col("id").alias("qid"), "keys")).collect()]
    assert "query=5" in lines and "query=1 0 1000000000" in lines
    assert len(text.frequency_lines(workload.frequencies(rows)).collect()) == 192
    assert [r.place for r in workload.numbered(rows, "id").orderBy("id").collect()] == [*range(11)]


@pytest.mark.parametrize("tags", ["uniform", "zipf", "bits"])
def test_generate(spark, tags):
    space = 50 if tags == "zipf" else 100_000
    df = workload.generate(spark, 300, 2, 5, tags, space=space, ifaces=(3, 9), trees=(1, 2), seed=9)
    got = df.collect()
    assert got == df.collect() and len(got) == 300 and {r.iface for r in got} == {*range(3, 10)} and {r.tree for r in got} == {1, 2}
    if tags != "bits":
        assert {len(r.tags) for r in got} == {2, 3, 4, 5} and all(len({*r.tags}) == len(r.tags) for r in got)
        assert not df.filter(~bloom.encode(fn.col("tags")).equals(Bits.of())).count()
    if tags == "zipf":
        count = lambda t: sum(t in r.tags for r in got)
        assert count(0) > count(10) > 0


def test_generate_with_dictionary(spark):
    df = workload.generate(spark, 50, 1, 1, dictionary=[[7], [9]], dictionary_count=1)
    assert not df.filter(~(Bits.of().test(7) | Bits.of().test(9))).count()
    with pytest.raises(ValueError):
        workload.generate(spark, 1, 1, 10, "zipf", space=5)


def test_zipf_weights():
    w = workload.zipf_weights(10, 2.0)
    assert w[0] == 100 and w[1] - w[0] == 25 and w[3] - w[2] == 4 and w[-1] - w[-2] == 1


def test_sample(spark):
    rows = spark.range(1000)
    got = {r.id for r in workload.sample(rows, 30, 100, seed=3).collect()}
    assert len(got) == 30 and max(got) < 100
    assert [r.id for r in workload.sample(rows, 20, 20).collect()] == [*range(20)]
    assert workload.sample(rows, 0, 10).count() == 0 and workload.sample(rows, 50).count() == 50


def test_bad_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.createDataFrame([("+ 01 5 x7 9",)], "value string").write.text(path)
    with pytest.raises(Exception, match="not a key: x7"):
        text.read_filters(spark, path).collect()


def test_a_permutation_after_many_other_lines(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(120_000).selectExpr("concat('# ', id)").union(spark.range(192).selectExpr("concat('p ', 191 - id)")).coalesce(1).write.text(path)
    assert text.read_permutation(spark, path) == [*range(191, -1, -1)]


@pytest.mark.parametrize("tags,s", [("uniform", 1.0), ("zipf", 1.0), ("zipf", 6.0)])
def test_sets_of_all_tags(spark, tags, s):
    got = workload.generate(spark, 60, 6, 6, tags, space=6, zipf_s=s).collect()
    assert all(sorted(r.tags) == [*range(6)] for r in got)
    if s > 1:
        assert sum(r.tags[0] == 0 for r in got) > 50 and sum(r.tags[1] == 1 for r in got) > 45
    with pytest.raises(ValueError):
        workload.generate(spark, 1, 1, 10, "uniform", space=5)


def test_order_helpers(sets):
    rng = __import__("random").Random(3)
    given = [sorted(rng.sample(range(192), 5)) for _ in range(40)]
    rows = sets([*enumerate(given)])
    text_ = lambda p: "".join("1" if i in p else "0" for i in range(192))
    order = sorted(range(40), key=lambda i: text_(given[i]), reverse=True)
    placed = workload.numbered(rows, Bits.of().to_ascii().desc())
    assert [r.id for r in placed.orderBy("place").collect()] == order and sorted(r.place for r in placed.collect()) == [*range(40)]
    assert not workload.out_of_order(placed, "place").count()
    wrong = {order.index(i + 1) for i in range(39) if text_(given[i + 1]) > text_(given[i])}
    assert {order.index(r.id) for r in workload.out_of_order(rows.withColumn("place", fn.col("id")), "place").collect()} == wrong
    parts = workload.sorted_in_partitions(rows.withColumn("pid", fn.col("id") % 3)).rdd.glom().collect()
    for p in parts:
        assert [(r.pid, order.index(r.id)) for r in p] == sorted((r.pid, order.index(r.id)) for r in p)
    assert workload.popcount_range(rows).first()[:] == (40, 5, 5, 5.0)
