import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subsieve.llm import mixing, queries, sharding, topk


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5], [0, 5, 0, 7], [], [3], [100, 1, 1, 1, 1, 1]])
def test_shares(sizes):
    size, weights = np.array(sizes), np.array([[5, 2, 1][i % 3] for i in range(len(sizes))], float)
    got = mixing.shares(size, weights, int(size.sum()), 3)
    assert got.sum() == pytest.approx(size.sum()) and (got <= 3 * size + 1e-9).all()
    free = [i for i in range(len(sizes)) if size[i] and got[i] < 3 * size[i] - 1e-9]
    assert len({round(got[i] / weights[i], 6) for i in free}) <= 1


def test_tree_keeps_quotas():
    quota = np.array([100, 3, 0, 57])
    out = mixing.split_tree(quota, 7, 1)
    assert (out.sum(0) == quota).all() and (out == mixing.split_tree(quota, 7, 1)).all()
    rows = out.sum(1)
    assert rows.max() - rows.min() <= 3  # the halves differ by one draw at most at each of three levels
    many = np.array([mixing.split_tree(quota, 2, s)[0] for s in range(300)])
    assert many[:, 0].mean() == pytest.approx(50, abs=1) and many[:, 3].mean() == pytest.approx(28.5, abs=1)


def test_fill():
    for room in range(20):
        sizes = [9, 5, 3, 1, 1]
        assert abs(sum(w for w, z in zip(sizes, mixing.fill(sizes, room), strict=True) if z) - min(room, 19)) <= 1


@pytest.mark.parametrize("block,cell", [(32, 64), (4, 3)])
def test_mix(spark, monkeypatch, block, cell):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "CELL", cell)
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 7}" if i % 50 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs, mixing.cyclic((5, 2, 1)), shards=5).toPandas()
    again = mixing.mix(docs.repartition(7), mixing.cyclic((5, 2, 1)), shards=5).toPandas()
    key = lambda d: sorted((i, [*x]) for i, x in zip(d["id"], d["draws"], strict=True))
    assert key(got) == key(again) and len(got) == 700
    got["taken"] = got["size"] * got["draws"].map(len)
    assert (got["taken"] <= 3 * got["size"]).all() and got.groupby(got["s"].fillna("~"))["target"].first().sum() == pytest.approx(got["size"].sum())
    for _, g in got.groupby(got["s"].fillna("~")):
        assert g["taken"].sum() == pytest.approx(g["target"].iloc[0], rel=0.02 if block == 32 else 0.1, abs=30)
    out = mixing.mixed(docs, mixing.cyclic((5, 2, 1)), shards=5)
    assert out.count() == got["draws"].map(len).sum() and {r.shard for r in out.select("shard").distinct().collect()} <= {*range(5)}
    assert mixing.shuffled(out).count() == out.count()


@pytest.mark.parametrize("window", [50_000, 20])
def test_op1_by_brute_force(spark, tmp_path, table, monkeypatch, window):
    """Targets by sharing out step by step, words taken near them, and each shard a gapless shuffle of its copies."""
    monkeypatch.setattr(mixing, "WINDOW", window)
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 50)), f"s{i % 5}" if i % 40 else None) for i in range(600)] + [(None, "w w", "s1"), (None, None, "s1")] + [(7000, "one text many times", "s2")] * 300
    got = queries.op1_mix(spark, table(tmp_path / "t", rows)).toPandas()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    words = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(words.values())), list(names)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while left > 1e-9 and free:  # pour a little at a time; what is full stays out
        step = min((3 * words[s] - target[s]) / weight[s] for s in free)
        step = min(step, left / sum(weight[s] for s in free))
        for s in free:
            target[s] += step * weight[s]
            left -= step * weight[s]
        free = [s for s in free if target[s] < 3 * words[s] - 1e-9]
    by = {w: t for w, t in zip(got.source_size, got.target, strict=True)}
    assert by == pytest.approx({words[s]: target[s] for s in names})
    assert (got.taken <= 3 * got["size"]).all()
    for w, g in got.groupby("source_size"):
        assert g.taken.sum() == pytest.approx(by[w], rel=0.03, abs=60)
    shards = {}
    for a, b, taken, n in zip(got.shards, got.places, got.taken, got["size"], strict=True):
        at = a.split(",") if a else []
        assert len(at) * n == taken
        for x, y in zip(at, b.split(",") if b else [], strict=True):
            shards.setdefault(x, []).append(int(y))
    assert {*map(int, shards)} <= {*range(24)} and all(sorted(v) == [*range(len(v))] for v in shards.values())


def test_many_equal_rows_meet_their_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 3)
    docs = spark.createDataFrame([(1, "a b c", "s0")] * 500 + [(2, "d e", "s0")] * 400 + [(i, "x " * 9, "s1") for i in range(3, 200)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs, mixing.cyclic((5, 2, 1)), shards=3).toPandas()
    got["taken"] = got["size"] * got["draws"].map(len)
    for _, g in got.groupby("s"):
        assert g.taken.sum() == pytest.approx(g.target.iloc[0], abs=9)
    out = mixing.mixed(docs.withColumn("n", F.lit("x")), mixing.cyclic((5, 2, 1)), shards=3)
    assert out.count() == got["draws"].map(len).sum() and out.columns == ["doc_id", "text", "source", "n", "shard", "place"]


def test_op2_by_brute_force(spark, tmp_path, table):
    rng = np.random.default_rng(8)
    rows = [(i, f"text {i} " + "é" * int(rng.integers(0, 400)), "s") for i in range(900)] + [(2000 + i, f"twins {i // 3}" * 30, "s") for i in range(90)] + [(None, None, None), (None, None, None), (4000, "", "s"), (4001, "long " * 3000, "s")]
    got = shards(spark, rows, tmp_path, table)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((-1 if i != i else int(i), n, c) for i, n, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    by = got.groupby("shard")["size"].sum()
    assert [*by.index] == [*range(24)] and by.max() - by.mean() <= 15_008 and got.grown_shard.isna().all()
    assert got[got["size"] < 15_000].groupby("shard")["size"].sum().max() <= 1.08 * by.mean()
    assert all(sorted(g.slot) == [*range(len(g))] for _, g in got.groupby("shard"))
    assert got[got["size"] > 8].groupby("text_crc32").shard.nunique().max() == 1


def test_mix_on_odd_tables(odd, none):
    assert mixing.mix(odd, mixing.cyclic((1,))).count() == odd.count()
    out = mixing.mixed(odd, mixing.cyclic((1,)))
    assert out.columns == [*odd.columns, "_shard", "place"]
    assert mixing.mix(none, mixing.cyclic((1,))).count() == 0 and mixing.mixed(none, mixing.cyclic((1,))).count() == 0
    with pytest.raises(ValueError):
        mixing.make_plan(mixing.slim_rows(odd, 1)[0], mixing.cyclic((1,)), 2, 1, 3, max_sources=1)


def shards(spark, rows, tmp_path, table):
    return queries.op2_shards(spark, table(tmp_path / "t", rows)).toPandas()


def test_shards(spark, tmp_path, table):
    rng = np.random.default_rng(5)
    rows = [(i, f"text {i} " + "x" * int(rng.integers(0, 900)), "s") for i in range(1500)] + [(2000 + i, "the same long text " * 20, "s") for i in range(900)] + [(4000 + i, f"pair {i // 2}", "s") for i in range(60)] + [(5000, None, None), (5001, "", None)]
    got = shards(spark, rows, tmp_path, table)
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.itertuples()} == want and {*got.law} == {"bytes"}
    by = got.groupby("shard")["size"].sum()
    assert sorted(by.index) == [*range(24)] and by.max() < 1.08 * by.mean() and by.min() > 0.92 * by.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == [*range(len(g))]
    pairs = got[(got.doc_id >= 4000) & (got.doc_id < 5000)]
    assert pairs.groupby("text_crc32").shard.nunique().max() == 1


def test_numbering_in_several_windows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("shard"), sharding.hashed(F.col("id")).alias("t"))
    for _, g in sharding.numbered(rows, 500, 3).toPandas().groupby("shard"):
        assert sorted(g.slot) == [*range(len(g))]


def test_sharding_odd_tables(odd, none):
    out = sharding.shard_documents(odd, n_shards=4, dims={"lang": "code", "source": "code"}, output="part")
    assert out.columns == [*odd.columns, "part"] and out.count() == odd.count()
    assert sharding.shard_documents(odd, target_bytes=2000, output="part").select("part").distinct().count() > 1
    assert sharding.shard_documents(none, n_shards=4).count() == 0


def brute(rows, asked, k):
    return sorted((q, i, d, r + 1) for q, x in asked for r, (d, i) in enumerate(sorted((bin((x ^ y) & (2**64 - 1)).count("1"), i) for i, y in rows)[:k]))


@pytest.mark.parametrize("n,spread,hot", [(0, 1, 4096), (3, 1, 4096), (400, 64, 4096), (300, 6, 7)])
def test_topk_is_exact(spark, n, spread, hot, monkeypatch):
    monkeypatch.setattr(topk, "HOT", hot)
    monkeypatch.setattr(topk, "BROADCAST_HOT", 1 << 18 if hot > 7 else 0)
    rng = np.random.default_rng(n)
    base = rng.integers(-(2**63), 2**63 - 1, size=5)
    rows = [(i, int(base[i % 5]) ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, spread), replace=False)))) for i in range(n)]
    rows += [(1000 + i, int(base[0])) for i in range(40 if n > 3 else 0)]
    odd = [(None, 5, 1, 1), (77_777, None, 1, 1)]
    df = spark.createDataFrame([*((*r, 0, 0) for r in rows), *odd], "vec_id bigint, code bigint, q int, value int")
    asked = rows[:: max(1, n // 6)]
    got = topk.search(df, spark.createDataFrame([*((*r, 0, 0) for r in asked), *odd], df.schema), 5)
    assert sorted((r.qid, r.id, r.distance, r.rank) for r in got.collect()) == brute(rows, asked, 5)


def test_codes(spark):
    rows = [(None,), ([],), ([1.0, -1.0, 0.0, None, float("nan"), 2.0],), ([0.5] * 64,)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(topk.sign_code("v")).collect()] == [None, 0, 1 + 32, -1]


def test_the_pipeline_shuffles_its_mix_by_shard(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('some words of ', id) as text", "'en' as lang", "concat('s', id % 3) as source", "20L as n_chars")
    at = {(r.doc_id, r.shard): r.place for r in mixing.mixed(docs, mixing.cyclic(corpus_pipeline.WEIGHTS), corpus_pipeline.SHARDS).collect()}
    shards = {}
    for doc, shard in at:
        shards.setdefault(doc, set()).add(shard)
    once = {doc: next(iter(s)) for doc, s in shards.items() if len(s) == 1}
    parts = corpus_pipeline.mix_sources(spark, docs, "").select("doc_id").rdd.glom().collect()
    got = [[(once[r.doc_id], at[r.doc_id, once[r.doc_id]]) for r in p if r.doc_id in once] for p in parts]
    flat = [x for p in got for x in p]  # a shard may lie in several partitions, one after the other
    assert flat == sorted(flat) and len(flat) >= len(once) > 0
