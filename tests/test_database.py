import pytest
from fixtures import F
from pyspark.sql import functions as fn

from subsieve.operators.database import TagDatabase


def keys(db, sets, *queries, **options):
    q = sets([*enumerate(queries)], "qid bigint")
    return [sorted(r["keys"]) for r in db.match(q, **options).orderBy("qid").collect()]


def test_changes(spark, sets, tmp_path):
    db = TagDatabase(spark, str(tmp_path / "db"))
    assert keys(db, sets, F[1]) == [[]]
    db.consolidate()
    assert keys(db, sets, F[1]) == [[]]
    db.add(sets([(1, F[1]), (2, F[1]), (3, F[2]), (4, F[3])], "key bigint"))
    assert keys(db, sets, F[1]) == [[]]  # staged only
    db.consolidate()
    assert keys(db, sets, F[1], F[2], F[3], [*range(192)], []) == [[1, 2], [3], [4], [1, 2, 3, 4], []]
    db.remove(sets([(2, F[1]), (3, F[2])], "key bigint"))
    db.add(sets([(7, F[1])], "key bigint"))
    db.consolidate()
    assert keys(db, sets, F[1], F[2]) == [[1, 7], []] and db.snapshot().count() == 2
    assert db.versions == [1, 2, 3] and db.snapshot(2).count() == 3
    db.add(sets([(9, F[1])], "key bigint"))
    db.remove(sets([(9, F[1])], "key bigint"))  # the last operation wins
    db.consolidate()
    assert keys(db, sets, F[1]) == [[1, 7]]
    for strategy in ("nested_loop", "mask_routed", "anchor"):
        assert keys(db, sets, [*range(192)], strategy=strategy, unique=True) == [[1, 4, 7]]
    assert db.routing(sets([(0, [*range(192)])], "qid bigint")).agg(fn.sum("queries")).first()[0] >= 1 and db.bytesize() > 0
    db.clear()
    db.consolidate()
    assert keys(db, sets, F[1]) == [[]]


def test_start_and_stop(spark, sets, tmp_path):
    db = TagDatabase(spark, str(tmp_path / "db"))
    for turn in range(2):
        db.add(sets([(turn, F[turn])], "key bigint"))
        db.consolidate()
        db.start()
        db.start()
        assert keys(db, sets, F[turn]) == [[turn]]
        db.stop()
        db.stop()
    assert keys(db, sets, [*range(192)]) == [[0, 1]]


def test_empty_sets(spark, sets, tmp_path):
    with pytest.raises(ValueError):
        TagDatabase(spark, str(tmp_path / "a")).add(sets([(1, [])], "key bigint"))
    db = TagDatabase(spark, str(tmp_path / "b"), allow_empty=True)
    db.add(sets([(1, []), (2, [4])], "key bigint"))
    db.consolidate()
    for strategy in ("nested_loop", "mask_routed", "anchor"):
        assert keys(db, sets, [], [4], strategy=strategy) == [[1], [1, 2]]


def test_many_keys(spark, sets, tmp_path):
    db = TagDatabase(spark, str(tmp_path / "db"))
    df = sets([(0, F[1])]).withColumn("keys", fn.expr("sequence(0L, 99999L)"))
    db.add(df)
    db.consolidate()
    assert len(keys(db, sets, F[1])[0]) == 100_000


def test_the_last_operation_wins_across_objects(spark, sets, tmp_path):
    path = str(tmp_path / "db")
    open_ = lambda: TagDatabase(spark, path)
    one = sets([(1, F[1])], "key bigint")
    open_().add(one)
    open_().remove(one)
    open_().add(one)
    open_().consolidate()
    assert keys(open_(), sets, F[1]) == [[1]]
    open_().remove(one)
    db = open_()
    db.start()
    db.consolidate()  # what start() held of the old version is let go
    assert not db.started and keys(db, sets, F[1]) == [[]]
    db.start()
    db.add(one)
    db.consolidate()
    assert keys(db, sets, F[1]) == [[1]] and db.versions == [1, 2, 3]
    db.clear()
    assert db.versions == [] and not [p for p in (tmp_path / "db").iterdir() if not p.name.startswith(".")]


def test_unfinished_changes_and_consolidations(spark, sets, tmp_path, monkeypatch):
    path = tmp_path / "db"
    db = TagDatabase(spark, str(path))
    db.add(sets([(1, F[1])], "key bigint"))
    (path / "changes" / "seq=2").mkdir()  # a change whose writer was lost
    db.add(sets([(2, F[1])], "key bigint"))
    assert sorted(r.seq for r in db.changes().collect()) == [1, 3]
    merged = db.snapshot

    def late(*a):  # a change that comes while a consolidation runs
        monkeypatch.undo()
        TagDatabase(spark, str(path)).add(sets([(3, F[1])], "key bigint"))
        return merged(*a)

    monkeypatch.setattr(db, "snapshot", late)
    monkeypatch.setattr(db, "_delete", lambda p: None)  # and that ends before it has cleared away
    db.consolidate()
    assert keys(db, sets, F[1]) == [[1, 2]]
    again = TagDatabase(spark, str(path))
    assert [r.key for r in again.changes().collect()] == [3]
    again.consolidate()
    assert keys(again, sets, F[1]) == [[1, 2, 3]]
