from fixtures import MATCHES, F, Q

from subsieve.operators.database import TagDatabase
from subsieve.schema import QUERIES
from subsieve.streaming.match_stream import drain, match_stream, to_table


def make(spark, sets, tmp_path):
    db = TagDatabase(spark, str(tmp_path / "db"))
    db.add(sets([*enumerate(F)], "key bigint"))
    db.consolidate()
    sets([*enumerate(Q)], "qid bigint").repartition(3).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(QUERIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q"))
    return db, stream


def test_available_now(spark, sets, tmp_path):
    db, stream = make(spark, sets, tmp_path)
    run = match_stream(db, stream, to_table(str(tmp_path / "out")), str(tmp_path / "c"))
    run.awaitTermination()
    assert {r.qid: r["keys"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == dict(enumerate(MATCHES))


def test_latency_and_drain(spark, sets, tmp_path):
    db, stream = make(spark, sets, tmp_path)
    seen = {}
    run = match_stream(db, stream, lambda answers, n: seen.update({r.qid: r["keys"] for r in answers.collect()}), str(tmp_path / "c"), latency_ms=200)
    drain(run)
    assert seen == dict(enumerate(MATCHES)) and not run.isActive
    db.add(sets([(50, F[1])], "key bigint"))
    db.consolidate()
    sets([(99, F[1])], "qid bigint").write.mode("append").parquet(str(tmp_path / "q"))
    drain(match_stream(db, stream, lambda answers, n: seen.update({r.qid: r["keys"] for r in answers.collect()}), str(tmp_path / "c"), latency_ms=200))
    assert seen[99] == [1, 50]
