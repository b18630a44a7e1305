"""Matching a stream of queries against a published database version.

Each micro-batch joins its queries with the version that is current then, so a consolidation is seen from the
next batch on. The latency limit is the trigger's interval; with none, a run takes what is there and ends.
Results go to a handler per batch; the checkpoint makes each query's answer appear once in an idempotent sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from subsieve.operators.database import TagDatabase


def match_stream(database: TagDatabase, queries: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, unique: bool | str = True, strategy: str = "auto", latency_ms: int | None = None) -> StreamingQuery:
    """Answer a stream of (qid, b0..b2). ``handler(answers, batch)`` gets (qid, keys) of each micro-batch."""
    latency = database.latency_ms if latency_ms is None else latency_ms

    def answer(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        held = batch.persist()
        try:
            handler(database.match(held, strategy, unique), number)
        finally:
            held.unpersist()

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{latency} milliseconds") if latency else writer.trigger(availableNow=True)).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own, so that a repeated batch replaces itself."""
    return lambda answers, number: answers.write.mode("overwrite").parquet(f"{path}/batch={number}")


def drain(query: StreamingQuery) -> None:
    """Answer all that has arrived, then stop."""
    query.processAllAvailable()
    query.stop()
