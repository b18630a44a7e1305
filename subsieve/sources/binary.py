"""Binary records, little endian: sets 24 bytes, prefixes 33, and rows with a counted list of 32-bit keys.

Records of one length are read by Hadoop's fixed-length input, which splits files at records; rows with keys
have no such places and are read file by file. Files are written one per partition, by Python, to a folder that
all executors mount.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits
from subsieve.runtime import ship
from subsieve.schema import words

WORDS = words()


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    jvm = spark.sparkContext._jvm
    rdd = spark.sparkContext._jsc.sc().binaryRecords(path, size, spark.sparkContext._jsc.hadoopConfiguration())
    return DataFrame(spark._jsparkSession.createDataset(rdd, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("raw")


def _number(at: int, size: int) -> Column:
    """An unsigned little-endian number of ``size`` bytes at a place (from 0) of ``raw``."""
    return F.conv(F.hex(F.concat(*(F.substring("raw", at + i, 1) for i in range(size, 0, -1)))), 16, 10).cast("bigint")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(b0..b2) of 24-byte records."""
    return _records(spark, path, 24).select(*Bits.from_binary(F.col("raw")).columns())


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """(pid, m0..m2, length, size) of 33-byte records: set, length, id, size."""
    return _records(spark, path, 33).select(_number(25, 4).alias("pid"), *Bits.from_binary(F.substring("raw", 1, 24)).columns("m"), _number(24, 1).cast("int").alias("length"), _number(29, 4).alias("size"))


def parse(raw: bytes, with_pid: bool) -> pa.RecordBatch:
    """All rows of a file: their places one by one, as each says how long it is, and their values at once."""
    if len(raw) % 4:
        raise ValueError("the file ends within a row")
    values, head = np.frombuffer(raw, "<u4"), 1 if with_pid else 0
    counts, at, starts = memoryview(values), 0, []
    while at < len(counts):
        starts.append(at)
        at += head + 7 + counts[at + head + 6] if at + head + 6 < len(counts) else len(counts) + 1
    if at != len(counts):
        raise ValueError("the file ends within a row")
    first = np.array(starts, np.int64)
    word = lambda k: (values[first + head + 2 * k].astype(np.uint64) | values[first + head + 2 * k + 1].astype(np.uint64) << np.uint64(32)).view(np.int64)
    sizes = values[first + head + 6].astype(np.int64)
    ends = np.cumsum(sizes)
    keys = values[np.repeat(first + head + 7 - (ends - sizes), sizes) + np.arange(sizes.sum())].astype(np.int64)
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys))
    pid = pa.array(values[first].astype(np.int64)) if with_pid else pa.nulls(len(first), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(word(k)) for k in range(3)), listed, pid], names=[*WORDS, "keys", "pid"])


def _read_rows(spark: SparkSession, path: str, with_pid: bool) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield parse(raw, with_pid)

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInArrow(run, "b0 bigint, b1 bigint, b2 bigint, keys array<bigint>, pid bigint")
    return out if with_pid else out.drop("pid")


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """(b0..b2, keys)."""
    return _read_rows(spark, path, False)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """(b0..b2, keys, pid)."""
    return _read_rows(spark, path, True)


def _digits(c: Column, size: int) -> Column:
    """Hexadecimal digits of a number's little-endian bytes."""
    digits = F.lpad(F.hex(c.cast("bigint")), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)))


def _fixed(c: Column, size: int) -> Column:
    """A number as little-endian bytes."""
    return F.unhex(_digits(c, size))


def _counted_keys() -> Column:
    return F.concat(_fixed(F.size("keys"), 4), F.unhex(F.array_join(F.transform("keys", lambda k: _digits(k, 4)), "")))


def filter_records(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(Bits.of().to_binary(), _counted_keys()).alias("raw"))


def partitioned_records(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(_fixed(F.col("pid"), 4), Bits.of().to_binary(), _counted_keys()).alias("raw"))


def prefix_records(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(Bits.of("m").to_binary(), _fixed(F.col("length"), 1), _fixed(F.col("pid"), 4), _fixed(F.col("size"), 4)).alias("raw"))


def query_records(rows: DataFrame) -> DataFrame:
    return rows.select(Bits.of().to_binary().alias("raw"))


def write(records: DataFrame, path: str) -> None:
    """The ``raw`` bytes of each partition, one after the other, as files ``part-<n>`` in a folder that all executors see.

    A file is written under a name of its own task attempt and then renamed, so a lost or repeated task leaves
    one whole file."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError("binary files are written by Python: the path must be a folder that all executors mount")
    folder = path.removeprefix("file://")

    def run(part: int, rows: Iterator) -> Iterator:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/.{uuid.uuid4().hex}"
        with open(name, "wb") as f:
            for r in rows:
                f.write(r.raw)
        os.replace(name, f"{folder}/part-{part:05d}")
        return iter(())

    records.select("raw").rdd.mapPartitionsWithIndex(run).count()


#: What each format is read and written by.
KINDS = {
    "filters": ("read_filters", "filter"),
    "partitioned": ("read_partitioned", "partitioned"),
    "prefixes": ("read_prefixes", "prefix"),
    "queries": ("read_queries", "query"),
}


def convert(spark: SparkSession, kind: str, source: str, target: str, to_binary: bool = True) -> None:
    """Text to binary files or back, for one of ``KINDS``."""
    from subsieve.sources import text

    read, write_ = KINDS[kind]
    if to_binary:
        write(globals()[f"{write_}_records"](getattr(text, read)(spark, source)), target)
    else:
        getattr(text, f"{write_}_lines")(globals()[read](spark, source)).write.mode("overwrite").text(target)
