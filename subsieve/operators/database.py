"""A versioned database of sets and keys: staged changes, consolidation into snapshots, matching on the last one.

A database is a folder: ``changes/seq=<n>/`` has the n-th staged change, ``v=<n>/`` the snapshots (sets with sorted
keys), and each row of the ``CURRENT`` table publishes a version and says up to which change it goes. A snapshot is
never altered, so readers of an older one are not disturbed, and matching before anything was published answers
with no keys. Changes are numbered by the folder, so the last operation on a key wins whichever object or session
staged it; one that was not written to its end does not count. A consolidation takes the changes that were staged
when it began: what is staged meanwhile waits for the next one, and if it ends before it has cleared them away, they
are passed over as published already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits
from subsieve.operators import match
from subsieve.plans.partition import balanced_partitions
from subsieve.runtime import cut
from subsieve.schema import CHANGES, DATABASE, words

WORDS = words()


def net(old: DataFrame, changes: DataFrame) -> DataFrame:
    """(b0..b2, key) after the changes: per set and key the last operation by ``seq`` wins, others stay."""
    last = changes.groupBy(*WORDS, "key").agg(F.max_by("op", "seq").alias("op"))
    kept = old.join(last.select(*WORDS, "key"), [*WORDS, "key"], "left_anti")
    return kept.select(*WORDS, "key").unionByName(last.filter("op = 'add'").select(*WORDS, "key"))


class TagDatabase:
    """Add and remove keys of sets, consolidate, match."""

    def __init__(self, spark: SparkSession, path: str, latency_ms: int = 0, allow_empty: bool = False):
        self.spark, self.path, self.latency_ms, self.allow_empty = spark, path.rstrip("/"), latency_ms, allow_empty
        self.started, self.max_partition_size = False, 1000
        self._rows: DataFrame | None = None
        self._parts: tuple[DataFrame, DataFrame] | None = None

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _published(self) -> list[tuple[int, int]]:
        """(version, last change in it), oldest first."""
        path = f"{self.path}/CURRENT"
        return sorted(map(tuple, self.spark.read.schema("version bigint, upto bigint").parquet(path).collect())) if self._exists(path) else []

    @property
    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return [v for v, _ in self._published()]

    @property
    def version(self) -> int | None:
        return max(self.versions, default=None)

    # changes

    def _staged(self, whole: bool = True) -> list[int]:
        """Numbers of the staged changes; only of those written to their end, or of all."""
        path = f"{self.path}/changes"
        if not self._exists(path):
            return []
        fs, p = self._fs(path)
        found = [int(f.getPath().getName().removeprefix("seq=")) for f in fs.listStatus(p) if f.getPath().getName().startswith("seq=")]
        return sorted(n for n in found if not whole or self._exists(f"{path}/seq={n}/_SUCCESS"))

    def _stage(self, sets: DataFrame, op: str) -> None:
        if not self.allow_empty and sets.filter(Bits.of().is_empty()).limit(1).count():
            raise ValueError("an empty set is in every query; set allow_empty to store it")
        seq = max([0, *self._staged(whole=False), *(upto for _, upto in self._published())]) + 1
        staged = sets.select(F.lit(op).alias("op"), *WORDS, F.col("key").cast("bigint").alias("key"))
        staged.write.mode("error").parquet(f"{self.path}/changes/seq={seq}")

    def add(self, sets: DataFrame) -> None:
        """Stage keys of sets: columns b0..b2 and ``key``, or ``keys`` (an array)."""
        self._stage(sets.select(*WORDS, F.explode("keys").alias("key")) if "keys" in sets.columns else sets, "add")

    def remove(self, sets: DataFrame) -> None:
        """Stage removals of keys from sets."""
        self._stage(sets.select(*WORDS, F.explode("keys").alias("key")) if "keys" in sets.columns else sets, "remove")

    def changes(self) -> DataFrame:
        """(seq, op, b0..b2, key) of all staged changes that no version holds."""
        done = max((upto for _, upto in self._published()), default=0)
        paths = [f"{self.path}/changes/seq={n}" for n in self._staged() if n > done]
        if not paths:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).option("basePath", f"{self.path}/changes").parquet(*paths).select(*CHANGES.names)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """(b0..b2, keys) of a published version, the last by default; empty if there is none."""
        version = self.version if version is None else version
        return self.spark.createDataFrame([], DATABASE) if version is None else self.spark.read.schema(DATABASE).parquet(f"{self.path}/v={version}")

    def consolidate(self, max_partition_size: int = 1000) -> int:
        """Merge the staged changes into a new version, publish it, and partition it when it is first matched by
        routing. Sets without keys are gone. What ``start`` held of the former version is let go."""
        staged, published = self._staged(), self._published()
        old = self.snapshot().select(*WORDS, F.explode("keys").alias("key"))
        merged = match.merged_keys(net(old, self.changes().filter(F.col("seq") <= max(staged, default=0))))
        version = max((v for v, _ in published), default=0) + 1
        merged.select(*WORDS, "keys").write.mode("overwrite").parquet(f"{self.path}/v={version}")
        upto = max([0, *staged, *(x for _, x in published)])
        self.spark.createDataFrame([(version, upto)], "version bigint, upto bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/CURRENT")
        for n in staged:
            self._delete(f"{self.path}/changes/seq={n}")
        self.stop()
        self.max_partition_size = max_partition_size
        return version

    def clear(self) -> None:
        """Forget versions, staged changes and what is held in memory."""
        self.stop()
        versions = self.versions
        for name in ("changes", "CURRENT", *(f"v={v}" for v in versions)):
            self._delete(f"{self.path}/{name}")

    # matching

    def start(self) -> None:
        """Hold the published version in memory; without effect if it is held already."""
        if not self.started:
            self._rows, self.started = self.snapshot().persist(), True

    def stop(self) -> None:
        """Let go of what ``start`` holds. It may be called again, and ``start`` after it."""
        if self._rows is not None and self.started:
            self._rows.unpersist()
        self._rows, self._parts, self.started = None, None, False

    def rows(self) -> DataFrame:
        return self._rows if self._rows is not None else self.snapshot()

    def partitions(self) -> tuple[DataFrame, DataFrame]:
        if self._parts is None:
            rows, masks = balanced_partitions(self.rows(), self.max_partition_size)
            self._parts = cut(rows), cut(masks)
        return self._parts

    def pairs(self, queries: DataFrame, strategy: str = "auto") -> DataFrame:
        options = {"partitioned": self.partitions()} if strategy == "mask_routed" else {}
        return match.pairs(self.rows(), queries, strategy=strategy, **options)

    def match(self, queries: DataFrame, strategy: str = "auto", unique: bool | str = False) -> DataFrame:
        """(qid, keys) of every query: the bag of the keys of all its sets. A key counts once for each set."""
        found = self.pairs(queries, strategy).select("qid", F.explode("keys").alias("key"))
        return match.answers(queries, found, unique)

    def match_unique(self, queries: DataFrame, strategy: str = "auto") -> DataFrame:
        """(qid, keys): as ``match``, sorted and each key once."""
        return self.match(queries, strategy, True)

    # figures

    def bytesize(self) -> int:
        """Estimate of the bytes of the rows matched against."""
        return match.size_bound(self.rows())

    def partition_sizes(self) -> DataFrame:
        """(pid, size, popcount): sets of each partition, and bits of its common mask."""
        return self.partitions()[1].select("pid", "size", Bits.of("m").popcount().alias("popcount"))

    def routing(self, queries: DataFrame) -> DataFrame:
        """(pid, queries): how many queries each partition would be asked."""
        return match.route(self.partitions()[1], queries).groupBy("pid").agg(F.count("*").alias("queries"))
