"""Command lines: ``python -m subsieve.cli <command> …``, over text or binary files of sets and queries.

generate, sample, convert, frequency, count, sort, permute: workloads. split: runs by prefix. partition: balanced
partitions. match: queries against sets, or against partitioned sets with their prefixes. run: add to a database,
consolidate, match, totals. Times go to the standard output, as does what has no output path.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsieve.functions.bits import Bits
from subsieve.operators import match, workload
from subsieve.operators.database import TagDatabase
from subsieve.plans.partition import balanced_partitions, leading_runs, prefixes
from subsieve.runtime import cut
from subsieve.sources import binary, text


def read(spark: SparkSession, args: argparse.Namespace, kind: str, path: str) -> DataFrame:
    return getattr(binary if args.format == "binary" else text, binary.KINDS[kind][0])(spark, path)


def put(args: argparse.Namespace, kind: str, rows: DataFrame, path: str) -> None:
    name = binary.KINDS[kind][1]
    if args.format == "binary":
        binary.write(getattr(binary, f"{name}_records")(rows), path)
    else:
        getattr(text, f"{name}_lines")(rows).write.mode("overwrite").text(path)


def show(lines: DataFrame, path: str | None) -> None:
    """To files, or, read from one partition after the other, to the standard output."""
    if path:
        lines.write.mode("overwrite").text(path)
    else:
        for r in lines.toLocalIterator():
            print(r[0])


def timed(what: str, f: Callable, count: int | None = None):
    start = time.perf_counter()
    out = f()
    took = time.perf_counter() - start
    print(f"{what}: {took * 1000:.0f} ms" + (f", {took * 1e9 / max(count, 1):.0f} ns a query" if count is not None else ""))
    return out


def first(rows: DataFrame, n: int | None) -> DataFrame:
    return rows if n is None else rows.limit(n)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = workload.generate(spark, a.n, a.least, a.most, a.tags, a.space, a.zipf_s, a.k, ifaces=(a.first_iface, a.last_iface), seed=a.seed)
    put(a, a.kind, rows.withColumn("keys", F.array(F.col("iface").cast("bigint"))), a.output)


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read(spark, a, a.kind, a.input).withColumn("place", F.monotonically_increasing_id())
    put(a, a.kind, workload.sample(rows, a.k, a.n, "place", a.seed).drop("place"), a.output)


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    binary.convert(spark, a.kind, a.input, a.output, to_binary=a.format == "text")


def frequency(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = workload.frequencies(read(spark, a, a.kind, a.input))
    show(text.frequency_lines(counts.orderBy("freq", "pos").coalesce(1)), a.output)


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    r = workload.popcount_range(read(spark, a, a.kind, a.input)).first()
    print(f"sets={r['sets']} bits={r['least']}..{r['most']} mean={r['mean']}")


def sort(spark: SparkSession, a: argparse.Namespace) -> None:
    put(a, a.kind, workload.sort_descending(read(spark, a, a.kind, a.input), a.first), a.output)


def permute(spark: SparkSession, a: argparse.Namespace) -> None:
    put(a, a.kind, workload.permute(read(spark, a, a.kind, a.input), text.read_permutation(spark, a.map)), a.output)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = cut(leading_runs(first(read(spark, a, "filters", a.input), a.first), a.max, a.ones))
    save_parts(a, rows, prefixes(rows))


def partition(spark: SparkSession, a: argparse.Namespace) -> None:
    found = timed("partitioning", lambda: [cut(x) for x in balanced_partitions(read(spark, a, "filters", a.input), a.max)])
    save_parts(a, *found)


def save_parts(a: argparse.Namespace, rows: DataFrame, masks: DataFrame) -> None:
    """``filters`` and ``prefixes`` under the output; ids are numbered from 0, as files have 32 bits for them."""
    names = workload.numbered(masks, "pid")
    held = rows.join(names.select("pid", "place"), "pid").drop("pid").withColumnRenamed("place", "pid")
    length = F.col("length") if "length" in masks.columns else F.lit(Bits.of("m").width)
    put(a, "partitioned", held, f"{a.output}/filters")
    put(a, "prefixes", names.drop("pid").withColumnRenamed("place", "pid").withColumn("length", length), f"{a.output}/prefixes")
    r = names.agg(F.count("*").alias("n"), F.max("size").alias("most")).first()
    print(f"partitions={r['n']} largest={r['most']}")


def asked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return cut(first(read(spark, a, "queries", a.queries), a.limit).withColumn("qid", F.monotonically_increasing_id()).select("qid", "b0", "b1", "b2"))


def answer(a: argparse.Namespace, queries: DataFrame, found: DataFrame) -> None:
    n = queries.count()
    out = timed("matching", lambda: cut(match.answers(queries, found.select("qid", F.explode("keys").alias("key")), a.unique)), n)
    r = match.totals(out).first()
    print(f"queries={r['queries']} keys={r['keys']}")
    show(text.result_lines(out), a.output)


def run_match(spark: SparkSession, a: argparse.Namespace) -> None:
    queries = asked(spark, a)
    rows = read(spark, a, "partitioned" if a.prefixes else "filters", a.filters)
    if a.map:
        new = text.read_permutation(spark, a.map)
        rows, queries = workload.permute(rows, new), workload.permute(queries, new)
    if a.prefixes:
        answer(a, queries, match.mask_routed(rows, queries, partitioned=(rows, read(spark, a, "prefixes", a.prefixes))))
    else:
        answer(a, queries, match.pairs(rows, queries, strategy=a.strategy))


def run_all(spark: SparkSession, a: argparse.Namespace) -> None:
    db = TagDatabase(spark, a.database)
    db.add(read(spark, a, "filters", a.filters))
    timed("consolidation", lambda: db.consolidate(a.max))
    queries = asked(spark, a)
    answer(a, queries, db.pairs(queries, a.strategy))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="subsieve", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(f: Callable, name: str, *paths: str, kind: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(f=f)
        p.add_argument("--format", choices=("text", "binary"), default="text")
        if kind:
            p.add_argument("--kind", choices=tuple(binary.KINDS), default="filters")
        for path in paths:
            p.add_argument(path)
        return p

    p = command(generate, "generate", "output")
    for name, kind, value in (("n", int, 1000), ("least", int, 1), ("most", int, 10), ("space", int, 100_000), ("zipf-s", float, 1.0), ("k", int, 7), ("first-iface", int, 0), ("last-iface", int, 0), ("seed", int, 1)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--tags", choices=("uniform", "zipf", "bits"), default="uniform")
    p = command(sample, "sample", "input", "output")
    for name, value in (("k", 1000), ("n", None), ("seed", 1)):
        p.add_argument(f"--{name}", type=int, default=value)
    command(convert, "convert", "input", "output")
    command(frequency, "frequency", "input").add_argument("--output")
    command(count, "count", "input")
    command(sort, "sort", "input", "output").add_argument("--first", type=int)
    command(permute, "permute", "input", "output").add_argument("--map", required=True)
    p = command(split, "split", "input", "output", kind=False)
    for name, value in (("max", 100), ("ones", 2), ("first", None)):
        p.add_argument(f"--{name}", type=int, default=value)
    command(partition, "partition", "input", "output", kind=False).add_argument("--max", type=int, default=200_000)
    for f, name in ((run_match, "match"), (run_all, "run")):
        p = command(f, name, "filters", "queries", kind=False)
        p.add_argument("--strategy", choices=[s for s in match.STRATEGIES if s != "tag_anchor"], default="auto")
        p.add_argument("--unique", action="store_true")
        p.add_argument("--limit", type=int)
        p.add_argument("--output")
        if f is run_match:
            p.add_argument("--prefixes")
            p.add_argument("--map")
        else:
            p.add_argument("--database", required=True)
            p.add_argument("--max", type=int, default=1000)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.f(spark or SparkSession.builder.appName("subsieve").getOrCreate(), args)


if __name__ == "__main__":
    main()
