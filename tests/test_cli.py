import re

import pytest
from fixtures import MATCHES, F, Q
from pyspark.sql import functions as fn

from subsieve import cli
from subsieve.functions.bits import Bits
from subsieve.operators import workload
from subsieve.sources import binary, text


@pytest.fixture
def given(spark, sets, tmp_path):
    """Files of the known sets with their numbers as keys, and of the queries, in both formats."""
    filters = sets([*enumerate(F)]).withColumn("keys", fn.array("id")).coalesce(1)
    queries = sets([*enumerate(Q)]).orderBy("id").coalesce(1)
    text.filter_lines(filters).write.text(f"{tmp_path}/text-f")
    text.query_lines(queries).write.text(f"{tmp_path}/text-q")
    binary.write(binary.filter_records(filters), f"{tmp_path}/binary-f")
    binary.write(binary.query_records(queries), f"{tmp_path}/binary-q")
    return str(tmp_path)


def lines(spark, path):
    return [sorted(map(int, r[0].split()[1:])) for r in spark.read.text(path).orderBy(fn.regexp_extract("value", "=([0-9]+)", 1).cast("bigint")).collect()]


WANT = [sorted(m) for m in MATCHES]


@pytest.mark.parametrize("format_", ["text", "binary"])
def test_match_by_each_way(spark, given, capsys, format_):
    run = lambda *a: cli.main([*a, "--format", format_], spark)
    f, q = f"{given}/{format_}-f", f"{given}/{format_}-q"
    for strategy in ("auto", "anchor"):
        run("match", f, q, "--strategy", strategy, "--unique", "--output", f"{given}/{strategy}")
        assert lines(spark, f"{given}/{strategy}") == WANT
    said = capsys.readouterr().out
    assert re.search(r"matching: \d+ ms, \d+ ns a query", said) and f"queries={len(Q)} keys={sum(map(len, MATCHES))}" in said
    run("partition", f, f"{given}/parts", "--max", "3")
    run("match", f"{given}/parts/filters", q, "--prefixes", f"{given}/parts/prefixes", "--output", f"{given}/routed")
    assert lines(spark, f"{given}/routed") == WANT
    run("split", f, f"{given}/runs", "--max", "3")
    run("match", f"{given}/runs/filters", q, "--prefixes", f"{given}/runs/prefixes", "--output", f"{given}/by-runs")
    assert lines(spark, f"{given}/by-runs") == WANT
    run("run", f, q, "--database", f"{given}/db", "--limit", "3", "--output", f"{given}/few")
    assert lines(spark, f"{given}/few") == WANT[:3]


def test_workload_commands(spark, given, capsys):
    run = lambda *a: cli.main([*a], spark)
    f = f"{given}/text-f"
    run("frequency", f, "--output", f"{given}/map")
    run("permute", f, f"{given}/moved", "--map", f"{given}/map")
    new = text.read_permutation(spark, f"{given}/map")
    want = text.filter_lines(workload.permute(text.read_filters(spark, f), new))
    assert sorted(spark.read.text(f"{given}/moved").collect()) == sorted(want.collect())
    run("match", f, f"{given}/text-q", "--map", f"{given}/map", "--output", f"{given}/same")
    assert lines(spark, f"{given}/same") == WANT
    run("sort", f, f"{given}/sorted", "--first", "4")
    assert text.read_filters(spark, f"{given}/sorted").count() == 4
    run("convert", f, f"{given}/there")
    run("convert", f"{given}/there", f"{given}/back", "--format", "binary")
    assert sorted(spark.read.text(f"{given}/back").collect()) == sorted(spark.read.text(f).collect())
    run("sample", f, f"{given}/some", "--k", "5")
    assert text.read_filters(spark, f"{given}/some").count() == 5
    capsys.readouterr()
    run("count", f)
    assert f"sets={len(F)} bits={min(map(len, F))}..{max(map(len, F))}" in capsys.readouterr().out
    run("generate", f"{given}/made", "--n", "50", "--tags", "zipf", "--space", "30", "--kind", "queries")
    assert not text.read_queries(spark, f"{given}/made").filter(Bits.of().is_empty()).count()
    run("frequency", f)
    assert len(capsys.readouterr().out.splitlines()) == 192
