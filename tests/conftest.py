import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sets(spark):
    """A function that makes a table of sets from (values…, positions) rows."""
    from pyspark.sql import functions as F

    from subsieve.functions.bits import Bits

    def make(rows, names="id bigint"):
        df = spark.createDataFrame([(*r[:-1], [*r[-1]]) for r in rows], f"{names}, positions array<int>")
        return df.select(*[c for c in df.columns if c != "positions"], *Bits.from_positions(F.col("positions")).columns())

    return make
