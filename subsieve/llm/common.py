"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from subsieve.runtime import ship

#: A word: what lies between ASCII white space, as ``bytes.split()`` sees it.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: str | Column) -> Column:
    """Bytes of the UTF-8 form; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fold(key: str | Column, folds: int) -> Column:
    """Fold of a row by crc32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))), F.lit(folds))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package importable on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def beside(docs: DataFrame, text: str, keep: list[str] | None, outputs: list[StructField]) -> tuple[DataFrame, list[str], StructType]:
    """What a pass over texts reads, the names of the columns that it keeps, and the schema of what it returns.

    It reads the kept columns, under names of their own, and the text last. Columns named as an output (compared
    without case) are replaced by it; no other name matters."""
    made = {f.name.lower() for f in outputs}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    types = [f.dataType for f in source.schema.fields[:-1]]
    return source, kept, StructType([*(StructField(c, t) for c, t in zip(kept, types, strict=True)), *outputs])


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
