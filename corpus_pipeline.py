"""A corpus pipeline over ``documents``: each stage is written as Parquet and reread as the next one's input.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and decides by them alone; labels
are those of the rows that are still there. All but the last return the columns of ``documents``.

Defined results, of all stages: an empty table gives an empty table; columns beside those of ``documents`` stay,
whatever their names, up to the last stage, which returns its own; texts are read whole however long they are; a
null text counts as empty, but in the near-dedup stage as a text of its own kind; repeated rows and ties are kept or
go together, but for that stage, which keeps one, and the mix, which draws each row by itself. Rows without an id
are no examples for the classifiers, which score them like all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsieve.llm import bytebpe, mixing, neardup, quality, toxicity
from subsieve.llm.common import fresh
from subsieve.runtime import cut

#: A document goes if its quality is scored below, or its toxicity not below, these thresholds.
LEAST_QUALITY, MOST_TOXICITY = 0.3, 0.5
#: Weights of the sources by code point order, repeating, and output shards of the mix.
WEIGHTS, SHARDS = (5, 2, 1), 24


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is scored at ``LEAST_QUALITY`` or more; without labels of both kinds all have one score."""
    model, (score,) = quality.fit(docs, labels(spark, sf_dir), "quality"), fresh(docs, "score")
    return quality.score(docs, model, output=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is scored below ``MOST_TOXICITY``; without labels of both kinds all have one score."""
    model, (score,) = toxicity.fit(docs, labels(spark, sf_dir), "toxic"), fresh(docs, "score")
    return toxicity.score(docs, model, output=score).filter(F.col(score) < MOST_TOXICITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; null ids rank last."""
    return neardup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once per copy, each shard's together and shuffled; a null source is the last one."""
    shard, place = fresh(docs, "shard", "place")
    return mixing.shuffled(mixing.mixed(docs, mixing.cyclic(WEIGHTS), SHARDS), shard, place).drop(shard, place)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as counts and digests."""
    coder = bytebpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytebpe.encode(docs, coder, keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level bpe", byte_bpe),
]

#: The classifiers and the random draw are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else cut(docs), sf_dir)
    return docs
