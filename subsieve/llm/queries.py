"""The queries of this subpackage over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, linear, lm, media, mixing, neardup, quality, sharding, tokenfile, topk, toxicity
from subsieve.runtime import cut

from .common import n_bytes, read


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = 24
    rows = mixing.local_places(mixing.mix(read(spark, sf_dir, "documents"), mixing.cyclic((5, 2, 1)), shards), shards)
    taken = F.col("size") * F.size("draws")
    listed = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for c, n in (("draws", "shards"), ("places", "places"))]
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("bigint").alias("taken"), *listed)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 24
    docs = read(spark, sf_dir, "documents")
    size = n_bytes("text") + 8
    dims = [sharding.code(F.col("lang")), sharding.number(F.col("n_chars")), sharding.number(size)]
    crc = F.coalesce(F.crc32(F.col("text")), F.lit(0)).alias("text_crc32")
    rows = cut(sharding.prepared(docs.select("doc_id", crc, "lang", "n_chars", "text"), dims, size, sharding.hashed(F.col("text")), sharding.hashed(F.col("doc_id"))).drop("lang", "n_chars", "text"))
    tree = sharding.grow(rows, len(dims), n)
    out = sharding.numbered(cut(sharding.assign(rows, tree, len(dims))), rows.count(), n, order=("doc_id", "g"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def scored(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("doc_id", linear.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), "quality")
    return scored(quality.score(docs, model, keep=["doc_id"]), 0.3)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic")
    return scored(toxicity.score(docs, model, keep=["doc_id"]), 0.5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bytebpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytebpe.encode(read(spark, sf_dir, "documents"), coder, keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", topk.sign_code("embedding").alias("code"))
    return topk.search(rows, rows.filter("vec_id % 100 = 0"), k=10).withColumnsRenamed({"qid": "query_id", "id": "vec_id"})


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    counts, vocab, scorer = lm.fit(docs.filter(~lm.held_out()))
    out = lm.score(docs, counts, vocab, scorer, keep=["doc_id"])
    return out.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = neardup.classes(read(spark, sf_dir, "documents"))
    keep = (F.col("row") == F.col("class_row")) & (F.col("md5") == F.col("class_md5"))
    return c.select(F.col("row.id").alias("doc_id"), F.col("class_row.id").alias("class_id"), keep.alias("kept"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    shards = tokenfile.write_shards(read(spark, sf_dir, "documents"), definition, bits=16, end_id=1)
    return tokenfile.read_shards(shards).withColumnRenamed("key", "doc_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", n_bytes("text").alias("n_bytes"), "text")
    stored = cut(media.to_media(docs, keep=["doc_id", "n_bytes"]))
    outputs = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.from_media(stored, keep=["doc_id", "n_bytes"], outputs=outputs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_shards": op2_shards,
    "op3_quality": op3_quality,
    "op5_toxicity": op5_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op6_topk": op6_topk,
    "op7_lm": op7_lm,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_files": op9_token_files,
    "op10_media": op10_media,
}

ORACLES: dict[str, str] = {
    "op6_topk": """
        WITH codes AS (
            SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS code
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(q.code[i] <> r.code[i] AS INT))) AS INT) AS distance
            FROM codes q, codes r WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM pairs)
        SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= 10""",
}
