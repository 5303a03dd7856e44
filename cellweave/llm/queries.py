"""The subpackage's queries over whole tables, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm import bpe, conversations, hnsw, linededup, orderminhash, packing, quality, secrets, sharding, simhash, toxicity, vectorcodes, vectordedup
from cellweave.llm.oracles import CONVERSATION_SQL, EDITED_TEXTS_SQL, LINE_DEDUP_SQL, SECRET_BASE_SPANS_SQL, SHARD_SIZES_SQL, VECTOR_CODE_SQL, VECTOR_DEDUP_SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_read(spark, sf_dir, "documents"))


def op3_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=8)


def op4_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), n_lines="n_lines", n_removed="n_removed")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_read(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op7_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hnsw.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress_vectors(_read(spark, sf_dir, "embeddings"))


def op12_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_summaries(conversations.damaged(_read(spark, sf_dir, "conversations")))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's sizes, and whether the law of each document's shard holds."""
    placed = op3_sampled_splitter_sharding(spark, sf_dir)
    held = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("least"), F.max("slot").alias("most"), F.sum("size").alias("held"), F.max("size").alias("largest"))
    every = Window.partitionBy(F.lit(0))  # a row for each of eight shards
    shards = held.select("*", F.sum("held").over(every).alias("total"), F.max("largest").over(every).alias("longest"))
    laws = shards.select(
        "shard",
        ((F.col("slots") == F.col("n")) & (F.col("least") == 0) & (F.col("most") == F.col("n") - 1)).alias("gapless"),
        (F.abs(F.col("held") - F.col("total") / 8) <= F.col("longest") + sharding.WHOLE_GROUP * F.col("total") / 8).alias("near_equal"),
    )
    return placed.join(F.broadcast(laws), "shard").select("doc_id", "size", "law", "gapless", "near_equal")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that fixed patterns decide."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that the order of the documents decides."""
    return op6_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    named = (op1_quality_classifier, op2_simhash_near_dedup, op3_sampled_splitter_sharding, op4_line_window_dedup, op5_secret_scan, op6_order_minhash, op7_hnsw_search, op8_byte_bpe, op9_best_fit_packing, op10_toxicity_severity, op11_vector_codes, op12_itq_near_dedup, op13_conversation_repair, shard_sizes, secret_base_spans, edited_texts)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_window_dedup": LINE_DEDUP_SQL, "op11_vector_codes": VECTOR_CODE_SQL, "op12_itq_near_dedup": VECTOR_DEDUP_SQL, "op13_conversation_repair": CONVERSATION_SQL, "shard_sizes": SHARD_SIZES_SQL, "secret_base_spans": SECRET_BASE_SPANS_SQL, "edited_texts": EDITED_TEXTS_SQL}
