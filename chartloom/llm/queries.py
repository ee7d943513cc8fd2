"""One registered query per operator, with check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import (
    centroid_clusters, chat_format, mixing, near_dup, oracles, packing, private_data, quality, repeats, secrets, source_audit, token_store, topk, vector_links,
)
from chartloom.llm.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_store")
def token_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, WORD_TOKENIZER, end_id=1)
    return token_store.read_store(spark, path, WORD_TOKENIZER).withColumnRenamed("key", "doc_id")


@query("op7_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, end_id=0, capacity=2048)
    return packed.withColumnRenamed("key", "doc_id")


@query("op10_mixing")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "copies", "taken")


@query("op3_secrets")
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op4_private_data")
def private_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private_data(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


@query("op8_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("key", "doc_id")


@query("op1_top_k", oracles.TOP_K)
def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.nearest(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


@query("op9_vector_links", oracles.VECTOR_LINKS)
def vector_links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = vector_links.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)
    return linked.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query("op5_repeats", oracles.REPEATS)
def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), window=35).withColumnRenamed("key", "doc_id")


@query("op6_near_duplicates", oracles.NEAR_DUPLICATES)
def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = near_dup.link_documents(table(spark, sf_dir, "documents"), percent=75)
    return linked.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@query("op11_chat_format", oracles.CHATS)
def chat_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", signs), (-1, 1, "assistant", signs)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_chats(chat_format.format_chats(turns)).withColumnRenamed("key", "conv_id")


@query("op12_source_audit", oracles.SOURCE_AUDIT)
def source_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


@query("op13_clusters", oracles.CLUSTERS)
def clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")
