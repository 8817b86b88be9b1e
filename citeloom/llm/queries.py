"""The registered queries of the training-data operators, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, language_id, mixing, packing, pii, piece_codec, prefix_trie, quality_model, quality_rules, simhash_dedup, token_store, whitening
from .common import read_table, shared_dir


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read_table(spark, sf_dir, "embeddings"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select(
        F.col("id").alias("doc_id"), language_id.held_out(F.col("id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans")
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.build(read_table(spark, sf_dir, "documents"), shared_dir(spark))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_codec.encode(read_table(spark, sf_dir, "documents"), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_embedding_near_dedup, op2_chat_formatting, op3_pii, op4_language_id, op5_token_store,
            op6_packing, op7_simhash_near_dedup, op8_mixing, op9_quality_model, op10_quality_rules,
            op11_piece_codec, op12_whitening, op13_prefix_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.SQL, "op8_mixing": mixing.SQL, "op13_prefix_trie": prefix_trie.SQL}
