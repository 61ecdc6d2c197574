"""One query for each corpus operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vframe.llm import ann, chat, embdedup, langid, mixing, neardup, oracles, packing, pii, secret_scan, token_store
from vframe.llm.common import Scratch, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.explode(F.array(*(F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")
    )
    return chat.digest(chat.read_chat(chat.format_chat(turns.unionByName(extra.select("x.*")))))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_store.digest(token_store.read_tokens(spark, path))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("doc_id", "text").alias("key"))
    mixed = mixing.mix(scratch.table(sized, "sizes"), size="words", key="key", scratch=scratch)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.find_secrets(docs, secret_scan.train(docs)))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2).drop("source", "within")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.find_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus-2024")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_format": op2_chat_format,
        "op3_cross_polytope": op3_cross_polytope,
        "op4_token_store": op4_token_store,
        "op5_mix_sources": op5_mix_sources,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_pack": op8_pack,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_pii_pseudonyms": op10_pii_pseudonyms,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": oracles.CHAT, "op6_minhash_dedup": oracles.NEAR_DUPLICATES, "op9_embedding_dedup": oracles.EMBEDDINGS}
