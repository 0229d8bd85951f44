"""The text queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, conversation_trie, host_rules, mixing, ngram_join, order_minhash, packing, pii, quality, secret_scan, suffix_dedup, toxicity
from .rows import documents, remainder, table


def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.against_next(documents(spark, folder, "doc_id", "text"))


def op2_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = host_rules.judge(documents(spark, folder, "doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder, "doc_id", "text", "source"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(documents(spark, folder, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = byte_bpe.encode(documents(spark, folder, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), quality.HELD_OUT_PARTS) == quality.HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove(documents(spark, folder, "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), toxicity.HELD_OUT_PARTS) == 0).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(documents(spark, folder, "doc_id", "text"))
    return found.select("doc_id", *[pii.count_kind(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.digest(F.col("found")).alias("spans"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder, "doc_id", "text"))
    return found.select("doc_id", *[secret_scan.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secret_scan.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.digest(F.col("found")).alias("spans"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.build(conversation_trie.rebuilt(table(spark, folder, "conversations"))).drop("prefix")


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.score(alignment.align(documents(spark, folder, "doc_id", "text"), *files), alignment.id_types(*files))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_order_minhash, op2_host_rules, op3_mixing, op4_ngram_join, op5_byte_bpe, op6_quality, op7_suffix_dedup, op8_toxicity, op9_pii, op10_secret_scan,
                                       op11_conversation_trie, op12_alignment, op13_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_host_rules": host_rules.SQL, "op3_mixing": mixing.SQL, "op4_ngram_join": ngram_join.SQL,
            "op11_conversation_trie": conversation_trie.SQL}
