"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import (
    chat_format, compaction, decontaminate, hard_negatives, language_id, line_dedup, matroska, near_dedup, prefix_hash, sentencepiece_fst, token_alignment, toxicity,
    warc,
)
from millwright.llm.common import table, tokenizer_path


def op1_byte_cnn_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.classify(table(spark, sf_dir, "documents"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_fst.read_model(spark, tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"), model)


def op4_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shards, version = compaction.shard_and_compact(docs)
    text = F.col("text")
    return shards.read(version, docs.schema).select(
        "doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("text_bytes"), F.md5(text).alias("text_md5")
    )


OP4 = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS text_bytes, md5(text) AS text_md5 FROM documents"


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = near_dedup.NearDupConfig(shingle_words=2, percent=80)
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"), cfg)


def op6_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.describe(matroska.store(table(spark, sf_dir, "documents")))


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op9_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = prefix_hash.with_next(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


def op12_whitespace_anchor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = token_alignment.read_vocabularies(spark, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return token_alignment.link_strength(table(spark, sf_dir, "documents"), vocabularies)


def op13_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_cnn_language_id, op2_simhash_decontamination, op3_sentencepiece_fst, op4_size_tiered_sharding, op5_minhash_near_dedup,
        op6_matroska_media, op7_chat_collapse, op8_warc_normaliser, op9_line_chunk_dedup, op9_repeated_passages, op10_toxicity,
        op11_prefix_hash_fingerprints, op12_whitespace_anchor_alignment, op13_gnat_hard_negatives,
    )
}
ORACLES = {
    "op4_size_tiered_sharding": OP4,
    "op7_chat_collapse": chat_format.ORACLE,
    "op8_warc_normaliser": warc.ORACLE,
    "op9_line_chunk_dedup": line_dedup.ORACLE,
    "op9_repeated_passages": line_dedup.PASSAGES_ORACLE,
    "op13_gnat_hard_negatives": hard_negatives.ORACLE,
}
