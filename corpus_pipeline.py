"""Corpus pipeline over ``documents``: five stages, each a training-data operator whose decisions take effect.

Every stage works on all rows that its predecessor kept. Rows with a null, empty or blank text pass the filtering stages unchanged;
rows that repeat both doc_id and text are one document after the near-dedup. Columns but the five of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import decontaminate, line_dedup, near_dedup, sentencepiece_fst, toxicity
from millwright.llm.common import remove, table, tokenizer_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not predict toxic; texts without words stay."""
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line passages that another document (or an earlier place) has; n_chars follows the text.

    A document that has no word left, all of it being whole in others, goes; a text that was blank before stays.
    """
    cleaned = line_dedup.drop_repeated_passages(docs.select(*COLUMNS)).where((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\s]"))
    return cleaned.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more. Rows are compared, not ids."""
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS), near_dedup.NearDupConfig(shingle_words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip of each document."""
    return sentencepiece_fst.encode(docs, sentencepiece_fst.read_model(spark, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
#: No stage but the line dedup can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each stage's rows are written for the next one, which may read them more than once, and deleted when it is done."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
