"""Helpers shared by the training-data operators: table access, work folders, written intermediates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.work import root

#: Remainder of crc32(doc_id as text) modulo 4 that no model may learn from.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared work folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediates that no returned DataFrame reads."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id) -> F.Column:
    """True for rows no model may learn from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(True))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 16, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint where ``rows`` (counted by the caller) proves the size; else the plain frame, which Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


#: Parts that a common key is dealt to where it is too large to be broadcast.
SALTS = 64


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, size=None, most: int = 1000, limit: int = 64 << 20) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (unique by ``keys``; ``count`` is how many rows a key has), no key in one task.

    Keys with more than a thousandth of all rows are at most ``most``, so they are broadcast where their bytes (``size``, a column
    of ``counted``) are within ``limit``; the others are shuffled. Beyond the limit the common keys are shuffled as well, each dealt to
    :data:`SALTS` parts by a hash of its rows, with its one counted row in every part; only their hashes are broadcast. Both inputs are
    read twice and should be written tables.
    """
    total, = counted.agg(F.sum(count)).first()
    common = F.col(count) > max(most, (total or 0) // most)
    n, held = counted.where(common).agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    if not n:
        return rows.join(counted, keys)
    if held + 100 * n > limit:
        hashed = F.broadcast(counted.where(common).select(F.xxhash64(*keys).alias("__hash")).distinct().withColumn("__hot", F.lit(True)))
        marked = lambda df: df.withColumn("__hash", F.xxhash64(*keys)).join(hashed, "__hash", "left")
        salted = marked(rows).withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hash", "__hot")
        spread = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        return salted.join(marked(counted).withColumn("__salt", spread).drop("__hash", "__hot"), [*keys, "__salt"]).drop("__salt")
    hot = F.broadcast(counted.where(common))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(counted.where(common).select(*keys)), keys, "left_anti").join(counted.where(~common), keys))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows, so that what is built from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_batches(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column of an Arrow batch, without decoding to ``str``."""
    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(wide).to_pylist()


def tokenizer_path(name: str) -> str:
    return os.path.join(os.environ.get("MILLWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)
