"""Size-tiered compaction of a sharded table, in DataFrame functions only.

A table is a folder of immutable Parquet shards and of manifests, one for each version. An append writes its rows as small shards and commits
a manifest that adds them. A compaction puts the live shards in tiers by size (each tier ``fanout`` times the last), and in each tier with
enough shards rewrites runs of similarly sized ones as files near the target size. The rows of a run are read and written in place, with no
shuffle: a tier's shards are of like size, so joining them evenly gives files of like size.
Old shards stay for readers of older versions.

A manifest's rows are written to a folder of their own. The commit is the creation of the small file ``v=<version>`` that names the
folder, with its content at once, which fails where the file exists: of two writers that began at one version, one gets an error, however slow it
is, and nothing is lost. On a store without an atomic rename that rests on the store's own check.
The paths of live shards, some hundred bytes each, are read by the driver, as Spark's readers take a list of files.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import new_path
from millwright.work import create_file

MANIFEST = "shard string, bytes long, tier int"


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20
    smallest_bytes: int = 1 << 20
    fanout: int = 4
    least_shards: int = 4
    shard_rows: int = 0


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class ShardedTable:
    """Versions, appends and compactions of the table in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, tiers: Tiers | None = None):
        self.spark, self.folder, self.tiers = spark, folder.rstrip("/"), tiers or Tiers()

    # -- manifests

    def version(self) -> int:
        """The newest committed version; 0 for an empty table."""
        fs, path = _fs(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()] if fs.exists(path) else []
        return max((int(n[2:]) for n in names if n.startswith("v=")), default=0)

    def _named(self, file) -> str:
        """The folder that a version's file names. Files appear whole, so one without a name is not of this table's writers."""
        fs = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = fs.open(file)
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not name:
            raise RuntimeError(f"{file.toString()} is empty: whose version it is cannot be known")
        return name

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        _, file = _fs(self.spark, f"{self.folder}/manifests/v={version}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/staged/{self._named(file)}")

    def _commit(self, live: DataFrame, after: int) -> int:
        """Make ``live`` the version that follows ``after``."""
        name = new_path(self.spark, "m").rsplit("/", 1)[1]
        live.coalesce(1).write.parquet(f"{self.folder}/staged/{name}")
        version = after + 1
        if not create_file(self.spark, f"{self.folder}/manifests/v={version}", name.encode()):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    # -- shards

    def _tier(self, size) -> F.Column:
        steps = F.log(size / F.lit(float(self.tiers.smallest_bytes))) / math.log(self.tiers.fanout)
        return F.greatest(F.lit(0), F.floor(steps) + 1).cast("int")

    def _shards(self, folder: str) -> DataFrame:
        """The shards of one written batch with their sizes and tiers (no content is read)."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        return files.select(F.col("path").alias("shard"), F.col("length").alias("bytes"), self._tier(F.col("length")).alias("tier"))

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.folder}/shards/{new_path(self.spark, 'b').rsplit('/', 1)[1]}"
        writer = rows.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", self.tiers.shard_rows) if self.tiers.shard_rows else writer).parquet(folder)
        return folder

    def append(self, rows: DataFrame) -> int:
        """Add ``rows`` as new shards, one or more for each of their partitions; returns the new version."""
        version = self.version()
        new = self._shards(self._write(rows))
        return self._commit(self.manifest(version).unionByName(new), version)

    def compact(self) -> int:
        """One pass over all tiers; returns the version after it, the same one where no tier has enough shards to merge."""
        version = self.version()
        live = self.manifest(version)
        full = F.col("bytes") >= self.tiers.target_bytes // 2
        tiers = live.where(~full).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.tiers.least_shards).orderBy("tier")
        merged, kept = None, live
        for tier, n, size in [(r.tier, r.n, r.bytes) for r in tiers.collect()]:  # a handful: sizes grow by the fanout
            files = max(1, min(n // 2, math.ceil(size / self.tiers.target_bytes)))
            # the list of one tier's paths is metadata of the table, some hundred bytes a shard
            paths = [r.shard for r in live.where((F.col("tier") == tier) & ~full).orderBy("bytes", "shard").toLocalIterator()]
            rows = self.spark.read.parquet(*paths)
            new = self._shards(self._write(rows.coalesce(files)))
            merged = new if merged is None else merged.unionByName(new)
            kept = kept.where(~((F.col("tier") == tier) & ~full))
        if merged is None:
            return version
        return self._commit(kept.unionByName(merged), version)

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """The rows of a version's live shards."""
        paths = [r.shard for r in self.manifest(version).select("shard").orderBy("shard").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], schema or T.StructType())
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths)


def shard_and_compact(docs: DataFrame, tiers: Tiers | None = None, arrivals: int = 4) -> tuple[ShardedTable, int]:
    """A new table of ``docs``: each arrival (rows dealt by a hash of doc_id, null ids in the first) is appended as small shards, then the
    table is compacted until a pass merges nothing; every pass leaves fewer shards, so it ends.

    All rows and columns are kept as they are: nulls, repeated rows, columns of any name. An empty table has versions without rows.
    """
    table = ShardedTable(docs.sparkSession, new_path(docs.sparkSession, "table"), tiers)
    of = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0))
    for arrival in range(arrivals):
        version = table.append(docs.where(of == arrival))
    while (after := table.compact()) != version:
        version = after
    return table, version
