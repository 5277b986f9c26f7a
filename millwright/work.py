"""Written intermediates: what several stages read is written once to a folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_STAGES: dict[tuple, tuple] = {}


def root(spark: SparkSession) -> str:
    """Folder for intermediates: ``spark.checkpoint.dir``, or a local one where that is unset and Spark runs in one process (tests).

    It belongs to the application and is deleted when that ends: what is written there is read by later stages and by returned DataFrames only.
    """
    shared, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if shared:
        folder = f"{shared.rstrip('/')}/millwright/{app}"
        if app not in _LOCAL:
            _LOCAL[app] = folder
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediates are written there")
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='millwright-')}"
    return _LOCAL[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: cuts lineage and survives a lost executor."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, inputs: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage ``name`` of the analysis over the tables in ``inputs``: built and written once in an application, then read.

    Inputs are immutable snapshots, so a stage of the same inputs is the same table.
    """
    key = (spark.sparkContext.applicationId, inputs, name)
    if key not in _STAGES:
        df = build()
        path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        _STAGES[key] = path, df.schema
        del df
        release(spark, path)
    path, schema = _STAGES[key]
    return spark.read.schema(schema).parquet(path)


def dealt_stage(spark: SparkSession, inputs: str, name: str, build: Callable[[], tuple[DataFrame, int]], key: str) -> DataFrame:
    """:func:`stage` written in buckets of ``key``: windows, groupings and joins by it and more columns read it without a shuffle.

    ``build`` gives the rows, which lie in hash partitions of the key, and their number: so many buckets there are, each in one file.
    """
    at = (spark.sparkContext.applicationId, inputs, name)
    if at not in _STAGES:
        label = f"{name}_{uuid.uuid4().hex[:12]}"
        rows, parts = build()
        rows.write.bucketBy(parts, key).option("path", f"{root(spark)}/{label}").saveAsTable(label)
        _STAGES[at] = (label,)
        del rows
        release(spark, f"{root(spark)}/{label}")
    return spark.table(_STAGES[at][0])


#: Bytes of a written stage from which its shuffle files are worth a wait.
RELEASED = 8 << 20


def release(spark: SparkSession, path: str) -> None:
    """Have Spark delete the shuffle files that the stage written to ``path`` was made from, if it is large.

    Spark's cleaner goes by the driver's garbage collection, which by itself may come half an hour later (``spark.cleaner.periodicGC.interval``): until then the files of all stages
    lie on the disks together. A query that has just ended is still held for a moment, so a second collection follows.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() < RELEASED:
        return
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint where a count shows at most ``rows`` rows; beyond, the plain frame, which Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def create_file(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file that appears with all of its ``content`` or not at all; False where one of that name exists.

    The content is written under a private name first, then takes its own: by a hard link on a local file system, elsewhere by a rename, which
    file systems with an atomic one refuse where the name is taken. Of writers that race, however slow, one succeeds.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    private = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_private-{uuid.uuid4().hex}")
    if fs.getUri().getScheme() == "file":
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        files = spark._jvm.java.nio.file.Files
        files.write(local(private), content, spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.OpenOption, 0))
    else:
        stream = fs.create(private, False)
        stream.write(content)
        stream.close()
    try:
        return _expose(spark, fs, private, target)
    finally:
        fs.delete(private, False)


def _expose(spark: SparkSession, fs, private, target) -> bool:
    """Give a written file its name; False where the name is taken."""
    if fs.getUri().getScheme() != "file":
        return not fs.exists(target) and fs.rename(private, target)
    local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
    try:
        spark._jvm.java.nio.file.Files.createLink(local(target), local(private))
    except Py4JJavaError as wrong:
        if "FileAlreadyExists" in wrong.java_exception.getClass().getName():
            return False
        raise
    return True
