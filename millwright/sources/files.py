"""Strict CSV scans, typed conversion with a violations table, fingerprints, record numbers, snapshot manifests, exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.config import BATCH_KINDS, STAGES
from millwright.operators.events import in_order, order_violations, violations
from millwright.work import create_file


def read_strict_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; a header other than ``columns`` or a row of another width fails the scan.

    MS949 input needs spark.sql.legacy.javaCharsets=true.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"header": "true", "enforceSchema": "false", "multiLine": "true", "mode": "FAILFAST", "encoding": encoding, "escape": '"'}
    return spark.read.schema(schema).options(**options).csv(path)


def numbered(rows: DataFrame, name: str = "_source_record_number") -> DataFrame:
    """Adds the ordinal of each record in reading order, 2 for the first (the header is 1): partition offsets plus place, no global sort."""
    marked = rows.withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return marked.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, place + F.col("__before") + 2).drop("__p", "__id", "__before")


def typed(rows: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(converted rows, violations): ``kinds`` names IDENTIFIER, NUMBER, DATE, HOUR or STRING for each column.

    Empty is null (a DATE or HOUR must be there); whitespace-only identifiers, non-finite numbers, other dates and hours are violations.
    """
    done, wrong = {}, []
    for c, kind in kinds.items():
        raw, text = F.col(c), F.nullif(F.trim(F.col(c)), F.lit(""))
        if kind == "IDENTIFIER":
            value, bad = text, (raw != "") & text.isNull()
        elif kind == "NUMBER":
            value = text.try_cast("double")
            bad = text.isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
        elif kind == "DATE":
            value = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))
            bad = value.isNull()
        elif kind == "HOUR":
            number = text.try_cast("double")
            value = F.when((number == F.floor(number)) & number.between(0, 23), number.cast("int"))
            bad = value.isNull()
        else:
            value, bad = F.nullif(raw, F.lit("")), F.lit(False)
        done[c] = value
        wrong.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), raw.alias("value"))))
    violations = rows.select(F.explode(F.array_compact(F.array(*wrong))).alias("v")).select("v.*")
    return rows.withColumns(done), violations


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each file's bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def digest(rows: DataFrame, role: str) -> DataFrame:
    """One row: a table's role, row count and an order-free digest of its rows."""
    return rows.agg(F.lit(role).alias("role"), F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("digest"))


def publish(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Publish tables as one snapshot and return its manifest (role, rows, digest, path).

    Tables are written to a new place below ``folder`` and exposed by the manifest, whose folder is created at the end and only if there is
    none: readers see a whole snapshot or none. Publishing equal tables again changes nothing; other tables raise and leave what was published.
    """
    spark = next(iter(tables.values())).sparkSession
    place, manifest = uuid.uuid4().hex, None
    for role, rows in tables.items():
        rows.write.parquet(f"{folder}/data/{place}/{role}")
        here = digest(spark.read.parquet(f"{folder}/data/{place}/{role}"), role).withColumn("path", F.lit(f"data/{place}/{role}"))
        manifest = here if manifest is None else manifest.unionByName(here)
    rows = [tuple(r) for r in manifest.collect()]  # a row a table
    stated = _manifest_rows(spark, folder)
    if stated is None:
        if create_file(spark, f"{folder}/manifest.json", json.dumps(rows).encode()):
            return published(spark, folder)
        stated = _manifest_rows(spark, folder)
    _delete(spark, f"{folder}/data/{place}")
    if sorted(r[:3] for r in stated) != sorted(r[:3] for r in rows):
        raise ValueError(f"{folder} holds another snapshot")
    return published(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _manifest_rows(spark: SparkSession, folder: str) -> list[tuple] | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest.json")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return [tuple(r) for r in json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))]


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a published snapshot."""
    rows = _manifest_rows(spark, folder)
    if rows is None:
        raise FileNotFoundError(f"{folder} holds no snapshot")
    return spark.createDataFrame(rows, "role string, rows long, digest long, path string")


def snapshot(spark: SparkSession, folder: str, role: str) -> DataFrame:
    """One table of a published snapshot."""
    return spark.read.parquet(f"{folder}/{published(spark, folder).where(F.col('role') == role).first().path}")


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """(role, expected, found) of tables whose rows or digest differ from the manifest."""
    stated, now = published(spark, folder), None
    for row in stated.collect():  # one row a table
        here = digest(spark.read.parquet(f"{folder}/{row.path}"), row.role)
        now = here if now is None else now.unionByName(here)
    found = now.select("role", F.col("rows").alias("r"), F.col("digest").alias("g"))
    return stated.join(found, "role").where("rows <> r or digest <> g").select("role", F.col("rows").alias("expected"), F.col("r").alias("found"))


#: Fixed columns of an alert export, in order.
ALERT_COLUMNS = (
    "bundle_id", "material_key", "event_stage", "rule_id", "kind", "grade", "repeated", "replay_date", "replay_hour", "equipment_type", "equipment_id", "field",
    "observed_value", "range_status", "discovery_support", "discovery_defects", "discovery_relative_risk", "discovery_rr_ci_lower", "discovery_rr_ci_upper",
    "discovery_q_value", "confirmation_support", "confirmation_defects",
)


def export_alerts(alerts: DataFrame, path: str, order: list[str]) -> None:
    """CSV files of :data:`ALERT_COLUMNS` in the history's ``order`` (files by name, rows as they lie); absent columns and nulls are empty."""
    columns = [(F.col(c) if c in alerts.columns else F.lit(None)).cast("string").alias(c) for c in ALERT_COLUMNS]
    alerts.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).write.option("header", "true").option("emptyValue", "").csv(path)


#: Columns of a replay-event file.
EVENT_COLUMNS = (
    "schema_version", "bundle_id", "criteria_id", "event_id", "replay_date", "replay_hour", "batch_kind", "batch_id", "equipment_batch_id", "batch_step", "time_precision",
    "material_key", "equipment_type", "equipment_id", "charge_id", "slab_no", "hr_coil_id", "ap_prod_id", "values_json",
)


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of replay-event CSV files: typed events with the columns of the total order, and all violations of the stream, rows out of order among them.

    A header or row of another width fails the scan; values of a wrong type are problems of kind INVALID_VALUE, as are unknown batch steps and kinds.
    """
    raw = read_strict_csv(spark, path, list(EVENT_COLUMNS)).select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    stages, kinds = (F.create_map(*[F.lit(x) for kv in pairs for x in kv]) for pairs in (STAGES, BATCH_KINDS))
    empty = {c: F.nullif(F.col(c), F.lit("")) for c in EVENT_COLUMNS}
    rows = raw.withColumns(empty | {"replay_date": empty["replay_date"].try_cast("date"), "replay_hour": empty["replay_hour"].try_cast("int")})
    rows = rows.withColumns({
        "stage_rank": F.element_at(stages, F.col("batch_step")), "kind_rank": F.element_at(kinds, F.col("batch_kind")), "hour_rank": F.coalesce("replay_hour", F.lit(-1)),
        "furnace_rank": F.when(F.col("equipment_type") == "FURNACE", F.col("equipment_id").try_cast("int")).otherwise(0),
    })
    bad = rows.where("event_id is null or material_key is null or replay_date is null or stage_rank is null or kind_rank is null or (batch_kind = 'FURNACE_HOUR' and coalesce(replay_hour not between 0 and 23, true))")
    problems = violations(rows).unionByName(bad.select("material_key", "event_id", F.lit("INVALID_VALUE").alias("problem")))
    return rows.drop("__file", "__row"), problems.unionByName(order_violations(rows, "__file", "__row"))


def write_events(events: DataFrame, path: str, bundle_id: str, criteria_id: str) -> None:
    """Replay-event CSV files in the stream's total order: files by name, rows as they lie."""
    fixed = {"schema_version": F.lit("v1"), "bundle_id": F.lit(bundle_id), "criteria_id": F.lit(criteria_id), "time_precision": F.when(F.col("replay_hour").isNull(), "DAY").otherwise("HOUR")}
    rows = in_order(events.withColumns(fixed))
    columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in EVENT_COLUMNS]
    rows.select(*columns).write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)
