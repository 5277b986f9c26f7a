"""Structured Streaming jobs of the sensor fleet: ingest with dead letters and latest state, events joined with the state, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators import fleet

EVENT = "event_id string, equipment_id string, equipment_type string, status string, temperature double, vibration double, rpm double, power double, current_value double, occurred_at timestamp, run_id string"


def sensor_source(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as they arrive in a folder; for a broker use the kafka source's ``value`` in :func:`parsed`."""
    return spark.readStream.text(path)


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """``key``, ``value`` and ``partition`` of a broker's records, for :func:`parsed`."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return stream.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition")


def keyed_records(events: DataFrame) -> DataFrame:
    """Records (key, value) for a broker: keyed by equipment, so that each equipment's events keep their order in one partition."""
    return events.select(F.col("equipment_id").alias("key"), F.to_json(F.struct(*[c for c in events.columns])).alias("value"))


def kafka_sink(events: DataFrame, servers: str, topic: str, checkpoint: str):
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
    return keyed_records(events).writeStream.format("kafka").options(**options).start()


def parsed(raw: DataFrame) -> DataFrame:
    """``value`` as an event ``e``; what is no event (bad JSON, or no id) keeps ``e`` without id."""
    return raw.select(*raw.columns, F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))


#: As many runs of stored events as this are merged into one.
FAN = 8
ARRIVAL = ("batch", "row")
STATE = "equipment_id string, event_id string, status string, severity string, temperature double, occurred_at timestamp, batch long, row long"


def _runs(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """Runs (first batch, last batch) of stored events without those that a merged run contains."""
    found = [tuple(map(int, n.split("-"))) for n in _names(spark, f"{folder}/events")]
    return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))


def stored_events(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The events that :func:`ingest` has stored (by batches less than ``before``)."""
    schema = f"{EVENT}, severity string, anomaly boolean, batch long, row long"
    paths = [f"{folder}/events/{a}-{b}" for a, b in _runs(spark, folder) if before is None or a < before]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    return rows if before is None else rows.where(F.col("batch") < before)


def newest_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The latest state that :func:`ingest` has written last (by a batch less than ``before``); no rows where there is none."""
    versions = [int(n.removeprefix("version=")) for n in _names(spark, f"{folder}/latest")]
    versions = [v for v in versions if before is None or v < before]
    return spark.read.schema(STATE).parquet(f"{folder}/latest/version={max(versions)}") if versions else spark.createDataFrame([], STATE)


def ingest(raw: DataFrame, folder: str, checkpoint: str, kept_versions: int = 2, attempts: int = 3):
    """Events go to ``events`` (each id once, that seen first), lines that are no event to ``dead_letters``, and the latest state to ``latest``.

    A batch writes one run of events, and :data:`FAN` runs of one size are merged into one, so there are fewer than that of each size however many
    batches there were, and every event is rewritten a logarithmic number of times. A batch's ids are looked for in the stored ones by a
    scan of that column, with the batch as the broadcast side where its counted rows allow it: history is not shuffled. A repeated batch rewrites its own
    files. One that fails is tried ``attempts`` times. Ids are any text. Dead letters keep what came with the line (a broker's key and partition).
    A batch without events writes no state; old versions of it are deleted but for ``kept_versions``.
    """
    events = parsed(raw)

    def store(batch: DataFrame, number: int) -> None:
        for attempt in range(attempts):
            try:
                return once(batch, number)
            except Exception:
                if attempt + 1 == attempts:
                    raise

    def once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lines = batch.withColumns({"batch": F.lit(number).cast("long"), "row": F.monotonically_increasing_id()}).persist()
        lines.where("e is null or e.event_id is null").drop("e", "batch", "row").write.mode("overwrite").parquet(f"{folder}/dead_letters/batch={number}")
        good = fleet.analysed(lines.where("e.event_id is not null").select("e.*", "batch", "row"))
        first = F.min_by(F.struct(*good.columns), "row")  # an id that a batch repeats counts where it is seen first
        good = good.groupBy("event_id").agg(first.alias("x")).select("x.*").persist()
        n = good.count()
        if n:
            earlier = stored_events(spark, folder, number).select("event_id")
            ids = good.select("event_id")
            again = earlier.join(F.broadcast(ids) if n <= 1_000_000 else ids, "event_id", "left_semi").distinct()
            fresh, own = good.join(again, "event_id", "left_anti"), f"{folder}/events/{number}-{number}"
            fresh.coalesce(max(1, n // 1_000_000)).write.mode("overwrite").parquet(own)
            state = fleet.upserted(newest_state(spark, folder, number), spark.read.schema(fresh.schema).parquet(own), ARRIVAL)
            state.write.mode("overwrite").parquet(f"{folder}/latest/version={number}")
        good.unpersist()
        lines.unpersist()
        merge(spark, number)
        kept = sorted((int(v.removeprefix("version=")) for v in _names(spark, f"{folder}/latest")), reverse=True)
        for old in kept[kept_versions:]:
            _delete(spark, f"{folder}/latest/version={old}")

    def merge(spark: SparkSession, number: int) -> None:
        size = FAN
        while (number + 1) % size == 0:
            first, names = number + 1 - size, set(_names(spark, f"{folder}/events"))
            parts = [p for a in range(first, number + 1, size // FAN) if (p := f"{a}-{a + size // FAN - 1}") in names]
            final = f"{first}-{number}"
            if parts and final not in names:  # a run appears whole, by a rename; one that is there was merged before this batch was repeated
                rows = spark.read.parquet(*[f"{folder}/events/{p}" for p in parts])
                rows.coalesce(max(1, rows.rdd.getNumPartitions() // FAN)).write.mode("overwrite").parquet(f"{folder}/merging/{final}")
                _rename(spark, f"{folder}/merging/{final}", f"{folder}/events/{final}")
            for p in parts:
                _delete(spark, f"{folder}/events/{p}")
            size *= FAN

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_state(events: DataFrame, state_folder: str, out: str, checkpoint: str):
    """Each event with ``state_status`` and ``state_severity``, what is known of its equipment; nulls where nothing is.

    The state's newest version is read again for every micro-batch, so one that :func:`ingest` has written meanwhile is seen by the next. Output lies in a
    folder a batch, which a repeated batch rewrites.
    """
    def join(batch: DataFrame, number: int) -> None:
        known = newest_state(batch.sparkSession, state_folder).select("equipment_id", F.col("status").alias("state_status"), F.col("severity").alias("state_severity"))
        batch.join(known, "equipment_id", "left").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return events.writeStream.foreachBatch(join).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is absent."""
    fs, target = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target) if not f.getPath().getName().startswith(("_", "."))] if fs.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    fs, target = _fs(spark, path)
    final = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(final.getParent())
    if not fs.rename(target, final):
        raise OSError(f"{path} could not be renamed to {to}")


def alert_stream(raw: DataFrame) -> DataFrame:
    """Anomalies of the stream as alert records, without de-duplication."""
    return fleet.alerts(fleet.analysed(parsed(raw).where("e.event_id is not null").select("e.*")), F.current_timestamp())
