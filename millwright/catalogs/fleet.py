"""Queries of the sensor-fleet operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalogs import Registry, rounded
from millwright.operators import fleet as L
from millwright.sources import bindings
from millwright.sources.bindings import BASE

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
ARRIVAL = ("arrival",)
LATEST = "latest AS MATERIALIZED (SELECT equipment_id, event_id, status, severity, temperature, occurred_at FROM sensed QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY occurred_at DESC, arrival) = 1)"
ALERTS = "alerted AS MATERIALIZED (SELECT event_id, arrival, equipment_id, severity, (epoch_us(TIMESTAMP '2024-03-01') // 1000 - epoch_us(occurred_at) // 1000)::BIGINT AS raw, status FROM sensed WHERE severity <> 'NORMAL'), alerts AS MATERIALIZED (SELECT event_id, arrival, equipment_id, severity, greatest(0, raw) AS latency_ms, severity || ' ' || equipment_id || ': ' || status AS message FROM alerted)"


def sensed(spark, d):
    return L.analysed(bindings.sensor_events(spark, d), F.lit("2024-02-29 00:00:00").cast("timestamp"))


def raised(spark, d):
    return L.alerts(sensed(spark, d), F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query("b14_b15_severity", BASE + "SELECT event_id, severity, severity <> 'NORMAL' AS anomaly, occurred_at FROM sensed")
def b14(spark, d):
    return sensed(spark, d).select("event_id", "severity", "anomaly", "occurred_at")


@query("k1_latest_state", BASE + ", " + LATEST + " SELECT * FROM latest")
def k1(spark, d):
    return L.latest_state(sensed(spark, d), ARRIVAL).drop("arrival")


@query("k2_recent_events", BASE + "SELECT event_id, occurred_at FROM sensed ORDER BY occurred_at DESC, arrival LIMIT 20")
def k2(spark, d):
    return L.recent(sensed(spark, d), arrival=ARRIVAL).select("event_id", "occurred_at")


@query("a13_idempotent_insert", BASE + "SELECT event_id FROM sensed WHERE arrival % 2 = 1")
def a13(spark, d):
    rows = sensed(spark, d)
    return L.new_events(rows.unionByName(rows), rows.where("arrival % 2 = 0")).select("event_id")


@query("a14_latest_upsert", BASE + ", " + LATEST + " SELECT equipment_id, event_id, severity FROM latest")
def a14(spark, d):
    rows = sensed(spark, d).select("equipment_id", "event_id", "status", "severity", "temperature", "occurred_at", "arrival")
    old = L.latest_state(rows.where("arrival % 3 = 0"), ARRIVAL)
    return L.upserted(old, rows.where("arrival % 3 <> 0"), ARRIVAL).select("equipment_id", "event_id", "severity")


@query("k12_dashboard", BASE + ", " + LATEST + """ SELECT count(*) FILTER (WHERE severity = 'NORMAL') AS normal, count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
 count(*) FILTER (WHERE occurred_at > TIMESTAMP '2024-01-15' - INTERVAL 60 SECONDS) AS last_minute, (SELECT count(*) FROM latest WHERE status = 'RUNNING') AS equipment_running, (SELECT count(*) FROM latest WHERE status = 'IDLE') AS equipment_idle,
 (SELECT count(*) FROM latest WHERE status = 'WARNING') AS equipment_warning, (SELECT count(*) FROM latest WHERE status = 'FAILURE') AS equipment_failure,
 (SELECT string_agg(event_id, ',' ORDER BY occurred_at DESC, arrival) FROM (SELECT * FROM sensed ORDER BY occurred_at DESC, arrival LIMIT 20)) AS recent FROM sensed""")
def k12(spark, d):
    return L.dashboard(sensed(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp"), ARRIVAL).withColumn("recent", F.array_join("recent", ","))


@query("l3_alert_records", BASE + ", " + ALERTS + " SELECT * FROM alerts")
def l3(spark, d):
    return raised(spark, d)


@query("f9_l4_alert_metrics", BASE + ", " + ALERTS + ", newest AS (SELECT * FROM alerts ORDER BY arrival DESC LIMIT 20000) SELECT count(*) AS n, round(avg(latency_ms), 3) AS mean_ms, (SELECT quantile_disc(latency_ms, 0.95) FROM newest)::DOUBLE AS p95, (SELECT quantile_disc(latency_ms, 0.99) FROM newest)::DOUBLE AS p99 FROM alerts")
def f9(spark, d):
    return L.alert_metrics(raised(spark, d)).withColumns({c: F.col(c).cast("double") for c in ("p95", "p99")})


#: Runs made of the sensor events: run-0 loses nothing, run-1 fails its critical events, run-2 misses five; run-3 has only begun, run-4 is published, nothing of it saved.
TRACKED = """, tracked AS MATERIALIZED (SELECT *, run_id = 'run-1' AND severity = 'CRITICAL' AS bad FROM sensed),
spans AS (SELECT run_id, count(*) AS n, min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE occurred_at <= TIMESTAMP '2024-01-15') AS polled FROM tracked GROUP BY run_id),
sums AS (SELECT run_id, n + CASE WHEN run_id = 'run-2' THEN 5 ELSE 0 END AS expected, n AS published, n AS consumed, n - failed AS saved, failed, polled, first_at, last_at, 1500 AS publish_ms, true AS progressed FROM spans
 UNION ALL SELECT 'run-3', 7, 0, 0, 0, 0, NULL, TIMESTAMP '2024-01-02', NULL, 0, false UNION ALL SELECT 'run-4', 7, 9, 0, 0, 0, 0, TIMESTAMP '2024-01-02', NULL, 250, false),
timed AS (SELECT *, saved + failed >= expected AS ended, first_at - INTERVAL 60 SECONDS AS started_at, CASE WHEN run_id <> 'run-3' THEN first_at + INTERVAL 10 SECONDS END AS published_at FROM sums),
ran AS (SELECT *, greatest(0, expected - saved - failed) AS lag, CASE WHEN ended THEN greatest(1, (epoch_us(last_at) // 1000) - (epoch_us(published_at) // 1000)) WHEN published_at IS NOT NULL THEN greatest(1, (epoch_us(TIMESTAMP '2024-03-01') // 1000) - (epoch_us(published_at) // 1000)) ELSE 0 END AS processing_ms FROM timed)
"""


@query("l5_l6_run_tracking", BASE + TRACKED + """SELECT run_id, expected, published, consumed, saved, failed, lag, CASE WHEN polled IS NULL THEN lag ELSE greatest(lag, expected - polled) END AS max_lag, publish_ms, processing_ms,
 greatest(1, (epoch_us(CASE WHEN ended THEN last_at ELSE TIMESTAMP '2024-03-01' END) // 1000) - (epoch_us(started_at) // 1000)) AS total_ms, round(published / (greatest(1, publish_ms) / 1000.0::DOUBLE), 6) AS published_per_second, round(saved / (greatest(1, processing_ms) / 1000.0::DOUBLE), 6) AS saved_per_second,
 lag = 0 AS completed, CASE WHEN run_id = 'run-3' THEN 'STARTED' WHEN NOT progressed THEN 'PUBLISHED' WHEN NOT ended THEN 'PROCESSING' WHEN failed = 0 THEN 'COMPLETED' ELSE 'COMPLETED_WITH_FAILURE' END AS status FROM ran""")
def l5(spark, d):
    rows = sensed(spark, d)
    bad = (F.col("run_id") == "run-1") & (F.col("severity") == "CRITICAL")
    progress = rows.select("run_id", F.col("occurred_at").alias("at"), F.when(bad, "FAILED").otherwise("SAVED").alias("kind"), F.lit(1).alias("consumed"), F.lit(1).alias("n"))
    others = spark.createDataFrame([("run-3", 7, None, None), ("run-4", 7, 9, 250)], "run_id string, n long, published long, elapsed_ms long").withColumn("first_at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    spans = rows.groupBy("run_id").agg(F.count("*").alias("n"), F.min("occurred_at").alias("first_at")).withColumns({"published": F.col("n"), "elapsed_ms": F.lit(1500)}).unionByName(others)
    runs = spans.select("run_id", (F.col("n") + F.when(F.col("run_id") == "run-2", 5).otherwise(0)).alias("expected"), (F.col("first_at") - F.expr("INTERVAL 60 SECONDS")).alias("started_at"))
    published = spans.where("published is not null").select("run_id", (F.col("first_at") + F.expr("INTERVAL 10 SECONDS")).alias("at"), "published", "elapsed_ms")
    polls = spans.where("run_id <> 'run-3'").select("run_id", F.explode(F.array(*[F.lit(t).cast("timestamp") for t in ("2024-01-15 00:00:00", "2024-02-01 00:00:00")])).alias("at"))
    return rounded(L.run_tracking(runs, published, progress, polls, F.lit("2024-03-01 00:00:00").cast("timestamp")), "published_per_second", "saved_per_second")


@query("l7_sliding_counts", BASE + "SELECT s.start AS start, severity, count(*) AS n FROM (SELECT severity, unnest([time_bucket(INTERVAL 10 SECONDS, occurred_at) - INTERVAL (10 * k) SECONDS for k in range(6)]) AS start FROM sensed) s GROUP BY ALL")
def l7(spark, d):
    return L.sliding_counts(sensed(spark, d))


@query("c11_event_with_state", BASE + ", " + LATEST + " SELECT s.event_id, l.severity AS state FROM sensed s JOIN latest l USING (equipment_id)")
def c11(spark, d):
    rows = sensed(spark, d)
    state = L.latest_state(rows, ARRIVAL).select("equipment_id", F.col("severity").alias("state"))
    return rows.join(state, "equipment_id").select("event_id", "state")
