"""Sensor fleet: severity, idempotent insert, latest state, dashboard, alert metrics, run tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import predicates as P
from millwright.operators.ranges import at_ranks


def analysed(events: DataFrame, received_at=None) -> DataFrame:
    """Events with severity and anomaly; an event without its own time gets that of its receipt (now, unless given)."""
    rows = events.withColumn("severity", P.severity())
    now = F.current_timestamp() if received_at is None else received_at
    return rows.withColumns({"anomaly": F.col("severity") != "NORMAL", "occurred_at": F.coalesce("occurred_at", now)})


def new_events(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Events of a batch whose id is not stored yet, each id once."""
    return batch.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")


def first_seen(events: DataFrame, arrival: tuple[str, ...] = ()) -> list[Column]:
    """Sort columns of events, the earlier seen first: ``arrival`` (columns that count up), then the id as text."""
    return [*map(F.col, arrival), F.col("event_id")]


def latest_state(events: DataFrame, arrival: tuple[str, ...] = ()) -> DataFrame:
    """Last event of each equipment by time; of equal times the one seen first, by ``arrival`` and then by the least id. Ids are any text."""
    kept = ["event_id", "status", "severity", "temperature", "occurred_at", *arrival]
    last = F.min_by(F.struct(*kept), F.struct(-F.unix_micros("occurred_at"), *first_seen(events, arrival)))
    return events.groupBy("equipment_id").agg(last.alias("e")).select("equipment_id", "e.*")


def upserted(old: DataFrame, events: DataFrame, arrival: tuple[str, ...] = ()) -> DataFrame:
    return latest_state(old.unionByName(events.select(*old.columns)), arrival)


def recent(events: DataFrame, n: int = 20, arrival: tuple[str, ...] = ()) -> DataFrame:
    return events.orderBy(F.col("occurred_at").desc(), *first_seen(events, arrival)).limit(n)


def dashboard(events: DataFrame, now, arrival: tuple[str, ...] = (), shown: int = 20) -> DataFrame:
    """One row: events by severity, in the last 60 seconds, equipment by latest status, and the ids of the ``shown`` most recent events in order."""
    fleet = latest_state(events, arrival).agg(*[F.count_if(F.col("status") == s).alias(f"equipment_{s.lower()}") for s in ("RUNNING", "IDLE", "WARNING", "FAILURE")])
    by = events.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("NORMAL", "WARNING", "CRITICAL")], F.count_if(F.col("occurred_at") > now - F.expr("INTERVAL 60 SECONDS")).alias("last_minute"))
    place = F.struct((-F.unix_micros("occurred_at")).alias("at"), *first_seen(events, arrival))
    newest = recent(events, shown, arrival).agg(F.transform(F.array_sort(F.collect_list(place)), lambda e: e["event_id"]).alias("recent"))  # ``shown`` rows
    return by.crossJoin(fleet).crossJoin(newest)


def alerts(events: DataFrame, published_at) -> DataFrame:
    """Anomalies as alert records with latency in milliseconds (never negative) and a message; ``arrival`` is kept where events have it."""
    delay = F.greatest(F.lit(0), F.unix_millis(published_at) - F.unix_millis("occurred_at"))
    text = F.format_string("%s %s: %s", F.col("severity"), F.col("equipment_id"), F.col("status"))
    return events.where("severity <> 'NORMAL'").select("event_id", "equipment_id", "severity", delay.alias("latency_ms"), text.alias("message"), *[c for c in events.columns if c == "arrival"])


def alert_metrics(alerts_: DataFrame, last: int = 20_000, order: str = "arrival", since: Column | None = None) -> DataFrame:
    """Nearest-rank p95 and p99 over the ``last`` alerts by ``order`` (more where the last one's value repeats), count and mean over all.

    ``since`` (a condition) is the reset: alerts before it do not count.
    """
    rows = alerts_ if since is None else alerts_.where(since)
    bound = at_ranks(rows.select(F.col(order).alias("__at")), [], "__at", {"__since": lambda n: F.greatest(F.lit(1), n - (last - 1))})
    newest = rows.join(F.broadcast(bound), F.col(order) >= F.col("__since"))
    tail = newest.agg(F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95"), F.expr("percentile_disc(0.99) within group (order by latency_ms)").alias("p99"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 3).alias("mean_ms")).crossJoin(tail)


def run_tracking(runs: DataFrame, published: DataFrame, progress: DataFrame, polls: DataFrame, now: Column) -> DataFrame:
    """The status of every run at ``now``: counts, lag and the greatest lag polled, elapsed milliseconds, rates, completion and status.

    ``runs``: run_id, expected, started_at. ``published``: run_id, at, published, elapsed_ms (a run's last row counts). ``progress``: run_id, at, kind (SAVED or
    FAILED), consumed, n. ``polls``: run_id, at. Finished events only grow, so the lag that polls saw was greatest at the first one: all of it comes from
    grouped sums, no run's rows are ordered. A publication that comes after the last progress is the state again, as in the specification.
    """
    first_poll = polls.groupBy("run_id").agg(F.min("at").alias("polled_at"))  # a row a run
    told = published.groupBy("run_id").agg(F.max_by(F.struct("published", "elapsed_ms"), "at").alias("p"), F.max("at").alias("published_at"))
    saved, failed = (F.when(F.col("kind") == k, F.col("n")).otherwise(0) for k in ("SAVED", "FAILED"))
    known = progress.join(first_poll, "run_id", "left")
    sums = known.groupBy("run_id").agg(
        F.sum("consumed").alias("consumed"), F.sum(saved).alias("saved"), F.sum(failed).alias("failed"), F.max("at").alias("progressed_at"),
        F.sum(F.when(F.col("at") <= F.col("polled_at"), F.col("n")).otherwise(0)).alias("polled"),
    )
    rows = runs.join(told, "run_id", "left").join(sums, "run_id", "left").join(first_poll, "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.split(".")[-1])
    rows = rows.select("run_id", "expected", "started_at", "published_at", "progressed_at", "polled_at", *map(zero, ("p.published", "p.elapsed_ms", "consumed", "saved", "failed", "polled")))
    finished, ms = F.col("saved") + F.col("failed"), lambda a, b: F.greatest(F.lit(1), F.unix_millis(a) - F.unix_millis(b))
    ended = F.col("progressed_at").isNotNull() & (finished >= F.col("expected"))
    completed = F.when(ended, F.col("progressed_at"))
    begun = F.when(F.col("published_at") <= F.col("progressed_at"), F.col("published_at")).otherwise(F.col("started_at"))
    processing = F.when(ended, ms(F.col("progressed_at"), begun)).when(F.col("published_at").isNotNull(), ms(now, F.col("published_at"))).otherwise(
        F.coalesce(F.when(F.col("progressed_at").isNotNull(), ms(F.col("progressed_at"), F.col("started_at"))), F.lit(0))
    )
    rows = rows.withColumns({"processing_ms": processing, "lag": F.greatest(F.lit(0), F.col("expected") - finished), "completed_at": completed})
    last = F.when(F.col("progressed_at").isNull() | (F.col("published_at") > F.col("progressed_at")), "PUBLISHED")
    status = F.when(F.col("progressed_at").isNull() & F.col("published_at").isNull(), "STARTED").when(last.isNotNull(), last).when(~ended, "PROCESSING")
    return rows.select(
        "run_id", "expected", "published", "consumed", "saved", "failed", "lag",
        F.greatest("lag", F.when(F.col("polled_at").isNotNull(), F.greatest(F.lit(0), F.col("expected") - F.col("polled")))).alias("max_lag"),
        F.col("elapsed_ms").alias("publish_ms"), "processing_ms", ms(F.coalesce("completed_at", now), F.col("started_at")).alias("total_ms"),
        (F.col("published") / (F.greatest(F.lit(1), F.col("elapsed_ms")) / 1000.0)).alias("published_per_second"),
        (F.col("saved") / (F.greatest(F.lit(1), F.col("processing_ms")) / 1000.0)).alias("saved_per_second"), (F.col("lag") == 0).alias("completed"),
        F.coalesce(status, F.when(F.col("failed") == 0, "COMPLETED").otherwise("COMPLETED_WITH_FAILURE")).alias("status"),
    )


def sliding_counts(events: DataFrame, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    w = F.window("occurred_at", length, slide)
    return events.groupBy(w.alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "severity", "n")
