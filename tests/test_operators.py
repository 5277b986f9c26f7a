"""Plant and sensor operators: agreement with SQL, boundaries, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from millwright.catalog import FLAGSHIP, ORACLES, QUERIES
from millwright.functions import predicates as P
from millwright.functions.statistics import erfc, wilson
from millwright.operators import fleet, genealogy, holdout, monitor, ranges, rules
from millwright.sources import files
from millwright.streaming import jobs
from tests.oracle import DATA, compare

SF = f"{DATA}/sf0.001"
QUICK = ["g15_g17_g18_graded_rules", "g12_bootstrap_intervals", "g18_final_grades", "h4_holdout_intervals", "l8_l9_replay_stream", "i5_stream_violations", "k7_b20_all_alerts", "c7_most_specific_range", "i9_aggregate_lineage", "j3_encoding", "a8_ordered_sink", "d2_quarantine", "e5_split_counts", "e6_forward_folds", "f4_equal_frequency_bins", FLAGSHIP, "i1_i3_replay_events", "k12_dashboard", "j6_average_precision", "g11_hashed_draws"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_agree_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def test_entry_points_list_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and FLAGSHIP in entry.queries()


def test_quarantine_of_hand_made_records(spark):
    sm = spark.createDataFrame([("s1", "c1", "1", "2025-01-01"), ("s2", "c1", "2", "2025-01-09"), ("s3", None, "3", "2025-01-01"), ("s4", "c9", "9", "2025-01-01")], "sm_record string, charge_id string, slab_no string, cast_date string")
    fur = spark.createDataFrame([("f1", "c1", "1", "h1", "2025-01-02"), ("f2", "c1", "2", "h2", "2025-01-02"), ("f5", "c5", "5", "h5", None), ("f6", "c6", "6", "h6", "2025-01-02"), ("f7", "c6", "6", "h7", "2025-01-02")], "fur_record string, charge_id string, slab_no string, hr_coil_id string, hr_date string")
    fur = fur.withColumn("hr_date", F.to_date("hr_date")).withColumns({"f_ext_date": F.col("hr_date"), **{g: F.lit(1.0) for g in ("f_bfg", "f_cog", "f_ldg")}})
    ap = spark.createDataFrame([("a1", "h1", "p1", "2025-01-03", None), ("a2", "h1 ", " ", "2025-01-03", None)], "ap_record string, hr_coil_id string, ap_prod_id string, ap_date string, judge string").withColumn("ap_date", F.to_date("ap_date"))
    got = {r.record: r.reason for r in genealogy.quarantine(sm.withColumn("cast_date", F.to_date("cast_date")), fur, ap).collect()}
    assert got == {
        "s2": "IMPOSSIBLE_STAGE_DATE_ORDER", "f2": "IMPOSSIBLE_STAGE_DATE_ORDER", "s3": "MISSING_SM_CC_KEY", "s4": "UNLINKED_SM_CC", "f5": "INVALID_FUR_HR_DATE",
        "f6": "DUPLICATE_FUR_HR_KEY", "f7": "DUPLICATE_FUR_HR_KEY", "a2": "MISSING_AP_PROD_ID",
    }


def test_severity_and_range_boundaries(spark):
    rows = spark.createDataFrame([("RUNNING", 89.9, 0.0, 0.0), ("RUNNING", 90.0, 0.0, 0.0), ("IDLE", 74.9, 4.9, 59.9), ("IDLE", 0.0, 5.0, 0.0), ("FAILURE", 0.0, 0.0, 0.0), ("IDLE", 0.0, 0.0, 80.0)], "status string, temperature double, vibration double, current_value double")
    assert [r[0] for r in rows.select(P.severity()).collect()] == ["WARNING", "CRITICAL", "NORMAL", "WARNING", "CRITICAL", "CRITICAL"]
    one = spark.range(1).select(P.range_status(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(True), F.lit(True)), P.range_status(F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), F.lit(False), F.lit(True))).first()
    assert tuple(one) == ("SEVERE", "TYPICAL")


def test_statistics(spark):
    import math

    low, high = wilson(F.lit(5), F.lit(50), 1.959963984540054)
    got = spark.range(1).select(erfc(F.lit(1.2)), low, high).first()
    assert abs(got[0] - math.erfc(1.2)) < 1e-6 and abs(got[1] - 0.04348) < 1e-4 and abs(got[2] - 0.21360) < 1e-4
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 1.0)], "family string, field string, p double")
    q = {r.field: round(r.q, 6) for r in rules.benjamini_hochberg(p, "family", "p", ("field",)).collect()}
    assert q == {"a": 0.04, "b": 0.053333, "c": 0.053333, "d": 1.0}


def test_repetition_badge(spark):
    seen = [("e", "r", u, f"m{u}", u % 2 == 0 or u > 6) for u in range(10)]
    batch = {r.unit: r.repeated for r in monitor.repeated(spark.createDataFrame(seen, "equipment_id string, rule_id string, unit long, material string, hit boolean")).collect()}
    assert batch[4] and batch[8] and not batch[2] and not batch[3]


def sensor_line(i, t, temp, equipment="e1"):
    return json.dumps({"event_id": i, "equipment_id": equipment, "status": "RUNNING", "temperature": temp, "vibration": 0, "current_value": 0, "occurred_at": t})


def test_ingest_stream(spark, tmp_path):
    line, source = sensor_line, tmp_path / "in"
    source.mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def arrives(name, *lines):
        (source / name).write_text("\n".join(lines))
        jobs.ingest(jobs.sensor_source(spark, str(source)), out, cp).awaitTermination()

    def ids():
        return sorted(r.event_id for r in jobs.stored_events(spark, out).collect())

    arrives("0.txt", "no event at all")  # a first batch of bad lines only
    assert ids() == [] and jobs.newest_state(spark, out).count() == 0 and spark.read.parquet(f"{out}/dead_letters").count() == 1
    day = "2024-01-01T00:00:00Z"
    arrives("a.txt", line("evt-b", day, 95.0), line("evt-b", day, 5.0), line("evt-a", day, 80.0), "no json", '{"equipment_id": "no id"}')
    assert ids() == ["evt-a", "evt-b"] and spark.read.parquet(f"{out}/dead_letters").count() == 3
    state = jobs.newest_state(spark, out).collect()
    assert [(r.event_id, r.severity) for r in state] == [("evt-b", "CRITICAL")]  # of equal times the one seen first, whatever its id
    arrives("b.txt", line("evt-b", "2024-05-01T00:00:00Z", 95.0), line("evt-0", day, 10.0), line("8f14e45f-ceea-467f-a0e6-1d2e3f4a5b6c", "2023-01-01T00:00:00Z", 10.0))
    assert len(ids()) == 4 and [r.event_id for r in jobs.newest_state(spark, out).collect()] == ["evt-b"]  # a late repeat is refused, later arrivals of the same time too
    arrives("c.txt", "{")
    assert len(ids()) == 4 and [r.event_id for r in jobs.newest_state(spark, out).collect()] == ["evt-b"]


def test_stored_runs_are_merged_and_ids_refused_for_ever(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FAN", 3)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(10):
        lines = [sensor_line(f"id-{n}-{k}", f"2024-01-{n + 1:02d}T00:00:00Z", 10.0 * n, f"e{k}") for k in range(3)] + [sensor_line(f"id-{n // 2}-0", "2025-01-01T00:00:00Z", 99.0)]
        (source / f"{n}.txt").write_text("\n".join(lines if n != 4 else ["bad"]))
        jobs.ingest(jobs.sensor_source(spark, str(source)), out, str(tmp_path / "cp")).awaitTermination()
        assert len(list((tmp_path / "out/events").iterdir())) <= 4 and len(list((tmp_path / "out/latest").iterdir())) <= 2
    assert sorted(p.name for p in (tmp_path / "out/events").iterdir()) == ["0-8", "9-9"]
    rows = jobs.stored_events(spark, out).collect()
    assert sorted(r.event_id for r in rows) == sorted({f"id-{n}-{k}" for n in range(10) if n != 4 for k in range(3)} | {"id-4-0"})
    newest = {r.equipment_id: r.event_id for r in jobs.newest_state(spark, out).collect()}
    assert newest == {"e0": "id-9-0", "e1": "id-4-0", "e2": "id-9-2"}
    # a merged run hides parts that a stopped merge has left, and a repeated batch does not merge them again
    (tmp_path / "out/events/9-9").rename(tmp_path / "out/events/8-8")
    assert jobs.stored_events(spark, out).count() == len(rows) - 3 and jobs.stored_events(spark, out, 2).count() == 6


def test_events_meet_the_state_of_their_time(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "sensors"
    source.mkdir()
    state.mkdir()
    orders = spark.readStream.schema("equipment_id string, n int").json(str(source))
    seen = []
    for n, temp in enumerate((None, 10.0, 95.0)):
        if temp is not None:
            (state / f"{n}.txt").write_text(sensor_line(f"s{n}", f"2024-01-0{n}T00:00:00Z", temp))
            jobs.ingest(jobs.sensor_source(spark, str(state)), str(tmp_path / "store"), str(tmp_path / "cp1")).awaitTermination()
        (source / f"{n}.json").write_text(json.dumps({"equipment_id": "e1", "n": n}) + "\n" + json.dumps({"equipment_id": "other", "n": n}))
        jobs.with_state(orders, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    seen = {(r.equipment_id, r.n): r.state_severity for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert seen == {("e1", 0): None, ("e1", 1): "NORMAL", ("e1", 2): "CRITICAL", ("other", 0): None, ("other", 1): None, ("other", 2): None}


def test_alert_stream_does_not_deduplicate(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join([sensor_line("x", "2024-01-01T00:00:00Z", 95.0)] * 2 + [sensor_line("y", "2024-01-01T00:00:00Z", 1.0), "bad"]))
    jobs.alert_stream(jobs.sensor_source(spark, str(source))).writeStream.format("memory").queryName("alerted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    rows = spark.table("alerted").collect()
    assert [(r.event_id, r.severity, r.message) for r in rows] == [("x", "CRITICAL", "CRITICAL e1: RUNNING")] * 2 and all(r.latency_ms > 0 for r in rows)


def test_run_tracking_states(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    stamp = lambda rows, schema, *names: spark.createDataFrame(rows, schema).withColumns({n: F.to_timestamp(n) for n in names})
    runs = stamp([(r, 10, at(0)) for r in ("done", "failed", "open", "early", "published", "begun", "more")], "run_id string, expected long, started_at string", "started_at")
    published = stamp([("done", at(2), 10, 500), ("done", at(1), 3, 100), ("failed", at(2), 10, 0), ("early", at(9), 10, 400), ("published", at(4), 10, 100), ("open", at(1), 10, 100), ("more", at(1), 10, 1)], "run_id string, at string, published long, elapsed_ms long", "at")
    progress = stamp([("done", at(3), "SAVED", 6, 6), ("done", at(5), "SAVED", 5, 4), ("failed", at(4), "SAVED", 9, 8), ("failed", at(6), "FAILED", 0, 2), ("open", at(3), "SAVED", 4, 4), ("early", at(5), "SAVED", 10, 10), ("more", at(3), "SAVED", 12, 12)], "run_id string, at string, kind string, consumed long, n long", "at")
    polls = stamp([("done", at(4)), ("done", at(9)), ("open", at(2)), ("more", at(9))], "run_id string, at string", "at")
    got = {r.run_id: r for r in fleet.run_tracking(runs, published, progress, polls, F.to_timestamp(F.lit(at(20)))).collect()}
    assert {k: r.status for k, r in got.items()} == {"done": "COMPLETED", "failed": "COMPLETED_WITH_FAILURE", "open": "PROCESSING", "early": "PUBLISHED", "published": "PUBLISHED", "begun": "STARTED", "more": "COMPLETED"}
    assert (got["done"].published, got["done"].consumed, got["done"].max_lag, got["done"].processing_ms, got["done"].total_ms, got["done"].published_per_second) == (10, 11, 4, 3000, 5000, 20.0)
    assert (got["failed"].failed, got["failed"].lag, got["failed"].completed, got["failed"].published_per_second) == (2, 0, True, 10000.0)
    assert (got["open"].lag, got["open"].max_lag, got["open"].processing_ms, got["open"].total_ms) == (6, 10, 19000, 20000)
    assert (got["early"].processing_ms, got["begun"].processing_ms, got["begun"].lag, got["more"].lag, got["more"].max_lag) == (5000, 0, 10, 0, 0)
    assert got["done"].saved_per_second == pytest.approx(10 / 3.0)


def test_strict_csv_types_and_manifest(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,n,d,h\n a ,1.5,2025-01-01,23\n,,2025-02-30,24\n"q ""x""",inf,2025-01-03,1\n')
    rows = files.numbered(files.read_strict_csv(spark, str(path), ["id", "n", "d", "h"]))
    assert [r[0] for r in rows.select("_source_record_number").collect()] == [2, 3, 4]
    good, bad = files.typed(rows, {"id": "IDENTIFIER", "n": "NUMBER", "d": "DATE", "h": "HOUR"})
    assert good.first().id == "a" and {(r.column, r.value) for r in bad.collect()} == {("d", "2025-02-30"), ("h", "24"), ("n", "inf")}
    with pytest.raises(Exception, match="(?i)header|column"):
        files.read_strict_csv(spark, str(path), ["id", "other", "d", "h"]).collect()
    assert files.fingerprints(spark, str(path)).first().size == path.stat().st_size
    folder = str(tmp_path / "bundle")
    files.publish({"rows": good}, folder)
    assert files.audit(spark, folder).count() == 0
    files.publish({"rows": good}, folder)
    with pytest.raises(ValueError):
        files.publish({"rows": good.limit(1)}, folder)
    assert files.audit(spark, folder).count() == 0 and files.snapshot(spark, folder, "rows").count() == 3
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/{files.published(spark, folder).first().path}")
    assert files.audit(spark, folder).count() == 1


def test_a_created_file_is_whole_and_the_first_of_racing_writers_stays(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from millwright import work

    path = str(tmp_path / "made/file")
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: work.create_file(spark, path, f"content {k}".encode() * 1000), range(8)))
    assert sum(won) == 1 and (tmp_path / "made/file").read_text() == f"content {won.index(True)}" * 1000
    # a writer that is slow between its content and its name loses to one that comes between, and nothing of it is seen
    expose, slow = work._expose, str(tmp_path / "made/slow")

    def late(*args):
        monkeypatch.setattr(work, "_expose", expose)
        assert not (tmp_path / "made/slow").exists() and work.create_file(spark, slow, b"quick")
        return expose(*args)

    monkeypatch.setattr(work, "_expose", late)
    assert not work.create_file(spark, slow, b"slow") and (tmp_path / "made/slow").read_bytes() == b"quick"
    assert sorted(p.name for p in (tmp_path / "made").iterdir()) == ["file", "slow"]


def test_event_files_round_trip_and_problems(spark, tmp_path):
    import datetime

    from millwright.operators import events

    day = datetime.date(2025, 1, 1)
    rows = spark.createDataFrame([(f"c{k}", "1", "g, \"q\"", "u", 1.5, "x", 2.0, 1.0, 1.0, 1.0, f"h{k}", "p", "양품", day, day, day, k % 24, "2", "r" if k % 2 else None) for k in range(30)],
        "charge_id string, slab_no string, steel_grade string, steel_usage string, tundish_temp double, f_jangip_gubun string, f_heat_temp double, f_bfg double, f_cog double, f_ldg double, hr_coil_id string, ap_prod_id string, judge string, cast_date date, f_ext_date date, ap_date date, f_ext_time int, furnace_no string, ap_record string")
    built = events.build_events(rows)
    files.write_events(built, str(tmp_path / "events"), "b1", "c1")
    back, problems = files.read_events(spark, str(tmp_path / "events"))
    assert problems.count() == 0 and back.count() == built.count() == 30 * 7 + 15
    assert sorted(r.values_json for r in back.collect()) == sorted(r.values_json for r in built.collect())
    files.write_events(built.withColumn("equipment_type", F.when(F.col("batch_step") == "RM4_RECORDED", "AP").otherwise(F.col("equipment_type"))), str(tmp_path / "bad"), "b1", "c1")
    kinds = {r.problem: r["count"] for r in files.read_events(spark, str(tmp_path / "bad"))[1].groupBy("problem").count().collect()}
    assert kinds == {"WRONG_EQUIPMENT": 30, "WRONG_EVENT_ID": 30}
    # rows moved in a file, a row delivered twice, and files in the wrong order
    lines = [x for f in sorted((tmp_path / "events").glob("*.csv")) for x in f.read_text().splitlines()[1:]]
    header = sorted((tmp_path / "events").glob("*.csv"))[0].read_text().splitlines()[0]

    def problems_of(name, *parts):
        (tmp_path / name).mkdir()
        for k, part in enumerate(parts):
            (tmp_path / name / f"part-{k}.csv").write_text("\n".join([header, *part]) + "\n")
        return [r.problem for r in files.read_events(spark, str(tmp_path / name))[1].collect()]

    assert problems_of("whole", lines[:100], lines[100:]) == []
    assert problems_of("moved", lines[:50] + [lines[60]] + lines[50:60] + lines[61:]) == ["SORT_INVALID"]
    assert problems_of("swapped", lines[100:], lines[:100]) == ["SORT_INVALID"]
    assert sorted(problems_of("twice", lines[:10], [lines[9], *lines[10:]])) == ["DUPLICATE_EVENT_ID", "SORT_INVALID"]
    ordered = spark.createDataFrame([("m", f"e{i}", 0, i, v) for i, v in enumerate([1, 2, 2, 5, 4, 6, 7, 7, 9, 3])], "material_key string, event_id string, f int, r long, k int")
    for run in (1, 2, 3, 100):
        assert {r.event_id for r in events.order_violations(ordered, "f", "r", ("k",), run).collect()} == {"e2", "e4", "e7", "e9"}
    mixed = back.withColumn("bundle_id", F.when(F.col("charge_id") == "c1", "b2").otherwise(F.col("bundle_id")))
    assert {r.problem for r in events.violations(mixed).collect()} == {"MIXED_BUNDLE"}


def test_alert_export_has_its_columns_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("m2", "r", 2), ("m1", "r", 1), ("m3", None, 3)], "material_key string, rule_id string, place int")
    files.export_alerts(rows, str(tmp_path / "alerts"), ["place"])
    got = spark.read.option("header", "true").csv(str(tmp_path / "alerts"))
    assert tuple(got.columns) == files.ALERT_COLUMNS and [r.material_key for r in got.collect()] == ["m1", "m2", "m3"]


def test_broker_records_are_keyed(spark):
    keyed = jobs.keyed_records(spark.createDataFrame([("e9", 1.0)], "equipment_id string, temperature double")).first()
    assert keyed.key == "e9" and json.loads(keyed.value) == {"equipment_id": "e9", "temperature": 1.0}


def plain_draws(material, n, replicates):
    import hashlib

    seed = hashlib.sha256(material.encode()).digest()
    place = lambda r, i: int.from_bytes(hashlib.sha256(seed + r.to_bytes(8, "big") + i.to_bytes(8, "big")).digest()[:8], "big") % n
    return [[place(r, i) for i in range(n)] for r in range(replicates)]


def test_bootstraps_equal_plain_draws(spark):
    import math
    import random

    rng = random.Random(4)
    blocks = [("rule", f"c{k:03d}", s, rng.randrange(4), rng.randrange(6), rng.randrange(3), rng.randrange(9)) for k in range(40) for s in ("x", "y") if rng.random() < 0.8]
    charges = sorted({b[1] for b in blocks})
    ratios = []
    for draw in plain_draws("m\0rule\0rule-ci-v1", len(charges), 60):
        cells = {}
        for i in draw:
            for b in blocks:
                if b[1] == charges[i]:
                    cells[b[2]] = [x + y for x, y in zip(cells.get(b[2], [0] * 4), b[3:], strict=True)]
        num = den = 0.0
        for t in cells.values():
            a, b, c, d = (x + (0.5 if 0 in t else 0) for x in t)
            num, den = num + a * (c + d) / (a + b + c + d), den + c * (a + b) / (a + b + c + d)
        ratios.append(num / den)
    ratios.sort()
    want = [ratios[math.ceil(q * len(ratios)) - 1] for q in (0.025, 0.975)]
    df = spark.createDataFrame(blocks, "rule_id string, charge_id string, stratum string, a long, b long, c long, d long")
    got = rules.bootstrap_intervals(df, 60, 50, "m").first()
    assert (got.rr_low, got.rr_high, got.valid, got.reason) == (pytest.approx(want[0]), pytest.approx(want[1]), 60, "NONE")
    assert rules.bootstrap_intervals(df, 60, 61, "m").first().reason == "TOO_FEW_VALID_BOOTSTRAPS"
    shuffled = rules.bootstrap_intervals(df, 60, 50, "m", in_place=0).first()  # draws as rows, for keys that no task should hold
    assert tuple(shuffled) == tuple(got)
    lone = spark.createDataFrame([("none", "c1", "x", 0, 3, 0, 4), ("é", "ü", "x", 1, 1, 1, 1)], df.schema)
    found = {r.rule_id: (r.valid, r.reason) for r in rules.bootstrap_intervals(lone, 30, 20, "m").collect()}
    assert found == {"none": (30, "NONE"), "é": (30, "NONE")} and rules.bootstrap_intervals(df.limit(0), 30, 20, "m").count() == 0
    counts = [("DANGER", f"c{k:03d}", k % 3, k % 4, k % 2, 5) for k in range(30)]
    by_charge = spark.createDataFrame(counts, "profile string, charge_id string, tp long, fp long, fn long, tn long")
    recalls = sorted(sum(counts[i][2] for i in draw) / sum(counts[i][2] + counts[i][4] for i in draw) for draw in plain_draws("m\0holdout-bootstrap-v1", 30, 60))
    row = {r.metric: r for r in holdout.bootstrap(by_charge, 60, 50, "m").collect()}["recall"]
    assert (row.lower, row.upper) == (pytest.approx(recalls[1]), pytest.approx(recalls[58])) and row.reason == "NONE"
    assert {tuple(r) for r in holdout.bootstrap(by_charge, 60, 50, "m", in_place=0).collect()} == {tuple(r) for r in holdout.bootstrap(by_charge, 60, 50, "m").collect()}


def test_bootstrap_blocks_are_shuffled_in_parcels(spark):
    rows = [(f"NUMERIC|some_long_field|{r}", str(100000 + 7 * k), f"steel_grade=Brand#{k % 5}", k % 2, 0, 1, k % 3) for r in range(3) for k in range(2000)]
    blocks = spark.createDataFrame(rows, "rule_id string, charge_id string, stratum string, a long, b long, c long, d long").repartition(2)
    packed = rules.parcels(blocks, "rule_id", "stratum", ("a", "b", "c", "d")).collect()
    assert len(packed) <= 6 and sum(len(r.parcel) for r in packed) < 20 * len(rows)  # a row of the table itself has 100 bytes
    sums = rules.replicate_sums(blocks, "rule_id", "stratum", ("a", "b", "c", "d"), F.sha2("rule_id", 256), 2)
    assert sums.groupBy("rule_id", "replicate").agg(F.count("*").alias("n")).where("n = 5").count() == 6
    exchanges = [x for x in sums._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(exchanges) == 1 and "charge_id" not in exchanges[0] and "__chunk" in exchanges[0]


def test_interactions_need_two_bins_a_side(spark):
    names = ["charge_id", "slab_no", "judge", "steel_grade", "steel_usage", "furnace_no", "f_jangip_gubun", "tundish_temp", "f_heat_temp", "f_bfg_ratio", "f_cog_ratio"]
    rows = spark.createDataFrame([(str(i), "1", "x", "g", "u", "1", "c", 5.0, float(i), float(i % 4), 1.0) for i in range(12)], ", ".join(f"{n} {'double' if n.endswith(('temp', 'ratio')) else 'string'}" for n in names))
    from millwright.config import AnalysisConfig

    found = {(r.family, r.field) for r in rules.memberships(rows, *rules.bins(rows, AnalysisConfig())).select("family", "field").distinct().collect()}
    assert ("INTERACTION", "f_heat_temp|f_bfg_ratio") in found and ("INTERACTION", "tundish_temp|f_heat_temp") not in found and ("NUMERIC", "tundish_temp") in found


def test_early_warning_needs_a_stage_before_the_result(spark):
    rows = spark.createDataFrame([("f_heat_temp",), ("tundish_temp|f_heat_temp",), ("furnace_no",), ("ap_line_speed",), ("steel_grade|ap_shift",)], "field string")
    assert [r[0] for r in rows.select(rules.first_stage()).collect()] == ["HEAT_COMPLETE", "HEAT_COMPLETE", "FURNACE_CHARGED", "AP_RECORDED_WITH_RESULT", "AP_RECORDED_WITH_RESULT"]


def test_intervals_go_to_applicable_rules_and_decide_danger(spark):
    from millwright.config import AnalysisConfig

    cfg = AnalysisConfig()
    base = {"family": "NUMERIC", "field": "f_heat_temp", "kind": "STRATIFIED", "support": 300, "defects": 30, "adjusted": 0.1, "comparator": 0.02, "rd": 0.08, "rr": 3.0, "q": 0.01, "reason": "NONE", "c_rr": 2.0, "c_rd": 0.05, "c_reason": "NONE"}
    changed = [{}, {"support": 199}, {"defects": 4}, {"rr": None}, {"rr": 0.0}, {"comparator": None}, {"rr": float("inf")}]
    names = [*base, "bin"]
    df = spark.createDataFrame([tuple({**base, **c, "bin": str(i)}[k] for k in names) for i, c in enumerate(changed)], "family string, field string, kind string, support long, defects long, adjusted double, comparator double, rd double, rr double, q double, reason string, c_rr double, c_rd double, c_reason string, bin string")
    assert [r.bin for r in df.where(rules.bootstrap_applicable(cfg)).collect()] == ["0"]
    one = df.where("bin = '0'")
    for low, reason, want in ((1.2, "NONE", ("DANGER", "NONE")), (0.9, "NONE", ("CAUTION", "NONE")), (None, "TOO_FEW_VALID_BOOTSTRAPS", ("CAUTION", "TOO_FEW_VALID_BOOTSTRAPS"))):
        ci = spark.createDataFrame([("NUMERIC|f_heat_temp|0", low, 4.0, reason)], "rule_id string, rr_low double, rr_high double, reason string")
        row = rules.graded_rules(one, cfg, ci).first()
        assert (row.grade, row.reason) == want and row.early_warning
    assert rules.graded_rules(one, cfg).first().grade == "DANGER"


def test_grades_and_reasons_of_rule_metrics(spark):
    from millwright.config import AnalysisConfig

    cfg = AnalysisConfig(discovery_support=10, caution_defects=2)
    chosen = spark.createDataFrame([("F", "f", b, 0, k) for b, k in (("none", "STRATIFIED"), ("one", "STRATIFIED"), ("small", "UNADJUSTED_FALLBACK"), ("fine", "UNADJUSTED_FALLBACK"), ("flat", "UNADJUSTED_FALLBACK"))], "family string, field string, bin string, level int, kind string")
    cells = [("one", "s", 9, 9, 9, 9), ("small", "s", 1, 1, 40, 40), ("fine", "s", 20, 20, 5, 45), ("flat", "s", 20, 0, 30, 0)]
    tables = spark.createDataFrame([("F", "f", b, 0, *c) for b, *c in cells], "family string, field string, bin string, level int, stratum string, a long, b long, c long, d long")
    summed = rules.sums(tables, rules.weights(tables, chosen), chosen)
    got = {r.bin: r for r in rules.metrics(summed, cfg, 10, 2).collect()}
    assert {k: r.reason for k, r in got.items()} == {"none": "NO_INFORMATIVE_STRATA", "one": "NO_INFORMATIVE_STRATA", "small": "LOW_SUPPORT", "fine": "NONE", "flat": "ZERO_VARIANCE"}
    assert all(got[k].p == 1.0 and got[k].rr is None for k in ("none", "one", "small")) and got["fine"].rr == pytest.approx(5.0) and got["none"].crude is None
    flat = rules.grade(cfg)
    rows = spark.createDataFrame([("ZERO_VARIANCE", "NONE", 1.0, 0.0, 1.0), ("LOW_SUPPORT", "NONE", 9.0, 0.5, 0.0), ("NONE", "NONE", 1.6, 0.02, 0.01)], "reason string, c_reason string, rr double, rd double, q double")
    rows = rows.withColumns({"defects": F.lit(20), "c_rr": F.lit(2.0), "c_rd": F.lit(0.1), "kind": F.lit("STRATIFIED")})
    assert [r[0] for r in rows.select(flat).collect()] == ["NORMAL", "INSUFFICIENT_EVIDENCE", "CAUTION"]


def test_missing_keys_are_never_ambiguous(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (" ", 5), ("b", 6)], "k string, n int")
    got = {r.n: r.twice for r in genealogy.mark_ambiguous(rows, ["k"], "twice", ~P.missing("k")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_quantiles_equal_sorted_lists(spark):
    import math
    import random
    import statistics

    rng = random.Random(9)
    rows = [(k, None if rng.random() < 0.1 else rng.choice([0.5, 0.5, 7.0, rng.gauss(0, 5)])) for k in ("a", None, "b") for _ in range(301)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    places = {"lo": 0.0, "q05": 0.05, "mid": 0.5, "q99": 0.99, "hi": 1.0}
    groups = {k: sorted(v for key, v in rows if key == k and v is not None) for k, _ in rows}
    want = {k: tuple(v[max(1, math.ceil(q * len(v))) - 1] for q in places.values()) + (len(v),) for k, v in groups.items() if v}
    assert {r[0]: tuple(r)[1:] for r in ranges.type1_quantiles(df, ["k"], "v", places, "n").collect()} == want
    assert {r.k: r.median for r in ranges.medians(df, ["k"], "v").collect()} == {k: statistics.median(v) for k, v in groups.items() if v}
    assert ranges.type1_quantiles(df.where("false"), ["k"], "v", places).count() == 0
    every = sorted(v for v in (v for _, v in rows) if v is not None)
    assert ranges.type1_quantiles(df, [], "v", {"q": 0.25}).first().q == every[math.ceil(0.25 * len(every)) - 1]


def test_alert_metrics_take_the_latest_alerts(spark):
    alerts = spark.createDataFrame([(f"evt-{999 - i}", i, i) for i in range(1, 101)], "event_id string, arrival long, latency_ms long")
    assert tuple(fleet.alert_metrics(alerts, 20).first()) == (100, 50.5, 99, 100)
    assert tuple(fleet.alert_metrics(alerts, since=F.col("arrival") > 90).first()) == (10, 95.5, 100, 100)
    assert tuple(fleet.alert_metrics(alerts.where("false"), 20).first()) == (0, None, None, None)


def test_genealogy_deals_each_source_once(spark):
    """Rows of a source go through one shuffle by their key, linked rows through one more; records are numbers until they are shown."""
    from millwright.catalogs import bound
    from millwright.sources import bindings

    for rows, most in ((genealogy.chain(*bound.sources(spark, SF, numbered=True)), 8), (genealogy.boundary(bindings.fur_hr(spark, SF, numbered=True)), 1)):
        assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= most
    assert dict(bound.replay(spark, SF).dtypes)["ap_record"] == "bigint"


def test_quarantine_tells_the_most_severe_reason(spark):
    sm = spark.createDataFrame([("s1", "c1", "1", "2025-01-01"), ("s2", "c2", "1", "2025-01-01"), ("s3", "c3", "1", "2025-01-01"), ("s3", "c3", "1", "2025-01-02"), ("s4", "c4", "1", "2025-01-01")], "sm_record string, charge_id string, slab_no string, cast_date string")
    fur = spark.createDataFrame(
        [("f1", "c1", "1", "h", "2025-01-02"), ("f2", "c2", "1", "h", "2025-01-02"), ("f3", "c3", "1", "h3", "2025-01-02"), ("f4", "c4", "1", " ", "2025-01-02"), ("f5", "c5", "1", "h5", None), ("f6", " ", "1", "h6", "2025-01-02")],
        "fur_record string, charge_id string, slab_no string, hr_coil_id string, hr_date string",
    ).withColumn("hr_date", F.to_date("hr_date"))
    ap = spark.createDataFrame([("a1", "h", "p1", "2025-01-03"), ("a3", "h3", "p3", "2025-01-03"), ("a4", "h4", "p3", "2025-01-03"), ("a5", "h5", "p5", "2025-01-03"), ("a6", None, "p6", "2025-01-03"), ("a7", "h7", None, "2025-01-03")], "ap_record string, hr_coil_id string, ap_prod_id string, ap_date string")
    dated = sm.withColumn("cast_date", F.to_date("cast_date")), fur.withColumn("f_ext_date", F.col("hr_date")), ap.withColumns({"ap_date": F.to_date("ap_date"), "judge": F.lit(None).cast("string")})
    got = {r.record: r.reason for r in genealogy.quarantine(*dated).collect()}
    assert got == {
        "s1": "UNLINKED_SM_CC", "s2": "UNLINKED_SM_CC", "s3": "DUPLICATE_SM_CC_KEY", "s4": "UNLINKED_SM_CC", "f1": "DUPLICATE_FUR_HR_COIL_KEY", "f2": "DUPLICATE_FUR_HR_COIL_KEY",
        "f3": "UNLINKED_FUR_HR", "f4": "MISSING_FUR_HR_COIL_ID", "f5": "INVALID_FUR_HR_DATE", "f6": "MISSING_FUR_HR_KEY", "a1": "UNLINKED_AP", "a3": "DUPLICATE_AP_PROD_ID",
        "a4": "DUPLICATE_AP_PROD_ID", "a6": "MISSING_AP_HR_COIL_ID", "a7": "MISSING_AP_PROD_ID",
    }
    assert genealogy.chain(*[rows for rows in dated]).count() == 0


def _shuffles(rows):
    return rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_events_are_not_shuffled_whole(spark):
    """Events follow from the replay rows: they are built where they are read, units reach them by a broadcast, and the ordered files hold what places them."""
    from millwright.catalogs import events as catalog
    from millwright.operators import events as E

    rows = catalog.built(spark, SF)
    assert _shuffles(rows) == 0 and _shuffles(QUERIES["i4_i6_total_order_units"](spark, SF)) == 0
    assert set(catalog.streamed(spark, SF).columns) == {*E.ORDER, "place"}
    one, two = rows.where("stage_rank < 12"), rows.where("stage_rank = 11 or stage_rank > 14")
    found = E.parity(one.unionByName(one), two, ["event_id"])
    assert _shuffles(found) == 1
    assert found.where("side = 'first'").count() == 2 * one.count() - rows.where("stage_rank = 11").count()
    assert found.where("side = 'second'").count() == rows.where("stage_rank > 14").count()


def test_ordered_streams_are_shuffled_without_digests(spark, monkeypatch):
    from millwright.catalogs import events as catalog
    from millwright.operators import events as E

    built = catalog.built(spark, SF)
    told = E.told(built)
    assert not {"event_id", "batch_id", "material_key"} & set(told.columns) and "event_id" not in E.in_order(told)._jdf.queryExecution().optimizedPlan().toString()
    assert E.digested(told).select(*E.ORDER).exceptAll(built.select(*E.ORDER)).count() == 0 == built.select(*E.ORDER).exceptAll(E.digested(told).select(*E.ORDER)).count()
    with monkeypatch.context() as m:
        m.setattr(E, "written", lambda rows, label: rows)
        wrong = E.order_violations(told.withColumns({"f": F.lit("stream"), "r": F.monotonically_increasing_id()}), "f", "r")
        assert _shuffles(wrong) == 2  # once for either of the two that read what is written
    keys = [tuple(r) for r in E.digested(E.in_order(told)).select(*E.ORDER).collect()]
    assert keys == sorted(keys) and len(keys) > 1000
    assert compare(QUERIES["i5_a9_strict_order"](spark, SF), ORACLES["i5_a9_strict_order"], SF) == ""


def test_blocks_of_charges_are_dealt_by_charge(spark):
    """A row of a charge is not shuffled once for every rule of its field."""
    from millwright.catalogs import bound

    weighted = rules.weights(bound.tables(spark, SF, "discovery"), bound.level(spark, SF))
    blocks = rules.charge_blocks(bound.members(spark, SF, "discovery"), weighted, bound.level(spark, SF))
    dealt = [line for line in blocks._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and "charge_id" in line]
    assert dealt and all("hashpartitioning(family" in line for line in dealt)


def test_lines_dealt_by_charge_are_not_dealt_again(spark):
    """Castings and furnace rows meet where the lines lie; only what goes by coil is shuffled: picklings, their products, furnace coils, linked rows."""
    from millwright.catalogs import bound
    from millwright.operators import split

    sources = bound.sources(spark, SF, numbered=True)
    near = genealogy.chain(*sources, by_charge=True)
    assert _shuffles(near) <= 5 and _shuffles(bound.boundary(spark, SF)) == 0
    assert _shuffles(split.crossing_charges(bound.boundary(spark, SF), spark.range(1).selectExpr("date'1999-01-01' as c"), "c")) == 0
    assert sorted(map(tuple, near.collect()), key=repr) == sorted(map(tuple, genealogy.chain(*sources).select(near.columns).collect()), key=repr)


def test_unit_groups_are_told_by_hours(spark):
    """What is shuffled for the groups are rows of a kind and an hour; groups are the (batch, step) pairs that the events have, in their order."""
    from millwright.catalogs import events as catalog
    from millwright.operators import events as E

    rows = catalog.built(spark, SF).where("stage_rank not in (11, 15) or cast(charge_id as long) % 3 = 0")
    got = sorted((r.unit, *[r[c] for c in E.UNIT]) for r in E.unit_groups(rows).collect())
    want = sorted(tuple(r) for r in rows.select(*E.UNIT).distinct().collect())
    assert got == [(i + 1, *w) for i, w in enumerate(want)]


def test_violations_shuffle_suspects_only(spark, monkeypatch):
    """Events are not shuffled whole for their checks; with too many suspects to broadcast the result is the same."""
    from millwright.catalogs import events as catalog
    from millwright.operators import events as E

    rows = catalog.built(spark, SF).where("not (stage_rank = 13 and charge_id like '%3')").withColumn("replay_date", F.expr("if(stage_rank = 12 and charge_id like '%7', date_add(replay_date, 30), replay_date)"))
    rows = rows.unionByName(rows.where("stage_rank = 14 and charge_id like '%5'"))
    found = E.violations(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "xxhash64" in plan
    got = sorted((r.material_key, r.event_id or "", r.problem) for r in found.collect())
    assert {p for _, _, p in got} == {"DUPLICATE_EVENT_ID", "STAGE_OUT_OF_ORDER", "MISSING_STAGE", "WRONG_BATCH_ID"}
    monkeypatch.setattr(E._of, "__defaults__", (0,))
    assert sorted((r.material_key, r.event_id or "", r.problem) for r in E.violations(rows).collect()) == got


def test_alerts_and_evidence_are_told_where_events_are_built(spark):
    """Statuses, rule hits and scores follow from an event's own replay row: none is joined, dealt by its material or written; alerts are dealt by unit."""
    import re

    from millwright import work

    def dealt(name):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        return [[c.split("#")[0].strip() for c in x.split(",")] for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]

    of_rows = lambda name: [x for x in dealt(name) if {"unit", "charge_id", "slab_no", "material_key", "event_key", "batch_step"} & set(x)]
    assert of_rows("k7_range_alerts") == [] and [x[0] for x in of_rows("k7_b20_all_alerts")] == ["unit"]
    assert [x[:3] for x in of_rows("k5_evidence")] == [["charge_id", "slab_no", "unit"]]
    assert not any("material_key" in x for name in ("k4_repetition_badge", "b17_alert_history_filter") for x in dealt(name))
    assert not {"placed", "statuses", "evaluations"} & {key[2] for key in work._STAGES}
    for name in ("k7_range_alerts", "k5_evidence", "k4_repetition_badge", "b17_alert_history_filter"):
        assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""
