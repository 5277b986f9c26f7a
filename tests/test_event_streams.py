"""Event sets and streams: what is shuffled, and how often events are built."""

from pyspark.sql import functions as F

from millwright.catalog import ORACLES, QUERIES
from millwright.catalogs import events as catalog
from millwright.operators import events as E
from tests.oracle import DATA, compare

SF = f"{DATA}/sf0.001"


def test_parity_of_told_events_shuffles_no_digest(spark):
    plan = QUERIES["i12_batch_parity"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "hashpartitioning(charge_id" in dealt[0] and not any(c in dealt[0] for c in ("event_id", "material_key"))
    assert compare(QUERIES["i12_batch_parity"](spark, SF), ORACLES["i12_batch_parity"], SF) == ""
    rows = catalog.built(spark, SF).limit(400).localCheckpoint()
    one = rows.where("stage_rank < 14").unionByName(rows.where("stage_rank = 12"))
    two = rows.where("stage_rank > 11").withColumn("replay_hour", F.when(F.col("stage_rank") != 13, F.col("replay_hour")))
    two = two.withColumns({"batch_id": E.batch_id()}).withColumn("equipment_batch_id", E._equipment_batch()).withColumn("event_id", E.event_id())
    columns = ["event_id", "batch_step"]
    short = sorted(map(tuple, E.parity(E.told(one), E.told(two), columns).collect()))
    assert short == sorted(map(tuple, E.parity(one, two, columns).collect())) and {s for s, *_ in short} == {"first", "second"}


def test_a_stream_is_checked_in_few_passes(spark):
    """What an event alone shows is told in one pass, and a material's batches are digested before its events."""
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(QUERIES["i5_stream_violations"](spark, SF)).count("Generate explode(array(struct(") <= 8
    above, below = plan(catalog.built(spark, SF).select("event_id", "batch_id", "equipment_batch_id")).split("Generate", 1)
    assert above.count("sha2(") == 1 and "batch-id/v1" in below
    rows = catalog.built(spark, SF)
    again = rows.withColumns({"b": E.batch_id(), "q": E._equipment_batch(), "m": E.material_key()})
    assert rows.count() > 1000 and again.where("not (b <=> batch_id) or not (q <=> equipment_batch_id) or not (m <=> material_key)").count() == 0


def test_payloads_are_parsed_once(spark):
    plan = QUERIES["i2_stage_payload"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json(") == 1
    assert compare(QUERIES["i2_stage_payload"](spark, SF), ORACLES["i2_stage_payload"], SF) == ""


def test_shuffle_files_of_a_written_stage_are_deleted(spark, monkeypatch):
    """Without it they lie beside all later ones until the driver happens to collect its garbage."""
    import glob
    import time
    import uuid

    from millwright import work

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    monkeypatch.setattr(work, "RELEASED", 0)
    before = files()
    rows = work.stage(spark, "none", f"dealt-{uuid.uuid4().hex}", lambda: spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 7000).alias("k")).count())
    until = time.time() + 15
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and rows.count() == 7000


def test_blocks_are_not_written_twice_and_materials_are_joined_without_digests(spark):
    blocks = QUERIES["g13_bootstrap_blocks"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in blocks and blocks.count("concat_ws(|") <= 1
    cards = QUERIES["k10_overview_cards"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in cards and "charge_id" in cards
