"""Queries of the replay-event operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millwright.catalogs import Registry, bound
from millwright.config import STAGES
from millwright.operators import events as E
from millwright.operators import monitor as M
from millwright.sources.bindings import BASE
from millwright.work import root, stage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _sha(namespace: str, body: str) -> str:
    return f"'sha256:' || sha256('{namespace}' || chr(10) || {body} || chr(10))"


def _stage(stage: str, rank: int, source: str = "replay") -> str:
    furnace = 10 <= rank < 15
    kind = ("CAST_DAY", 0) if rank == 0 else ("AP_DAY", 2) if rank == 20 else ("FURNACE_HOUR", 1)
    date = "cast_date" if rank == 0 else "ap_date" if rank == 20 else "f_ext_date"
    equipment = "'SM1'" if rank == 0 else "'AP1'" if rank == 20 else "furnace_no" if furnace else "'RM4_PROCESS'"
    hour = "f_ext_time" if kind[0] == "FURNACE_HOUR" else "NULL::INTEGER"
    return f"SELECT charge_id, slab_no, '{stage}' AS batch_step, {rank} AS stage_rank, '{kind[0]}' AS batch_kind, {kind[1]} AS kind_rank, {date} AS replay_date, {hour} AS replay_hour, '{'SM_CC' if rank == 0 else 'AP' if rank == 20 else 'FURNACE' if furnace else 'RM4'}' AS equipment_type, {equipment} AS equipment_id FROM {source}" + (" WHERE ap_record IS NOT NULL" if rank == 20 else "")


def events_sql(source: str = "replay", suffix: str = "") -> str:
    return f"""staged{suffix} AS ({" UNION ALL ".join(_stage(*s, source) for s in STAGES)}),
keyed{suffix} AS (SELECT *, {_sha("material-key/v1", "'{\"chargeId\":\"' || charge_id || '\",\"slabNo\":\"' || slab_no || '\"}'")} AS material_key,
 {_sha("batch-id/v1", "'{\"batchKind\":\"' || batch_kind || '\",\"replayDate\":\"' || strftime(replay_date, '%Y-%m-%d') || '\"' || CASE WHEN batch_kind = 'FURNACE_HOUR' THEN ',\"replayHour\":' || replay_hour ELSE '' END || '}'")} AS batch_id FROM staged{suffix}),
subbed{suffix} AS (SELECT *, CASE WHEN equipment_type = 'FURNACE' THEN {_sha("equipment-batch-id/v1", "'{\"batchId\":\"' || batch_id || '\",\"equipmentId\":\"' || equipment_id || '\",\"equipmentType\":\"FURNACE\"}'")} END AS equipment_batch_id FROM keyed{suffix}),
evented{suffix} AS MATERIALIZED (SELECT *, coalesce(replay_hour, -1) AS hour_rank, CASE WHEN equipment_type = 'FURNACE' THEN equipment_id::INTEGER ELSE 0 END AS furnace_rank,
 {_sha("event-id/v1", "'{\"batchId\":\"' || batch_id || '\",\"batchStep\":\"' || batch_step || '\",\"equipmentBatchId\":' || coalesce('\"' || equipment_batch_id || '\"', 'null') || ',\"equipmentId\":\"' || equipment_id || '\",\"equipmentType\":\"' || equipment_type || '\",\"materialKey\":\"' || material_key || '\"}'")} AS event_id FROM subbed{suffix})
"""


EVENTS = BASE + ", " + events_sql() + "\n"


def built(spark, d):
    """The events, built where they are read: their digests follow from the replay rows and are many times as long."""
    return E.build_events(bound.replay(spark, d))


def unit_groups(spark, d):
    return stage(spark, d, "unit-groups", lambda: E.unit_groups(built(spark, d)))


def told(spark, d):
    """The stream's files read back, without digests."""
    return E.streamed(f"{root(spark)}/stream-{uuid.uuid4().hex[:12]}", E.told(built(spark, d)))


def streamed(spark, d):
    return E.digested(told(spark, d)).select(*E.ORDER, "place")


@query("i1_i3_replay_events", EVENTS + "SELECT event_id, batch_id, equipment_batch_id, material_key, batch_step, batch_kind, replay_date, replay_hour, equipment_type, equipment_id FROM evented")
def i1(spark, d):
    return built(spark, d).select("event_id", "batch_id", "equipment_batch_id", "material_key", "batch_step", "batch_kind", "replay_date", "replay_hour", "equipment_type", "equipment_id")


FIELDS = ("steel_grade", "steel_usage", "tundish_temp", "f_jangip_gubun", "f_heat_temp", "f_bfg", "f_cog", "f_ldg", "hr_coil_id", "ap_prod_id", "judge")
KNOWN_AT = {f: dict(STAGES)[step] for step, fields in E.PAYLOAD.items() for f in fields}


@query("i2_stage_payload", EVENTS + f"SELECT event_id, {', '.join(f'CASE WHEN stage_rank = {KNOWN_AT[f]} THEN r.{f} END AS {f}' for f in FIELDS)} FROM evented e JOIN replay r ON r.charge_id = e.charge_id AND r.slab_no = e.slab_no")
def i2(spark, d):
    number = {f for f in FIELDS if f.startswith("f_") and f != "f_jangip_gubun"} | {"tundish_temp"}
    schema = ", ".join(f"{f} {'double' if f in number else 'string'}" for f in FIELDS)
    # parsed once for all fields: with an option given, the optimizer does not parse it once for each
    return built(spark, d).select("event_id", F.from_json("values_json", schema, {"mode": "PERMISSIVE"}).alias("v")).select("event_id", *[f"v.{f}" for f in FIELDS])


@query("i4_i6_total_order_units", EVENTS + "SELECT event_id, dense_rank() OVER (ORDER BY replay_date, kind_rank, hour_rank, batch_id, stage_rank) AS unit FROM evented")
def i4(spark, d):
    return E.units(built(spark, d), unit_groups(spark, d)).select("event_id", "unit")


#: Faults put in the built events, by charge number: repeated, moved, misplaced, lost and renamed events.
FAULTS = EVENTS + """, numbered AS (SELECT *, charge_id::BIGINT AS c FROM evented),
faulty AS MATERIALIZED (SELECT * REPLACE (CASE WHEN c % 13 = 0 AND stage_rank = 13 THEN replay_date + 40 ELSE replay_date END AS replay_date, CASE WHEN c % 17 = 0 AND stage_rank = 15 THEN 'AP' ELSE equipment_type END AS equipment_type,
  CASE WHEN c % 23 = 0 AND stage_rank = 0 THEN 'sha256:' || material_key ELSE event_id END AS event_id) FROM numbered WHERE NOT (c % 19 = 0 AND stage_rank = 11) UNION ALL SELECT * FROM numbered WHERE c % 11 = 0 AND stage_rank = 12)
"""


@query("i5_stream_violations", FAULTS + """SELECT min(material_key) AS material_key, event_id, 'DUPLICATE_EVENT_ID' AS problem FROM faulty GROUP BY event_id HAVING count(*) > 1
UNION ALL SELECT material_key, event_id, 'STAGE_OUT_OF_ORDER' FROM (SELECT *, lag(replay_date) OVER (PARTITION BY material_key ORDER BY stage_rank, replay_date) AS previous FROM faulty) WHERE previous > replay_date
UNION ALL SELECT material_key, event_id, 'WRONG_BATCH_ID' FROM faulty WHERE c % 13 = 0 AND stage_rank = 13
UNION ALL SELECT material_key, event_id, unnest(['WRONG_EVENT_ID', 'WRONG_EQUIPMENT']) FROM faulty WHERE c % 17 = 0 AND stage_rank = 15
UNION ALL SELECT material_key, event_id, 'WRONG_EVENT_ID' FROM faulty WHERE c % 23 = 0 AND stage_rank = 0
UNION ALL SELECT material_key, event_id, 'MIXED_BUNDLE' FROM faulty WHERE c % 31 = 0 AND stage_rank = 12 UNION ALL SELECT material_key, event_id, 'MIXED_CRITERIA' FROM faulty WHERE c % 37 = 0 AND stage_rank = 13
UNION ALL SELECT material_key, NULL, 'MISSING_STAGE' FROM faulty WHERE stage_rank < 20 GROUP BY material_key HAVING count(DISTINCT stage_rank) < 7""")
def i5(spark, d):
    rows = built(spark, d).withColumn("c", F.col("charge_id").cast("long"))
    at = lambda k, rank: (F.col("c") % k == 0) & (F.col("stage_rank") == rank)
    faulty = rows.where(~at(19, 11)).withColumns({
        "replay_date": F.when(at(13, 13), F.date_add("replay_date", 40)).otherwise(F.col("replay_date")), "equipment_type": F.when(at(17, 15), "AP").otherwise(F.col("equipment_type")),
        "event_id": F.when(at(23, 0), F.concat(F.lit("sha256:"), "material_key")).otherwise(F.col("event_id")),
    }).unionByName(rows.where(at(11, 12)))
    return E.violations(faulty.withColumns({"bundle_id": F.when(at(31, 12), "other").otherwise("bundle"), "criteria_id": F.when(at(37, 13), "other").otherwise("criteria")}))


@query("i5_a9_strict_order", EVENTS + """, numbered AS (SELECT material_key, event_id, row_number() OVER (ORDER BY replay_date, kind_rank, hour_rank, batch_id, stage_rank, furnace_rank, material_key, event_id) AS place FROM evented),
moved AS (SELECT *, CASE WHEN place % 997 = 0 THEN 2 * place + 21 ELSE 2 * place END AS lies FROM numbered)
SELECT material_key, event_id, 'SORT_INVALID' AS problem FROM (SELECT *, lag(place) OVER (ORDER BY lies) AS previous FROM moved) WHERE previous >= place""")
def i5o(spark, d):
    """The stream's files, in which every 997th event lies ten places late."""
    rows = told(spark, d)
    late = F.when(F.col("place") % 997 == 0, 21).otherwise(0)
    return E.order_violations(rows.withColumns({"__file": F.lit("stream"), "__row": 2 * F.col("place") + late}), "__file", "__row", run=4096)


ALTERED = ", altered AS (SELECT * REPLACE (CASE WHEN charge_id::BIGINT % 29 = 0 THEN '1' ELSE furnace_no END AS furnace_no) FROM replay WHERE charge_id::BIGINT % 23 <> 0), " + events_sql("altered", "2") + "\n"


@query("i12_batch_parity", EVENTS + ALTERED + "SELECT 'first' AS side, event_id, batch_step FROM (SELECT event_id, batch_step FROM evented EXCEPT ALL SELECT event_id, batch_step FROM evented2) UNION ALL SELECT 'second', event_id, batch_step FROM (SELECT event_id, batch_step FROM evented2 EXCEPT ALL SELECT event_id, batch_step FROM evented)")
def i12(spark, d):
    """A second run whose sources lack some charges and name another furnace for others."""
    charge = F.col("charge_id").cast("long")
    altered = bound.replay(spark, d).where(charge % 23 != 0).withColumn("furnace_no", F.when(charge % 29 == 0, "1").otherwise(F.col("furnace_no")))
    return E.parity(E.told(built(spark, d)), E.told(E.build_events(altered)), ["event_id", "batch_step"])


@query("a8_ordered_sink", EVENTS + "SELECT event_id, row_number() OVER (ORDER BY replay_date, kind_rank, hour_rank, batch_id, stage_rank, furnace_rank, material_key, event_id) AS place FROM evented")
def a8(spark, d):
    return streamed(spark, d).select("event_id", "place")


@query("k3_accumulated_values", EVENTS + "SELECT event_id, CASE WHEN stage_rank >= 12 THEN r.f_heat_temp END AS heat_so_far, r.tundish_temp AS cast_so_far FROM evented e JOIN (SELECT charge_id, slab_no, f_heat_temp, tundish_temp FROM replay) r ON r.charge_id = e.charge_id AND r.slab_no = e.slab_no")
def k3(spark, d):
    rows = built(spark, d)
    value = lambda name: F.get_json_object("values_json", f"$.{name}").cast("double")
    rows = rows.withColumns({"heat": value("f_heat_temp"), "cast": value("tundish_temp")})
    return M.accumulated(rows, ("heat", "cast"), ("stage_rank",)).select("event_id", "heat_so_far", "cast_so_far")


@query("k9_monitor_totals", EVENTS + "SELECT count(*) AS events, count(DISTINCT material_key) AS materials, count(DISTINCT batch_id || batch_step) AS units FROM evented")
def k9(spark, d):
    return built(spark, d).agg(F.count("*").alias("events"), F.count_distinct("material_key").alias("materials"), F.count_distinct("batch_id", "batch_step").alias("units"))


@query("k8_equipment_snapshot", EVENTS + """, united AS (SELECT e.*, r.f_heat_temp, r.tundish_temp, dense_rank() OVER (ORDER BY replay_date, kind_rank, hour_rank, batch_id, stage_rank) AS unit FROM evented e JOIN replay r ON r.charge_id = e.charge_id AND r.slab_no = e.slab_no)
SELECT equipment_type, equipment_id, unit, string_agg(material_key || CASE stage_rank WHEN 0 THEN ':' || round(tundish_temp * 100)::BIGINT WHEN 13 THEN '' ELSE '' END, ',' ORDER BY material_key) AS materials FROM (SELECT * FROM united QUALIFY unit = max(unit) OVER (PARTITION BY equipment_type, equipment_id)) GROUP BY equipment_type, equipment_id, unit""")
def k8(spark, d):
    rows = E.units(built(spark, d), unit_groups(spark, d))
    cast = F.round(F.get_json_object("values_json", "$.tundish_temp").cast("double") * 100).cast("long").cast("string")
    rows = rows.withColumn("shown", F.concat("material_key", F.coalesce(F.concat(F.lit(":"), cast), F.lit(""))))
    return M.equipment_snapshot(rows, "shown").withColumn("materials", F.array_join("materials", ","))
