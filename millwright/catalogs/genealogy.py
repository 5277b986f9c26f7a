"""Queries of the key, join, quarantine and lineage operators, and of the source-side scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalogs import Registry, bound
from millwright.config import DEFECT, GOOD
from millwright.functions import predicates as P
from millwright.operators import genealogy as G
from millwright.sources import bindings
from millwright.sources.bindings import BASE

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

DUPES = """SELECT 'sm_cc' AS role, sm_record AS record, 'DUPLICATE_SM_CC_KEY' AS reason, 6 AS k FROM sm1 WHERE same > 1
UNION ALL SELECT 'fur_hr', fur_record, 'DUPLICATE_FUR_HR_KEY', 7 FROM fur1 WHERE same > 1
UNION ALL SELECT 'ap', ap_record, 'DUPLICATE_AP_KEY', 8 FROM ap1 WHERE same > 1"""
UNLINKED = """SELECT 'sm_cc' AS role, sm_record AS record, 'UNLINKED_SM_CC' AS reason, 13 AS k FROM sm1 s WHERE same = 1 AND NOT EXISTS (SELECT 1 FROM fur1 f WHERE f.same = 1 AND f.charge_id = s.charge_id AND f.slab_no = s.slab_no)
UNION ALL SELECT 'fur_hr', fur_record, 'UNLINKED_FUR_HR', 14 FROM fur1 f WHERE same = 1 AND NOT EXISTS (SELECT 1 FROM sm1 s WHERE s.same = 1 AND f.charge_id = s.charge_id AND f.slab_no = s.slab_no)
UNION ALL SELECT 'ap', ap_record, 'UNLINKED_AP', 15 FROM ap1 a WHERE same = 1 AND NOT EXISTS (SELECT 1 FROM fur1 f WHERE f.same = 1 AND f.hr_coil_id = a.hr_coil_id)"""
BAD_ORDER = "linked WHERE NOT (cast_date <= f_ext_date AND f_ext_date <= hr_date AND (ap_date IS NULL OR hr_date <= ap_date))"
ORDER = f"""SELECT 'sm_cc' AS role, sm_record AS record, 'IMPOSSIBLE_STAGE_DATE_ORDER' AS reason, 12 AS k FROM {BAD_ORDER}
UNION ALL SELECT 'fur_hr', fur_record, 'IMPOSSIBLE_STAGE_DATE_ORDER', 12 FROM {BAD_ORDER}
UNION ALL SELECT 'ap', ap_record, 'IMPOSSIBLE_STAGE_DATE_ORDER', 12 FROM {BAD_ORDER} AND ap_record IS NOT NULL"""


@query("c1_composite_key_join", BASE + "SELECT f.charge_id, f.slab_no, f.hr_coil_id, s.steel_grade FROM fur1 f JOIN sm1 s ON f.charge_id = s.charge_id AND f.slab_no = s.slab_no WHERE f.same = 1 AND s.same = 1")
def c1(spark, d):
    return G.chain(*bound.sources(spark, d), by_charge=True).select("charge_id", "slab_no", "hr_coil_id", "steel_grade")


@query("c2_optional_result_join", BASE + "SELECT charge_id, slab_no, ap_record, judge FROM linked")
def c2(spark, d):
    return G.chain(*bound.sources(spark, d), by_charge=True).select("charge_id", "slab_no", "ap_record", "judge")


@query("c3_unlinked_records", BASE + f"SELECT role, record, reason FROM ({UNLINKED})")
def c3(spark, d):
    return G.unlinked(*G.checked(*bound.sources(spark, d)))


@query("c4_quality_subset_violations", BASE + "SELECT charge_id, slab_no, CASE WHEN charge_id::BIGINT % 37 = 0 THEN 'NOT_IN_REPLAY' ELSE 'COIL_DIFFERS' END AS problem FROM replay WHERE ap_record IS NOT NULL AND (charge_id::BIGINT % 37 = 0 OR charge_id::BIGINT % 41 = 0)")
def c4(spark, d):
    """Quality rows of which some charges are lost from the replay population and others carry another coil."""
    rows, charge = bound.replay(spark, d), F.col("charge_id").cast("long")
    quality = rows.where("ap_record is not null").withColumn("hr_coil_id", F.when(charge % 41 == 0, F.concat(F.col("hr_coil_id"), F.lit("x"))).otherwise(F.col("hr_coil_id")))
    return G.quality_subset_violations(quality, rows.where(charge % 37 != 0))


@query("c10_material_catalog", BASE + "SELECT a.ap_record, r.charge_id, r.slab_no FROM ap1 a JOIN replay r ON a.hr_coil_id = r.hr_coil_id WHERE a.same = 1 AND r.hr_coil_id = r.charge_id || '-' || r.slab_no")
def c10(spark, d):
    a = G.mark_ambiguous(bindings.ap(spark, d), ["hr_coil_id"], "twice").where("not twice").select("ap_record", "hr_coil_id")
    pair = bound.replay(spark, d).select("charge_id", "slab_no", "hr_coil_id")
    return a.join(pair, "hr_coil_id").where("hr_coil_id = concat_ws('-', charge_id, slab_no)").select("ap_record", "charge_id", "slab_no")


@query("d1_ambiguous_keys", BASE + f"SELECT role, record, reason FROM ({DUPES})")
def d1(spark, d):
    parts = [rows.where("reason like 'DUPLICATE%'").select(F.lit(role).alias("role"), F.col(rec).alias("record"), "reason")
             for rows, role, rec in zip(G.checked(*bound.sources(spark, d)), ("sm_cc", "fur_hr", "ap"), ("sm_record", "fur_record", "ap_record"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d2_quarantine", BASE + f"SELECT role, record, min_by(reason, k) AS reason FROM ({DUPES} UNION ALL {UNLINKED} UNION ALL {ORDER}) GROUP BY role, record")
def d2(spark, d):
    """Lines are numbered until their faults are known; two lines of one record id are one record."""
    return G.most_severe(bindings.recorded(spark, d, G.quarantine(*bound.sources(spark, d, numbered=True))))


@query("d3_boundary_population", BASE + "SELECT charge_id, slab_no, hr_date FROM boundary")
def d3(spark, d):
    return bound.boundary(spark, d).select("charge_id", "slab_no", "hr_date")


@query("d4_order_violations", BASE + f"SELECT role, record, reason FROM ({ORDER})")
def d4(spark, d):
    return G.order_violations(G.chain(*bound.sources(spark, d), by_charge=True))


@query("i7_material_lineage", BASE + "SELECT charge_id, slab_no, 'sm_cc' AS role, sm_record AS record FROM replay UNION ALL SELECT charge_id, slab_no, 'fur_hr', fur_record FROM replay UNION ALL SELECT charge_id, slab_no, 'ap', ap_record FROM replay WHERE ap_record IS NOT NULL")
def i7(spark, d):
    return bindings.recorded(spark, d, G.lineage(bound.replay(spark, d)))


@query("b1_missing_values", "SELECT count(*) FILTER (WHERE props IS NULL OR trim(props) = '') AS blank_is_missing, count(*) FILTER (WHERE props IS NULL) AS blank_is_present, event_type FROM events GROUP BY event_type")
def b1(spark, d):
    return bindings.table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(P.missing("props")).alias("blank_is_missing"), F.count_if(~P.present_for_rules("props")).alias("blank_is_present")
    )


@query("b2_finite_values", "SELECT l_linestatus, count(*) FILTER (WHERE isfinite(l_extendedprice / (l_discount * 100))) AS finite_rows FROM lineitem WHERE l_discount > 0 GROUP BY l_linestatus")
def b2(spark, d):
    rows = bindings.table(spark, d, "lineitem").where("l_discount > 0").withColumn("x", F.col("l_extendedprice") / (F.col("l_discount") * 100))
    return rows.groupBy("l_linestatus").agg(F.count_if(P.finite("x")).alias("finite_rows"))


@query("b3_fuel_ratios", BASE + "SELECT charge_id, slab_no, round(f_bfg_ratio, 6) AS f_bfg_ratio, round(f_cog_ratio, 6) AS f_cog_ratio, round(f_ldg_ratio, 6) AS f_ldg_ratio FROM replay")
def b3(spark, d):
    return bound.replay(spark, d).select("charge_id", "slab_no", *[F.round(f"{g}_ratio", 6).alias(f"{g}_ratio") for g in ("f_bfg", "f_cog", "f_ldg")])


@query("b4_available_by", BASE + "SELECT furnace_no, count(*) FILTER (WHERE ap_date <= as_of) AS pickled, count(*) FILTER (WHERE f_ext_date <= as_of) AS extracted FROM outer_split GROUP BY furnace_no")
def b4(spark, d):
    return bound.outer(spark, d).groupBy("furnace_no").agg(F.count_if(P.available_by("ap_date", "as_of")).alias("pickled"), F.count_if(P.available_by("f_ext_date", "as_of")).alias("extracted"))


@query("b5_label_status", BASE + "SELECT label_status, count(*) AS n FROM replay GROUP BY label_status")
def b5(spark, d):
    return bound.replay(spark, d).groupBy("label_status").agg(F.count("*").alias("n"))


@query("b13_monotone_dates", BASE + "SELECT charge_id, slab_no, (cast_date <= f_ext_date AND f_ext_date <= hr_date AND (ap_date IS NULL OR hr_date <= ap_date)) AS ordered FROM linked")
def b13(spark, d):
    return G.chain(*bound.sources(spark, d), by_charge=True).select("charge_id", "slab_no", P.monotone("cast_date", "f_ext_date", "hr_date", "ap_date").alias("ordered"))


@query("b8_b10_interval_and_category_clauses", BASE + f"SELECT charge_id, slab_no, coalesce(judge = '{DEFECT}', false) AS defect FROM replay WHERE f_heat_temp > 20 AND f_heat_temp <= 38 AND steel_grade IN ('Brand#1', 'Brand#2', 'Brand#3') AND f_bfg_ratio IS NOT NULL AND f_bfg_ratio >= 0.7")
def b8(spark, d):
    clause = P.in_interval("f_heat_temp", F.lit(20.0), F.lit(False), F.lit(38.0), F.lit(True))
    open_end = P.in_interval("f_bfg_ratio", F.lit(0.7), F.lit(True), F.lit(None).cast("double"), F.lit(False))
    level = P.in_values("steel_grade", F.array(*map(F.lit, ("Brand#1", "Brand#2", "Brand#3"))))
    return bound.replay(spark, d).where(clause & open_end & level).select("charge_id", "slab_no", F.coalesce(F.col("judge") == DEFECT, F.lit(False)).alias("defect"))


@query("judge_totals", BASE + f"SELECT steel_usage, count(*) FILTER (WHERE judge = '{GOOD}') AS good, count(*) FILTER (WHERE judge = '{DEFECT}') AS bad FROM replay GROUP BY steel_usage")
def judge_totals(spark, d):
    return bound.replay(spark, d).groupBy("steel_usage").agg(F.count_if(F.col("judge") == GOOD).alias("good"), F.count_if(F.col("judge") == DEFECT).alias("bad"))
