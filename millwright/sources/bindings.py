"""Views that bind the plant roles and sensor events to the star-schema tables, as DataFrames and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.config import DEFECT, GOOD
from millwright.work import broadcast_if_small, dealt_stage, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a bucket on average, at most: what one task sorts.
BUCKET = 500_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's day and part, joined once and dealt by charge (their order), and ``row``, a number of their own."""
    return dealt_stage(spark, sf_dir, "lines", lambda: _joined(spark, sf_dir), "charge_id")


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The lines and the number of their parts. A part's brand and type go with its lines as a number of the few such pairs."""
    lines = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // BUCKET))
    types = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    kinds = broadcast_if_small(written(types.select("p_brand", "p_type").distinct().withColumn("__kind", F.monotonically_increasing_id()), "kinds"))
    same = types.p_brand.eqNullSafe(kinds.p_brand) & types.p_type.eqNullSafe(kinds.p_type)
    types = broadcast_if_small(types.join(kinds, same).select(types.p_partkey, "__kind"), 2_000_000)  # two numbers a part
    lines = lines.join(types, F.col("p_partkey") == F.col("l_partkey")).drop("p_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    mine, theirs = F.col("l_orderkey").cast("string"), F.col("o_orderkey").cast("string")  # dealt as the text that the buckets go by
    rows = lines.repartition(parts, mine).join(orders.repartition(parts, theirs).hint("merge"), mine == theirs).join(kinds, "__kind")
    rows = rows.withColumns({"charge_id": mine, "slab_no": F.col("l_linenumber").cast("string")}).drop("l_orderkey", "l_linenumber", "o_orderkey")
    return rows.drop("__kind").withColumn("row", F.monotonically_increasing_id()), parts


def _record() -> Column:
    """A line's record id. It is as long as all else that a source row carries, so it is made where it is shown, from the line."""
    number = lambda c: F.round(F.col(c) * 100).cast("long")
    return F.concat_ws("-", "charge_id", "slab_no", "l_partkey", "l_suppkey", number("l_extendedprice"), number("l_quantity"), "l_shipdate")


def recorded(spark: SparkSession, sf_dir: str, rows: DataFrame, number: str = "record") -> DataFrame:
    """``rows`` whose column ``number`` has the numbers of lines, with the lines' record ids in their place."""
    ids = _lines(spark, sf_dir).select(F.col("row").alias(number), _record().alias("__id"))
    return rows.join(ids, number).withColumn(number, F.col("__id")).select(*rows.columns)


def _coil() -> Column:
    return F.concat_ws("-", "charge_id", "slab_no")


def sm_cc(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Casting rows; with ``numbered`` the records of this and the other sources are the numbers of lines (see :func:`recorded`)."""
    late = F.when(F.col("l_suppkey") % 50 == 0, 20).otherwise(0)
    return _lines(spark, sf_dir).where("l_tax <= 0.06").select(
        (F.col("row") if numbered else _record()).alias("sm_record"), "charge_id", "slab_no", F.date_add("d", late).alias("cast_date"), F.col("p_brand").alias("steel_grade"),
        F.col("p_type").alias("steel_usage"), F.col("l_extendedprice").alias("tundish_temp"),
    )


def fur_hr(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    day = F.expr("date_add(d, cast(slab_no as int))")
    return _lines(spark, sf_dir).where("l_discount <= 0.08").select(
        (F.col("row") if numbered else _record()).alias("fur_record"), "charge_id", "slab_no", (1 + F.col("l_suppkey") % 4).cast("string").alias("furnace_no"),
        F.col("l_linestatus").alias("f_jangip_gubun"), _coil().alias("hr_coil_id"), day.alias("hr_date"), day.alias("f_ext_date"),
        (F.col("l_partkey") % 24).cast("int").alias("f_ext_time"), F.col("l_quantity").alias("f_heat_temp"), F.col("l_quantity").alias("f_bfg"),
        F.round(F.col("l_tax") * 100).alias("f_cog"), F.round(F.col("l_discount") * 100).alias("f_ldg"),
    )


def ap(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    judge = (
        F.when(F.expr("l_returnflag = 'N' and l_partkey % 10 = 0"), F.lit(None))
        .when(F.expr("l_returnflag = 'R' and (l_quantity > 38 or l_partkey % 20 = 0)"), DEFECT).otherwise(GOOD)
    )
    return _lines(spark, sf_dir).where("l_quantity <= 45").select(
        (F.col("row") if numbered else _record()).alias("ap_record"), judge.alias("judge"), _coil().alias("hr_coil_id"), _coil().alias("ap_prod_id"),
        F.expr("date_add(d, cast(slab_no as int) + cast(l_quantity as int))").alias("ap_date"),
    )


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("case event_type when 'error' then 'FAILURE' when 'purchase' then 'WARNING' when 'view' then 'IDLE' else 'RUNNING' end")
    kinds = F.array(*map(F.lit, ("CASTER", "FURNACE", "MILL", "PICKLER", "CRANE")))
    zero = F.lit(0.0)
    cycle = lambda n: (F.col("event_id") % n).cast("double")
    return table(spark, sf_dir, "events").select(
        F.regexp_replace(F.md5(F.col("event_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-").alias("event_id"), F.col("event_id").cast("long").alias("arrival"), F.col("user_id").cast("string").alias("equipment_id"),
        F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("equipment_type"), status.alias("status"), F.col("value").alias("temperature"),
        (cycle(90) / 10).alias("vibration"), zero.alias("rpm"), zero.alias("power"), cycle(83).alias("current_value"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("occurred_at"),
        F.concat(F.lit("run-"), (F.col("event_id") % 3).cast("string")).alias("run_id"),
    )


#: The same views as common table expressions, for oracles.
BASE = f"""
WITH li AS MATERIALIZED (
  SELECT l.*, o.o_orderdate::DATE AS d, p.p_brand, p.p_type, l_orderkey || '-' || l_linenumber AS coil,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT || '-' || round(l_quantity * 100)::BIGINT || '-' || l_shipdate::DATE AS record
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
sm_cc AS MATERIALIZED (
  SELECT record AS sm_record, l_orderkey::VARCHAR AS charge_id, l_linenumber::VARCHAR AS slab_no, (d + CASE WHEN l_suppkey % 50 = 0 THEN 20 ELSE 0 END)::DATE AS cast_date,
    p_brand AS steel_grade, p_type AS steel_usage, l_extendedprice AS tundish_temp FROM li WHERE l_tax <= 0.06),
fur_hr AS MATERIALIZED (
  SELECT record AS fur_record, l_orderkey::VARCHAR AS charge_id, l_linenumber::VARCHAR AS slab_no, (1 + l_suppkey % 4)::VARCHAR AS furnace_no, l_linestatus AS f_jangip_gubun,
    coil AS hr_coil_id, (d + l_linenumber)::DATE AS hr_date, (d + l_linenumber)::DATE AS f_ext_date, (l_partkey % 24)::INTEGER AS f_ext_time, l_quantity AS f_heat_temp,
    l_quantity AS f_bfg, round(l_tax * 100) AS f_cog, round(l_discount * 100) AS f_ldg FROM li WHERE l_discount <= 0.08),
ap AS MATERIALIZED (
  SELECT record AS ap_record, CASE WHEN l_returnflag = 'N' AND l_partkey % 10 = 0 THEN NULL WHEN l_returnflag = 'R' AND (l_quantity > 38 OR l_partkey % 20 = 0) THEN '{DEFECT}' ELSE '{GOOD}' END AS judge,
    coil AS hr_coil_id, coil AS ap_prod_id, (d + l_linenumber + l_quantity::INTEGER)::DATE AS ap_date FROM li WHERE l_quantity <= 45),
sm1 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY charge_id, slab_no) AS same FROM sm_cc),
fur1 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY charge_id, slab_no) AS same FROM fur_hr),
ap1 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY hr_coil_id) AS same FROM ap),
linked AS MATERIALIZED (
  SELECT f.* EXCLUDE (same), s.* EXCLUDE (same, charge_id, slab_no), a.ap_record, a.judge, a.ap_prod_id, a.ap_date FROM (SELECT * FROM fur1 WHERE same = 1) f
  JOIN (SELECT * FROM sm1 WHERE same = 1) s ON f.charge_id = s.charge_id AND f.slab_no = s.slab_no LEFT JOIN (SELECT * FROM ap1 WHERE same = 1) a ON a.hr_coil_id = f.hr_coil_id),
replay AS MATERIALIZED (
  SELECT *, CASE WHEN f_bfg + f_cog + f_ldg <> 0 THEN f_bfg / (f_bfg + f_cog + f_ldg) END AS f_bfg_ratio, CASE WHEN f_bfg + f_cog + f_ldg <> 0 THEN f_cog / (f_bfg + f_cog + f_ldg) END AS f_cog_ratio,
    CASE WHEN f_bfg + f_cog + f_ldg <> 0 THEN f_ldg / (f_bfg + f_cog + f_ldg) END AS f_ldg_ratio,
    CASE WHEN ap_record IS NULL THEN 'AP_UNLINKED' WHEN judge IS NULL THEN 'LABEL_MISSING' ELSE 'AVAILABLE' END AS label_status
  FROM linked WHERE cast_date <= f_ext_date AND f_ext_date <= hr_date AND (ap_date IS NULL OR hr_date <= ap_date)),
boundary AS MATERIALIZED (SELECT * FROM fur1 WHERE same = 1 AND hr_date IS NOT NULL),
cut AS MATERIALIZED (SELECT hr_date AS as_of FROM (SELECT hr_date, row_number() OVER (ORDER BY hr_date) AS i, count(*) OVER () AS n FROM boundary) WHERE i = ceil(0.7 * n)),
purged AS MATERIALIZED (SELECT charge_id FROM boundary, cut GROUP BY charge_id, as_of HAVING min(hr_date) <= as_of AND max(hr_date) > as_of),
outer_split AS MATERIALIZED (
  SELECT r.*, as_of, CASE WHEN hr_date <= as_of THEN 'reference' ELSE 'holdout' END AS split FROM replay r ANTI JOIN purged ON r.charge_id = purged.charge_id CROSS JOIN cut),
labelled AS MATERIALIZED (
  SELECT *, CASE WHEN ap_record IS NULL THEN 'AP_UNLINKED' WHEN split = 'reference' AND (hr_date > as_of - 38 OR ap_date > as_of) THEN 'NOT_YET' WHEN judge IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS known FROM outer_split),
mature AS MATERIALIZED (SELECT * FROM labelled WHERE split = 'reference' AND known = 'AVAILABLE'),
cut2 AS MATERIALIZED (SELECT hr_date AS cutoff FROM (SELECT hr_date, row_number() OVER (ORDER BY hr_date) AS i, count(*) OVER () AS n FROM mature) WHERE i = ceil(0.7 * n)),
purged2 AS MATERIALIZED (SELECT charge_id FROM mature, cut2 GROUP BY charge_id, cutoff HAVING min(hr_date) <= cutoff AND max(hr_date) > cutoff),
inner_split AS MATERIALIZED (SELECT m.* EXCLUDE (split), CASE WHEN hr_date <= cutoff THEN 'discovery' ELSE 'confirmation' END AS split FROM mature m ANTI JOIN purged2 ON m.charge_id = purged2.charge_id CROSS JOIN cut2),
sensor AS MATERIALIZED (
  SELECT regexp_replace(md5(event_id::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') AS event_id, event_id::BIGINT AS arrival, user_id::VARCHAR AS equipment_id, ['CASTER','FURNACE','MILL','PICKLER','CRANE'][(user_id % 5 + 1)::INTEGER] AS equipment_type,
    CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'purchase' THEN 'WARNING' WHEN 'view' THEN 'IDLE' ELSE 'RUNNING' END AS status, value AS temperature, (event_id % 90)::DOUBLE / 10 AS vibration, (event_id % 83)::DOUBLE AS current_value, CASE WHEN event_id % 97 <> 0 THEN ts ELSE TIMESTAMP '2024-02-29' END AS occurred_at, 'run-' || (event_id % 3) AS run_id FROM events),
sensed AS MATERIALIZED (SELECT *, CASE WHEN status = 'FAILURE' OR temperature >= 90 OR vibration >= 8 OR current_value >= 80 THEN 'CRITICAL' WHEN status = 'WARNING' OR temperature >= 75 OR vibration >= 5 OR current_value >= 60 THEN 'WARNING' ELSE 'NORMAL' END AS severity FROM sensor)
"""
