"""Queries of the quantile, range, profile and drift operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalogs import CONFIG, Registry, bound, rounded
from millwright.config import CONTEXTS, FEATURES
from millwright.functions import predicates as P
from millwright.operators import ranges as R
from millwright.sources.bindings import BASE
from millwright.work import stage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def long_sql(source: str, as_of: str | None = "as_of", more: str = "") -> str:
    parts = []
    for f in FEATURES:
        known = f" AND {f.date} <= {as_of}" if as_of else ""
        parts.append(f"SELECT charge_id, slab_no, steel_grade, steel_usage, '{f.name}' AS field, '{f.stage}' AS stage, '{f.equipment_type}' AS equipment_type, {f.equipment} AS equipment_id, {f.name} AS value{more} FROM {source} WHERE {f.name} IS NOT NULL AND isfinite({f.name}){known}")
    return " UNION ALL ".join(parts)


@query("f1_type1_quantiles", BASE + "SELECT steel_grade, quantile_disc(f_heat_temp, 0.05) AS q0, quantile_disc(f_heat_temp, 0.5) AS q1, quantile_disc(f_heat_temp, 0.95) AS q2 FROM replay GROUP BY steel_grade")
def f1(spark, d):
    return R.type1_quantiles(bound.replay(spark, d), ["steel_grade"], "f_heat_temp", {"q0": 0.05, "q1": 0.5, "q2": 0.95})


BANDS = "SELECT '{f}' AS field, quantile_disc({f}, 0.25) AS q1, quantile_disc({f}, 0.5) AS q2, quantile_disc({f}, 0.75) AS q3 FROM {t}"


@query("f2_reference_band_boundaries", BASE + " UNION ALL ".join(BANDS.format(f=f, t="labelled WHERE split = 'reference' AND f_ext_date <= as_of") for f in ("f_heat_temp", "f_bfg_ratio")))
def f2(spark, d):
    return R.band_boundaries(bound.reference(spark, d).where(P.available_by("f_ext_date", "as_of")), ("f_heat_temp", "f_bfg_ratio"))


@query("f3_discovery_band_boundaries", BASE + " UNION ALL ".join(BANDS.format(f=f, t="inner_split WHERE split = 'discovery'") for f in ("tundish_temp", "f_heat_temp")))
def f3(spark, d):
    return R.band_boundaries(bound.inner(spark, d).where("split = 'discovery'"), ("tundish_temp", "f_heat_temp"))


@query("b11_quartile_bands", BASE + ", q AS (SELECT quantile_disc(f_heat_temp, 0.25) AS q1, quantile_disc(f_heat_temp, 0.5) AS q2, quantile_disc(f_heat_temp, 0.75) AS q3 FROM replay) SELECT CASE WHEN f_heat_temp <= q1 THEN 'Q1' WHEN f_heat_temp <= q2 THEN 'Q2' WHEN f_heat_temp <= q3 THEN 'Q3' WHEN f_heat_temp IS NOT NULL THEN 'Q4' END AS f_heat_temp_band, count(*) AS n FROM replay, q GROUP BY 1")
def b11(spark, d):
    return R.banded(bound.replay(spark, d), ("f_heat_temp",)).groupBy("f_heat_temp_band").agg(F.count("*").alias("n"))


@query("b12_context_values", BASE + "SELECT split, CASE WHEN f_ext_date <= as_of THEN furnace_no END AS furnace, CASE WHEN ap_date <= as_of THEN judge END AS result, count(*) AS n FROM labelled GROUP BY 1, 2, 3")
def b12(spark, d):
    known = lambda c, date: F.when(P.available_by(date, "as_of"), F.col(c))
    return bound.outer(spark, d).groupBy("split", known("furnace_no", "f_ext_date").alias("furnace"), known("judge", "ap_date").alias("result")).agg(F.count("*").alias("n"))


def bins_sql(source: str, field: str, bins: int) -> str:
    return f"""cuts_{bins} AS (SELECT DISTINCT unnest(quantile_disc({field}, [{", ".join(str(k / bins) for k in range(1, bins + 1))}])) AS upper FROM {source}),
bins_{bins} AS (SELECT '{field}' AS field, (row_number() OVER (ORDER BY upper) - 1)::INTEGER AS bin, coalesce(lag(upper) OVER (ORDER BY upper), (SELECT min({field}) FROM {source})) AS lower, upper, lag(upper) OVER (ORDER BY upper) IS NULL AS lower_inclusive FROM cuts_{bins})"""


@query("f4_equal_frequency_bins", BASE + ", disc AS (SELECT * FROM inner_split WHERE split = 'discovery'), " + bins_sql("disc", "f_heat_temp", 10) + " SELECT * FROM bins_10")
def f4(spark, d):
    return R.equal_frequency_bins(bound.inner(spark, d).where("split = 'discovery'"), "f_heat_temp", 10)


@query("c9_interval_join", BASE + ", disc AS (SELECT * FROM inner_split WHERE split = 'discovery'), " + bins_sql("disc", "f_heat_temp", 10) + " SELECT bin, count(*) AS n FROM inner_split JOIN bins_10 ON (f_heat_temp > lower OR (lower_inclusive AND f_heat_temp = lower)) AND f_heat_temp <= upper GROUP BY bin")
def c9(spark, d):
    rows = bound.inner(spark, d)
    bins = R.equal_frequency_bins(rows.where("split = 'discovery'"), "f_heat_temp", 10)
    inside = P.in_interval("f_heat_temp", "lower", F.col("lower_inclusive"), "upper", F.lit(True))
    return rows.join(F.broadcast(bins), inside).groupBy("bin").agg(F.count("*").alias("n"))


def ranges_sql() -> str:
    """Ranges by plain SQL: level groups, nomination by the row's first supported level, quantiles over all of a nominated group's rows."""
    s, t = CONFIG.range_support, CONFIG.tail_support
    level = lambda i, a, b: f"SELECT {i} AS level, field, stage, equipment_type, equipment_id, {a} AS c_steel_grade, {b} AS c_steel_usage, count(*) AS support, {', '.join(f'quantile_disc(value, {q}) AS {n}' for n, q in (('p01', 0.01), ('p05', 0.05), ('median', 0.5), ('p95', 0.95), ('p99', 0.99)))} FROM longed GROUP BY ALL HAVING count(*) >= {s}"
    on = lambda n, more: f"LEFT JOIN groups {n} ON {n}.level = {n[1]} AND {n}.field = l.field AND {n}.equipment_id = l.equipment_id{more}"
    return BASE + f""", ref AS (SELECT * FROM labelled WHERE split = 'reference'), longed AS MATERIALIZED ({long_sql('ref')}),
groups AS MATERIALIZED ({level(0, 'steel_grade', 'steel_usage')} UNION ALL {level(1, 'steel_grade', 'NULL')} UNION ALL {level(2, 'NULL', 'NULL')}),
nominated AS (SELECT DISTINCT coalesce(g0.level, g1.level, g2.level) AS level, l.field, l.equipment_id, CASE WHEN coalesce(g0.level, g1.level, g2.level) < 2 THEN l.steel_grade END AS c_steel_grade, CASE WHEN coalesce(g0.level, g1.level, g2.level) < 1 THEN l.steel_usage END AS c_steel_usage
  FROM longed l {on('g0', ' AND g0.c_steel_grade = l.steel_grade AND g0.c_steel_usage = l.steel_usage')} {on('g1', ' AND g1.c_steel_grade = l.steel_grade')} {on('g2', '')}),
ranged AS MATERIALIZED (SELECT g.field || '|' || g.equipment_type || '|' || g.equipment_id || '|' || g.level || '|' || coalesce(g.c_steel_grade, '*') || '|' || coalesce(g.c_steel_usage, '*') AS rule_id, g.field, g.stage, g.equipment_type, g.equipment_id, g.level::INTEGER AS context_level, g.c_steel_grade, g.c_steel_usage, support,
  CASE WHEN support >= {t} THEN p01 END AS p01, p05, median, p95, CASE WHEN support >= {t} THEN p99 END AS p99, coalesce(CASE WHEN support >= {t} THEN p01 END <> p05, false) AS lower_tail, coalesce(CASE WHEN support >= {t} THEN p99 END <> p95, false) AS upper_tail
  FROM groups g SEMI JOIN nominated n ON g.level = n.level AND g.field = n.field AND g.equipment_id = n.equipment_id AND g.c_steel_grade IS NOT DISTINCT FROM n.c_steel_grade AND g.c_steel_usage IS NOT DISTINCT FROM n.c_steel_usage)
"""


RANGES = ranges_sql()


def ranges_df(spark, d):
    return stage(spark, d, "ranges", lambda: R.operating_ranges(bound.reference(spark, d), CONFIG))


@query("f5_operating_ranges", RANGES + "SELECT * FROM ranged")
def f5(spark, d):
    return ranges_df(spark, d).drop("context")


IN_RANGE = "l.field = r.field AND l.equipment_id = r.equipment_id AND (r.c_steel_grade IS NULL OR r.c_steel_grade = l.steel_grade) AND (r.c_steel_usage IS NULL OR r.c_steel_usage = l.steel_usage)"


@query("f6_range_contributors", RANGES + f"SELECT r.rule_id, count(*) AS materials, min(l.charge_id) AS first_charge FROM longed l JOIN ranged r ON {IN_RANGE} GROUP BY r.rule_id")
def f6(spark, d):
    rows = bound.reference(spark, d)
    return R.range_contributors(rows, ranges_df(spark, d)).groupBy("rule_id").agg(F.count("*").alias("materials"), F.min("charge_id").alias("first_charge"))


SELECT_RANGE = f""", hold AS (SELECT * FROM labelled WHERE split = 'holdout'), monitored AS MATERIALIZED ({long_sql('hold', None)}),
best AS (SELECT l.charge_id || '-' || l.slab_no AS event_key, l.field, l.equipment_id, any_value(l.value) AS value, arg_min(struct_pack(rule_id, context_level, p01, p05, p95, p99, lower_tail, upper_tail), context_level || '/' || rule_id) AS r
  FROM monitored l LEFT JOIN ranged r ON {IN_RANGE} GROUP BY ALL)
SELECT event_key, field, equipment_id, value, r.rule_id AS rule_id, CASE WHEN r.rule_id IS NULL THEN 'NO_RANGE' WHEN r.context_level = 0 THEN 'SELECTED' ELSE 'FALLBACK' END AS reason,
 CASE WHEN r.rule_id IS NULL THEN 'INSUFFICIENT' WHEN value < r.p05 THEN CASE WHEN NOT r.lower_tail AND r.p01 IS NOT NULL THEN 'TYPICAL' WHEN r.p01 IS NOT NULL AND value < r.p01 THEN 'SEVERE' ELSE 'CAUTION' END
  WHEN value > r.p95 THEN CASE WHEN NOT r.upper_tail AND r.p99 IS NOT NULL THEN 'TYPICAL' WHEN r.p99 IS NOT NULL AND value > r.p99 THEN 'SEVERE' ELSE 'CAUTION' END ELSE 'TYPICAL' END AS range_status
FROM best"""


def monitored(spark, d):
    rows = bound.outer(spark, d).where("split = 'holdout'")
    return R.long_form(rows, as_of=None).withColumn("event_key", F.concat_ws("-", "charge_id", "slab_no"))


@query("c7_most_specific_range", RANGES + SELECT_RANGE)
def c7(spark, d):
    return R.select_range(monitored(spark, d), ranges_df(spark, d))


#: Ranges and values in which every reason occurs: fine contexts of two fields get a band, one field has no other, another no coarse context; one is a reference field, one furnace
#: has no ranges of a field, one field none at all. Some charges lack values, bands or have text for a number.
BANDED = """, varied AS MATERIALIZED (SELECT rule_id, field, CASE WHEN field = 'f_cog_ratio' THEN 'PRODUCT_STATE_REFERENCE' ELSE 'DIRECT_OPERATION' END AS role, stage, equipment_type, equipment_id, c_steel_grade, c_steel_usage,
  CASE WHEN field IN ('tundish_temp', 'f_heat_temp') AND context_level < 2 THEN 'Q2' END AS c_band, context_level, p01, p05, p95, p99, lower_tail, upper_tail
  FROM ranged WHERE NOT (field = 'tundish_temp' AND context_level = 2) AND NOT (field = 'f_bfg_ratio' AND context_level = 2) AND NOT (field = 'f_cog_ratio' AND equipment_id = '4')),
hold AS (SELECT * FROM labelled WHERE split = 'holdout'), roles AS (SELECT * FROM (VALUES {roles}) AS r(field, stage, equipment_type)),
told AS MATERIALIZED (SELECT h.charge_id || '-' || h.slab_no AS event_key, r.field, r.stage, r.equipment_type, CASE r.equipment_type WHEN 'SM_CC' THEN h.steel_grade ELSE h.furnace_no END AS equipment_id, h.steel_grade, h.steel_usage,
  CASE WHEN charge_id::BIGINT % 3 = 0 THEN 'Q2' WHEN charge_id::BIGINT % 3 = 1 THEN 'Q1' END AS band,
  CASE WHEN charge_id::BIGINT % 7 = 0 THEN NULL WHEN charge_id::BIGINT % 11 = 0 AND r.field IN ('f_heat_temp', 'f_cog_ratio') THEN 'n/a' ELSE CASE r.field {values} END::VARCHAR END AS value FROM hold h CROSS JOIN roles r),
fits AS (SELECT t.event_key, t.field, count(v.rule_id) AS owned, bool_and(v.c_band IS NOT NULL AND t.band IS NULL) AS unsealed,
  arg_min(v, v.context_level || '/' || v.rule_id) FILTER (WHERE (v.c_steel_grade IS NULL OR v.c_steel_grade = t.steel_grade) AND (v.c_steel_usage IS NULL OR v.c_steel_usage = t.steel_usage) AND (v.c_band IS NULL OR coalesce(v.c_band = t.band, false))) AS r,
  min(v.context_level) FILTER (WHERE v.c_band IS NOT NULL AND t.band IS NULL AND (v.c_steel_grade IS NULL OR v.c_steel_grade = t.steel_grade) AND (v.c_steel_usage IS NULL OR v.c_steel_usage = t.steel_usage)) AS finer
  FROM told t JOIN varied v ON v.field = t.field AND v.equipment_id = t.equipment_id GROUP BY ALL),
reasoned AS (SELECT t.*, f.r, CASE WHEN NOT EXISTS (SELECT 1 FROM varied v WHERE v.field = t.field) THEN 'NO_BASELINE' WHEN f.owned IS NULL THEN 'UNREGISTERED_EQUIPMENT' WHEN t.value IS NULL THEN 'DATA_MISSING'
  WHEN f.r IS NULL THEN CASE WHEN unsealed THEN 'BAND_BOUNDARY_NOT_SEALED' ELSE 'UNREGISTERED_CONTEXT' END WHEN f.r.role <> 'PRODUCT_STATE_REFERENCE' AND t.value = 'n/a' THEN 'DATA_MISSING'
  WHEN coalesce(finer < f.r.context_level, false) THEN 'BAND_BOUNDARY_NOT_SEALED_FALLBACK' ELSE 'EXACT_CONTEXT' END AS reason, try_cast(t.value AS DOUBLE) AS x FROM told t LEFT JOIN fits f ON f.event_key = t.event_key AND f.field = t.field)
SELECT event_key, stage, equipment_type, equipment_id, field, CASE WHEN value IS NOT NULL THEN r.rule_id END AS rule_id, reason, CASE WHEN reason IN ('NO_BASELINE', 'BAND_BOUNDARY_NOT_SEALED') THEN 'INSUFFICIENT_EVIDENCE' WHEN reason LIKE 'UNREGISTERED%' THEN 'UNREGISTERED_CONDITION' WHEN reason = 'DATA_MISSING' THEN 'DATA_MISSING'
 WHEN r.role = 'PRODUCT_STATE_REFERENCE' THEN 'REFERENCE_ONLY' WHEN x < r.p05 THEN CASE WHEN NOT r.lower_tail AND r.p01 IS NOT NULL THEN 'TYPICAL' WHEN r.p01 IS NOT NULL AND x < r.p01 THEN 'SEVERE' ELSE 'CAUTION' END
  WHEN x > r.p95 THEN CASE WHEN NOT r.upper_tail AND r.p99 IS NOT NULL THEN 'TYPICAL' WHEN r.p99 IS NOT NULL AND x > r.p99 THEN 'SEVERE' ELSE 'CAUTION' END ELSE 'TYPICAL' END AS range_status FROM reasoned""".format(
    roles=", ".join([*[f"('{f.name}', '{f.stage}', '{f.equipment_type}')" for f in FEATURES], "('f_heat_interval', 'HEAT_COMPLETE', 'FURNACE')"]),
    values=" ".join(f"WHEN '{f.name}' THEN {f.name}" for f in FEATURES) + " ELSE 1.0",
)


@query("c7_range_reasons", RANGES + BANDED)
def c7r(spark, d):
    """All reasons of the look-up, over the holdout's events and a varied range table."""
    band = F.when(F.col("field").isin("tundish_temp", "f_heat_temp") & (F.col("context_level") < 2), F.map_concat("context", F.create_map(F.lit("f_heat_temp_band"), F.lit("Q2")))).otherwise(F.col("context"))
    ranges = ranges_df(spark, d).where("not (field = 'tundish_temp' and context_level = 2) and not (field = 'f_bfg_ratio' and context_level = 2) and not (field = 'f_cog_ratio' and equipment_id = '4')")
    ranges = ranges.withColumns({"context": band, "role": F.when(F.col("field") == "f_cog_ratio", "PRODUCT_STATE_REFERENCE").otherwise("DIRECT_OPERATION")})
    monitored_ = spark.createDataFrame([*[(f.name, f.stage, f.equipment_type) for f in FEATURES], ("f_heat_interval", "HEAT_COMPLETE", "FURNACE")], "field string, stage string, equipment_type string")
    c = F.col("charge_id").cast("long")
    text = {f.name: F.when(F.lit(f.name in ("f_heat_temp", "f_cog_ratio")) & (c % 11 == 0), "n/a").otherwise(F.col(f.name).cast("string")) for f in FEATURES} | {"f_heat_interval": F.lit("1.0")}
    values = F.create_map(*[x for k, v in text.items() for x in (F.lit(k), F.when(c % 7 != 0, v))], *[x for k in ("steel_grade", "steel_usage") for x in (F.lit(k), F.col(k))],
                          F.lit("f_heat_temp_band"), F.when(c % 3 == 0, "Q2").when(c % 3 == 1, "Q1"))
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("equipment_type"), F.col(e).alias("equipment_id")) for s, k, e in sorted({(f.stage, f.equipment_type, f.equipment) for f in FEATURES})]))
    events = bound.outer(spark, d).where("split = 'holdout'").select(F.concat_ws("-", "charge_id", "slab_no").alias("event_key"), values.alias("values"), stages.alias("x")).select("event_key", "values", "x.*")
    return R.evaluate_ranges(events, ranges, monitored_).drop("value")


@query("b16_range_tail_status", RANGES + f"SELECT field, range_status, count(*) AS n FROM ({SELECT_RANGE.replace(', hold AS (', 'WITH hold AS (', 1)}) GROUP BY field, range_status")
def b16(spark, d):
    return R.select_range(monitored(spark, d), ranges_df(spark, d)).groupBy("field", "range_status").agg(F.count("*").alias("n"))


@query("c8_monitored_fields", BASE + "SELECT r.charge_id, r.slab_no, c.field FROM replay r, (VALUES " + ", ".join(f"('{f.name}')" for f in FEATURES) + ") AS c(field)")
def c8(spark, d):
    catalog = spark.createDataFrame([(f.name,) for f in FEATURES], "field string")
    return bound.replay(spark, d).select("charge_id", "slab_no").crossJoin(F.broadcast(catalog))


PROFILE = "SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS \"distinct\", {q} FROM replay"
QUANTS = ", ".join(f"quantile_disc({{c}}, {q}) AS {n}" for n, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95)))
NULLS = "NULL::DOUBLE AS p05, NULL::DOUBLE AS median, NULL::DOUBLE AS p95"


@query("f7_column_profile", BASE + " UNION ALL ".join([PROFILE.format(c=c, q=QUANTS.format(c=c)) for c in ("tundish_temp", "f_heat_temp", "f_bfg_ratio")] + [PROFILE.format(c=c, q=NULLS) for c in ("steel_grade", "judge")]))
def f7(spark, d):
    return R.column_profile(bound.replay(spark, d), ("tundish_temp", "f_heat_temp", "f_bfg_ratio"), ("steel_grade", "judge"))


@query("f7_category_levels", BASE + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS n FROM replay WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("steel_grade", "steel_usage", "judge")))
def f7l(spark, d):
    return R.category_levels(bound.replay(spark, d), ("steel_grade", "steel_usage", "judge"))


DRIFT = " UNION ALL ".join(
    f"SELECT '{f.name}' AS field, split, count(*) AS rows, round(1 - count(x)::DOUBLE / count(*), 6) AS missing_rate, quantile_disc(x, 0.05) AS p05, quantile_disc(x, 0.5) AS median, quantile_disc(x, 0.95) AS p95 FROM (SELECT split, CASE WHEN split <> 'reference' OR {f.date} <= as_of THEN {f.name} END AS x FROM labelled) GROUP BY split"
    for f in FEATURES
)


@query("f8_drift", BASE + DRIFT)
def f8(spark, d):
    return rounded(R.drift(bound.outer(spark, d)), "missing_rate")


assert CONTEXTS[0] == ("steel_grade", "steel_usage")
