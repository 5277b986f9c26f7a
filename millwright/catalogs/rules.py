"""Queries of the quality-risk rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalogs import CONFIG, Registry, bound, r6, rounded
from millwright.catalogs.ranges import IN_RANGE, RANGES, ranges_df
from millwright.config import ADJUSTMENTS, CATEGORIES, DEFECT, FEATURES, INTERACTIONS
from millwright.functions.statistics import erfc, erfc_sql, hashed_draw, wilson
from millwright.operators import ranges as G
from millwright.operators import rules as R
from millwright.sources import bindings
from millwright.sources.bindings import BASE
from millwright.work import broadcast_if_small, stage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
C = CONFIG


def _bins(source: str, fields, bins: int, name: str) -> str:
    one = lambda f: f"SELECT '{f}' AS field, unnest(list_distinct(quantile_disc({f}, [{', '.join(str(k / bins) for k in range(1, bins + 1))}]))) AS upper, min({f}) AS least FROM {source}"
    return f"""{name}_cuts AS ({" UNION ALL ".join(one(f) for f in fields)}),
{name} AS MATERIALIZED (SELECT field, (row_number() OVER w - 1)::INTEGER AS bin, coalesce(lag(upper) OVER w, least) AS lower, upper, lag(upper) OVER w IS NULL AS lower_inclusive FROM {name}_cuts WINDOW w AS (PARTITION BY field ORDER BY upper))"""


COARSE = tuple(sorted({f for pair in INTERACTIONS for f in pair}))
INSIDE = "(v > lower OR (lower_inclusive AND v = lower)) AND v <= upper"


def _members(source: str) -> str:
    keep = "charge_id, slab_no, judge, steel_grade, furnace_no"
    values = lambda fields: " UNION ALL ".join(f"SELECT {keep}, '{f}' AS field, {f} AS v FROM {source} WHERE {f} IS NOT NULL" for f in fields)
    pairs = " UNION ALL ".join(
        f"SELECT a.charge_id, a.slab_no, a.judge, a.steel_grade, a.furnace_no, 'INTERACTION' AS family, '{x}|{y}' AS field, a.bin || '|' || b.bin AS bin FROM {source}_wide a JOIN {source}_wide b ON a.charge_id = b.charge_id AND a.slab_no = b.slab_no AND a.field = '{x}' AND b.field = '{y}'"
        for x, y in INTERACTIONS
    )
    return f"""{source}_wide AS MATERIALIZED (SELECT {keep}, field, bin FROM ({values(COARSE)}) JOIN coarse USING (field) WHERE {INSIDE}),
{source}_members AS MATERIALIZED (SELECT {keep}, 'NUMERIC' AS family, field, bin::VARCHAR AS bin FROM ({values(R.NUMERIC)}) JOIN fine USING (field) WHERE {INSIDE}
 UNION ALL {" UNION ALL ".join(f"SELECT {keep}, 'CATEGORICAL', '{c}', {c} FROM {source} WHERE {c} IS NOT NULL" for c in CATEGORIES)} UNION ALL {pairs})"""


def _tables(source: str) -> str:
    level = []
    for i, lv in enumerate(ADJUSTMENTS):
        parts = " || ';' || ".join(f"CASE WHEN field = '{c}' THEN '' ELSE '{c}=' || {c} END" for c in lv) or "'all'"
        level.append(f"SELECT family, field, bin, judge, {i} AS level, {parts} AS stratum FROM {source}_members")
    return f"""{source}_cells AS (SELECT family, field, level, stratum, bin, count(*) FILTER (WHERE judge = '{DEFECT}') AS a, count(*) AS n FROM ({" UNION ALL ".join(level)}) WHERE stratum IS NOT NULL GROUP BY ALL),
{source}_tables AS MATERIALIZED (SELECT family, field, level, stratum, bin, a, n - a AS b, sum(a) OVER w - a AS c, sum(n) OVER w - n - sum(a) OVER w + a AS d FROM {source}_cells WINDOW w AS (PARTITION BY family, field, level, stratum))"""


TOLD = "a + b > 0 AND c + d > 0"
PREP = BASE + f""", disc AS MATERIALIZED (SELECT * FROM inner_split WHERE split = 'discovery'), conf AS MATERIALIZED (SELECT * FROM inner_split WHERE split = 'confirmation'),
{_bins("disc", R.NUMERIC, C.numeric_bins, "fine")}, {_bins("disc", COARSE, C.interaction_bins, "coarse")},
{_members("disc")}, {_members("conf")}, {_tables("disc")}, {_tables("conf")},
by_level AS (SELECT family, field, bin, level, count(*) FILTER (WHERE {TOLD}) AS strata, sum(CASE WHEN {TOLD} THEN a + b ELSE 0 END) AS mine, sum(CASE WHEN {TOLD} THEN c + d ELSE 0 END) AS others FROM disc_tables GROUP BY ALL),
chosen AS MATERIALIZED (SELECT family, field, bin, coalesce(min(level) FILTER (WHERE good), max(level)) AS level, CASE WHEN bool_or(good) THEN 'STRATIFIED' ELSE 'UNADJUSTED_FALLBACK' END AS kind
  FROM (SELECT *, strata >= {C.informative_strata} AND mine >= {C.discovery_support} AND others >= {C.discovery_support} AS good FROM by_level) GROUP BY family, field, bin),
weighted AS MATERIALIZED (SELECT family, field, bin, stratum, (a + b + c + d)::DOUBLE AS w FROM disc_tables SEMI JOIN chosen USING (family, field, bin, level) WHERE {TOLD})
"""


def _metrics(source: str, support: int, defects: int) -> str:
    z, z2 = C.wilson_z, C.wilson_z**2
    p = erfc_sql("abs(diff) / sqrt(var) / sqrt(2.0)")
    share = "(defects / support::DOUBLE)"
    bound = lambda sign: f"CASE WHEN support > 0 THEN greatest(0.0, least(1.0, ({share} + {z2} / (2 * support)) / (1 + {z2} / support) {sign} {z} / (1 + {z2} / support) * sqrt({share} * (1 - {share}) / support + {z2} / (4.0 * support * support)))) END"
    return f"""(SELECT family, field, bin, level, kind, support, defects, CASE WHEN support > 0 THEN {share} END AS crude, {bound("-")} AS crude_low, {bound("+")} AS crude_high,
  CASE WHEN fine THEN ra END AS adjusted, CASE WHEN fine THEN rc END AS comparator, CASE WHEN fine THEN ra - rc END AS rd, CASE WHEN fine AND den > 0 THEN num / den END AS rr,
  CASE WHEN fine AND var > 0 THEN least(1.0, {p}) ELSE 1.0 END AS p,
  CASE WHEN few THEN 'NO_INFORMATIVE_STRATA' WHEN low THEN 'LOW_SUPPORT' WHEN defects < {defects} THEN 'LOW_DEFECT_COUNT' WHEN coalesce(var, 0) <= 0 THEN 'ZERO_VARIANCE' ELSE 'NONE' END AS reason
 FROM (SELECT *, NOT few AND NOT low AS fine FROM (SELECT *, strata < CASE WHEN kind = 'STRATIFIED' THEN {C.informative_strata} ELSE 1 END AS few, support < {support} OR others < {support} AS low
 FROM (SELECT c.family, c.field, c.bin, c.level, c.kind, coalesce(m.defects, 0)::BIGINT AS defects, coalesce(m.support, 0)::BIGINT AS support, coalesce(m.others, 0)::BIGINT AS others, coalesce(m.strata, 0) AS strata, ra, rc, num, den, diff, var FROM chosen c LEFT JOIN (
 SELECT family, field, bin, sum(a) AS defects, sum(a + b) AS support, sum(c + d) AS others, count(*) AS strata, sum(w * a / (a + b)) / sum(w) AS ra, sum(w * c / (c + d)) / sum(w) AS rc,
  sum((a + f) * (c + d + 2 * f) / (a + b + c + d + 4 * f)) AS num, sum((c + f) * (a + b + 2 * f) / (a + b + c + d + 4 * f)) AS den, sum(a - (a + b) * (a + c) / (a + b + c + d)) AS diff,
  sum(CASE WHEN a + b + c + d > 1 THEN (a + b) * (c + d) * (a + c) * (b + d) / ((a + b + c + d) * (a + b + c + d) * (a + b + c + d - 1)) ELSE 0.0 END) AS var
  FROM (SELECT t.family, t.field, t.bin, t.a::DOUBLE AS a, t.b::DOUBLE AS b, t.c::DOUBLE AS c, t.d::DOUBLE AS d, w, CASE WHEN t.a = 0 OR t.b = 0 OR t.c = 0 OR t.d = 0 THEN 0.5 ELSE 0.0 END AS f FROM {source}_tables t SEMI JOIN chosen USING (family, field, bin, level) JOIN weighted USING (family, field, bin, stratum) WHERE t.a + t.b > 0 AND t.c + t.d > 0) GROUP BY family, field, bin) m USING (family, field, bin)))))"""


RULES = PREP + f""", one AS MATERIALIZED {_metrics("disc", C.discovery_support, C.caution_defects)}, two AS MATERIALIZED {_metrics("conf", C.confirmation_support, C.confirmation_defects)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, field, bin) AS k, count(*) OVER (PARTITION BY family) AS m FROM one),
tested AS MATERIALIZED (SELECT * EXCLUDE (k, m), least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ranked),
ruled AS MATERIALIZED (SELECT t.*, two.support AS c_support, two.defects AS c_defects, two.adjusted AS c_adjusted, two.comparator AS c_comparator, two.rd AS c_rd, two.rr AS c_rr, two.reason AS c_reason
  FROM tested t LEFT JOIN two USING (family, field, bin)),
flags AS (SELECT *, coalesce(rr >= {C.rr_caution} AND rd >= {C.rd_caution} AND q <= {C.q_caution}, false) AS caution, coalesce(c_rr > 1 AND c_rd > 0, false) AS again FROM ruled),
graded AS MATERIALIZED (SELECT *, family || '|' || field || '|' || bin AS rule_id, CASE WHEN reason IN {R.INSUFFICIENT} OR coalesce(c_reason IN {R.INSUFFICIENT}, true) THEN 'INSUFFICIENT_EVIDENCE'
  WHEN caution AND defects >= {C.danger_defects} AND rr >= {C.rr_danger} AND rd >= {C.rd_danger} AND q <= {C.q_danger} AND again AND c_rr >= {C.confirm_rr_danger} AND kind = 'STRATIFIED' THEN 'DANGER'
  WHEN caution AND again THEN 'CAUTION' WHEN caution THEN 'UNCONFIRMED' ELSE 'NORMAL' END AS grade FROM flags)
"""
#: Written in the inputs' place of the seed material; the reference population's identity in a real run.
MATERIAL = "sha256:" + "0" * 64


@query("g1_candidates", PREP + "SELECT family, field, bin, count(*) AS members FROM disc_members GROUP BY ALL")
def g1(spark, d):
    return bound.members(spark, d, "discovery").groupBy("family", "field", "bin").agg(F.count("*").alias("members"))


@query("g4_g5_stratum_tables", PREP + "SELECT family, field, bin, level::INTEGER AS level, stratum, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d FROM disc_tables")
def g5(spark, d):
    return bound.tables(spark, d, "discovery")


@query("g3_adjustment_level", PREP + "SELECT family, field, bin, level::INTEGER AS level, kind FROM chosen")
def g3(spark, d):
    return bound.level(spark, d)


@query("g6_wilson_interval", BASE + f"SELECT steel_grade, round(greatest(0.0, least(1.0, (x / n + {C.wilson_z**2} / (2 * n)) / (1 + {C.wilson_z**2} / n) - {C.wilson_z} / (1 + {C.wilson_z**2} / n) * sqrt(x / n * (1 - x / n) / n + {C.wilson_z**2} / (4 * n * n)))), 6) AS low, round(greatest(0.0, least(1.0, (x / n + {C.wilson_z**2} / (2 * n)) / (1 + {C.wilson_z**2} / n) + {C.wilson_z} / (1 + {C.wilson_z**2} / n) * sqrt(x / n * (1 - x / n) / n + {C.wilson_z**2} / (4 * n * n)))), 6) AS high FROM (SELECT steel_grade, (count(*) FILTER (WHERE judge = '{DEFECT}'))::DOUBLE AS x, count(*)::DOUBLE AS n FROM replay GROUP BY 1)")
def g6(spark, d):
    rows = bound.replay(spark, d).groupBy("steel_grade").agg(F.count_if(F.col("judge") == DEFECT).alias("x"), F.count("*").alias("n"))
    low, high = wilson(F.col("x"), F.col("n"), C.wilson_z)
    return rows.select("steel_grade", r6(low).alias("low"), r6(high).alias("high"))


METRICS = ("crude", "crude_low", "crude_high", "adjusted", "comparator", "rd", "rr", "p", "q", "c_adjusted", "c_comparator", "c_rd", "c_rr")
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


@query("g7_g8_g9_g14_rule_metrics", RULES + f"SELECT family, field, bin, support, defects, reason, level::INTEGER AS level, kind, c_support, c_defects, c_reason, {ROUNDED} FROM ruled")
def g7(spark, d):
    return rounded(bound.ruled(spark, d), *METRICS)


@query("g9_erfc", f"SELECT l_linenumber, round(sum({erfc_sql('l_discount * 10')}), 6) AS total FROM lineitem GROUP BY l_linenumber")
def g9(spark, d):
    return bindings.table(spark, d, "lineitem").groupBy("l_linenumber").agg(r6(F.sum(erfc(F.col("l_discount") * 10))).alias("total"))


@query("g10_benjamini_hochberg", RULES + "SELECT family, field, bin, round(p, 6) AS p, round(q, 6) AS q FROM ruled")
def g10(spark, d):
    return rounded(bound.ruled(spark, d).select("family", "field", "bin", "p", "q"), "p", "q")


@query("g15_g17_g18_graded_rules", RULES + "SELECT rule_id, family, field, bin, grade, kind, CASE WHEN family = 'CATEGORICAL' AND field = 'furnace_no' THEN 'EQUIPMENT_SPECIFIC' ELSE 'PROCESS_GLOBAL' END AS scope, CASE WHEN family = 'CATEGORICAL' AND field = 'furnace_no' THEN bin ELSE 'ALL' END AS equipment_id, true AS early_warning FROM graded")
def g15(spark, d):
    return bound.graded(spark, d).select("rule_id", "family", "field", "bin", "grade", "kind", "scope", "equipment_id", "early_warning")


@query("g16_display_merge", RULES + """, numbered AS (SELECT rule_id, field, grade, bin::INTEGER AS bin FROM graded WHERE family = 'NUMERIC'),
broken AS (SELECT n.*, CASE WHEN lag(f.upper) OVER w = f.lower THEN 0 ELSE 1 END AS new FROM numbered n JOIN fine f ON f.field = n.field AND f.bin = n.bin WINDOW w AS (PARTITION BY n.field, n.grade ORDER BY n.bin)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY field, grade ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM broken)
SELECT rule_id, array_to_string(list(rule_id) OVER (PARTITION BY field, grade, run ORDER BY rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), ',') AS members FROM runs QUALIFY count(*) OVER (PARTITION BY field, grade, run) >= 2""")
def g16(spark, d):
    return R.merged_display(bound.graded(spark, d), bound.bins(spark, d)[0]).select("rule_id", F.array_join("members", ",").alias("members"))


@query("g11_hashed_draws", "SELECT l_orderkey, l_linenumber, l_partkey, (('0x' || substr(sha256(unhex(sha256('seed') || lpad(lower(to_hex(l_orderkey)), 16, '0') || lpad(lower(to_hex(l_partkey)), 16, '0'))), 1, 16))::UBIGINT % 9973)::BIGINT AS draw FROM lineitem")
def g11(spark, d):
    rows = bindings.table(spark, d, "lineitem")
    seed = F.sha2(F.lit("seed"), 256)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", hashed_draw(seed, F.col("l_orderkey"), F.col("l_partkey"), F.lit(9973)).alias("draw"))


def _applicable(spark, d):
    """Levels of the rules that get an interval."""
    return bound.level(spark, d).join(bound.ruled(spark, d).where(R.bootstrap_applicable(C)).select(*R.KEYS), R.KEYS)


def _blocks(spark, d):
    weighted = R.weights(bound.tables(spark, d, "discovery"), bound.level(spark, d))
    return R.charge_blocks(bound.members(spark, d, "discovery"), weighted, _applicable(spark, d))


BLOCKS = RULES + f""", hot AS (SELECT family, field, bin AS rule_bin, level FROM ruled WHERE support >= {C.discovery_support} AND defects >= {C.caution_defects} AND adjusted IS NOT NULL AND comparator IS NOT NULL AND rr > 0), staged AS (
{" UNION ALL ".join(f"SELECT family, field, bin, charge_id, judge, {i} AS level, " + (" || ';' || ".join(f"CASE WHEN field = '{c}' THEN '' ELSE '{c}=' || {c} END" for c in lv) or "'all'") + " AS stratum FROM disc_members" for i, lv in enumerate(ADJUSTMENTS))}),
blocks AS MATERIALIZED (SELECT s.family || '|' || s.field || '|' || rule_bin AS rule_id, charge_id, s.stratum, count(*) FILTER (WHERE s.bin = rule_bin AND judge = '{DEFECT}') AS a, count(*) FILTER (WHERE s.bin = rule_bin AND judge <> '{DEFECT}') AS b, count(*) FILTER (WHERE s.bin <> rule_bin AND judge = '{DEFECT}') AS c, count(*) FILTER (WHERE s.bin <> rule_bin AND judge <> '{DEFECT}') AS d
FROM staged s JOIN hot h ON s.family = h.family AND s.field = h.field AND s.level = h.level SEMI JOIN weighted w ON w.family = s.family AND w.field = s.field AND w.bin = rule_bin AND w.stratum = s.stratum GROUP BY ALL)
"""


@query("g13_bootstrap_blocks", BLOCKS + "SELECT * FROM blocks")
def g13(spark, d):
    """The blocks as they are made: they are many rows, and what reads them more than once has them written."""
    return _blocks(spark, d)


#: Replicates, and how many of them must give a ratio: those of the configuration.
REPLICATES, VALID = C.bootstrap_replicates, C.bootstrap_valid


def draws_sql(seed: str, key: str, source: str, n: int) -> str:
    """times(key, r, charge_id, times): the draws of ``n`` replicates in SQL."""
    pad = lambda k: f"lpad(lower(to_hex({k})), 16, '0')"
    return f"""placed AS MATERIALIZED (SELECT {key}, charge_id, row_number() OVER (PARTITION BY {key} ORDER BY charge_id) - 1 AS place, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT DISTINCT {key}, charge_id FROM {source})),
seeds AS (SELECT DISTINCT {key}, n, sha256({seed}) AS seed FROM placed),
drawing AS (SELECT {key}, r, (('0x' || substr(sha256(unhex(seed || {pad("r")} || {pad("i")})), 1, 16))::UBIGINT % n::UBIGINT)::BIGINT AS place FROM (SELECT *, unnest(range(n)) AS i FROM seeds), range({n}) AS t(r)),
times AS MATERIALIZED (SELECT {key}, r, charge_id, count(*) AS times FROM drawing JOIN placed USING ({key}, place) GROUP BY ALL)"""


INTERVALS = BLOCKS + ", " + draws_sql(f"'{MATERIAL}' || chr(0) || rule_id || chr(0) || 'rule-ci-v1'", "rule_id", "blocks", REPLICATES) + f""",
resampled AS (SELECT rule_id, r, stratum, sum(times * a)::DOUBLE AS a, sum(times * b)::DOUBLE AS b, sum(times * c)::DOUBLE AS c, sum(times * d)::DOUBLE AS d FROM times JOIN blocks USING (rule_id, charge_id) GROUP BY ALL),
ratios AS (SELECT rule_id, r, sum((a + f) * (c + d + 2 * f) / (a + b + c + d + 4 * f)) AS num, sum((c + f) * (a + b + 2 * f) / (a + b + c + d + 4 * f)) AS den FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS f FROM resampled) GROUP BY ALL),
bounds AS (SELECT rule_id, count(*) AS valid, quantile_disc(num / den, 0.025) AS low, quantile_disc(num / den, 0.975) AS high FROM ratios WHERE den > 0 AND num > 0 GROUP BY rule_id),
intervals AS MATERIALIZED (SELECT r.rule_id, CASE WHEN valid >= {VALID} THEN low END AS rr_low, CASE WHEN valid >= {VALID} THEN high END AS rr_high, coalesce(valid, 0) AS valid, CASE WHEN valid >= {VALID} THEN 'NONE' ELSE 'TOO_FEW_VALID_BOOTSTRAPS' END AS reason
 FROM (SELECT DISTINCT rule_id FROM blocks) r LEFT JOIN bounds b ON b.rule_id = r.rule_id)
"""


def _intervals(spark, d):
    return stage(spark, d, "intervals", lambda: R.bootstrap_intervals(stage(spark, d, "blocks", lambda: _blocks(spark, d)), REPLICATES, VALID, MATERIAL))


@query("g12_bootstrap_intervals", INTERVALS + "SELECT rule_id, round(rr_low, 6) AS rr_low, round(rr_high, 6) AS rr_high, valid, reason FROM intervals")
def g12(spark, d):
    return rounded(_intervals(spark, d), "rr_low", "rr_high")


@query("g18_final_grades", INTERVALS + f"""SELECT g.rule_id, CASE WHEN g.reason = 'NONE' THEN coalesce(i.reason, 'NONE') ELSE g.reason END AS reason, round(i.rr_low, 6) AS rr_low, round(i.rr_high, 6) AS rr_high, g.grade AS before_bootstrap,
 CASE WHEN g.grade = 'DANGER' AND coalesce(i.rr_low <= 1, true) THEN 'CAUTION' ELSE g.grade END AS grade FROM graded g LEFT JOIN intervals i ON i.rule_id = g.rule_id""")
def g18(spark, d):
    """The rule table after the bootstrap, whose lower bound DANGER needs above 1."""
    rows = R.graded_rules(bound.ruled(spark, d), C, _intervals(spark, d))
    before = bound.graded(spark, d).select("rule_id", F.col("grade").alias("before_bootstrap"))
    return rounded(rows.join(before, "rule_id").select("rule_id", "reason", "rr_low", "rr_high", "before_bootstrap", "grade"), "rr_low", "rr_high")


@query("g19_rule_contributors", RULES + "SELECT g.rule_id, m.charge_id, m.slab_no FROM graded g JOIN disc_members m USING (family, field, bin) WHERE grade IN ('DANGER', 'CAUTION')")
def g19(spark, d):
    hot = bound.graded(spark, d).where("grade in ('DANGER', 'CAUTION')").select("rule_id", *R.KEYS)
    return bound.members(spark, d, "discovery").join(broadcast_if_small(hot), R.KEYS).select("rule_id", "charge_id", "slab_no")


_EVIDENCE = "SELECT t.family || '|' || t.field || '|' || t.bin AS rule_id, '{split}' AS split, t.stratum, w AS weight, (t.a + t.b)::BIGINT AS candidates, (t.c + t.d)::BIGINT AS comparators FROM {source}_tables t SEMI JOIN chosen USING (family, field, bin, level) JOIN weighted USING (family, field, bin, stratum) WHERE t.a + t.b > 0 AND t.c + t.d > 0"


@query("g19_rule_strata", PREP + " UNION ALL ".join(_EVIDENCE.format(split=s, source=t) for s, t in (("DISCOVERY", "disc"), ("CONFIRMATION", "conf"))))
def g19s(spark, d):
    chosen = bound.level(spark, d)
    weighted = R.weights(bound.tables(spark, d, "discovery"), chosen)
    one, two = (R.stratum_evidence(bound.tables(spark, d, name), weighted, chosen, name.upper()) for name in ("discovery", "confirmation"))
    return one.unionByName(two)


ROLES = "(VALUES " + ", ".join(f"('{f.name}', '{f.stage}', '{f.equipment_type}')" for f in FEATURES) + ") AS roles(field, stage, equipment_type)"


@query("c6_rule_event_status", RULES + f""", terms AS (SELECT g.rule_id, grade, r.stage, r.equipment_type, g.field, lower, lower_inclusive, upper FROM graded g JOIN {ROLES} ON r.field = g.field JOIN fine f ON f.field = g.field AND f.bin::VARCHAR = g.bin WHERE family = 'NUMERIC'),
seen AS ({" UNION ALL ".join(f"SELECT charge_id || '-' || slab_no || '-{f.name}' AS event_key, '{f.name}' AS field, CASE WHEN charge_id::BIGINT % 7 <> 0 THEN {f.name} END AS v FROM labelled WHERE split = 'holdout'" for f in FEATURES)})
SELECT status, rule_id, grade, count(*) AS events FROM (SELECT t.*, CASE WHEN v IS NULL THEN 'DATA_MISSING' WHEN (v > lower OR (lower_inclusive AND v = lower)) AND v <= upper THEN 'MATCHED' ELSE 'NOT_MATCHED' END AS status FROM terms t JOIN (SELECT s.*, o.charge_id FROM seen s JOIN (SELECT DISTINCT charge_id, charge_id || '-' || slab_no AS k FROM labelled WHERE split = 'holdout') o ON s.event_key = o.k || '-' || s.field) e ON e.field = t.field) GROUP BY ALL""".replace("AS roles(field, stage, equipment_type)", "AS r(field, stage, equipment_type)"))
def c6(spark, d):
    roles = spark.createDataFrame([(f.name, f.stage, f.equipment_type) for f in FEATURES], "field string, stage string, equipment_type string")
    fine, _ = bound.bins(spark, d)
    terms = bound.graded(spark, d).where("family = 'NUMERIC'").join(F.broadcast(roles), "field").join(fine.withColumn("bin", F.col("bin").cast("string")), ["field", "bin"])
    terms = terms.select("rule_id", "grade", "stage", "equipment_type", "scope", "equipment_id", "field", "lower", "lower_inclusive", "upper", F.lit(True).alias("upper_inclusive"), F.lit(None).cast("array<string>").alias("accepted"))
    # an event a stage of a material: its payload is what is first known there; every seventh charge lacks it
    lacking = F.col("charge_id").cast("long") % 7 == 0
    by_stage = {}
    for f in FEATURES:
        by_stage.setdefault((f.stage, f.equipment_type, f.equipment), []).append(f.name)
    items = [F.struct(
        F.lit(stage_).alias("stage"), F.lit(kind).alias("equipment_type"), F.col(own).alias("equipment_id"),
        F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.when(~lacking, F.col(n).cast("string")) for n in names])).alias("values"),
    ) for (stage_, kind, own), names in by_stage.items()]
    events = bound.outer(spark, d).where("split = 'holdout'").select(F.concat_ws("-", "charge_id", "slab_no").alias("event_key"), F.explode(F.array(*items)).alias("x")).select("event_key", "x.*")
    return R.memberships_by_status(events, terms).groupBy("status", "rule_id", "grade").agg(F.count("*").alias("events"))


@query("d6_distinct_candidates", PREP + """, named AS (SELECT DISTINCT family, field, bin FROM disc_members), mirrored AS (SELECT family || '|' || field || '|' || bin AS rule_id, family, [[split_part(field, '|', 1), split_part(bin, '|', 1)], [split_part(field, '|', 2), split_part(bin, '|', 2)]] AS terms FROM named WHERE family = 'INTERACTION'
 UNION ALL SELECT family || '|' || split_part(field, '|', 2) || '|' || split_part(field, '|', 1) || '|' || split_part(bin, '|', 2) || '|' || split_part(bin, '|', 1), family, [[split_part(field, '|', 1), split_part(bin, '|', 1)], [split_part(field, '|', 2), split_part(bin, '|', 2)]] FROM named WHERE family = 'INTERACTION'
 UNION ALL SELECT family || '|' || field || '|' || bin, family, [[field, bin]] FROM named WHERE family <> 'INTERACTION')
SELECT min(rule_id) AS rule_id, family, count(*) AS forms FROM mirrored GROUP BY family, list_sort(terms)""")
def d6(spark, d):
    """Interactions are generated in both orders of their fields; one of the two forms stays."""
    named = bound.members(spark, d, "discovery").select(*R.KEYS).distinct()
    part = lambda c, k: F.split_part(F.col(c), F.lit("|"), F.lit(k))
    term = lambda k: F.struct(part("field", k).alias("field"), part("bin", k).alias("bin"))
    two = F.col("family") == "INTERACTION"
    forms = F.when(two, F.array(
        F.struct(F.concat_ws("|", *R.KEYS).alias("rule_id"), F.array(term(1), term(2)).alias("terms")),
        F.struct(F.concat_ws("|", "family", part("field", 2), part("field", 1), part("bin", 2), part("bin", 1)).alias("rule_id"), F.array(term(2), term(1)).alias("terms")),
    )).otherwise(F.array(F.struct(F.concat_ws("|", *R.KEYS).alias("rule_id"), F.array(F.struct("field", "bin")).alias("terms"))))
    candidates = named.select("family", F.explode(forms).alias("x")).select("family", "x.*")
    counts = candidates.groupBy("family", F.to_json(F.array_sort("terms")).alias("predicate")).agg(F.count("*").alias("forms"))
    return R.distinct_candidates(candidates).join(counts, ["family", "predicate"]).select("rule_id", "family", "forms")


def _behind(source: str) -> str:
    level = [f"SELECT family, field, bin, charge_id, slab_no, {i} AS level, " + (" || ';' || ".join(f"CASE WHEN field = '{c}' THEN '' ELSE '{c}=' || {c} END" for c in lv) or "'all'") + f" AS stratum FROM {source}_members" for i, lv in enumerate(ADJUSTMENTS)]
    return f"SELECT m.family, m.family || '|' || m.field || '|' || m.bin AS rule_id, charge_id, slab_no FROM ({' UNION ALL '.join(level)}) m JOIN chosen USING (family, field, bin, level) SEMI JOIN (SELECT family, field, bin, level, stratum FROM {source}_tables WHERE {TOLD}) t USING (family, field, bin, level, stratum) SEMI JOIN weighted w USING (family, field, bin, stratum)"


@query("i9_aggregate_lineage", RULES + ", " + RANGES[len(BASE) + 2:] + f""", lined AS (
SELECT 'equipment_operating_ranges' AS artifact, r.rule_id, 'REFERENCE' AS split, 'NOT_APPLICABLE' AS selection, 'STAGE_AVAILABLE_AT_AS_OF,FINITE_VALUE' AS filters, 'TYPE1_QUANTILE' AS transformations, l.charge_id, l.slab_no FROM longed l JOIN ranged r ON {IN_RANGE}
UNION ALL SELECT 'quality_risk_intervals', rule_id, 'DISCOVERY', 'FIXED_POPULATION_STRATA_MINUS_CANDIDATE', 'LABEL_AVAILABLE_AND_MATURE,' || CASE WHEN family <> 'CATEGORICAL' THEN 'FINITE_VALUE,' ELSE '' END || 'PREDICATE_MATCH,INFORMATIVE_STRATA_ONLY', 'WILSON_SCORE_INTERVAL,BENJAMINI_HOCHBERG_FDR', charge_id, slab_no FROM ({_behind("disc")})
UNION ALL SELECT 'quality_risk_intervals', rule_id, 'CONFIRMATION', 'FIXED_POPULATION_STRATA_MINUS_CANDIDATE', 'LABEL_AVAILABLE_AND_MATURE,' || CASE WHEN family <> 'CATEGORICAL' THEN 'FINITE_VALUE,' ELSE '' END || 'PREDICATE_MATCH,FIXED_DISCOVERY_STRATA,INFORMATIVE_STRATA_ONLY', 'WILSON_SCORE_INTERVAL', charge_id, slab_no FROM ({_behind("conf")}))
SELECT artifact, rule_id, split, selection, filters, transformations, count(*) AS materials, min(charge_id || '-' || slab_no) AS first_material FROM lined GROUP BY ALL""")
def i9(spark, d):
    weighted, chosen = R.weights(bound.tables(spark, d, "discovery"), bound.level(spark, d)), bound.level(spark, d)
    behind = [R.contributors(bound.members(spark, d, name), bound.tables(spark, d, name), weighted, chosen) for name in ("discovery", "confirmation")]
    edges = R.aggregate_lineage(G.range_contributors(bound.reference(spark, d), ranges_df(spark, d)), *behind)
    text = {c: F.array_join(c, ",") for c in ("filters", "transformations")}
    return edges.withColumns(text).groupBy("artifact", "rule_id", "split", "selection", "filters", "transformations").agg(
        F.count("*").alias("materials"), F.min(F.concat_ws("-", "charge_id", "slab_no")).alias("first_material")
    )
