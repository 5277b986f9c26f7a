"""Queries of the time-split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalogs import CONFIG, Registry, bound
from millwright.config import DEFECT, FEATURES, GOOD
from millwright.operators import split as S
from millwright.sources.bindings import BASE

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
COUNTS = f"count(*) AS total, count(*) FILTER (WHERE known = 'AVAILABLE' AND judge = '{DEFECT}') AS defects, count(*) FILTER (WHERE known = 'AVAILABLE' AND judge = '{GOOD}') AS non_defects, count(*) FILTER (WHERE known <> 'AVAILABLE' OR judge IS NULL) AS unknown, min(hr_date) AS first_date, max(hr_date) AS last_date"


@query("e1_whole_date_cutoff", BASE + "SELECT as_of FROM cut")
def e1(spark, d):
    return S.whole_date_cutoff(bound.boundary(spark, d), CONFIG.reference_fraction, "as_of")


@query("e2_charge_purge", BASE + "SELECT charge_id FROM purged")
def e2(spark, d):
    rows = bound.boundary(spark, d)
    return S.crossing_charges(rows, S.whole_date_cutoff(rows, CONFIG.reference_fraction, "as_of"), "as_of")


@query("e3_outer_split", BASE + "SELECT charge_id, slab_no, split FROM outer_split")
def e3(spark, d):
    return bound.outer(spark, d).select("charge_id", "slab_no", "split")


@query("b6_b7_label_maturity", BASE + "SELECT charge_id, slab_no, split, known FROM labelled")
def b6(spark, d):
    return bound.outer(spark, d).select("charge_id", "slab_no", "split", "known")


@query("e4_inner_split", BASE + "SELECT charge_id, slab_no, split FROM inner_split")
def e4(spark, d):
    return bound.inner(spark, d).select("charge_id", "slab_no", "split")


@query("e5_split_counts", BASE + f"SELECT split, {COUNTS} FROM labelled GROUP BY split UNION ALL SELECT split, {COUNTS} FROM inner_split GROUP BY split")
def e5(spark, d):
    return S.split_counts(bound.outer(spark, d)).unionByName(S.split_counts(bound.inner(spark, d)))


@query("e5_censoring_counts", BASE + "SELECT split, known, count(*) AS n FROM labelled GROUP BY split, known")
def e5c(spark, d):
    return S.censoring_counts(bound.outer(spark, d))


FOLDS = """, ordered AS (SELECT hr_date, row_number() OVER (ORDER BY hr_date) AS i, count(*) OVER () AS n FROM mature),
cuts3 AS (SELECT k AS fold, min(hr_date) FILTER (WHERE i = ceil(n * k / 4.0)) AS cut, CASE WHEN k = 3 THEN max(hr_date) ELSE min(hr_date) FILTER (WHERE i = ceil(n * (k + 1) / 4.0)) END AS stop FROM ordered, range(1, 4) AS t(k) GROUP BY k),
placed AS (SELECT fold, charge_id, slab_no, CASE WHEN hr_date <= cut THEN 'train' ELSE 'validate' END AS side FROM mature JOIN cuts3 ON hr_date <= stop)
SELECT fold::INTEGER AS fold, side, charge_id, slab_no FROM placed WHERE (fold, charge_id) NOT IN (SELECT (fold, charge_id) FROM placed GROUP BY fold, charge_id HAVING count(DISTINCT side) > 1)"""


@query("e6_forward_folds", BASE + FOLDS)
def e6(spark, d):
    return S.forward_folds(bound.outer(spark, d).where("split = 'reference' and known = 'AVAILABLE'"), 3)


@query("i8_population_lineage", BASE + "SELECT 'replay' AS population, charge_id, slab_no FROM replay UNION ALL SELECT split, charge_id, slab_no FROM outer_split UNION ALL SELECT split, charge_id, slab_no FROM inner_split")
def i8(spark, d):
    keys = ["population", "charge_id", "slab_no"]
    rows = bound.replay(spark, d).withColumn("population", F.lit("replay")).select(*keys)
    for part in (bound.outer(spark, d), bound.inner(spark, d)):
        rows = rows.unionByName(part.withColumnRenamed("split", "population").select(*keys))
    return rows


_VALUES = [f"CASE WHEN {f.date} <= as_of AND {f.name} IS NOT NULL THEN '\"{f.name}\":\"' || printf('%.6f', {f.name}) || '\"' END" for f in FEATURES]


@query("a16_criteria_projection", BASE + f"""SELECT '{{"charge_id":"' || charge_id || '","furnace_no":"' || furnace_no || '","steel_grade":"' || steel_grade || '","hr_date":"' || strftime(hr_date, '%Y-%m-%d') || '"' || CASE WHEN known = 'AVAILABLE' AND judge IS NOT NULL THEN ',"label":"' || judge || '"' ELSE '' END
 || ',"slab_no":"' || slab_no || '","values":{{' || concat_ws(',', {', '.join(_VALUES)}) || '}}}}' AS line FROM labelled WHERE split = 'reference'""")
def a16(spark, d):
    return S.criteria_projection(bound.reference(spark, d), FEATURES, ("steel_grade", "furnace_no"))
