"""Queries of the defect-model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalogs import Registry, bound, rounded
from millwright.config import DEFECT
from millwright.operators import model as M
from millwright.sources.bindings import BASE
from millwright.work import stage

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
#: A fixed score that both engines can form, to hold the metric operators against SQL.
SCORE = "round(f_heat_temp / 50.0 * 0.6 + f_bfg_ratio * 0.4, 3)"
SCORED = BASE + f", scored AS MATERIALIZED (SELECT {SCORE} AS probability, (judge = '{DEFECT}')::INTEGER AS label FROM labelled WHERE split = 'holdout' AND known = 'AVAILABLE' AND f_bfg_ratio IS NOT NULL), groups AS MATERIALIZED (SELECT probability AS score, pos, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp FROM (SELECT probability, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY probability DESC ROWS UNBOUNDED PRECEDING))"


def scored(spark, d):
    rows = bound.outer(spark, d).where("split = 'holdout' and known = 'AVAILABLE' and f_bfg_ratio is not null")
    return rows.select(F.expr(SCORE).cast("double").alias("probability"), (F.col("judge") == DEFECT).cast("int").alias("label"))


@query("j1_projection", BASE + f"SELECT charge_id, slab_no, hr_date, {', '.join(M.CATEGORICAL)}, {', '.join(f'round({c}, 6) AS {c}' for c in M.NUMERIC)}, (judge = '{DEFECT}')::INTEGER AS label FROM replay")
def j1(spark, d):
    return rounded(M.project(bound.replay(spark, d)), *M.NUMERIC)


@query("j2_feature_contract", BASE + f"SELECT {', '.join(f'round(median({c}), 6) AS median_{c}' for c in M.NUMERIC)}, {', '.join(f'array_to_string(list_sort(list(DISTINCT {c})), chr(44)) AS levels_{c}' for c in M.CATEGORICAL)}, quantile_disc({' + '.join(f'({c} IS NULL)::INTEGER' for c in (*M.CATEGORICAL, *M.NUMERIC))}, 0.99)::INTEGER AS most_missing FROM mature")
def j2(spark, d):
    rows = M.fit_contract(M.project(bound.outer(spark, d).where("split = 'reference' and known = 'AVAILABLE'")))
    rows = rows.withColumns({f"levels_{c}": F.array_join(f"levels_{c}", ",") for c in M.CATEGORICAL})
    return rounded(rows, *[f"median_{c}" for c in M.NUMERIC])


HOT = " || ',' || ".join(f"array_to_string(list_transform(levels_{c}, lambda v: CASE WHEN v = {c} THEN '1' ELSE '0' END), ',') || ',' || CASE WHEN {c} IS NULL OR NOT list_contains(levels_{c}, {c}) THEN '1' ELSE '0' END" for c in M.CATEGORICAL)
GONE = " || ',' || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in (*M.CATEGORICAL, *M.NUMERIC))
NUMBERS = " || ',' || ".join(f"round(coalesce({c}, median_{c})::FLOAT::DOUBLE * 1000)::BIGINT" for c in M.NUMERIC)
MISSES = " + ".join(f"({c} IS NULL)::INTEGER" for c in (*M.CATEGORICAL, *M.NUMERIC))
CONTRACT = f"contract AS (SELECT {', '.join(f'median({c}) AS median_{c}' for c in M.NUMERIC)}, {', '.join(f'list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)) AS levels_{c}' for c in M.CATEGORICAL)}, quantile_disc({MISSES}, 0.99) AS most_missing FROM mature)"


@query("j3_encoding", BASE + f", {CONTRACT}, altered AS (SELECT * REPLACE (CASE WHEN charge_id::BIGINT % 7 = 0 THEN NULL ELSE f_bfg_ratio END AS f_bfg_ratio, CASE WHEN charge_id::BIGINT % 5 = 0 THEN 'new' ELSE steel_grade END AS steel_grade) FROM labelled WHERE split = 'holdout') SELECT charge_id, slab_no, {NUMBERS} || ',' || {HOT} || ',' || {GONE} AS vector, {MISSES} <= most_missing AS complete FROM altered, contract")
def j3(spark, d):
    """Holdout rows of which some lack a number and others have a category that training never saw."""
    known, charge = bound.outer(spark, d), F.col("charge_id").cast("long")
    contract = M.fit_contract(M.project(known.where("split = 'reference' and known = 'AVAILABLE'")))
    rows = M.project(known.where("split = 'holdout'")).withColumns({"f_bfg_ratio": F.when(charge % 7 != 0, F.col("f_bfg_ratio")), "steel_grade": F.when(charge % 5 == 0, "new").otherwise(F.col("steel_grade"))})
    n = len(M.NUMERIC)
    vector = F.concat(F.transform(F.slice("features", 1, n), lambda v: F.round(v.cast("double") * 1000).cast("long").cast("string")), F.transform(F.slice("features", n + 1, 10_000), lambda v: v.cast("int").cast("string")))
    return M.encode(rows, contract).select("charge_id", "slab_no", F.array_join(vector, ",").alias("vector"), "complete")


@query("j6_metrics_at_threshold", SCORED + " SELECT count(*) FILTER (WHERE probability >= 0.8 AND label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.8 AND label = 0) AS fp, count(*) FILTER (WHERE probability < 0.8 AND label = 0) AS tn, count(*) FILTER (WHERE probability < 0.8 AND label = 1) AS fn, round(count(*) FILTER (WHERE probability >= 0.8 AND label = 1)::DOUBLE / sum(label), 6) AS recall, round(count(*) FILTER (WHERE probability >= 0.8 AND label = 1)::DOUBLE / count(*) FILTER (WHERE probability >= 0.8), 6) AS precision, round(avg((probability - label) ** 2), 6) AS brier, round(1 - avg((probability - label) ** 2) / avg((0.05 - label) ** 2), 6) AS brier_skill FROM scored")
def j6(spark, d):
    return rounded(M.metrics_at(scored(spark, d), 0.8, 0.05), "recall", "precision", "brier", "brier_skill")


@query("j6_average_precision", SCORED + " SELECT round(sum(tp / (tp + fp)::DOUBLE * pos) / (SELECT sum(label) FROM scored), 6) AS ap FROM groups")
def j6a(spark, d):
    return rounded(M.average_precision(scored(spark, d)), "ap")


@query("j7_f2_threshold", SCORED + " SELECT score AS threshold, round(f2, 6) AS f2 FROM (SELECT score, round(5 * tp / (4 * (SELECT sum(label) FROM scored) + tp + fp)::DOUBLE, 12) AS f2 FROM groups) ORDER BY f2 DESC, score DESC LIMIT 1")
def j7(spark, d):
    return rounded(M.f2_threshold(scored(spark, d)), "f2")


@query("j4_j10_trained_scores")
def j4(spark, d):
    known = bound.outer(spark, d)
    train = M.project(known.where("split = 'reference' and known = 'AVAILABLE'"))
    contract = M.fit_contract(train)
    model = M.train(M.encode(train, contract))
    return M.score(M.encode(M.project(known.where("split = 'holdout'")), contract), model).select("charge_id", "slab_no", "probability", "status")


@query("j9_qualification", SCORED + """, m AS (SELECT count(*) FILTER (WHERE probability >= 0.8 AND label = 1) AS tp, count(*) FILTER (WHERE probability >= 0.8 AND label = 0) AS fp, count(*) FILTER (WHERE probability < 0.8 AND label = 1) AS fn, 1 - avg((probability - label) ** 2) / avg((0.05 - label) ** 2) AS skill, avg(label) AS prevalence FROM scored),
a AS (SELECT sum(tp / (tp + fp)::DOUBLE * pos) / (SELECT sum(label) FROM scored) AS ap FROM groups),
r AS (SELECT list_filter([CASE WHEN ap <= prevalence THEN 'AP_NOT_ABOVE_PREVALENCE' END, CASE WHEN skill <= 0 THEN 'NONPOSITIVE_BRIER_SKILL' END, CASE WHEN tp + fp = 0 THEN 'NO_PREDICTED_DEFECTS' END, CASE WHEN tp + fn = 0 THEN 'NO_HOLDOUT_DEFECTS' END], lambda x: x IS NOT NULL) AS reasons FROM m, a)
SELECT CASE WHEN len(reasons) > 0 THEN 'RESEARCH_ONLY' ELSE 'QUALIFIED' END AS qualification, array_to_string(reasons, ',') AS reasons FROM r""")
def j9(spark, d):
    return M.qualified(scored(spark, d), 0.8, 0.05).withColumn("reasons", F.array_join("reasons", ","))


@query("j11_score_parity", SCORED + ", other AS (SELECT round(probability, 2) AS again, probability FROM scored) SELECT count(*) AS rows, round(max(abs(probability - again)), 9) AS max_abs_diff, max(abs(probability - again)) <= 0.00001 AS equal FROM other")
def j11(spark, d):
    """The scores against their own rounding to two digits."""
    rows = bound.outer(spark, d).where("split = 'holdout' and known = 'AVAILABLE' and f_bfg_ratio is not null").select("charge_id", "slab_no", F.expr(SCORE).cast("double").alias("probability"))
    return rounded(M.score_parity(rows, rows.withColumn("probability", F.round("probability", 2)), ["charge_id", "slab_no"]), "max_abs_diff")


@query("j5_candidate_ranking")
def j5(spark, d):
    known = bound.outer(spark, d).where("split = 'reference' and known = 'AVAILABLE'")
    return M.ranked_candidates(stage(spark, d, "reference-known", lambda: known))


@query("j8_grouped_importance")
def j8(spark, d):
    known = bound.outer(spark, d)
    train = M.project(known.where("split = 'reference' and known = 'AVAILABLE'"))
    contract = M.fit_contract(train)
    hold = M.encode(M.project(known.where("split = 'holdout' and known = 'AVAILABLE'")), contract)
    return M.grouped_importance(stage(spark, d, "encoded-holdout", lambda: hold), contract, M.train(M.encode(train, contract)), repeats=3)
