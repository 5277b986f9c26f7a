"""Leak-free time splits: whole-date cuts, purge of charges on both sides, label maturity, forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.config import DEFECT, GOOD, AnalysisConfig
from millwright.functions import predicates as P
from millwright.work import broadcast_if_small, written


def whole_date_cutoff(rows: DataFrame, fraction: float, name: str, date: str = "hr_date") -> DataFrame:
    """One row: the date at place ceil(fraction * n) of the sorted dates; all rows of that date stay on the left."""
    days = F.expr(f"percentile_disc({fraction}) within group (order by unix_date({date}))")
    return rows.agg(F.date_from_unix_date(days.cast("int")).alias(name))


def crossing_charges(rows: DataFrame, cut: DataFrame, name: str) -> DataFrame:
    """Charges with rows on both sides of the cut."""
    spans = rows.groupBy("charge_id").agg(F.min("hr_date").alias("lo"), F.max("hr_date").alias("hi"))
    return spans.crossJoin(F.broadcast(cut)).where(F.col("lo").__le__(F.col(name)) & (F.col("hi") > F.col(name))).select("charge_id")


def without(rows: DataFrame, crossing: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` beside the cut, those of charges on both sides of it left out.

    Such charges are those of the few days around the cut: up to a million of them are broadcast, so that the rows stay where they are.
    """
    return rows.join(broadcast_if_small(crossing, 1_000_000), "charge_id", "left_anti").crossJoin(F.broadcast(cut))


def outer_split(replay: DataFrame, boundary: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Replay rows with as_of and split (reference, holdout); cut and purge come from the boundary population."""
    cut = whole_date_cutoff(boundary, cfg.reference_fraction, "as_of")
    return outer_at(replay, written(crossing_charges(boundary, cut, "as_of"), "crossing"), cut)


def outer_at(replay: DataFrame, crossing: DataFrame, cut: DataFrame) -> DataFrame:
    """:func:`outer_split` at a cut and with the charges that cross it."""
    return without(replay, crossing, cut).withColumn("split", F.when(F.col("hr_date") <= F.col("as_of"), "reference").otherwise("holdout"))


def labelled(split: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Adds ``known``: the label's status as of the cut for reference rows, as it is for holdout rows."""
    return split.withColumn("known", F.when(F.col("split") == "reference", P.reference_label("as_of", cfg.maturity_days)).otherwise(P.holdout_label()))


def mature(known: DataFrame) -> DataFrame:
    """Reference rows whose label is mature."""
    return known.where("split = 'reference' and known = 'AVAILABLE'")


def inner_split(known: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Mature labelled reference rows with split (discovery, confirmation), charges on both sides purged again."""
    cut = whole_date_cutoff(mature(known), cfg.discovery_fraction, "cutoff")
    return inner_at(known, written(crossing_charges(mature(known), cut, "cutoff"), "crossing"), cut)


def inner_at(known: DataFrame, crossing: DataFrame, cut: DataFrame) -> DataFrame:
    """:func:`inner_split` at a cut and with the charges that cross it."""
    rows = without(mature(known), crossing, cut)
    return rows.withColumn("split", F.when(F.col("hr_date") <= F.col("cutoff"), "discovery").otherwise("confirmation")).drop("cutoff")


def split_counts(rows: DataFrame) -> DataFrame:
    """Counts of each split. A label counts as defect or good only where it is AVAILABLE (``known``); every other row is unknown."""
    judge = F.when(F.col("known") == "AVAILABLE", F.col("judge"))
    return rows.groupBy("split").agg(
        F.count("*").alias("total"), F.count_if(judge == DEFECT).alias("defects"), F.count_if(judge == GOOD).alias("non_defects"),
        F.count_if(F.coalesce(judge.isin(DEFECT, GOOD), F.lit(False)) == F.lit(False)).alias("unknown"), F.min("hr_date").alias("first_date"), F.max("hr_date").alias("last_date"),
    )


def censoring_counts(known: DataFrame) -> DataFrame:
    return known.groupBy("split", "known").agg(F.count("*").alias("n"))


def forward_folds(rows: DataFrame, folds: int = 3) -> DataFrame:
    """(fold, side, charge_id, slab_no): for each of ``folds`` whole-date cuts, the rows up to it train and those up to the next cut validate.

    Charges on both sides of a fold are left out of it.
    """
    n = folds + 1
    places = ", ".join(str(k / n) for k in range(1, n))
    cuts = rows.agg(F.expr(f"percentile_disc(array({places})) within group (order by unix_date(hr_date))").alias("c"), F.expr("unix_date(max(hr_date))").alias("m"))
    bounds = cuts.select(F.posexplode(F.zip_with("c", F.concat(F.slice("c", 2, folds), F.array(F.col("m").cast("double"))), lambda a, b: F.struct(a.alias("cut"), b.alias("end")))).alias("k", "x"))
    bounds = bounds.select((F.col("k") + 1).alias("fold"), F.expr("date_from_unix_date(cast(x.cut as int))").alias("cut"), F.expr("date_from_unix_date(cast(x.end as int))").alias("end"))
    placed = rows.select("charge_id", "slab_no", "hr_date").crossJoin(F.broadcast(bounds)).where(F.col("hr_date") <= F.col("end"))
    placed = placed.withColumn("side", F.when(F.col("hr_date") <= F.col("cut"), "train").otherwise("validate"))
    both = placed.groupBy("fold", "charge_id").agg(F.count_distinct("side").alias("sides")).where("sides > 1").select("fold", "charge_id")
    return placed.join(both, ["fold", "charge_id"], "left_anti").select("fold", "side", "charge_id", "slab_no")


def criteria_projection(reference: DataFrame, features: tuple, context: tuple[str, ...]) -> DataFrame:
    """(line): exactly what criteria may see of the reference rows, as canonical JSON lines (fields in order, nulls left out).

    A value counts only if its stage had happened as of the cut, a label only if it is AVAILABLE. Sort by ``line`` to write the file;
    the lines' order-free digest needs no sort.
    """
    values = [F.when(P.available_by(f.date, "as_of") & P.finite(f.name), F.col(f.name)) for f in features]
    seen = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f.name) for f in features]), F.array(*[F.format_string("%.6f", v) for v in values])), lambda k, v: v.isNotNull() & (v != "null"))
    where = [F.col(c) for c in sorted(context)]
    label = F.when(F.col("known") == "AVAILABLE", F.col("judge"))
    return reference.select(F.to_json(F.struct("charge_id", *where, F.date_format("hr_date", "yyyy-MM-dd").alias("hr_date"), label.alias("label"), "slab_no", seen.alias("values"))).alias("line"))
