"""The analysis stages over the bound tables, each written once and read by the catalogs' queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.catalogs import CONFIG
from millwright.operators import genealogy, rules, split
from millwright.sources import bindings
from millwright.work import stage


def sources(spark: SparkSession, sf_dir: str, numbered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return bindings.sm_cc(spark, sf_dir, numbered), bindings.fur_hr(spark, sf_dir, numbered), bindings.ap(spark, sf_dir, numbered)


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay rows; their records are the numbers of lines."""
    return stage(spark, sf_dir, "replay", lambda: genealogy.replay_rows(*sources(spark, sf_dir, numbered=True), by_charge=True))


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary population, taken from the lines where they lie: they are dealt by charge, so it is not worth writing."""
    return genealogy.boundary(bindings.fur_hr(spark, sf_dir).select("charge_id", "slab_no", "hr_date"))


def outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay rows split, from the written cut and the few charges that cross it: long rows are written once, as replay rows."""
    cut = stage(spark, sf_dir, "outer-cut", lambda: split.whole_date_cutoff(boundary(spark, sf_dir), CONFIG.reference_fraction, "as_of"))
    crossing = stage(spark, sf_dir, "outer-crossing", lambda: split.crossing_charges(boundary(spark, sf_dir), cut, "as_of"))
    return split.labelled(split.outer_at(replay(spark, sf_dir), crossing, cut), CONFIG)


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outer(spark, sf_dir).where("split = 'reference'")


def inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = outer(spark, sf_dir)
    cut = stage(spark, sf_dir, "inner-cut", lambda: split.whole_date_cutoff(split.mature(known), CONFIG.discovery_fraction, "cutoff"))
    crossing = stage(spark, sf_dir, "inner-crossing", lambda: split.crossing_charges(split.mature(known), cut, "cutoff"))
    return split.inner_at(known, crossing, cut)


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inner(spark, sf_dir).where(F.col("split") == name)


def bins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fine = stage(spark, sf_dir, "bins-fine", lambda: rules.bins(part(spark, sf_dir, "discovery"), CONFIG)[0])
    return fine, stage(spark, sf_dir, "bins-coarse", lambda: rules.bins(part(spark, sf_dir, "discovery"), CONFIG)[1])


def members(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Candidates that the rows of a split (discovery, confirmation, holdout) are in."""
    rows = outer(spark, sf_dir).where("split = 'holdout' and known = 'AVAILABLE'") if name == "holdout" else part(spark, sf_dir, name)
    return stage(spark, sf_dir, f"members-{name}", lambda: rules.memberships(rows, *bins(spark, sf_dir)))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stage(spark, sf_dir, f"tables-{name}", lambda: rules.stratum_tables(members(spark, sf_dir, name)))


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "level", lambda: rules.choose_level(tables(spark, sf_dir, "discovery"), CONFIG))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery and confirmation metrics of every candidate."""
    found, held = tables(spark, sf_dir, "discovery"), tables(spark, sf_dir, "confirmation")
    chosen = level(spark, sf_dir)
    one = stage(spark, sf_dir, "sums-discovery", lambda: rules.sums(found, rules.weights(found, chosen), chosen))
    two = stage(spark, sf_dir, "sums-confirmation", lambda: rules.sums(held, rules.weights(found, chosen), chosen))
    return stage(spark, sf_dir, "ruled", lambda: rules.rule_metrics(one, two, CONFIG))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "graded", lambda: rules.graded_rules(ruled(spark, sf_dir), CONFIG))
