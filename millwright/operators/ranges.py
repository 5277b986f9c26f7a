"""Quantiles, bands, operating ranges by context, column profiles and drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.config import CONTEXTS, FEATURES, AnalysisConfig, Feature
from millwright.functions import predicates as P
from millwright.work import broadcast_if_small, written


def long_form(rows: DataFrame, features: tuple[Feature, ...] = FEATURES, as_of: str | None = "as_of") -> DataFrame:
    """(charge_id, slab_no, split?, field, stage, equipment_type, equipment_id, value and the context columns), a row per finite value.

    With ``as_of``, only values whose stage had happened by then.
    """
    contexts = sorted({c for level in CONTEXTS for c in level})
    keep = [c for c in ("charge_id", "slab_no", "split", *contexts) if c in rows.columns]
    items = []
    for f in features:
        known = P.available_by(f.date, as_of) if as_of else F.lit(True)
        items.append(F.struct(
            F.lit(f.name).alias("field"), F.lit(f.stage).alias("stage"), F.lit(f.equipment_type).alias("equipment_type"),
            F.col(f.equipment).alias("equipment_id"), F.when(known & P.finite(f.name), F.col(f.name)).alias("value"),
        ))
    return rows.select(*keep, F.explode(F.array(*items)).alias("x")).select(*keep, "x.*").where("value is not null")


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], total: str | None = None) -> DataFrame:
    """``keys`` and, for each name in ``ranks``, the group's element at that rank (1 is the least), a function of the number of values.

    No group meets in one task: counted distinct values are dealt by ranges of (keys, value), the ranges' totals tell which of them
    holds each wanted rank, and only those are ordered. Nulls in ``value`` do not count, nulls in ``keys`` form groups, groups
    without a value are absent. ``total`` names a column for the group's number of values.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.lit(0).alias("_"), *keys).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = written(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "quantiles")
    group = Window.partitionBy("g")
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("n")).select(
        "g", "part", "n", F.sum("n").over(group).alias("all"), F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("upto")
    )
    places = [rank(F.col("all")) - (F.col("upto") - F.col("n")) for rank in ranks.values()]
    asked = sums.select("g", "part", "all", *[F.when(r.between(1, F.col("n")), r).alias(f"r{i}") for i, r in enumerate(places)])
    asked = asked.where(F.coalesce(*[F.col(f"r{i}") for i in range(len(places))]).isNotNull())
    inside = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(asked, ["g", "part"]).withColumn("upto", F.sum("n").over(inside))
    picks = [F.max(F.when(F.col(f"r{i}").between(F.col("upto") - F.col("n") + 1, F.col("upto")), F.col("v"))).alias(name) for i, name in enumerate(ranks)]
    return found.groupBy("g").agg(*picks, F.max("all").alias("all")).select(*[f"g.{k}" for k in keys], *ranks, *([F.col("all").alias(total)] if total else []))


def type1_quantiles(rows: DataFrame, keys: list[str], value: str, places: dict[str, float], total: str | None = None) -> DataFrame:
    """Inverted-CDF quantiles by group: the element at rank max(1, ceil(q * n)) for each name in ``places``, as ``at_ranks`` finds it."""
    return at_ranks(rows, keys, value, {name: lambda n, q=q: F.greatest(F.lit(1), F.ceil(F.lit(q) * n)) for name, q in places.items()}, total)


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and the interpolating median: the mean of the two middle elements."""
    middle = at_ranks(rows, keys, value, {"a": lambda n: F.floor((n + 1) / 2), "b": lambda n: F.floor(n / 2) + 1})
    return middle.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("median"))


def band_boundaries(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, q1, q2, q3): one pass over the rows."""
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(P.finite(f), F.col(f)).alias("value")) for f in fields]))
    return type1_quantiles(rows.select(items.alias("x")).select("x.*"), ["field"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def banded(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``rows`` with <field>_band, Q1 to Q4 by the rows' own quartiles."""
    cuts = band_boundaries(rows, fields).groupBy().pivot("field", list(fields)).agg(F.first(F.struct("q1", "q2", "q3")))
    out = rows.crossJoin(F.broadcast(cuts.select(*[F.col(f).alias(f"__{f}") for f in fields])))
    return out.withColumns({f"{f}_band": P.quartile_band(f, f"__{f}.q1", f"__{f}.q2", f"__{f}.q3") for f in fields}).drop(*[f"__{f}" for f in fields])


def equal_frequency_bins(rows: DataFrame, field: str, bins: int) -> DataFrame:
    """(field, bin, lower, upper, lower_inclusive): equal cuts are merged; the first bin includes its minimum, later ones exclude their lower cut."""
    return field_bins(rows.select(F.lit(field).alias("field"), F.col(field).alias("value")).where(P.finite("value")), bins)


def field_bins(long: DataFrame, bins: int) -> DataFrame:
    places = {f"p{k}": k / bins for k in range(bins + 1)}
    cuts = type1_quantiles(long, ["field"], "value", places).select("field", F.col("p0").alias("lo"), F.array_distinct(F.array(*list(places)[1:])).alias("c"))
    cuts = cuts.select("field", "lo", F.posexplode("c").alias("bin", "upper"))
    before = F.lag("upper").over(Window.partitionBy("field").orderBy("bin"))
    return cuts.select("field", "bin", F.coalesce(before, F.col("lo")).alias("lower"), "upper", before.isNull().alias("lower_inclusive"))


def _level_keys() -> list[tuple[int, tuple[str, ...]]]:
    return list(enumerate(CONTEXTS))


def operating_ranges(reference: DataFrame, cfg: AnalysisConfig, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """Ranges by field, equipment and the most specific context with enough support.

    Each row nominates its first level that has ``range_support`` rows; a nominated group's quantiles come from *all* its rows.
    Extreme quantiles need ``tail_support``; a tail whose extreme equals its inner quantile is switched off.
    """
    long = long_form(reference, features)
    names = sorted({c for level in CONTEXTS for c in level})
    keys = ["field", "stage", "equipment_type", "equipment_id"]
    leveled = long.select(*keys, *names, "value", F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), *[(F.col(c) if c in level else F.lit(None).cast("string")).alias(f"c_{c}") for c in names]) for i, level in _level_keys()
    ])).alias("x")).select(*keys, *names, "value", "x.*")
    group = [*keys, "level", *[f"c_{c}" for c in names]]
    places = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    stats = written(type1_quantiles(leveled, group, "value", places, "support").where(F.col("support") >= cfg.range_support), "range-levels")
    # finest cells nominate: a cell's first supported level
    cells = long.groupBy(*keys, *names).agg(F.count("*").alias("n"))
    nominated = None
    for i, level in _level_keys():
        here = stats.where(F.col("level") == i).select(*keys, *[F.col(f"c_{c}").alias(c) for c in level], F.lit(i).alias(f"l{i}"))
        cells = cells.join(here, [*keys, *level], "left")
        nominated = F.col(f"l{i}") if nominated is None else F.coalesce(nominated, F.col(f"l{i}"))
    chosen = cells.withColumn("level", nominated).where("level is not null").select(
        *keys, "level", *[F.when(F.col("level").isin([i for i, lv in _level_keys() if c in lv]), F.col(c)).alias(f"c_{c}") for c in names]
    ).distinct()
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in group]
    kept = stats.alias("s").join(chosen.alias("k"), same, "left_semi")
    tails = F.col("support") >= cfg.tail_support
    rows = kept.withColumns({"p01": F.when(tails, F.col("p01")), "p99": F.when(tails, F.col("p99"))})
    context = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"c_{c}") for c in names])), lambda k, v: v.isNotNull())
    return rows.select(
        F.concat_ws("|", "field", "equipment_type", "equipment_id", F.col("level").cast("string"), *[F.coalesce(f"c_{c}", F.lit("*")) for c in names]).alias("rule_id"),
        *keys, F.col("level").alias("context_level"), context.alias("context"), *[F.col(f"c_{c}") for c in names], "support", "p01", "p05", "median", "p95", "p99",
        F.coalesce(F.col("p01") != F.col("p05"), F.lit(False)).alias("lower_tail"), F.coalesce(F.col("p99") != F.col("p95"), F.lit(False)).alias("upper_tail"),
    )


def range_contributors(reference: DataFrame, ranges: DataFrame, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """(rule_id, charge_id, slab_no): the materials behind each range."""
    names = sorted({c for level in CONTEXTS for c in level})
    long = long_form(reference, features)
    r = ranges.select("rule_id", F.col("field").alias("rf"), F.col("equipment_id").alias("re"), *[F.col(f"c_{c}") for c in names])
    match = (F.col("field") == F.col("rf")) & (F.col("equipment_id") == F.col("re"))
    for c in names:
        match = match & (F.col(f"c_{c}").isNull() | (F.col(f"c_{c}") == F.col(c)))
    return long.join(r, match).select("rule_id", "charge_id", "slab_no")


def select_range(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each monitored value (``events``: long form with event_key) the matching range of the finest context, its status and why.

    Reasons: SELECTED, FALLBACK (a coarser context), NO_RANGE; a null value is DATA_MISSING. Equal levels go to the lesser rule_id.
    """
    picked = ("rule_id", "context_level", "p01", "p05", "p95", "p99", "lower_tail", "upper_tail")
    rows, found = events, []
    for i, level in _level_keys():  # ranges have range_support rows each: a table that is counted before it is broadcast
        keys = ["field", "equipment_id", *level]
        here = ranges.where(F.col("context_level") == i).select("field", "equipment_id", *[F.col(f"c_{c}").alias(c) for c in level], F.struct(*picked).alias(f"r{i}"))
        here = here.groupBy(*keys).agg(F.min_by(f"r{i}", F.col(f"r{i}.rule_id")).alias(f"r{i}"))
        rows = rows.join(broadcast_if_small(here), keys, "left")
        found.append(f"r{i}")
    best = rows.withColumn("r", F.coalesce(*found))
    status = P.range_status("value", "r.p01", "r.p05", "r.p95", "r.p99", F.col("r.lower_tail"), F.col("r.upper_tail"))
    reason = F.when(F.col("r").isNull() | F.col("r.rule_id").isNull(), "NO_RANGE").when(F.col("r.context_level") == 0, "SELECTED").otherwise("FALLBACK")
    return best.select(
        "event_key", "field", "equipment_id", "value", F.col("r.rule_id").alias("rule_id"), reason.alias("reason"),
        F.when(reason == "NO_RANGE", "INSUFFICIENT").otherwise(status).alias("range_status"),
    )


def evaluate_ranges(events: DataFrame, ranges: DataFrame, monitored: DataFrame) -> DataFrame:
    """Status and selection reason of every monitored field of every event, with the range that was chosen.

    ``events``: event_key, stage, equipment_type, equipment_id, values (map of field to text). ``ranges``: rule_id, field, role, stage, equipment_type,
    equipment_id, context (map of field to text), context_level, p01, p05, p95, p99, lower_tail, upper_tail. ``monitored``: field, stage, equipment_type; fields
    that only have ranges are looked at too.

    A range fits if all of its context holds; the lowest level is taken, then the least rule_id. Contexts have few shapes (sets of fields), and each shape is
    looked up by equality on its fields, so no event meets ranges of other contexts. A shape with a band (a field named ``*_band``) of which the
    event has no value yet is not sealed: where it would fit otherwise, a coarser choice is a fallback. Reasons: EXACT_CONTEXT,
    BAND_BOUNDARY_NOT_SEALED_FALLBACK, BAND_BOUNDARY_NOT_SEALED, NO_BASELINE, UNREGISTERED_EQUIPMENT, UNREGISTERED_CONTEXT and DATA_MISSING.
    """
    place = ["stage", "equipment_type"]
    fields = monitored.select("field", *place).unionByName(ranges.select("field", *place)).distinct()
    based = ranges.select("field", *place).distinct().withColumn("__based", F.lit(True))
    bands = F.filter(F.map_keys("context"), lambda k: k.endswith("_band"))
    owned = ranges.groupBy("field", *place, "equipment_id").agg(F.collect_set(F.array_sort(bands)).alias("__bands"))
    shapes = [r[0] for r in ranges.select(F.array_sort(F.map_keys("context")).alias("s")).distinct().collect()]  # a row a set of context fields
    rows = events.join(F.broadcast(fields), place).join(F.broadcast(based), ["field", *place], "left").join(broadcast_if_small(owned), ["field", *place, "equipment_id"], "left")
    value = lambda k: F.element_at("values", F.lit(k) if isinstance(k, str) else k)
    rows = rows.withColumn("value", value(F.col("field")))
    keys, found, pending = ["field", *place, "equipment_id"], [], []
    for i, shape in enumerate(sorted(shapes)):
        own = ranges.where(F.array_sort(F.map_keys("context")) == F.array(*map(F.lit, shape)).cast("array<string>"))
        picked = F.struct("context_level", "rule_id", "role", "p01", "p05", "p95", "p99", "lower_tail", "upper_tail")
        at = {f"__c{j}": k for j, k in enumerate(shape)}
        here = own.select(*keys, *[F.element_at("context", k).alias(c) for c, k in at.items()], picked.alias(f"__r{i}"))
        here = here.groupBy(*keys, *at).agg(F.min(f"__r{i}").alias(f"__r{i}"))  # the struct begins with level and rule_id
        rows = rows.withColumns({c: value(k) for c, k in at.items()}).join(broadcast_if_small(here), [*keys, *at], "left").drop(*at)
        found.append(F.col(f"__r{i}"))
        banded_, plain = [k for k in shape if k.endswith("_band")], {f"__c{j}": k for j, k in enumerate(shape) if not k.endswith("_band")}
        if banded_:
            open_ = own.select(*keys, *[F.element_at("context", k).alias(c) for c, k in plain.items()], "context_level")
            open_ = open_.groupBy(*keys, *plain).agg(F.min("context_level").alias(f"__l{i}"))
            rows = rows.withColumns({c: value(k) for c, k in plain.items()}).join(broadcast_if_small(open_), [*keys, *plain], "left").drop(*plain)
            lacking = F.greatest(*[value(k).isNull() for k in banded_], F.lit(False))
            pending.append(F.when(lacking, F.col(f"__l{i}")))
    none = F.lit(None)
    best = (F.least(*found) if len(found) > 1 else found[0]) if found else none.cast("struct<context_level:int,rule_id:string,role:string,p01:double,p05:double,p95:double,p99:double,lower_tail:boolean,upper_tail:boolean>")
    finer = F.coalesce((F.least(*pending, F.lit(1 << 30)) if pending else F.lit(1 << 30)) < F.col("r.context_level"), F.lit(False))
    rows = rows.withColumn("r", best)
    unsealed = F.coalesce(F.forall("__bands", lambda s: F.exists(s, lambda k: F.element_at("values", k).isNull())), F.lit(False))
    number = F.col("value").try_cast("double")
    reason = (
        F.when(F.col("__based").isNull(), "NO_BASELINE").when(F.col("__bands").isNull(), "UNREGISTERED_EQUIPMENT").when(F.col("value").isNull(), "DATA_MISSING")
        .when(F.col("r").isNull(), F.when(unsealed, "BAND_BOUNDARY_NOT_SEALED").otherwise("UNREGISTERED_CONTEXT"))
        .when((F.col("r.role") != "PRODUCT_STATE_REFERENCE") & (number.isNull() | F.isnan(number)), "DATA_MISSING").when(finer, "BAND_BOUNDARY_NOT_SEALED_FALLBACK").otherwise("EXACT_CONTEXT")
    )
    exact = P.range_status(number, "r.p01", "r.p05", "r.p95", "r.p99", F.col("r.lower_tail"), F.col("r.upper_tail"))
    status = (
        F.when(F.col("reason").isin("NO_BASELINE", "BAND_BOUNDARY_NOT_SEALED"), "INSUFFICIENT_EVIDENCE").when(F.col("reason").startswith("UNREGISTERED"), "UNREGISTERED_CONDITION")
        .when(F.col("reason") == "DATA_MISSING", "DATA_MISSING").when(F.col("r.role") == "PRODUCT_STATE_REFERENCE", "REFERENCE_ONLY").otherwise(exact)
    )
    chosen = F.when(F.col("__bands").isNotNull() & F.col("value").isNotNull(), F.col("r.rule_id"))
    return rows.withColumn("reason", reason).select("event_key", "stage", "equipment_type", "equipment_id", "field", "value", chosen.alias("rule_id"), status.alias("range_status"), "reason")


def column_profile(rows: DataFrame, numeric: tuple[str, ...], categories: tuple[str, ...]) -> DataFrame:
    """(column, total, missing, distinct, p05, median, p95) of each column, from one pass over an unpivoted table."""
    items = [F.struct(F.lit(c).alias("column"), F.when(P.finite(c), F.col(c)).alias("v"), F.lit(None).cast("string").alias("s")) for c in numeric]
    items += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("v"), F.when(~P.missing(c), F.col(c)).alias("s")) for c in categories]
    long = rows.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    per_value = long.groupBy("column", "v", "s").agg(F.count("*").alias("n"))
    empty = F.col("v").isNull() & F.col("s").isNull()
    counts = per_value.groupBy("column").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(~empty).alias("distinct")
    )
    return counts.join(type1_quantiles(long, ["column"], "v", {"p05": 0.05, "median": 0.5, "p95": 0.95}), "column", "left")


def category_levels(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in categories]))
    return rows.select(items.alias("x")).select("x.*").where(~P.missing("level")).groupBy("column", "level").agg(F.count("*").alias("n"))


def drift(split: DataFrame, features: tuple[Feature, ...] = FEATURES) -> DataFrame:
    """Per field and split: rows, missing rate and quantiles; reference values count only if known as of the cut."""
    items = []
    for f in features:
        known = (F.col("split") != "reference") | P.available_by(f.date, "as_of")
        items.append(F.struct(F.lit(f.name).alias("field"), F.when(known & P.finite(f.name), F.col(f.name)).alias("value")))
    long = split.select("split", F.explode(F.array(*items)).alias("x")).select("split", "x.*")
    counts = long.groupBy("field", "split").agg(F.count("*").alias("rows"), F.round(F.count_if(F.col("value").isNull()) / F.count("*"), 9).alias("missing_rate"))
    return counts.join(type1_quantiles(long, ["field", "split"], "value", {"p05": 0.05, "median": 0.5, "p95": 0.95}), ["field", "split"], "left")
