"""Quality-risk rules: label-free candidates, stratified 2x2 statistics, false-discovery control, bootstrap, grades."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.config import ADJUSTMENTS, CATEGORIES, DEFECT, FEATURES, INTERACTIONS, STAGES, AnalysisConfig
from millwright.functions import predicates as P
from millwright.functions.digests import counted
from millwright.functions.statistics import erfc, wilson
from millwright.operators.ranges import field_bins
from millwright.work import broadcast_if_small, written

NUMERIC = tuple(f.name for f in FEATURES)


def _numeric_long(rows: DataFrame, fields: tuple[str, ...], keep: list) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(P.finite(f), F.col(f)).alias("value")) for f in fields]))
    return rows.select(*keep, items.alias("x")).select(*keep, "x.field", "x.value").where("value is not null")


def bins(discovery: DataFrame, cfg: AnalysisConfig) -> tuple[DataFrame, DataFrame]:
    """Bins of the numeric family and of the interaction family: no label is read."""
    fields = tuple(sorted({f for pair in INTERACTIONS for f in pair}))
    return field_bins(_numeric_long(discovery, NUMERIC, []), cfg.numeric_bins), field_bins(_numeric_long(discovery, fields, []), cfg.interaction_bins)


def _binned(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each value's bin: the first whose upper cut is not below it; values outside all bins are in none."""
    packed = cuts.groupBy("field").agg(F.sort_array(F.collect_list(F.struct("bin", "lower", "upper", "lower_inclusive"))).alias("bins"))
    hit = F.filter("bins", lambda b: ((F.col("value") > b["lower"]) | (b["lower_inclusive"] & (F.col("value") == b["lower"]))) & (F.col("value") <= b["upper"]))
    # a row a field, each with its few bins: as many as the configuration names
    return long.join(F.broadcast(packed), "field").withColumn("bin", F.get(hit, 0)["bin"].cast("string")).drop("bins").where("bin is not null")


def memberships(rows: DataFrame, numeric: DataFrame, coarse: DataFrame) -> DataFrame:
    """(row key, family, field, bin, judge, adjustment columns): the candidate of each family and field that a row is in.

    An interaction needs two bins of each of its fields at least; a predicate that no row is in is no candidate.
    """
    keep = ["charge_id", "slab_no", "judge", *sorted({c for level in ADJUSTMENTS for c in level})]
    one = _binned(_numeric_long(rows, NUMERIC, keep), numeric).withColumn("family", F.lit("NUMERIC"))
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("bin")) for c in CATEGORIES]))
    two = rows.select(*keep, items.alias("x")).select(*keep, "x.field", "x.bin", F.lit("CATEGORICAL").alias("family")).where("bin is not null")
    fields = tuple(sorted({f for pair in INTERACTIONS for f in pair}))
    wide = _binned(_numeric_long(rows, fields, keep), coarse).groupBy(*keep).pivot("field", list(fields)).agg(F.first("bin"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("field"), F.concat(F.col(a), F.lit("|"), F.col(b)).alias("bin")) for a, b in INTERACTIONS]))
    three = wide.select(*keep, pairs.alias("x")).select(*keep, "x.field", "x.bin", F.lit("INTERACTION").alias("family")).where("bin is not null")
    several = coarse.groupBy("field").agg(F.count("*").alias("__n")).where("__n >= 2")  # a row a field
    for k in (1, 2):
        three = three.join(F.broadcast(several.select(F.col("field").alias("__side"))), F.split_part("field", F.lit("|"), F.lit(k)) == F.col("__side"), "left_semi")
    columns = [*keep, "family", "field", "bin"]
    return one.select(*columns).unionByName(two.select(*columns)).unionByName(three.select(*columns))


def stratum_tables(members: DataFrame) -> DataFrame:
    """(family, field, bin, level, stratum, a, b, c, d): the 2x2 table of every candidate in every stratum of every level.

    One pass: counts by cell, then the comparator is the stratum's total less the cell. A field does not adjust itself.
    """
    levels = []
    for i, level in enumerate(ADJUSTMENTS):
        parts = [F.when(F.col("field") == c, F.lit("")).otherwise(F.concat(F.lit(f"{c}="), F.col(c))) for c in level]
        missing = F.lit(False)
        for c in level:
            missing = missing | ((F.col("field") != c) & F.col(c).isNull())
        levels.append(F.struct(F.lit(i).alias("level"), F.when(~missing, F.concat_ws(";", *parts) if parts else F.lit("all")).alias("stratum")))
    rows = members.select("family", "field", "bin", (F.col("judge") == DEFECT).cast("int").alias("bad"), F.explode(F.array(*levels)).alias("x"))
    rows = rows.select("family", "field", "bin", "bad", "x.*").where("stratum is not null")
    cells = rows.groupBy("family", "field", "level", "stratum", "bin").agg(F.sum("bad").alias("a"), F.count("*").alias("n"))
    whole = Window.partitionBy("family", "field", "level", "stratum")
    total = cells.withColumn("tn", F.sum("n").over(whole)).withColumn("ta", F.sum("a").over(whole))
    here = total.select("family", "field", "level", "stratum", "bin", "a", (F.col("n") - F.col("a")).alias("b"), (F.col("ta") - F.col("a")).alias("c"), (F.col("tn") - F.col("n") - F.col("ta") + F.col("a")).alias("d"))
    return here


def choose_level(tables: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """(family, field, bin, level, kind): the first level with enough informative strata and support on both sides, else the last."""
    told = (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0)
    by = tables.groupBy("family", "field", "bin", "level").agg(
        F.count_if(told).alias("strata"), F.sum(F.when(told, F.col("a") + F.col("b")).otherwise(0)).alias("mine"), F.sum(F.when(told, F.col("c") + F.col("d")).otherwise(0)).alias("others")
    )
    good = (F.col("strata") >= cfg.informative_strata) & (F.col("mine") >= cfg.discovery_support) & (F.col("others") >= cfg.discovery_support)
    return by.groupBy("family", "field", "bin").agg(F.min(F.when(good, F.col("level"))).alias("first"), F.max("level").alias("last")).select(
        "family", "field", "bin", F.coalesce("first", "last").alias("level"), F.when(F.col("first").isNotNull(), "STRATIFIED").otherwise("UNADJUSTED_FALLBACK").alias("kind")
    )


KEYS = ["family", "field", "bin"]
#: Fixed reasons that leave a rule without a grade.
INSUFFICIENT = ("LOW_SUPPORT", "LOW_DEFECT_COUNT", "NO_INFORMATIVE_STRATA", "NO_VARIATION", "NON_FINITE_ESTIMATE", "ZERO_COMPARATOR_RISK")


def weights(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """(family, field, bin, stratum, w): the size of each informative stratum of a candidate's level, among the discovery rows."""
    mine = found.join(chosen.drop("kind"), [*KEYS, "level"]).where("a + b > 0 and c + d > 0")
    return mine.select(*KEYS, "stratum", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).cast("double").alias("w"))


def sums(tables: DataFrame, weighted: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for every candidate: its counts over informative strata that have a weight, and the sums that its metrics are made of.

    Ratio cells get 0.5 in strata with a zero cell only; the test's sums use raw cells. A candidate without strata has zeros.
    """
    t = tables.join(chosen.drop("kind"), [*KEYS, "level"]).join(weighted, [*KEYS, "stratum"]).where("a + b > 0 and c + d > 0").withColumns({f"{x}_": F.col(x).cast("double") for x in "abcd"})
    a, b, c, d = (F.col(f"{x}_") for x in "abcd")
    n = a + b + c + d
    fix = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    fa, fb, fc, fd = a + fix, b + fix, c + fix, d + fix
    fn = fa + fb + fc + fd
    by = t.groupBy(*KEYS).agg(
        F.sum("a").alias("defects"), F.sum(F.col("a") + F.col("b")).alias("support"), F.sum(F.col("c") + F.col("d")).alias("others"), F.count("*").alias("strata"),
        (F.sum(F.col("w") * a / (a + b)) / F.sum("w")).alias("mine_rate"), (F.sum(F.col("w") * c / (c + d)) / F.sum("w")).alias("other_rate"),
        F.sum(fa * (fc + fd) / fn).alias("num"), F.sum(fc * (fa + fb) / fn).alias("den"),
        F.sum(a - (a + b) * (a + c) / n).alias("diff"), F.sum(F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).otherwise(0.0)).alias("var"),
    )
    return chosen.join(by, KEYS, "left").na.fill(0, ["defects", "support", "others", "strata"])


def metrics(summed: DataFrame, cfg: AnalysisConfig, support: int, defects: int) -> DataFrame:
    """Crude and adjusted rates, risk difference, Mantel-Haenszel ratio, test and reason of each candidate of :func:`sums`.

    Too few informative strata (a stratified candidate needs ``informative_strata``, another one) or too little support on either
    side give no estimates and p = 1, which takes part in the false-discovery control.
    """
    few = F.col("strata") < F.when(F.col("kind") == "STRATIFIED", cfg.informative_strata).otherwise(1)
    low = (F.col("support") < support) | (F.col("others") < support)
    told = lambda x: F.when(~(few | low), x)
    z = F.abs(F.col("diff")) / F.sqrt(F.col("var")) / F.lit(2.0**0.5)
    varied = F.coalesce(F.col("var") > 0, F.lit(False))
    reason = (
        F.when(few, "NO_INFORMATIVE_STRATA").when(low, "LOW_SUPPORT").when(F.col("defects") < defects, "LOW_DEFECT_COUNT").when(~varied, "ZERO_VARIANCE").otherwise("NONE")
    )
    lower, upper = wilson(F.col("defects"), F.col("support"), cfg.wilson_z)
    return summed.select(
        *KEYS, "level", "kind", "support", "defects", F.when(F.col("support") > 0, F.col("defects") / F.col("support")).alias("crude"), lower.alias("crude_low"), upper.alias("crude_high"),
        told(F.col("mine_rate")).alias("adjusted"), told(F.col("other_rate")).alias("comparator"), told(F.col("mine_rate") - F.col("other_rate")).alias("rd"),
        told(F.when(F.col("den") > 0, F.col("num") / F.col("den"))).alias("rr"),
        F.when(~(few | low) & varied, F.least(F.lit(1.0), erfc(z))).otherwise(1.0).alias("p"), reason.alias("reason"),
    )


def benjamini_hochberg(rows: DataFrame, family: str, p: str, order: tuple[str, ...]) -> DataFrame:
    """Adds q: the least of p * n / rank over this and later ranks, at most 1; ties in p are ordered by ``order``."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(family).orderBy(p, *order)))
    ranked = ranked.withColumn("__n", F.count("*").over(Window.partitionBy(family)))
    later = Window.partitionBy(family).orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(later))).drop("__rank", "__n")


def rule_metrics(found: DataFrame, held: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Discovery and confirmation metrics of every candidate from its :func:`sums` in both splits, q-values included."""
    one = benjamini_hochberg(metrics(found, cfg, cfg.discovery_support, cfg.caution_defects), "family", "p", ("field", "bin"))
    two = metrics(held, cfg, cfg.confirmation_support, cfg.confirmation_defects)
    return one.join(two.select(*KEYS, *[F.col(c).alias(f"c_{c}") for c in ("support", "defects", "adjusted", "comparator", "rd", "rr", "reason")]), KEYS, "left")


def grade(cfg: AnalysisConfig, ci_lower: str | None = None):
    """Grade of a metric row; with ``ci_lower`` (the bootstrap's lower bound) DANGER needs it above 1, else it is the grade before the bootstrap."""
    told = lambda x: F.coalesce(x, F.lit(False))
    caution = told((F.col("rr") >= cfg.rr_caution) & (F.col("rd") >= cfg.rd_caution) & (F.col("q") <= cfg.q_caution))
    danger = caution & told((F.col("defects") >= cfg.danger_defects) & (F.col("rr") >= cfg.rr_danger) & (F.col("rd") >= cfg.rd_danger) & (F.col("q") <= cfg.q_danger))
    if ci_lower:
        danger = danger & told(F.col(ci_lower) > 1)
    again = told((F.col("c_rr") > 1) & (F.col("c_rd") > 0))
    poor = F.col("reason").isin(*INSUFFICIENT) | told(F.col("c_reason").isin(*INSUFFICIENT)) | F.col("c_reason").isNull()
    return (
        F.when(poor, "INSUFFICIENT_EVIDENCE").when(danger & again & (F.col("c_rr") >= cfg.confirm_rr_danger) & (F.col("kind") == "STRATIFIED"), "DANGER")
        .when(caution & again, "CAUTION").when(caution, "UNCONFIRMED").otherwise("NORMAL")
    )


def graded_rules(ruled: DataFrame, cfg: AnalysisConfig, intervals: DataFrame | None = None) -> DataFrame:
    """The rule table: metrics, grade, scope, early-warning flag and, given :func:`bootstrap_intervals`, their bounds and reasons."""
    rows = ruled.withColumn("rule_id", F.concat_ws("|", *KEYS))
    if intervals is not None:
        rows = rows.join(intervals.select("rule_id", "rr_low", "rr_high", F.col("reason").alias("ci_reason")), "rule_id", "left")
        rows = rows.withColumn("reason", F.when(F.col("reason") == "NONE", F.coalesce("ci_reason", "reason")).otherwise(F.col("reason"))).drop("ci_reason")
    own = (F.col("family") == "CATEGORICAL") & (F.col("field") == "furnace_no")
    return rows.withColumns({
        "grade": grade(cfg, "rr_low" if intervals is not None else None), "scope": F.when(own, "EQUIPMENT_SPECIFIC").otherwise("PROCESS_GLOBAL"),
        "equipment_id": F.when(own, F.col("bin")).otherwise("ALL"), "early_warning": first_stage() != STAGES[-1][0],
    })


#: Stages of the categories; monitored fields have theirs in ``FEATURES``, results and other fields of pickling are known last.
CATEGORY_STAGES = {"steel_grade": "CAST_RECORDED", "steel_usage": "CAST_RECORDED", "furnace_no": "FURNACE_CHARGED", "f_jangip_gubun": "FURNACE_CHARGED"}


def first_stage() -> Column:
    """The stage at which all fields of a rule are known: the latest of theirs; a field of no listed stage is known with the result."""
    ranks = dict(STAGES)
    at = F.create_map(*[F.lit(x) for f, s in ({f.name: f.stage for f in FEATURES} | CATEGORY_STAGES).items() for x in (f, ranks[s])])
    latest = F.array_max(F.transform(F.split("field", r"\|"), lambda f: F.coalesce(F.element_at(at, f), F.lit(STAGES[-1][1]))))
    return F.element_at(F.create_map(*[F.lit(x) for s, r in STAGES for x in (r, s)]), latest)


def merged_display(rules: DataFrame, numeric: DataFrame) -> DataFrame:
    """(rule_id, run, members): maximal runs of two or more neighbouring numeric bins with one grade."""
    r = rules.where("family = 'NUMERIC'").select("rule_id", "field", "grade", F.col("bin").cast("int").alias("bin")).join(numeric.select("field", "bin", "lower", "upper"), ["field", "bin"])
    w = Window.partitionBy("field", "grade").orderBy("bin")
    breaks = r.withColumn("new", F.coalesce((F.lag("upper").over(w) != F.col("lower")).cast("int"), F.lit(1)))
    runs = breaks.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = runs.groupBy("field", "grade", "run").agg(F.sort_array(F.collect_list("rule_id")).alias("members")).where("size(members) >= 2")
    return runs.join(sized, ["field", "grade", "run"]).select("rule_id", "members")


def charge_blocks(members: DataFrame, weighted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(rule_id, charge_id, stratum, a, b, c, d): each charge's part of a rule's informative strata, summed before any resampling."""
    part = ["family", "field", "level", "stratum"]
    rules = weighted.join(chosen.select(*KEYS, "level"), KEYS).select(*part, F.col("bin").alias("rule_bin"), F.concat_ws("|", *KEYS).alias("rule_id"))
    levels = F.broadcast(chosen.select("family", "field", "level").distinct())  # a few rows a field
    rows = stratum_rows(members).join(levels, ["family", "field", "level"], "left_semi").repartition(*part, "charge_id")
    # rows are dealt once by charge and stratum; a rule's own and other rows there are a bin's and the rest
    cells = rows.groupBy(*part, "charge_id", "bin").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
    whole = cells.groupBy(*part, "charge_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("bad", "n")))).alias("bins"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    mine = F.element_at("bins", F.col("rule_bin"))
    a, n = F.coalesce(mine["bad"], F.lit(0)), F.coalesce(mine["n"], F.lit(0))
    return whole.join(broadcast_if_small(rules), part).select(
        "rule_id", "charge_id", "stratum",
        a.alias("a"), (n - a).alias("b"), (F.col("bad") - a).alias("c"), (F.col("n") - F.col("bad") - n + a).alias("d"),
    )


def stratum_rows(members: DataFrame) -> DataFrame:
    levels = []
    for i, level in enumerate(ADJUSTMENTS):
        parts = [F.when(F.col("field") == c, F.lit("")).otherwise(F.concat(F.lit(f"{c}="), F.col(c))) for c in level]
        levels.append(F.struct(F.lit(i).alias("level"), (F.concat_ws(";", *parts) if parts else F.lit("all")).alias("stratum")))
    rows = members.select("family", "field", "bin", "charge_id", (F.col("judge") == DEFECT).cast("int").alias("bad"), F.explode(F.array(*levels)).alias("x"))
    return rows.select("family", "field", "bin", "charge_id", "bad", "x.level", "x.stratum")


#: Replicates that one group of the resampling draws at least; groups that all keys make together at least, if there are replicates enough; rows of a key up to which its charges
#: are numbered where they are counted; places drawn at a time, and hashed one by one where they are fewer; rows that a parcel is made from at most; rows multiplied at a time.
CHUNK, GROUPS, IN_PLACE, HASHED, SINGLY, PARCEL, SLICE = 25, 64, 8_000_000, 1 << 16, 1 << 13, 1 << 18, 1 << 20


def draw_counts(seed: bytes, replicate: int, n: int) -> np.ndarray:
    """How often a replicate draws each of ``n`` places: draw i takes the first 8 bytes of SHA-256(seed, replicate, i) modulo n."""
    counts, head, step = np.zeros(n, np.int32), seed + replicate.to_bytes(8, "big"), max(HASHED, n // 8)
    for start in range(0, n, step):
        end = min(n, start + step)
        if end - start < SINGLY:
            numbers = np.frombuffer(b"".join([sha256(head + i.to_bytes(8, "big")).digest() for i in range(start, end)]), ">u8")[::4]
        else:
            numbers = counted(head, start, end)
        counts += np.bincount((numbers % np.uint64(n)).astype(np.int64), minlength=n).astype(np.int32)
    return counts


def parcels(rows: DataFrame, key: str, by: str, values: tuple[str, ...]) -> DataFrame:
    """(key, parcel): the rows (key, charge_id or its number, by, values) of a key that lie together, packed as one compressed Arrow table.

    Rows of a few bytes of news each carry long texts; sorted by charge and packed where they lie, they are shuffled at a fraction of that. A parcel
    holds at most ``PARCEL`` rows.
    """
    names = [key, "charge_id", by, *values]

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([(key, "ascending"), ("charge_id", "ascending")])
        runs = pc.run_end_encode(table.column(key).combine_chunks())
        start, keys, made = 0, [], []
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([table.schema.field(c) for c in names[1:]]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(start, end - start).select(names[1:]))
            start, keys, made = end, [*keys, name], [*made, sink.getvalue().to_pybytes()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(made, pa.binary())], names=[key, "parcel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PARCEL:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return rows.select(key, "charge_id", by, *[F.col(v).cast("long").alias(v) for v in values]).mapInArrow(run, f"{key} string, parcel binary")


def replicate_sums(blocks: DataFrame, key: str, by: str, values: tuple[str, ...], seed: Column, replicates: int, in_place: int = IN_PLACE) -> DataFrame:
    """(key, replicate, by, *values): ``values`` summed by ``by`` over charges drawn with replacement, as many as a key has.

    ``blocks`` has key, charge_id, by and whole numbers. A charge's place is its rank by id, and draws depend on seed, replicate and ordinal only, not
    on how the work is dealt. A group is a key and a part of its replicates: it holds the key's blocks, counts its draws in place and multiplies
    them with the blocks, so draws are never rows; the blocks come to it in :func:`parcels`, once a group, so few keys make many groups and many keys
    one each. Keys with more than ``in_place`` rows come with their charges numbered before (:func:`placed`).
    """
    sizes = written(blocks.groupBy(key).agg(F.count("*").alias("__rows")).withColumn("__seed", seed), "bootstrap-keys")
    few = sizes.count()
    wanted = max(GROUPS, 2 * blocks.sparkSession.sparkContext.defaultParallelism)
    chunks = max(1, min(-(-replicates // CHUNK), -(-wanted // max(1, few))))
    chunk = -(-replicates // chunks)
    groups = sizes.select(key, "__seed", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("__chunk"))
    # a group is few bytes and much hashing: tasks by the number of groups, not by their bytes
    packed = parcels(blocks.join(broadcast_if_small(sizes.where(F.col("__rows") <= in_place).select(key)), key, "left_semi"), key, by, values)
    if sizes.where(F.col("__rows") > in_place).limit(1).count():
        large = blocks.join(broadcast_if_small(sizes.where(F.col("__rows") > in_place).select(key)), key, "left_semi")
        numbered = large.join(placed(large, key), [key, "charge_id"]).withColumn("charge_id", F.col("place"))
        packed = packed.unionByName(parcels(numbered, key, by, values))
    rows = packed.join(broadcast_if_small(groups), key).repartition(max(1, min(2 * chunks * few, 4096)), key, "__seed", "__chunk")
    schema = f"{key} string, replicate long, {by} string, " + ", ".join(f"{v} long" for v in values)
    names = [key, "replicate", by, *values]

    def run(group: tuple, table: pa.Table) -> pa.Table:
        charges, codes, cells, texts = [], [], [[] for _ in values], {}
        for held in table.column("parcel").chunks:
            for parcel in held:
                one = pa.ipc.open_stream(parcel.as_buffer()).read_all()
                charges.append(one.column("charge_id").combine_chunks())
                strata = one.column(by).combine_chunks().dictionary_encode()
                codes.append(narrow(np.array([texts.setdefault(t, len(texts)) for t in strata.dictionary.to_pylist()])[strata.indices.to_numpy()]))
                for c, v in zip(cells, values, strict=True):
                    c.append(narrow(one.column(v).to_numpy()))
        if pa.types.is_integer(charges[0].type):
            place = np.concatenate([c.to_numpy() for c in charges])
        else:
            ids = pa.chunked_array(charges).combine_chunks().dictionary_encode()
            rank = np.empty(len(ids.dictionary), np.int32)
            rank[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
            place = rank[ids.indices.to_numpy()]
        place, stratum, cells, charges, ids = narrow(place), np.concatenate(codes), [np.concatenate(c) for c in cells], None, None
        n, first, out = int(place.max()) + 1, chunk * group[2].as_py(), []  # every place has a row
        for replicate in range(first, min(replicates, first + chunk)):
            counts, sums = draw_counts(bytes.fromhex(group[1].as_py()), replicate, n), [np.zeros(len(texts)) for _ in values]
            for at in range(0, len(place), SLICE):
                part = slice(at, at + SLICE)
                times = counts[place[part]].astype(np.int64)
                for total, c in zip(sums, cells, strict=True):
                    total += np.bincount(stratum[part], times * c[part], len(texts))  # exact to 2^53
            out.append([np.rint(total).astype(np.int64) for total in sums])
        found, shown = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64) for _ in values], pa.array(list(texts), pa.string())
        columns = [pa.array([group[0].as_py()] * len(found[0]), pa.string()), np.repeat(np.arange(first, first + len(out)), len(texts)), pa.concat_arrays([shown] * len(out) or [shown.slice(0, 0)]), *found]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return rows.groupBy(key, "__seed", "__chunk").applyInArrow(run, schema)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds the least and the greatest of them."""
    low, high = (int(numbers.min()), int(numbers.max())) if len(numbers) else (0, 0)
    return numbers.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def placed(blocks: DataFrame, key: str) -> DataFrame:
    """(key, charge_id, place): the rank of each charge of a key by its id. Charges are numbered in two levels by a range partitioning of their ids, no task orders them all."""
    charges = written(blocks.select(key, "charge_id").distinct().repartitionByRange(key, "charge_id").withColumn("__head", F.spark_partition_id()), "bootstrap-charges")
    heads = charges.groupBy(key, "__head").agg(F.count("*").alias("__n"))
    before = heads.select(key, "__head", F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(key, "__head").orderBy("charge_id")) - 1
    return charges.withColumn("__place", place).join(before, [key, "__head"]).select(key, "charge_id", (F.col("__place") + F.col("__before")).alias("place"))


def bootstrap_applicable(cfg: AnalysisConfig) -> Column:
    """Candidates that get an interval: enough support and defects, and a positive finite ratio with both rates."""
    rr = F.col("rr")
    told = F.col("adjusted").isNotNull() & F.col("comparator").isNotNull() & rr.isNotNull() & ~F.isnan(rr) & (rr < float("inf")) & (rr > 0)
    return F.coalesce((F.col("support") >= cfg.discovery_support) & (F.col("defects") >= cfg.caution_defects) & told, F.lit(False))


def bootstrap_intervals(blocks: DataFrame, replicates: int, valid: int, material: str, in_place: int = IN_PLACE) -> DataFrame:
    """(rule_id, rr_low, rr_high, valid, reason): percentile interval of the Mantel-Haenszel ratio over charges drawn with replacement."""
    nul = F.unhex(F.lit("00")).cast("string")
    seed = F.sha2(F.concat(F.lit(material), nul, F.col("rule_id"), nul, F.lit("rule-ci-v1")), 256)
    cells = replicate_sums(blocks, "rule_id", "stratum", ("a", "b", "c", "d"), seed, replicates, in_place).where("a + b + c + d > 0")
    fix = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    fixed = cells.select("rule_id", "replicate", *[(F.col(x) + fix).alias(x) for x in "abcd"])
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    ratios = fixed.groupBy("rule_id", "replicate").agg(F.sum(F.col("a") * (F.col("c") + F.col("d")) / n).alias("num"), F.sum(F.col("c") * (F.col("a") + F.col("b")) / n).alias("den"))
    ratios = ratios.where("den > 0").select("rule_id", (F.col("num") / F.col("den")).alias("rr")).where("rr > 0")
    ends = ratios.groupBy("rule_id").agg(F.count("*").alias("valid"), F.expr("percentile_disc(array(0.025, 0.975)) within group (order by rr)").alias("ends"))
    every = blocks.select("rule_id").distinct().join(ends, "rule_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    enough = F.col("valid") >= valid
    return every.select(
        "rule_id", F.when(enough, F.col("ends")[0]).alias("rr_low"), F.when(enough, F.col("ends")[1]).alias("rr_high"), "valid",
        F.when(enough, "NONE").otherwise("TOO_FEW_VALID_BOOTSTRAPS").alias("reason"),
    )


def memberships_by_status(events: DataFrame, terms: DataFrame, keep_others: bool = False) -> DataFrame:
    """(event_key, rule_id, grade, status) of every rule that an event is in the scope of; with ``keep_others`` an event of no rule's stage once, without rule.

    ``events``: event_key, stage, equipment_type, equipment_id and values (map of field to text; a missing field has no entry or a null).
    ``terms``: one row for each field of a rule's predicate: rule_id, grade, stage, equipment_type, scope, equipment_id, field, lower,
    lower_inclusive, upper, upper_inclusive, accepted (array of text; null for an interval). A rule MATCHED if all its terms hold, is
    DATA_MISSING if any of its values is, else NOT_MATCHED. The rule table (a few hundred rows by construction) is packed to one row a rule and
    joined by stage and equipment type.
    """
    packed = terms.groupBy("rule_id", "grade", "stage", "equipment_type", "scope", F.col("equipment_id").alias("own")).agg(
        F.collect_list(F.struct("field", "lower", "lower_inclusive", "upper", "upper_inclusive", "accepted")).alias("terms")
    )
    inside = (F.col("scope") != "EQUIPMENT_SPECIFIC") | (F.col("own") == F.col("equipment_id"))
    # a value is read as a number once an event, not for each rule and condition
    events = events.withColumn("__numbers", F.transform_values("values", lambda _, v: v.try_cast("double")))
    rows = events.join(broadcast_if_small(packed), ["stage", "equipment_type"], "left" if keep_others else "inner").where(inside | F.col("rule_id").isNull() if keep_others else inside)
    text = lambda t: F.element_at("values", t["field"])
    number = lambda t: F.element_at("__numbers", t["field"])
    lacks = lambda t: text(t).isNull() | (t["accepted"].isNull() & (number(t).isNull() | F.isnan(number(t))))
    holds = lambda t: F.when(t["accepted"].isNotNull(), P.in_values(text(t), t["accepted"])).otherwise(
        P.in_interval(number(t), t["lower"], t["lower_inclusive"], t["upper"], t["upper_inclusive"])
    )
    status = F.when(F.col("rule_id").isNull(), F.lit(None)).when(F.exists("terms", lacks), "DATA_MISSING").when(F.forall("terms", holds), "MATCHED").otherwise("NOT_MATCHED")
    return rows.select("event_key", "rule_id", "grade", "equipment_id", status.alias("status"))


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` (rule_id, family, terms: array of struct field, bin) with one of each family and canonical predicate: the least rule_id.

    The canonical predicate is the terms in the order of their fields, as JSON.
    """
    canonical = F.to_json(F.array_sort("terms"))
    ranked = candidates.withColumn("predicate", canonical).withColumn("__k", F.row_number().over(Window.partitionBy("family", "predicate").orderBy("rule_id")))
    return ranked.where("__k = 1").drop("__k")


def contributors(members: DataFrame, tables: DataFrame, weighted: DataFrame, chosen: DataFrame) -> DataFrame:
    """(rule_id, charge_id, slab_no): a split's rows in each candidate's bin, of the informative strata of the candidate's level that have a weight."""
    levels = []
    for i, level in enumerate(ADJUSTMENTS):
        parts = [F.when(F.col("field") == c, F.lit("")).otherwise(F.concat(F.lit(f"{c}="), F.col(c))) for c in level]
        levels.append(F.struct(F.lit(i).alias("level"), (F.concat_ws(";", *parts) if parts else F.lit("all")).alias("stratum")))
    rows = members.select(*KEYS, "charge_id", "slab_no", F.explode(F.array(*levels)).alias("x")).select(*KEYS, "charge_id", "slab_no", "x.level", "x.stratum")
    told = tables.where("a + b > 0 and c + d > 0").select(*KEYS, "level", "stratum").join(chosen.select(*KEYS, "level"), [*KEYS, "level"]).join(weighted.select(*KEYS, "stratum"), [*KEYS, "stratum"])
    return rows.join(told, [*KEYS, "level", "stratum"], "left_semi").select(F.concat_ws("|", *KEYS).alias("rule_id"), "charge_id", "slab_no")


def stratum_evidence(tables: DataFrame, weighted: DataFrame, chosen: DataFrame, split: str) -> DataFrame:
    """(rule_id, split, stratum, weight, candidates, comparators): the informative strata behind a candidate's metrics of a split, with the weight of discovery."""
    told = tables.join(chosen.drop("kind"), [*KEYS, "level"]).join(weighted, [*KEYS, "stratum"]).where("a + b > 0 and c + d > 0")
    return told.select(
        F.concat_ws("|", *KEYS).alias("rule_id"), F.lit(split).alias("split"), "stratum", F.col("w").alias("weight"), (F.col("a") + F.col("b")).alias("candidates"), (F.col("c") + F.col("d")).alias("comparators")
    )


def aggregate_lineage(ranges: DataFrame, discovery: DataFrame, confirmation: DataFrame) -> DataFrame:
    """(artifact, rule_id, split, selection, filters, transformations, charge_id, slab_no): the materials behind every range and every rule, by split."""
    names = lambda *x: F.array(*map(F.lit, x))
    finite = F.when(F.split("rule_id", r"\|")[0] != "CATEGORICAL", names("FINITE_VALUE")).otherwise(F.array().cast("array<string>"))

    def part(rows: DataFrame, artifact: str, split: str, selection: str, filters: Column, made: Column) -> DataFrame:
        return rows.select(F.lit(artifact).alias("artifact"), "rule_id", F.lit(split).alias("split"), F.lit(selection).alias("selection"), filters.alias("filters"), made.alias("transformations"), "charge_id", "slab_no")

    rest = "FIXED_POPULATION_STRATA_MINUS_CANDIDATE"
    before, after = names("LABEL_AVAILABLE_AND_MATURE"), names("INFORMATIVE_STRATA_ONLY")
    return (
        part(ranges, "equipment_operating_ranges", "REFERENCE", "NOT_APPLICABLE", names("STAGE_AVAILABLE_AT_AS_OF", "FINITE_VALUE"), names("TYPE1_QUANTILE"))
        .unionByName(part(confirmation, "quality_risk_intervals", "CONFIRMATION", rest, F.concat(before, finite, names("PREDICATE_MATCH", "FIXED_DISCOVERY_STRATA"), after), names("WILSON_SCORE_INTERVAL")))
        .unionByName(part(discovery, "quality_risk_intervals", "DISCOVERY", rest, F.concat(before, finite, names("PREDICATE_MATCH"), after), names("WILSON_SCORE_INTERVAL", "BENJAMINI_HOCHBERG_FDR")))
    )
