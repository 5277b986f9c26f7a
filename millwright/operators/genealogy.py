"""Genealogy: key checks, quarantine, the casting-furnace-pickling chain and its lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions import predicates as P

#: Fixed reasons, most severe first: a record is quarantined under its first one.
REASONS = (
    "MISSING_SM_CC_KEY", "MISSING_FUR_HR_KEY", "MISSING_AP_HR_COIL_ID", "MISSING_FUR_HR_COIL_ID", "MISSING_AP_PROD_ID", "DUPLICATE_SM_CC_KEY",
    "DUPLICATE_FUR_HR_KEY", "DUPLICATE_AP_KEY", "DUPLICATE_FUR_HR_COIL_KEY", "DUPLICATE_AP_PROD_ID", "INVALID_FUR_HR_DATE",
    "IMPOSSIBLE_STAGE_DATE_ORDER", "UNLINKED_SM_CC", "UNLINKED_FUR_HR", "UNLINKED_AP",
)


def mark_ambiguous(rows: DataFrame, keys: list[str], flag: str, eligible=None) -> DataFrame:
    """Flags every eligible row whose key another eligible row has; none of them is the right one.

    Keys are counted over eligible rows, and only those join the repeated keys; rows that are not eligible (missing keys) never meet in one task.
    """
    ok = F.coalesce(F.lit(True) if eligible is None else eligible, F.lit(False))
    twice = rows.where(ok).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys, F.lit(True).alias(flag))
    flagged = rows.where(ok).join(twice, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    if eligible is None:
        return flagged.select(*rows.columns, flag)
    return flagged.select(*rows.columns, flag).unionByName(rows.where(~ok).withColumn(flag, F.lit(False)))


def quality_subset_violations(quality: DataFrame, replay: DataFrame) -> DataFrame:
    """(charge_id, slab_no, problem) of quality rows that are NOT_IN_REPLAY, or whose coil is not the replay row's (COIL_DIFFERS)."""
    known = replay.select("charge_id", "slab_no", F.col("hr_coil_id").alias("__coil"), F.lit(True).alias("__known"))
    rows = quality.join(known, ["charge_id", "slab_no"], "left")
    problem = F.when(F.col("__known").isNull(), "NOT_IN_REPLAY").when(~F.col("hr_coil_id").eqNullSafe(F.col("__coil")), "COIL_DIFFERS")
    return rows.select("charge_id", "slab_no", problem.alias("problem")).where("problem is not null")


def checked(sm: DataFrame, fur: DataFrame, ap: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources with ``reason`` (their first own fault) and ``usable``."""
    key = ~P.missing("charge_id") & ~P.missing("slab_no")
    sm = mark_ambiguous(sm, ["charge_id", "slab_no"], "twice", key)
    sm = sm.withColumn("reason", F.when(~key, "MISSING_SM_CC_KEY").when(F.col("twice"), "DUPLICATE_SM_CC_KEY"))
    coil = ~P.missing("hr_coil_id")
    fur = mark_ambiguous(mark_ambiguous(fur, ["charge_id", "slab_no"], "twice", key), ["hr_coil_id"], "coil_twice", coil)
    fur = fur.withColumn("boundary", key & ~F.col("twice") & F.col("hr_date").isNotNull()).withColumn(
        "reason", F.when(~key, "MISSING_FUR_HR_KEY").when(~coil, "MISSING_FUR_HR_COIL_ID").when(F.col("twice"), "DUPLICATE_FUR_HR_KEY")
        .when(F.col("coil_twice"), "DUPLICATE_FUR_HR_COIL_KEY").when(F.col("hr_date").isNull(), "INVALID_FUR_HR_DATE")
    ).withColumn("usable", key & coil & ~F.col("twice") & ~F.col("coil_twice"))
    prod = ~P.missing("ap_prod_id")
    ap = mark_ambiguous(mark_ambiguous(ap, ["hr_coil_id"], "twice", coil), ["ap_prod_id"], "prod_twice", prod)
    ap = ap.withColumn(
        "reason", F.when(~coil, "MISSING_AP_HR_COIL_ID").when(~prod, "MISSING_AP_PROD_ID").when(F.col("twice"), "DUPLICATE_AP_KEY")
        .when(F.col("prod_twice"), "DUPLICATE_AP_PROD_ID")
    )
    return sm.withColumn("usable", F.col("reason").isNull()).drop("twice"), fur.drop("twice", "coil_twice"), ap.withColumn("usable", F.col("reason").isNull()).drop("twice", "prod_twice")


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("usable").drop("usable", "reason", "boundary")


def boundary(fur: DataFrame) -> DataFrame:
    """Furnace rows with a valid, unique key and a date: the population that time cuts are taken from, linked or not."""
    return unique(fur, "charge_id", "slab_no").where(F.col("hr_date").isNotNull())


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with a key that no other row has. They stay dealt and sorted by the key, so joins by it need no further shuffle."""
    return counted(rows, *keys).where("__n = 1").drop("__n")


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that have a key, with ``__n``, the number of rows that have it."""
    there = reduce(lambda a, b: a & b, [~P.missing(k) for k in keys])
    return rows.where(there).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))


def _coils_of_repeated_products(ap: DataFrame) -> DataFrame:
    """Coils of a product that is named with another coil too. For a coil with one row this says that the row's product is not its own."""
    w = Window.partitionBy("ap_prod_id")
    pairs = ap.where(~P.missing("ap_prod_id")).select("ap_prod_id", F.coalesce("hr_coil_id", F.lit("")).alias("hr_coil_id"))
    return pairs.withColumns({"__lo": F.min("hr_coil_id").over(w), "__hi": F.max("hr_coil_id").over(w)}).where("__lo <> __hi").select("hr_coil_id").distinct()


def _repeated_coils(fur: DataFrame) -> DataFrame:
    return fur.where(~P.missing("hr_coil_id")).groupBy("hr_coil_id").agg(F.count("*").alias("__n")).where("__n > 1").select("hr_coil_id")


def chain(sm: DataFrame, fur: DataFrame, ap: DataFrame, by_charge: bool = False) -> DataFrame:
    """Furnace rows joined with their casting and, where there is one, their pickling: rows whose key, coil and product are their own.

    Each source is dealt once by its key, the joined rows once more by their coil. ``by_charge`` says that castings and furnace rows lie dealt by charge:
    then they meet where they lie, the few slabs of a charge compared with each other. (Spark deals both anew for an equality in keys it has not dealt by.)
    """
    every, keys, fur, sm = fur, ["charge_id", "slab_no"], unique(fur, "charge_id", "slab_no").where(~P.missing("hr_coil_id")), unique(sm, "charge_id", "slab_no")
    if by_charge:
        rows = fur.join(sm.withColumnRenamed("slab_no", "__slab"), "charge_id").where("slab_no <= __slab and slab_no >= __slab").drop("__slab")
    else:
        rows = fur.join(sm, keys)
    own = unique(ap, "hr_coil_id").where(~P.missing("ap_prod_id")).join(_coils_of_repeated_products(ap), "hr_coil_id", "left_anti")
    # an anti join would be moved below the join by key, and the furnace rows dealt by coil and by key once more
    twice = _repeated_coils(every).withColumn("__twice", F.lit(True))
    return rows.join(twice, "hr_coil_id", "left").where("__twice is null").drop("__twice").join(own, "hr_coil_id", "left")


def accepted(linked: DataFrame) -> DataFrame:
    """The chain's rows whose stage dates do not decrease, with fuel shares and label status."""
    gases = ("f_bfg", "f_cog", "f_ldg")
    rows = linked.where(P.monotone("cast_date", "f_ext_date", "hr_date", "ap_date"))
    return rows.withColumns({f"{g}_ratio": P.ratio(g, *gases) for g in gases} | {"label_status": P.label_status()})


def replay_rows(sm: DataFrame, fur: DataFrame, ap: DataFrame, by_charge: bool = False) -> DataFrame:
    return accepted(chain(sm, fur, ap, by_charge))


def unlinked(sm: DataFrame, fur: DataFrame, ap: DataFrame) -> DataFrame:
    """(role, record, reason) of usable rows without a partner, in both directions and from pickling to furnace."""
    s, f, a = _usable(sm), _usable(fur), _usable(ap)
    out = lambda rows, role, record, reason: rows.select(F.lit(role).alias("role"), F.col(record).alias("record"), F.lit(reason).alias("reason"))
    return (
        out(s.join(f, ["charge_id", "slab_no"], "left_anti"), "sm_cc", "sm_record", "UNLINKED_SM_CC")
        .unionByName(out(f.join(s, ["charge_id", "slab_no"], "left_anti"), "fur_hr", "fur_record", "UNLINKED_FUR_HR"))
        .unionByName(out(a.join(f, "hr_coil_id", "left_anti"), "ap", "ap_record", "UNLINKED_AP"))
    )


def order_violations(linked: DataFrame) -> DataFrame:
    """(role, record, reason) for every source record of a chain whose dates decrease."""
    records = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("record")) for r, c in (("sm_cc", "sm_record"), ("fur_hr", "fur_record"), ("ap", "ap_record"))]))
    rows = linked.where(~P.monotone("cast_date", "f_ext_date", "hr_date", "ap_date")).select(records.alias("r"))
    return rows.select("r.role", "r.record", F.lit("IMPOSSIBLE_STAGE_DATE_ORDER").alias("reason")).where("record is not null")


def quarantine(sm: DataFrame, fur: DataFrame, ap: DataFrame) -> DataFrame:
    """One row per faulty source record: its most severe reason.

    One pass: castings and furnace rows meet by key, these and picklings by coil, and what comes out tells what is wrong with its records. Rows
    without a key or coil are told apart before; those that are out for another reason keep a place of their own, so they do not meet in one task.
    """
    key, coil, keys = ~P.missing("charge_id") & ~P.missing("slab_no"), ~P.missing("hr_coil_id"), ["charge_id", "slab_no"]
    s = counted(sm.select(*keys, "sm_record", "cast_date"), *keys).withColumnsRenamed({"__n": "__s"})
    f = counted(fur.select(*keys, "fur_record", "hr_coil_id", "f_ext_date", "hr_date"), *keys).withColumnsRenamed({"__n": "__f"})
    a = counted(ap.select("ap_record", "hr_coil_id", P.missing("ap_prod_id").alias("__blank"), "ap_date"), "hr_coil_id")
    a = a.join(_coils_of_repeated_products(ap).withColumn("__products", F.lit(True)), "hr_coil_id", "left")
    own = F.when(F.col("__blank"), "MISSING_AP_PROD_ID").when(F.col("__n") > 1, "DUPLICATE_AP_KEY").when(F.col("__products"), "DUPLICATE_AP_PROD_ID")
    a = a.select("ap_record", "ap_date", F.concat(F.lit("c"), "hr_coil_id").alias("__at"), own.alias("__own"))
    met = f.join(s, (f.charge_id == s.charge_id) & (f.slab_no == s.slab_no) & (f["__f"] == 1) & (s["__s"] == 1), "full").drop(*keys)
    alone = F.coalesce(coil & (F.col("__f") == 1), F.lit(False))
    place = F.when(alone, F.concat(F.lit("c"), "hr_coil_id")).otherwise(F.concat(F.lit("r"), F.coalesce(F.col("fur_record"), F.col("sm_record")).cast("string")))
    met = met.select("sm_record", "cast_date", "__s", "fur_record", "f_ext_date", "hr_date", "__f", P.missing("hr_coil_id").alias("__blank"), alone.alias("__alone"), place.alias("__at"))
    twice = _repeated_coils(fur).select(F.concat(F.lit("c"), "hr_coil_id").alias("__at"), F.lit(True).alias("__coils"))
    met = met.join(twice, "__at", "left").withColumn("__usable", F.col("__alone") & F.col("__coils").isNull())
    rows = met.join(a, (met["__at"] == a["__at"]) & met["__usable"] & a["__own"].isNull(), "full")
    usable, late = F.coalesce("__usable", F.lit(False)), ~P.monotone("cast_date", "f_ext_date", "hr_date", "ap_date")
    late = F.when(usable & F.col("sm_record").isNotNull() & late, "IMPOSSIBLE_STAGE_DATE_ORDER")
    of_sm = F.when(F.col("__s") > 1, "DUPLICATE_SM_CC_KEY").otherwise(F.coalesce(late, F.when(~usable, "UNLINKED_SM_CC")))
    of_fur = (
        F.when(F.col("__blank"), "MISSING_FUR_HR_COIL_ID").when(F.col("__f") > 1, "DUPLICATE_FUR_HR_KEY").when(F.col("__coils"), "DUPLICATE_FUR_HR_COIL_KEY")
        .when(F.col("hr_date").isNull(), "INVALID_FUR_HR_DATE").otherwise(F.coalesce(late, F.when(F.col("sm_record").isNull(), "UNLINKED_FUR_HR")))
    )
    of_ap = F.coalesce(F.col("__own"), late, F.when(~usable, "UNLINKED_AP"))
    told = [F.struct(F.lit(role).alias("role"), F.col(record).alias("record"), why.alias("reason")) for role, record, why in (("sm_cc", "sm_record", of_sm), ("fur_hr", "fur_record", of_fur), ("ap", "ap_record", of_ap))]
    every = rows.select(F.explode(F.array(*told)).alias("r")).select("r.*").where("record is not null and reason is not null")
    for source, lost, role, record, reason in ((sm, ~key, "sm_cc", "sm_record", "MISSING_SM_CC_KEY"), (fur, ~key, "fur_hr", "fur_record", "MISSING_FUR_HR_KEY"), (ap, ~coil, "ap", "ap_record", "MISSING_AP_HR_COIL_ID")):
        every = every.unionByName(source.where(lost).select(F.lit(role).alias("role"), F.col(record).alias("record"), F.lit(reason).alias("reason")))
    return most_severe(every)


def most_severe(reasons: DataFrame) -> DataFrame:
    """(role, record, reason): one row per record, with the first of its reasons."""
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    return reasons.groupBy("role", "record").agg(F.element_at(F.array(*map(F.lit, REASONS)), F.min(rank).cast("int")).alias("reason"))


def lineage(replay: DataFrame) -> DataFrame:
    """(charge_id, slab_no, role, record): the source records behind each material."""
    records = [F.struct(F.lit(r).alias("role"), F.col(c).alias("record")) for r, c in (("sm_cc", "sm_record"), ("fur_hr", "fur_record"), ("ap", "ap_record"))]
    return replay.select("charge_id", "slab_no", F.explode(F.array(*records)).alias("r")).select("charge_id", "slab_no", "r.role", "r.record").where("record is not null")
