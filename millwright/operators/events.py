"""Replay events: one row per stage of each material, deterministic ids, total order, units, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.config import BATCH_KINDS, STAGES
from millwright.functions.statistics import digest_id
from millwright.work import broadcast_if_small, written

#: Payload of each stage: only fields first known there.
PAYLOAD = {
    "CAST_RECORDED": ("steel_grade", "steel_usage", "tundish_temp"), "FURNACE_CHARGED": ("f_jangip_gubun",), "HEAT_COMPLETE": ("f_heat_temp", "f_bfg", "f_cog", "f_ldg"),
    "RM4_RECORDED": ("hr_coil_id",), "AP_RECORDED_WITH_RESULT": ("ap_prod_id", "judge"),
}
ORDER = ("replay_date", "kind_rank", "hour_rank", "batch_id", "stage_rank", "furnace_rank", "material_key", "event_id")


#: What an event of :func:`build_events` is told by: its digests follow from these, and are many times as long.
TOLD = ("charge_id", "slab_no", "stage_rank", "replay_date", "replay_hour", "equipment_id")


def told(events: DataFrame) -> DataFrame:
    """Built events without what follows from their stage and without digests; :func:`digested` gives both back."""
    return events.select(*TOLD)


def _ranked() -> dict[str, F.Column]:
    """Ranks of an event of :func:`told`."""
    rank = F.col("stage_rank")
    kind = F.when(rank == 0, "CAST_DAY").when(rank == 20, "AP_DAY").otherwise("FURNACE_HOUR")
    furnace = F.when((rank >= 10) & (rank < 15), F.col("equipment_id").cast("int")).otherwise(0)
    return {"kind_rank": F.element_at(F.create_map(*[F.lit(x) for kv in BATCH_KINDS for x in kv]), kind), "hour_rank": F.coalesce("replay_hour", F.lit(-1)), "furnace_rank": furnace}


def digested(rows: DataFrame) -> DataFrame:
    """Events of :func:`told` with all that places and identifies them."""
    rank = F.col("stage_rank")
    rows = rows.withColumns(_ranked() | {
        "batch_step": F.element_at(F.create_map(*[F.lit(x) for stage, r in STAGES for x in (r, stage)]), rank), "batch_kind": F.element_at(F.create_map(*[F.lit(x) for kind, r in BATCH_KINDS for x in (r, kind)]), _ranked()["kind_rank"]),
        "equipment_type": F.when(rank == 0, "SM_CC").when(rank == 20, "AP").when((rank >= 10) & (rank < 15), "FURNACE").otherwise("RM4"),
    })
    return rows.withColumns({"material_key": material_key(), "batch_id": batch_id()}).withColumn("equipment_batch_id", _equipment_batch()).withColumn("event_id", event_id())


def material_key() -> F.Column:
    return digest_id("material-key/v1", chargeId=F.col("charge_id"), slabNo=F.col("slab_no"))


def build_events(replay: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Seven events per material and one more for a pickled one, with ids and the sort columns of the total order; ``carried`` columns of the material go with each."""
    items = []
    for stage, rank in STAGES:
        furnace = 10 <= rank < 15
        kind = "CAST_DAY" if rank == 0 else "AP_DAY" if rank == 20 else "FURNACE_HOUR"
        fields = PAYLOAD.get(stage, ())
        values = F.to_json(F.struct(*[F.col(c).alias(c) for c in fields]), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
        items.append(F.struct(
            F.lit(stage).alias("batch_step"), F.lit(rank).alias("stage_rank"), F.lit(kind).alias("batch_kind"), F.lit(dict(BATCH_KINDS)[kind]).alias("kind_rank"),
            F.col("cast_date" if rank == 0 else "ap_date" if rank == 20 else "f_ext_date").alias("replay_date"),
            (F.col("f_ext_time") if kind == "FURNACE_HOUR" else F.lit(None).cast("int")).alias("replay_hour"),
            F.lit("SM_CC" if rank == 0 else "AP" if rank == 20 else "FURNACE" if furnace else "RM4").alias("equipment_type"),
            (F.lit("SM1") if rank == 0 else F.lit("AP1") if rank == 20 else F.col("furnace_no") if furnace else F.lit("RM4_PROCESS")).alias("equipment_id"),
            values.alias("values_json"),
        ))
    # a material has three batches and one of its furnace: their digests are made before its events, not once for each
    day = {"CAST_DAY": "cast_date", "FURNACE_HOUR": "f_ext_date", "AP_DAY": "ap_date"}
    made = {f"__{kind}": batch_id(F.lit(kind), F.col(date), F.col("f_ext_time")) for kind, date in day.items()}
    rows = replay.withColumns({"material_key": material_key()} | made)
    rows = rows.withColumn("__furnace", _equipment_batch(F.col("__FURNACE_HOUR"), F.lit("FURNACE"), F.col("furnace_no")))
    rows = rows.select("charge_id", "slab_no", "material_key", *carried, *made, "__furnace", F.col("ap_record").isNotNull().alias("pickled"), F.explode(F.array(*items)).alias("e"))
    rows = rows.select("charge_id", "slab_no", "material_key", *carried, *made, "__furnace", "pickled", "e.*").where("pickled or batch_step <> 'AP_RECORDED_WITH_RESULT'").drop("pickled")
    own = F.coalesce(*[F.when(F.col("batch_kind") == kind, F.col(f"__{kind}")) for kind in day])
    rows = rows.withColumns({"batch_id": own, "equipment_batch_id": F.when(F.col("equipment_type") == "FURNACE", F.col("__furnace"))}).drop(*made, "__furnace")
    return rows.withColumns({"event_id": event_id(), "hour_rank": F.coalesce("replay_hour", F.lit(-1)), "furnace_rank": F.when(F.col("equipment_type") == "FURNACE", F.col("equipment_id").cast("int")).otherwise(0)})


def _equipment_batch(batch: F.Column | None = None, kind: F.Column | None = None, equipment: F.Column | None = None) -> F.Column:
    """The identity of a furnace's part of a batch: of an event's columns, or of the given ones."""
    kind = F.col("equipment_type") if kind is None else kind
    sub = digest_id("equipment-batch-id/v1", batchId=F.col("batch_id") if batch is None else batch, equipmentId=F.col("equipment_id") if equipment is None else equipment, equipmentType=kind)
    return F.when(kind == "FURNACE", sub)


def batch_id(kind: F.Column | None = None, date: F.Column | None = None, hour: F.Column | None = None) -> F.Column:
    """The identity of a batch: its kind and day, and the hour of a furnace batch. It is told by an event's columns, or by the given ones."""
    kind = F.col("batch_kind") if kind is None else kind
    day = F.date_format("replay_date" if date is None else date, "yyyy-MM-dd")
    hourly = digest_id("batch-id/v1", batchKind=kind, replayDate=day, replayHour=F.col("replay_hour") if hour is None else hour)
    return F.when(kind == "FURNACE_HOUR", hourly).otherwise(digest_id("batch-id/v1", batchKind=kind, replayDate=day))


def event_id() -> F.Column:
    return digest_id("event-id/v1", batchId=F.col("batch_id"), batchStep=F.col("batch_step"), equipmentBatchId=F.col("equipment_batch_id"), equipmentId=F.col("equipment_id"),
                     equipmentType=F.col("equipment_type"), materialKey=F.col("material_key"))


def in_order(events: DataFrame) -> DataFrame:
    """A range partitioning by the total order, sorted within partitions: files in name order are the stream.

    Events of :func:`told` are dealt by it too, without a digest in the shuffle: only the material's is made, for the order, as bytes, on either side. A day, kind
    and hour have one batch, and a material one event a stage, so the order needs no other.
    """
    if "event_id" in events.columns:
        return events.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    key = F.unhex(F.substring(material_key(), 8, 64))
    by = _ranked()
    order = ["replay_date", by["kind_rank"], by["hour_rank"], "stage_rank", by["furnace_rank"]]
    return events.repartitionByRange(*order, key).withColumn("__key", key).sortWithinPartitions(*order, "__key").drop("__key")


UNIT = ["replay_date", "kind_rank", "hour_rank", "batch_id", "stage_rank"]


def unit_groups(events: DataFrame) -> DataFrame:
    """(*UNIT, unit): the ordinal of each (batch, step) group, in two levels so that no single task orders all events.

    Units are ranked among the distinct groups (far fewer rows than events), within their month, on the months' running counts.
    """
    # a row an hour of a kind, with the ranks of its stages as bits; the digest follows from these, so it is made for the groups only
    hours = events.groupBy("replay_date", "kind_rank", "batch_kind", "replay_hour", "hour_rank").agg(F.expr("bit_or(shiftleft(1L, stage_rank))").alias("stages"))
    stages = F.explode(F.expr("filter(sequence(0, 62), x -> (shiftright(stages, x) & 1) = 1)"))
    told = hours.withColumns({"batch_id": batch_id(), "stage_rank": stages, "month": F.trunc("replay_date", "month")})
    groups = written(told.select(*UNIT, "month"), "unit-groups")
    months = groups.groupBy("month").agg(F.count("*").alias("m"))
    before = months.select("month", F.coalesce(F.sum("m").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = groups.withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy(*UNIT))).join(F.broadcast(before), "month")
    return ranked.select(*UNIT, (F.col("k") + F.col("before")).alias("unit"))


def units(events: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Adds ``unit`` from ``groups``, by default the events' own :func:`unit_groups`.

    The calendar bounds the groups (146 a day), so they are broadcast up to half a million, 3 400 days; events are not shuffled. Given ``groups``, events
    may lack ``batch_id``: a day, kind and hour have one batch.
    """
    groups = written(unit_groups(events), "units") if groups is None else groups
    at = [c for c in UNIT if c in events.columns]
    return events.join(broadcast_if_small(groups.select(*at, "unit"), 500_000), at)


#: Hashes of suspected keys that are broadcast at most; beyond, all events are compared.
SUSPECTS = 4_000_000


def _of(events: DataFrame, column: str, hashes: DataFrame, most: int = SUSPECTS) -> DataFrame:
    """Events whose key may be one of those with the 64-bit ``hashes`` (``__h``): all of them and rarely another one, so what is found among them is exact."""
    hashes = written(hashes, "suspects")
    return events.join(F.broadcast(hashes), F.xxhash64(column) == F.col("__h"), "left_semi") if hashes.count() <= most else events


def _dates(events: DataFrame) -> DataFrame:
    """(material_key, stages, moved): the ranks below 20 that a material has, as bits, and whether a stage of it may lie before an earlier stage.

    A row a material, made where its events are built: events themselves are not shuffled. ``moved`` is true wherever a stage is late; a rank that is no stage's counts as moved.
    """
    ranks = sorted({rank for _, rank in STAGES})
    at = lambda how, r: how(F.when(F.col("stage_rank") == r, F.col("replay_date")))
    by = events.groupBy("material_key").agg(
        F.coalesce(F.bit_or(F.when(F.col("stage_rank") < 20, F.expr("shiftleft(1L, stage_rank)"))), F.lit(0)).alias("stages"), F.bool_or(~F.coalesce(F.col("stage_rank").isin(ranks), F.lit(False))).alias("other"),
        *[at(how, r).alias(f"{name}{r}") for r in ranks for name, how in (("lo", F.min), ("hi", F.max))],
    )
    moved = F.col("other")
    for i, r in enumerate(ranks[1:], 1):
        moved = moved | F.coalesce((F.greatest(*[F.col(f"hi{x}") for x in ranks[:i]]) if i > 1 else F.col(f"hi{ranks[0]}")) > F.col(f"lo{r}"), F.lit(False))
    return by.select("material_key", "stages", moved.alias("moved"))


def violations(events: DataFrame) -> DataFrame:
    """(material_key, event_id, problem): ids that are not unique or not what their fields give, stages at the wrong equipment, out of order or missing.

    event_id is null for a missing stage. Columns bundle_id and criteria_id, where the stream has them, must hold one value each:
    events of any but the least are MIXED_BUNDLE or MIXED_CRITERIA.
    """
    found = lambda rows, problem: rows.select("material_key", "event_id", F.lit(problem).alias("problem"))
    again = events.groupBy(F.xxhash64("event_id").alias("__h")).agg(F.count("*").alias("n")).where("n > 1").select("__h")
    twice = _of(events, "event_id", again).groupBy("event_id").agg(F.count("*").alias("n"), F.min("material_key").alias("material_key")).where("n > 1")
    lacks = (F.bit_count("stages") < len(STAGES) - 1) & (F.col("stages") > 0)
    odd = written(_dates(events).select("material_key", "moved", lacks.alias("lacks")).where("moved or lacks"), "odd-materials")
    moved = _of(events, "material_key", odd.where("moved").select(F.xxhash64("material_key").alias("__h")).distinct())
    late = moved.withColumn("previous", F.lag("replay_date").over(Window.partitionBy("material_key").orderBy("stage_rank", "replay_date"))).where("previous > replay_date")
    place = F.element_at(F.create_map(*[F.lit(x) for stage, rank in STAGES for x in (stage, "SM_CC" if rank == 0 else "AP" if rank == 20 else "FURNACE" if rank < 15 else "RM4")]), F.col("batch_step"))
    wrong = {"WRONG_BATCH_ID": F.col("batch_id") != batch_id(), "WRONG_EVENT_ID": F.col("event_id") != event_id(), "WRONG_EQUIPMENT": ~F.col("equipment_type").eqNullSafe(place)}
    mixed = {column: problem for column, problem in (("bundle_id", "MIXED_BUNDLE"), ("criteria_id", "MIXED_CRITERIA")) if column in events.columns}
    rows = events
    if mixed:
        rows = events.crossJoin(F.broadcast(events.agg(*[F.min(column).alias(f"__{column}") for column in mixed])))
        wrong |= {problem: ~F.col(column).eqNullSafe(F.col(f"__{column}")) for column, problem in mixed.items()}
    # what an event alone shows is told in one pass: digests are made once for all of its problems
    alone = rows.select("material_key", "event_id", F.explode(F.array(*[F.when(is_so, problem) for problem, is_so in wrong.items()])).alias("problem")).where("problem is not null")
    lacking = odd.where("lacks").withColumn("event_id", F.lit(None).cast("string"))
    return found(twice, "DUPLICATE_EVENT_ID").unionByName(found(late, "STAGE_OUT_OF_ORDER")).unionByName(alone).unionByName(found(lacking, "MISSING_STAGE"))


#: Rows of a file that are compared in one window.
RUN = 1 << 16


def order_violations(events: DataFrame, file: str, row: str, order: tuple[str, ...] = ORDER, run: int = RUN) -> DataFrame:
    """(material_key, event_id, problem): events whose sort key is not above that of the event before, in the order in which rows lie in the files.

    ``file`` sorts as the files do, ``row`` counts up within one. Neighbours are compared within runs of ``run`` rows, and the first of each run with
    the last of the run before, which may be in another file: a row a run is all that is ordered as a whole. Events of :func:`told` get their digests
    after they are dealt by run.
    """
    full = "event_id" in events.columns
    # one key: with two, a file named by a constant would leave one of them, and the windows would deal the rows anew
    at = F.struct(F.col(file).alias("file"), F.floor(F.col(row) / run).alias("run"))
    dealt = events.select(*(dict.fromkeys([*order, "material_key", "event_id"]) if full else TOLD), at.alias("__at"), F.col(row).alias("__r")).repartition("__at")
    shown = [c for c in ("material_key", "event_id") if c not in order]  # the others are in the key
    rows = (dealt if full else digested(dealt)).select(*shown, F.struct(*order).alias("__key"), "__at", "__r")
    inside = Window.partitionBy("__at").orderBy("__r")
    names = [F.col(c if c in shown else f"__key.{c}").alias(c) for c in ("material_key", "event_id")]
    # the first of a run has none before it here: it stays, with the run's last, to be compared with the run before
    last = F.last("__key").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = rows.withColumns({"__before": F.lag("__key").over(inside), "__last": last, "__k": F.row_number().over(inside)})
    near = written(near.where((F.col("__k") == 1) | (F.col("__before") >= F.col("__key"))), "order-runs")
    borders = near.where("__k = 1").withColumn("__before", F.lag("__last").over(Window.orderBy("__at")))
    found = near.where("__k > 1").select(*names).unionByName(borders.where(F.col("__before") >= F.col("__key")).select(*names))
    return found.withColumn("problem", F.lit("SORT_INVALID"))


def streamed(folder: str, events: DataFrame) -> DataFrame:
    """Write :func:`in_order` to ``folder`` and read it back with ``place``, each event's ordinal in the stream: files by name, rows as they lie."""
    in_order(events).write.parquet(folder)
    rows = events.sparkSession.read.schema(events.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count("*").alias("__n"))  # a row a file
    before = files.select("__file", F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__file").withColumn("place", F.col("__row") + F.col("__before") + 1).drop("__file", "__row", "__before")


def parity(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(side, *columns): rows of either event set that the other lacks, repeated rows counted.

    Two sets of :func:`told` events are compared by what they are told by, dealt by charge, and digests are made for the differences only.
    """
    short = not {"event_id", "material_key"} & ({*first.columns} | {*second.columns})
    by = list(TOLD) if short else columns
    both = first.select(*by, F.lit(1).alias("__n")).unionByName(second.select(*by, F.lit(-1).alias("__n")))
    counted = (both.repartition("charge_id") if short else both).groupBy(*by).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "first").otherwise("second")
    return (digested(counted) if short else counted).select(side.alias("side"), *columns, F.explode(F.expr("array_repeat(0, cast(abs(__n) as int))")).alias("__i")).drop("__i")
