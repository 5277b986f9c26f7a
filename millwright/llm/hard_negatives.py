"""Hard negatives by integer inner product, found through a GNAT-style multiway tree over all rows.

Components become integers; every row x gets one more coordinate, sqrt(M^2 - |x|^2) with M the longest row, and an anchor a gets 0 there. Then
the squared distance is |a|^2 + M^2 - 2 <a, x>: a window of scores is an annulus round the anchor. The tree has two levels of split points, chosen
far from each other in a bounded sample; each row lies below its nearest point on each level, so a region is bounded by hyperplanes. For each
split point and each sibling's subtree the least and largest distance is stored, taken over all rows. By the triangle
inequality a subtree is left out if some point's range does not meet the distances that the annulus allows; leaves are scanned exactly.

A subtree of the first level is a unit of work, in blocks of a bounded number of rows dealt by hash, so copies of one vector lie in several. A unit's rows are
held and the anchors that it cannot leave out stream past; the best of each unit are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import remove, written

#: Stands for no score.
NONE = -(1 << 62)
#: Anchors handled at a time.
STREAM = 128


class MiningConfig(NamedTuple):
    """``anchor_every``: anchors are rows whose id it divides. A negative's score lies between ``low`` and ``high`` hundredths of its positive's.

    ``sample_rows`` rows at most (those of least hashed id) are read to the driver to choose ``degree`` split points a node and to give first bounds; every row is indexed.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    anchor_every: int = 50
    scale: int = 256
    degree: int = 16
    sample_rows: int = 4096
    unit_rows: int = 32_768


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


def _far_points(x: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` different rows of ``x``, each the farthest from those before it."""
    chosen, near = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(degree, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Tree(NamedTuple):
    """``points``: split points of the root, then of each of its children; ``ranges``: (point, sibling) distances of the same nodes, once known."""

    longest: float
    points: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, longest: float, degree: int) -> Tree:
        x = Tree(longest, [], [], []).lifted(sample)
        root = _far_points(x, degree)
        child = _distances(x, root).argmin(1)
        points = [root, *[_far_points(x[child == c], degree) if (child == c).any() else root[c : c + 1] for c in range(len(root))]]
        return Tree(longest, points, [np.full((len(p),) * 2, np.inf) for p in points], [np.full((len(p),) * 2, -np.inf) for p in points])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1, keepdims=True), 0))], 1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child and leaf below it of each row."""
        x = self.lifted(x)
        child, leaf = _distances(x, self.points[0]).argmin(1), np.zeros(len(x), np.int64)
        for c in np.unique(child):
            leaf[child == c] = _distances(x[child == c], self.points[1 + c]).argmin(1)
        return child, leaf

    def widen(self, x: np.ndarray, child: np.ndarray, leaf: np.ndarray) -> None:
        """Take the rows' distances into the ranges."""
        x = self.lifted(x)
        for node, rows, below in [(0, slice(None), child), *[(1 + c, child == c, leaf[child == c]) for c in np.unique(child)]]:
            away = _distances(x[rows], self.points[node])
            for s in np.unique(below):
                self.low[node][:, s] = np.minimum(self.low[node][:, s], away[below == s].min(0))
                self.high[node][:, s] = np.maximum(self.high[node][:, s], away[below == s].max(0))

    def kept(self, node: int, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchor, window, sibling): False where no row of the subtree can score from ``low`` to ``high`` (anchor, window), which rounding cannot make wrong."""
        norms = (anchors * anchors).sum(1)
        near, far = (np.sqrt(np.maximum((norms + self.longest**2)[:, None] - 2.0 * s, 0)) for s in (high, low))
        away = _distances(np.concatenate([anchors, np.zeros((len(anchors), 1))], 1), self.points[node])[:, None, :]
        slack = 1e-6 * (np.sqrt(norms) + self.longest + 1)[:, None, None]
        least = np.maximum(away - far[:, :, None], near[:, :, None] - away) - slack
        most = away + far[:, :, None] + slack
        open_ = (low <= high)[:, :, None]
        return open_ & ((least[..., None] <= self.high[node]) & (most[..., None] >= self.low[node])).all(2)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _scores(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: in floating point where every partial sum is below 2^53, else in 64-bit integers."""
    return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64) if exact else anchors @ rows.T


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of the last axis with ids and rows, ties by lower id; ``scores`` is changed. Columns stand in ascending order of ids."""
    found = []
    lines = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        found.append((scores[lines, at], ids[at], rows[at]))
        scores[lines, at] = NONE
    return tuple(np.stack(x, 1) for x in zip(*found))


def _merged(left, right, k: int):
    """The k best of two sets of (score, id, row), each (anchor, k)."""
    score, ids, rows = (np.concatenate(x, 1) for x in zip(left, right))
    order = np.lexsort((rows, ids, -score), axis=-1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (score, ids, rows))


class Unit:
    """The rows of one unit, by leaf, and the search of anchors in them."""

    def __init__(self, tree: Tree, child: int, batches: list[pa.RecordBatch], width: int, exact: bool):
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.tree, self.child, self.exact = tree, child, exact
        self.row, self.vec_id, self.label, self.leaf = (np.asarray(table.column(c)) for c in ("__row", "vec_id", "label", "leaf"))
        self.x = _matrix(table.column("vector"), width)
        self.leaves = np.split(np.arange(len(self.row)), np.flatnonzero(np.diff(self.leaf)) + 1)

    def search(self, anchors: np.ndarray, row: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """(score, id, row), each (anchor, window, k), of the best rows between ``low`` and ``high`` of the same label (or of another one)."""
        low, floats = low.copy(), anchors.astype(float)
        best = [[np.full((len(anchors), k), v, np.int64) for v in (NONE, 0, 0)] for _ in range(low.shape[1])]
        near = _distances(np.concatenate([floats.mean(0), [0.0]])[None, :], self.tree.points[1 + self.child])[0]
        for place in sorted(self.leaves, key=lambda p: near[self.leaf[p[0]]]):
            open_ = self.tree.kept(1 + self.child, floats, low, high)[:, :, self.leaf[place[0]]]
            active = np.flatnonzero(open_.any(1))
            if not len(active):
                continue
            score = _scores(anchors[active], self.x[place], self.exact)
            fits = (self.label[place] == label[active][:, None]) == same
            fits &= self.row[place] != row[active][:, None]
            for w in range(low.shape[1]):
                mine = fits & (score >= low[active, w][:, None]) & (score <= high[active, w][:, None]) & open_[active, w][:, None]
                hit = np.flatnonzero(mine.any(1))
                if len(hit):
                    found = _best(np.where(mine[hit], score[hit], NONE), self.vec_id[place], self.row[place], k)
                    merged = _merged([b[active[hit]] for b in best[w]], found, k)
                    for b, m in zip(best[w], merged):
                        b[active[hit]] = m
                    low[active[hit], w] = np.maximum(low[active[hit], w], merged[0][:, -1])
        return [np.stack(x, 1) for x in zip(*best)]


def prepared(rows: DataFrame, cfg: MiningConfig) -> DataFrame:
    """__row, vec_id, label, vector (integers, not yet padded) of the rows that take part: no null, no component that is null or not finite."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    taken = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good)
    return taken.select(
        F.monotonically_increasing_id().alias("__row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * float(cfg.scale)).cast("long")).alias("vector"),
    )


HIT = "anchor long, place int, score long, found_id long, found_row long"


def mine(rows: DataFrame, cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor, each of its positives, each of the negatives found.

    A row has vec_id, embedding and label; one with a null among them, or with a component that is null or not finite, takes no part, as anchor or
    candidate. Shorter vectors count as padded with zeros. Rows that repeat a vec_id are rows of their own. Scores beyond 62 bits raise.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base, base_path = written(prepared(rows, cfg), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, longest = base.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    if not n or not width:
        remove(spark, base_path)
        return spark.createDataFrame([], schema)
    if longest >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit in 62 bits")
    exact = longest < 2.0**53
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector")))
    vectors = base.select("__row", "vec_id", "label", padded.alias("vector"))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "__row").limit(cfg.sample_rows).collect()  # at most sample_rows rows
    seeds = np.array([r.vector for r in sample], np.int64).reshape(len(sample), width)
    seed_rows, seed_labels = (np.array([r[c] for r in sample], np.int64) for c in ("__row", "label"))
    tree = Tree.fit(seeds.astype(float), float(longest) ** 0.5, cfg.degree)
    placed, placed_path = written(_placed(vectors, tree, width), "placed")
    remove(spark, base_path)

    for node, point, sibling, low, high in _ranges(placed, tree, width).collect():  # one row for each pair of siblings in the tree
        tree.low[node][point, sibling], tree.high[node][point, sibling] = low, high
    counts = dict(placed.groupBy("child").count().collect())
    blocks = [max(1, -(-counts.get(c, 0) // cfg.unit_rows)) for c in range(len(tree.points[0]))]
    first = [sum(blocks[:c]) for c in range(len(blocks))]
    shared = spark.sparkContext.broadcast((tree, seeds, seed_rows, seed_labels, first, blocks))
    spread = lambda xs: F.element_at(F.lit(xs), F.col("child") + 1)
    units = placed.withColumn("unit", (spread(first) + F.pmod(F.xxhash64("__row"), spread(blocks))).cast("int"))
    anchors = placed.where(F.col("vec_id") % cfg.anchor_every == 0).select("__row", "vec_id", "label", "vector")

    asked = anchors.withColumn("aims", F.lit(None).cast("array<long>"))
    found = _search(units, _routed(asked, shared, width, exact, True, cfg.positives, cfg), shared, width, exact, True, cfg.positives)
    positives, positives_path = written(found, "positives")
    aims = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # as many as positives a row
    asked = anchors.join(aims, F.col("__row") == F.col("anchor")).select("__row", "vec_id", "label", "vector", F.col("p.score").alias("aims"))
    found = _search(units, _routed(asked, shared, width, exact, False, cfg.negatives, cfg), shared, width, exact, False, cfg.negatives)
    negatives = found.select("anchor", F.col("place").alias("of"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = positives.select("anchor", (F.col("rank") - 1).alias("of"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("__row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    result = negatives.join(known, ["anchor", "of"]).join(ids, "anchor").select(*[c.split()[0] for c in schema.split(", ")])
    done, _ = written(result, "hard-negatives")
    remove(spark, placed_path, positives_path)
    return done


def _placed(vectors: DataFrame, tree: Tree, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                child, leaf = tree.place(_matrix(batch.column(3), width).astype(float))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(child.astype(np.int32)), pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "child", "leaf"])

    return vectors.mapInArrow(run, "__row long, vec_id long, label long, vector array<long>, child int, leaf int")


def _ranges(placed: DataFrame, tree: Tree, width: int) -> DataFrame:
    """node, point, sibling, low, high over all rows; each task sends its own ranges only."""
    names = ("node", "point", "sibling", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(tree.longest, tree.points, [x.copy() for x in tree.low], [x.copy() for x in tree.high])
        for batch in batches:
            if batch.num_rows:
                own.widen(_matrix(batch.column(0), width).astype(float), np.asarray(batch.column(1)), np.asarray(batch.column(2)))
        for node, (low, high) in enumerate(zip(own.low, own.high)):
            point, sibling = np.nonzero(np.isfinite(low))
            columns = (np.full(len(point), node, np.int32), point.astype(np.int32), sibling.astype(np.int32), low[point, sibling], high[point, sibling])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = placed.select("vector", "child", "leaf").mapInArrow(run, "node int, point int, sibling int, low double, high double")
    return rows.groupBy("node", "point", "sibling").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _routed(asked: DataFrame, shared, width: int, exact: bool, same: bool, k: int, cfg: MiningConfig) -> DataFrame:
    """Each anchor for each unit that it cannot leave out, with its windows ``low`` and ``high``.

    Rows of the sample are rows of the data: their k-th best score in a window is a bound that its k best cannot be below.
    """
    lowest, highest = cfg.low, cfg.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seeds, seed_rows, seed_labels, first, blocks = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, STREAM):
                batch = whole.slice(at, STREAM)
                row, label, x = np.asarray(batch.column(0)), np.asarray(batch.column(2)), _matrix(batch.column(3), width)
                if same:
                    low, high = np.full((len(row), 1), NONE, np.int64), np.full((len(row), 1), -NONE, np.int64)
                else:
                    aims = batch.column(4).to_pylist()
                    most = max(map(len, aims))
                    low, high = np.ones((len(row), most), np.int64), np.zeros((len(row), most), np.int64)  # no score lies between
                    for i, own in enumerate(aims):
                        low[i, : len(own)] = [-(-s * lowest // 100) for s in own]
                        high[i, : len(own)] = [s * highest // 100 for s in own]
                score = _scores(x, seeds, exact)
                fits = ((seed_labels == label[:, None]) == same) & (seed_rows != row[:, None])
                for w in range(low.shape[1]):
                    inside = np.where(fits & (score >= low[:, w : w + 1]) & (score <= high[:, w : w + 1]), score, NONE)
                    if inside.shape[1] >= k:
                        low[:, w] = np.maximum(low[:, w], np.partition(inside, -k, axis=1)[:, -k])
                reach = tree.kept(0, x.astype(float), low, high).any(1)
                targets = [[u for c in np.flatnonzero(r) for u in range(first[c], first[c] + blocks[c])] for r in reach]
                arrays = [pa.array(c, pa.list_(t)) for c, t in ((low.tolist(), pa.int64()), (high.tolist(), pa.int64()), (targets, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], names=["__row", "vec_id", "label", "vector", "low", "high", "units"])

    routed = asked.mapInArrow(run, "__row long, vec_id long, label long, vector array<long>, low array<long>, high array<long>, units array<int>")
    return routed.select(F.explode("units").alias("unit"), "__row", "vec_id", "label", "vector", "low", "high")


def _search(units: DataFrame, routed: DataFrame, shared, width: int, exact: bool, same: bool, k: int) -> DataFrame:
    """anchor, place (of the window), score, found_id, found_row, rank: the k best of all units."""
    none = F.lit(None).cast("array<long>")
    columns = ["unit", "__anchor", "__row", "vec_id", "label", "vector", "child", "leaf", "low", "high"]
    rows = units.withColumns({"__anchor": F.lit(False), "low": none, "high": none}).select(*columns)
    asked = routed.withColumns({"__anchor": F.lit(True), "child": F.lit(-1), "leaf": F.lit(-1)}).select(*columns)
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(asked).repartitionById(parts, F.col("unit") % parts).sortWithinPartitions("unit", "__anchor", "leaf", "vec_id", "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, *_ = shared.value
        held, current, unit = [], None, None
        for batch in batches:
            for part in _runs(batch):
                number, is_anchor = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if number != current:
                    held, current, unit = [], number, None
                if not is_anchor:
                    held.append(part)
                    continue
                if unit is None and held:
                    unit, held = Unit(tree, held[0].column("child")[0].as_py(), held, width, exact), []
                if unit is not None:
                    yield from _answers(unit, part, width, same, k)

    found = dealt.mapInArrow(run, HIT)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch with one unit and either rows or a bounded number of anchors."""
    unit, anchor = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    cuts = [0, *(np.flatnonzero((np.diff(unit) != 0) | (np.diff(anchor.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        for at in range(start, stop, STREAM if stop > start and anchor[start] else max(1, stop - start)):
            yield batch.slice(at, min(stop, at + STREAM) - at if anchor[start] else stop - start)


def _answers(unit: Unit, part: pa.RecordBatch, width: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    windows = len(part.column("low")[0])
    low, high = (part.column(c).to_pylist() for c in ("low", "high"))
    most = max(map(len, low))  # anchors of different batches may have different numbers of windows
    low, high = (np.array([x + [fill] * (most - len(x)) for x in xs], np.int64) for xs, fill in ((low, 1), (high, 0)))
    row, label = np.asarray(part.column("__row")), np.asarray(part.column("label"))
    score, ids, rows = unit.search(_matrix(part.column("vector"), width), row, label, low, high, same, k)
    i, w, r = np.nonzero(score > NONE)
    if len(i):
        columns = (row[i], w.astype(np.int32), score[i, w, r], ids[i, w, r], rows[i, w, r])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in HIT.split(", ")])


ORACLE = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 3
"""
