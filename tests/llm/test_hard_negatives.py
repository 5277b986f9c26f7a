"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from millwright.llm import hard_negatives as H
from millwright.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, cfg=H.MiningConfig()):
    taken = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((vec_id, [math.floor(cfg.scale * x) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for n, (anchor, v, label) in enumerate(taken):
        if anchor % cfg.anchor_every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, o)), i, own) for m, (i, o, own) in enumerate(taken) if m != n]
        for s, positive, _ in sorted(x for x in scored if x[2] == label)[: cfg.positives]:
            fit = sorted(x for x in scored if x[2] != label and cfg.low * -s <= -100 * x[0] <= cfg.high * -s)
            out += [(anchor, positive, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit[: cfg.negatives])]
    return sorted(out)


def mined(spark, rows, cfg=H.MiningConfig(), parts=4):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    return sorted(tuple(r) for r in H.mine(frame, cfg).select(*COLUMNS).collect())


def vectors(n, width=16, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    which = rng.integers(0, 6, n)
    x = centres[which] + spread * rng.normal(size=(n, width))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return [(i, x[i].tolist(), int(which[i] if i % 3 else (which[i] + i) % 10)) for i in range(n)]


def test_query_equals_sql_at_another_scale(spark):
    assert compare(QUERIES["op13_gnat_hard_negatives"](spark, f"{DATA}/sf0.01"), ORACLES["op13_gnat_hard_negatives"], f"{DATA}/sf0.01") == ""


def test_small_units_samples_and_trees_equal_all_pairs(spark):
    rows = vectors(900)
    expected = plain(rows)
    assert expected
    for cfg in (H.MiningConfig(sample_rows=60, degree=4, unit_rows=50), H.MiningConfig(sample_rows=1), H.MiningConfig(degree=1)):
        assert mined(spark, rows, cfg) == expected


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = vectors(300, width=8)
    rows += [(1000 + i, rows[0][1], i % 10) for i in range(400)]  # copies of one vector with all labels
    rows += [(50, None, 1), (100, [float("nan")] * 8, 2), (150, rows[3][1], None), (None, rows[3][1], 3), (200, [None] * 8, 3), (250, [float("inf")] + [0.0] * 7, 1)]
    rows += [(2000, [], 1), (2001, [0.5, 0.25], 1), (2050, [-x for x in rows[1][1]], 2), (2100, [100.0] * 8, 2), (2150, [0.0] * 8, 3)]
    rows += [rows[50], rows[51], rows[100]]  # rows again
    assert mined(spark, rows, H.MiningConfig(unit_rows=64, degree=5, sample_rows=100)) == plain(rows)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float(np.float32(x * 2e6)) for x in v], label) for i, v, label in vectors(200, width=4)]
    assert mined(spark, rows) == plain(rows)  # products beyond 2^53
    with pytest.raises(ValueError):
        mined(spark, [(i, [x * 1e12 for x in v], label) for i, v, label in rows])
    assert mined(spark, []) == [] and mined(spark, [(0, None, 1)]) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.8], 2)]) == plain([(0, [1.0], 1), (1, [1.0], 1), (2, [0.8], 2)])


def test_ranges_leave_out_subtrees_without_losing_rows():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(200, 8)) for c in np.eye(8)]))
    tree = H.Tree.fit(x[::7], float((x * x).sum(1).max()) ** 0.5, 8)
    child, leaf = tree.place(x)
    tree.widen(x, child, leaf)
    anchors = x[::40]
    scores = anchors @ x.T
    low, high = (np.floor(f * scores.max(1))[:, None] for f in (0.8, 0.95))
    kept = tree.kept(0, anchors, low, high)[:, 0]
    inside = (scores >= low) & (scores <= high)
    needed = np.stack([(inside & (child == c)).any(1) for c in range(len(tree.points[0]))], 1)
    assert kept[needed].all() and kept.mean() < 0.6
