"""The resampling: as many replicates as configured, draws hashed together, groups by the number of keys."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.catalog import ORACLES
from millwright.catalogs import CONFIG
from millwright.functions import digests
from millwright.operators import rules


@pytest.mark.parametrize("name", ["h4_holdout_intervals", "g12_bootstrap_intervals", "g18_final_grades"])
def test_registered_intervals_have_all_replicates(name):
    from millwright.catalogs import holdout
    from millwright.catalogs import rules as catalog

    module = holdout if name.startswith("h4") else catalog
    assert (module.REPLICATES, module.VALID) == (CONFIG.bootstrap_replicates, CONFIG.bootstrap_valid) == (2000, 1900)
    assert "range(2000) AS t(r)" in ORACLES[name] and ">= 1900" in ORACLES[name]


def test_draws_hashed_together_equal_plain_digests(monkeypatch):
    head = bytes(range(40))
    plain = lambda i: int.from_bytes(sha256(head + i.to_bytes(8, "big")).digest()[:8], "big")
    monkeypatch.setattr(digests, "LANES", 64)
    for start, end in ((0, 0), (0, 1), (60, 200), (2**32 - 70, 2**32 + 3)):
        assert digests.counted(head, start, end).tolist() == [plain(i) for i in range(start, end)]
    monkeypatch.setattr(rules, "HASHED", 256)
    counts = {}
    for singly in (0, 1 << 20):
        monkeypatch.setattr(rules, "SINGLY", singly)
        counts[singly] = rules.draw_counts(head[:32], int.from_bytes(head[32:], "big"), 3001)
    want = np.bincount([plain(i) % 3001 for i in range(3001)], minlength=3001)
    assert all((c == want).all() for c in counts.values())


def test_blocks_come_once_to_each_group(spark):
    """Many keys make a group each, so their blocks are not shuffled once for every few replicates; draws of keys with many rows are no rows either."""
    rows = [(f"r{r:03d}", f"c{k}", "xy"[k % 2], k % 2, 1, 1, k % 3) for r in range(70) for k in range(6)]
    blocks = spark.createDataFrame(rows, "rule_id string, charge_id string, stratum string, a long, b long, c long, d long")
    values = ("a", "b", "c", "d")
    made = {n: rules.replicate_sums(blocks, "rule_id", "stratum", values, F.sha2("rule_id", 256), 200, n) for n in (100, 0)}
    assert all("explode(sequence(0, 0," in m._jdf.queryExecution().analyzed().toString() for m in made.values())
    found = [sorted(map(tuple, m.collect())) for m in made.values()]
    assert found[0] == found[1] and len(found[0]) == 70 * 200 * 2 and {r[1] for r in found[0]} == set(range(200))
    one = rules.replicate_sums(blocks.where("rule_id = 'r000'"), "rule_id", "stratum", values, F.sha2("rule_id", 256), 200)
    assert sorted(map(tuple, one.collect())) == [r for r in found[0] if r[0] == "r000"]
