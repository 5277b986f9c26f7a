"""Registered queries of the plant and sensor operators, with the SQL each must agree with."""

from __future__ import annotations

from millwright.catalogs import events, fleet, genealogy, holdout, model, monitor, ranges, rules, split

FLAGSHIP = "f5_operating_ranges"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (genealogy, split, ranges, rules, holdout, events, monitor, fleet, model):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
