"""One module of registered queries and oracles for each group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.config import AnalysisConfig

#: Thresholds for the bound tables: supports are lower than the plant's, all else is as configured by default.
CONFIG = AnalysisConfig(range_support=100, tail_support=400)


class Registry:
    """Collects the queries and oracles of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add


def r6(x: str | Column) -> Column:
    """Rounded to six digits under its own name: sums of doubles differ in their last bits with the order of rows."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})
