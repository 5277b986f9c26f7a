"""Column predicates and classifications used across the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing(x) -> Column:
    """Null or blank text; for numbers use :func:`finite`."""
    return _c(x).isNull() | (F.trim(_c(x).cast("string")) == "")


def present_for_rules(x) -> Column:
    """Rules count a blank text as present."""
    return _c(x).isNotNull()


def finite(x) -> Column:
    return _c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < F.lit(float("inf")))


def ratio(part: str, *whole: str) -> Column:
    """part / sum of whole; null if any is missing or the sum is 0."""
    total = reduce(lambda a, b: a + b, [F.col(w) for w in whole])
    return F.when(total != 0, F.col(part) / total)


def available_by(date: str, as_of) -> Column:
    return F.coalesce(F.col(date) <= _c(as_of), F.lit(False))


def label_status() -> Column:
    return F.when(F.col("ap_record").isNull(), "AP_UNLINKED").when(F.col("judge").isNull(), "LABEL_MISSING").otherwise("AVAILABLE")


def reference_label(as_of: str, days: int) -> Column:
    """Label status as known at ``as_of``: exactly ``days`` old is mature."""
    late = F.col("ap_date").isNull() | (F.col("hr_date") > F.date_sub(F.col(as_of), days)) | (F.col("ap_date") > F.col(as_of))
    return F.when(F.col("ap_record").isNull(), "AP_UNLINKED").when(late, "NOT_YET").when(F.col("judge").isNull(), "MISSING").otherwise("AVAILABLE")


def holdout_label() -> Column:
    return F.when(F.col("ap_record").isNull(), "AP_UNLINKED").when(F.col("judge").isNull(), "MISSING").otherwise("AVAILABLE")


def in_interval(x, lower, lower_in, upper, upper_in) -> Column:
    """Within bounds that are each inclusive or not; a null bound is open, a null value outside."""
    v, lo, hi = _c(x), _c(lower), _c(upper)
    above = lo.isNull() | (v > lo) | (_c(lower_in) & (v == lo))
    below = hi.isNull() | (v < hi) | (_c(upper_in) & (v == hi))
    return F.coalesce(v.isNotNull() & above & below, F.lit(False))


def in_values(x, values) -> Column:
    return F.coalesce(F.array_contains(_c(values), _c(x)), F.lit(False))


def quartile_band(x, q1, q2, q3) -> Column:
    v = _c(x)
    return F.when(v <= _c(q1), "Q1").when(v <= _c(q2), "Q2").when(v <= _c(q3), "Q3").when(v.isNotNull(), "Q4")


def monotone(*dates: str) -> Column:
    """Dates that are there do not decrease."""
    there = F.array_compact(F.array(*dates))
    return there == F.array_sort(there)


def severity(status: str = "status", temperature: str = "temperature", vibration: str = "vibration", current: str = "current_value") -> Column:
    t, v, a = F.col(temperature), F.col(vibration), F.col(current)
    return (
        F.when((F.col(status) == "FAILURE") | (t >= 90) | (v >= 8) | (a >= 80), "CRITICAL")
        .when((F.col(status) == "WARNING") | (t >= 75) | (v >= 5) | (a >= 60), "WARNING").otherwise("NORMAL")
    )


def range_status(x, p01, p05, p95, p99, lower_on, upper_on) -> Column:
    """TYPICAL, CAUTION or SEVERE; a tail that is switched off though its extreme is known is typical."""
    v = _c(x)
    low = F.when(~_c(lower_on) & _c(p01).isNotNull(), "TYPICAL").when(_c(p01).isNotNull() & (v < _c(p01)), "SEVERE").otherwise("CAUTION")
    high = F.when(~_c(upper_on) & _c(p99).isNotNull(), "TYPICAL").when(_c(p99).isNotNull() & (v > _c(p99)), "SEVERE").otherwise("CAUTION")
    return F.when(v.isNull(), "DATA_MISSING").when(v < _c(p05), low).when(v > _c(p95), high).otherwise("TYPICAL")


def should_alert(probability: str, threshold, status: str = "status", qualification: str = "qualification") -> Column:
    return (F.col(status) == "AVAILABLE") & (F.col(qualification) == "QUALIFIED") & (F.col(probability) >= threshold)
