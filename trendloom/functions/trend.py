"""Trend labels and the numbers shown beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def half_up(value: Column) -> Column:
    """Round half towards positive infinity (Spark's own ``round`` moves negative halves away from zero)."""
    return F.floor(value + 0.5)


def trend_label(prev: Column, curr: Column, threshold: float = V.TREND_THRESHOLD) -> Column:
    """A change of more than the threshold is a trend; from nothing, any ticket is an increase."""
    return (
        F.when((prev == 0) & (curr > 0), "Increasing")
        .when(prev == 0, "Stable")
        .when(curr > prev * (1 + threshold), "Increasing")
        .when(curr < prev * (1 - threshold), "Decreasing")
        .otherwise("Stable")
    )


def percent_change(prev: Column, curr: Column) -> Column:
    """Whole percent, NULL when there is nothing to compare with."""
    return F.when(prev != 0, half_up((curr - prev) / prev * 100))


def percent_text(prev: Column, curr: Column) -> Column:
    change = percent_change(prev, curr)
    sign = F.when(change > 0, "+").otherwise("")
    from_zero = F.when(curr > 0, "+100%").otherwise("—")
    return F.when(prev == 0, from_zero).otherwise(F.concat(sign, change.cast("string"), F.lit("%")))


def alert_percent(prev: Column, curr: Column) -> Column:
    return F.when(prev > 0, percent_change(prev, curr)).otherwise(F.lit(100))


def projection(curr: Column, factor: float = V.PROJECTION_FACTOR) -> Column:
    return half_up(curr * F.lit(float(factor)))


def share_of(part: Column, total: Column) -> Column:
    """Percent of a total, at most 100; an empty total counts as 1."""
    return F.least(part / F.greatest(total, F.lit(1)) * 100, F.lit(100.0))
