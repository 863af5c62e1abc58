"""Exact integer arithmetic on columns. Spark's div truncates; grids need floors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(value: Column | int) -> Column:
    return value.cast("bigint") if isinstance(value, Column) else F.lit(value).cast("bigint")


def floor_div(num: Column, den: Column | int) -> Column:
    """floor(num / den) for a positive den, exactly."""
    n, d = big(num), big(den)
    return F.call_function("div", n - F.pmod(n, d), d)


def half_up(num: Column, den: Column | int) -> Column:
    """floor(num / den + 1/2) for a positive den: a mean in whole units, halves up."""
    d = big(den)
    return floor_div(big(num) + floor_div(d, 2), d)


def quantised(metres: Column) -> Column:
    """Whole millimetres, halves to even, from double precision."""
    return F.rint(metres.cast("double") * 1000).cast("bigint")


def clamped(value: Column, most: int) -> Column:
    return F.least(F.greatest(value, F.lit(-most)), F.lit(most))


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out
