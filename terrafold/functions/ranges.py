"""Horizontal ranges and distance buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def horizontal(x: Column, y: Column) -> Column:
    return F.hypot(x.cast("double"), y.cast("double"))


def bucket(r: Column, edges: Sequence[float], last_closed: bool = True) -> Column:
    """The index of the bucket that holds r: half-open, the last one closed if asked; -1 outside, null if r is."""
    out = F.when(r.isNull(), F.lit(None).cast("int"))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = (r >= a) & ((r <= b) if last_closed and k == len(edges) - 2 else (r < b))
        out = out.when(inside, F.lit(k))
    return out.otherwise(F.lit(-1))


def bucket_label(index: Column, edges: Sequence[int]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = out.when(index == k, F.lit(f"{a}-{b} m"))
    return out
