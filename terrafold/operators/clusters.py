"""Neighbours within a radius, nearest neighbours, clusters, and boxes around them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, Settings
from terrafold.shipping import ship_package
from terrafold.storage import written


def _buckets(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({f"b{c}": F.floor(F.col(c).cast("double") / side) for c in "xyz"})


def radius_join(points: DataFrame, most: float, eps: Column, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """pid, other, d2: other points of the frame within eps (a column of the first point, at most `most`).

    Space is cut into cubes of side `most`; the first point is sent to the 27 cubes around it, so this is an equi-join.
    """
    shift = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    here = _buckets(points, most)
    sent = here.select(*keys, "pid", "x", "y", "z", eps.alias("_eps"), "bx", "by", "bz", F.explode(shift).alias("_s"))
    sent = sent.select(*keys, "pid", "x", "y", "z", "_eps", (F.col("bx") + F.col("_s.a")).alias("bx"), (F.col("by") + F.col("_s.b")).alias("by"), (F.col("bz") + F.col("_s.c")).alias("bz"))
    there = here.select(*keys, F.col("pid").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"), "bx", "by", "bz")
    met = sent.join(there, [*keys, "bx", "by", "bz"]).filter("pid <> other")
    d2 = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return met.withColumn("d2", d2).filter(F.col("d2") <= F.col("_eps") * F.col("_eps")).select(*keys, "pid", "other", "d2")


def nearest(left: DataFrame, right: DataFrame, side: float, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """pid and distance of each left point's nearest right point of its key; left points of keys without right points have no row.

    A point asks the 27 cubes around it. What it finds within one cube's side is nearest for certain; points that find
    nothing so near ask again with cubes twice as large, until all are answered, however far that is. The points left are
    written after each round, so plans don't grow with rounds.
    """
    names = [*keys, "pid"]
    there = right.select(*keys, *(F.col(c).cast("double").alias(f"o{c}") for c in "xyz"))
    todo = left.select(*names, *(F.col(c).cast("double").alias(c) for c in "xyz")).join(there.select(*keys).distinct(), [*keys], "left_semi")
    shift = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    out, size = None, side
    while True:
        far = there.withColumns({f"b{c}": F.floor(F.col(f"o{c}") / size) for c in "xyz"})
        sent = _buckets(todo, size).withColumn("_s", F.explode(shift))
        sent = sent.withColumns({"bx": F.col("bx") + F.col("_s.a"), "by": F.col("by") + F.col("_s.b"), "bz": F.col("bz") + F.col("_s.c")})
        d2 = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        got = sent.join(far, [*keys, "bx", "by", "bz"]).groupBy(*names).agg(F.min(d2).alias("_d2")).filter(F.col("_d2") <= size * size)
        both = written(todo.join(got, names, "left"), "nearest")
        sure = both.filter("_d2 IS NOT NULL").select(*names, F.sqrt("_d2").alias("distance"))
        out = sure if out is None else out.unionByName(sure)
        todo = both.filter("_d2 IS NULL").drop("_d2")
        if todo.isEmpty():
            return out
        size *= 2


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n reaches over undirected edges."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _near(xyz: np.ndarray, eps: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i included, with j within eps[i] of i, by a sort on cubes; at most about `most` candidates at a time."""
    side = max(float(eps.max(initial=0.0)), 1e-9)
    cube = np.floor(xyz / side).astype(np.int64)
    if len(cube):
        cube -= cube.min(0) - 1
    dims = cube.max(0) + 2 if len(cube) else np.ones(3, np.int64)
    key = (cube[:, 0] * dims[1] + cube[:, 1]) * dims[2] + cube[:, 2]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            target = key + (a * dims[1] + b) * dims[2]
            lo, hi = np.searchsorted(ordered, target - 1), np.searchsorted(ordered, target + 1, "right")
            total = np.concatenate([[0], np.cumsum(hi - lo)])
            at = 0
            while at < len(xyz):
                to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
                n = hi[at:to] - lo[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = order[np.repeat(lo[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                near = ((xyz[i] - xyz[j]) ** 2).sum(1) <= eps[i] ** 2
                first.append(i[near])
                second.append(j[near])
                at = to
    return np.concatenate(first), np.concatenate(second)


def _numbered(roots: np.ndarray, least: int) -> np.ndarray:
    """Clusters by size, the largest first, ties by their first point; -1 for those that are too small."""
    found, inverse, n = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.lexsort((found, -n))
    number = np.full(len(found), -1)
    big = [k for k in order.tolist() if n[k] >= least]
    number[big] = np.arange(len(big))
    return number[inverse]


def clustered(points: DataFrame, keys: Sequence[str] = ("frame",), settings: Settings = DEFAULTS) -> DataFrame:
    """pid and cluster of each point: components of neighbours within eps0 + eps1 * range, -1 for small ones.

    A frame is a bounded scan and the unit of work, one task each.
    """

    ship_package(points.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        xyz = np.stack([table[c].to_numpy() for c in "xyz"], 1).astype(np.float64)
        eps = settings.eps0_m + settings.eps1_rel * np.linalg.norm(xyz, axis=1)
        label = _numbered(_roots(len(xyz), *_near(xyz, eps)), settings.min_points)
        return table.select([*keys, "pid"]).append_column("cluster", pa.array(label, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys, "pid").schema.fields)
    return points.select(*keys, "pid", "x", "y", "z").groupBy(*keys).applyInArrow(run, f"{kinds}, cluster long")


def dbscan(points: DataFrame, eps: float, min_samples: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """pid and part of each point: density clusters by order of their first point, -1 for noise. A point on the border
    of several belongs to the first."""

    ship_package(points.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        xyz = np.stack([table[c].to_numpy() for c in "xyz"], 1).astype(np.float64)
        i, j = _near(xyz, np.full(len(xyz), eps))
        core = np.bincount(i, minlength=len(xyz)) >= min_samples
        both = core[i] & core[j]
        roots = _roots(len(xyz), i[both], j[both])
        numbers = {r: k for k, r in enumerate(np.unique(roots[core]).tolist())}
        label = np.array([numbers[r] if c else -1 for r, c in zip(roots.tolist(), core.tolist(), strict=True)], np.int64)
        edge = ~core[i] & core[j]
        best = np.full(len(xyz), np.iinfo(np.int64).max)
        np.minimum.at(best, i[edge], label[j[edge]])
        label = np.where(~core & (best < np.iinfo(np.int64).max), best, label)
        return table.select([*keys, "pid"]).append_column("part", pa.array(label, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys, "pid").schema.fields)
    return points.select(*keys, "pid", "x", "y", "z").groupBy(*keys).applyInArrow(run, f"{kinds}, part long")


def aligned_boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axis-aligned boxes: centre, size and volume."""
    ends = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    size = {f"d{c}": F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in "xyz"}
    out = ends.withColumns({f"c{c}": (F.col(f"{c}_hi") + F.col(f"{c}_lo")) / 2 for c in "xyz"} | size)
    return out.withColumn("volume", F.col("dx") * F.col("dy") * F.col("dz")).select(*keys, "n", "cx", "cy", "cz", "dx", "dy", "dz", "volume")


def oriented_boxes(points: DataFrame, keys: Sequence[str], step: float = DEFAULTS.angle_step_deg) -> DataFrame:
    """The smallest rectangle on the ground around each object, over angles from 0 to under 90 degrees; length >= width.

    Every point meets every angle (a few constants), then one aggregation takes extents by object and angle.
    """
    angles = [math.radians(k * step) for k in range(math.ceil(90 / step))]
    turn = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s"), F.lit(t).alias("t")) for k, t in enumerate(angles))))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    out = points.withColumn("_a", turn).withColumns({"_x": x * F.col("_a.c") + y * F.col("_a.s"), "_y": y * F.col("_a.c") - x * F.col("_a.s")})
    ends = out.groupBy(*keys, "_a").agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.count(F.lit(1)).alias("n"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = ends.groupBy(*keys).agg(F.min_by(F.struct("_a", "x0", "x1", "y0", "y1", "z0", "z1", "n"), F.struct(area, F.col("_a.k"))).alias("b"))
    c, s, t = F.col("b._a.c"), F.col("b._a.s"), F.col("b._a.t")
    mx, my = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    length, width = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    return best.select(
        *keys, F.col("b.n").alias("n"), (mx * c - my * s).alias("cx"), (mx * s + my * c).alias("cy"), ((F.col("b.z0") + F.col("b.z1")) / 2).alias("cz"),
        F.greatest(length, width).alias("length"), F.least(length, width).alias("width"), (F.col("b.z1") - F.col("b.z0")).alias("height"),
        F.when(length >= width, t).otherwise(t + math.pi / 2).alias("yaw"),
    )
