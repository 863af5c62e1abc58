"""Voxels of points at several scales, features of points in them, normals from range images, votes over passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def voxelised(points: DataFrame, low: Sequence[float], size: float, scales: Sequence[int], keys: Sequence[str] = ("frame",)) -> DataFrame:
    """points for each scale s with i, j, k: the voxel, of edge size * s, truncated from the lower corner."""
    out = points.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    return out.withColumns({n: ((F.col(c).cast("double") - lo) / (size * F.col("scale"))).cast("bigint") for n, c, lo in zip("ijk", "xyz", low, strict=True)})


def numbered(voxels: DataFrame, keys: Sequence[str] = ("frame", "scale")) -> DataFrame:
    """voxels with `voxel`, the number of each point's voxel in order of i, j, k."""
    return voxels.withColumn("voxel", F.dense_rank().over(Window.partitionBy(*keys).orderBy("i", "j", "k")) - 1)


def point_features(voxels: DataFrame, low: Sequence[float], size: float, keys: Sequence[str] = ("frame", "scale")) -> DataFrame:
    """Offsets of each point to its voxel's mean and to its voxel's lower corner."""
    own = Window.partitionBy(*keys, "i", "j", "k")
    edge = size * F.col("scale")
    mean = {f"m{c}": F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(own) for c in "xyz"}
    corner = {f"o{c}": F.col(c).cast("double") - (lo + F.col(n) * edge) for n, c, lo in zip("ijk", "xyz", low, strict=True)}
    return voxels.withColumns(mean | corner)


def voxel_means(voxels: DataFrame, values: Sequence[str], keys: Sequence[str] = ("frame", "scale")) -> DataFrame:
    return voxels.groupBy(*keys, "i", "j", "k").agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))


def summed_votes(scores: DataFrame, key: str, cls: str, value: str) -> DataFrame:
    """The class of the highest summed score over several passes; the lowest class on ties."""
    total = scores.groupBy(key, cls).agg(F.sum(value).alias("_s"))
    return total.groupBy(key).agg(F.max_by(cls, F.struct("_s", -F.col(cls))).alias(cls), F.max("_s").alias(value))


def nearest_points(points: DataFrame, n: int, cx: Column, cy: Column, keys: Sequence[str] = ("frame",), tie: str = "pid") -> DataFrame:
    """The n points of each key nearest to a place on the ground."""
    d2 = (F.col("x_mm") - cx) ** 2 + (F.col("y_mm") - cy) ** 2
    out = points.withColumn("d2", d2.cast("double")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("d2", tie)))
    return out.filter(F.col("_k") <= n).drop("_k")


def normals(image: DataFrame, keys: Sequence[str] = ("frame",), width: int = 900) -> DataFrame:
    """Unit normals of a range image of points (v, u, x, y, z): the cross product of the steps to the right neighbour
    (columns wrap around) and the one below; pixels without both have none."""
    right = image.select(*keys, "v", F.pmod(F.col("u") - 1, F.lit(width)).alias("u"), *(F.col(c).alias(f"r{c}") for c in "xyz"))
    below = image.select(*keys, (F.col("v") - 1).alias("v"), "u", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    out = image.join(right, [*keys, "v", "u"]).join(below, [*keys, "v", "u"])
    a = [F.col(f"r{c}").cast("double") - F.col(c) for c in "xyz"]
    b = [F.col(f"b{c}").cast("double") - F.col(c) for c in "xyz"]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return out.select(*keys, "v", "u", *(F.when(size > 0, x / size).alias(f"n{c}") for c, x in zip("xyz", n, strict=True)))
