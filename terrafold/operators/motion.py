"""Motion: rigid transforms, range images, residual votes between frames, verdicts of clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, DYNAMIC, STATIC, Settings


def transformed(points: DataFrame, matrix: str, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """x, y, z through a row-major 4 x 4 matrix column."""
    x, y, z = (F.col(c).cast("double") for c in names)
    m = lambda k: F.get(F.col(matrix), F.lit(k))
    return points.withColumns({c: m(4 * k) * x + m(4 * k + 1) * y + m(4 * k + 2) * z + m(4 * k + 3) for k, c in enumerate(names)})


def matmul(a: Column, b: Column) -> Column:
    """The product of two row-major 4 x 4 matrices."""
    g = lambda m, k: F.get(m, F.lit(k))
    return F.array(*(g(a, 4 * i) * g(b, j) + g(a, 4 * i + 1) * g(b, 4 + j) + g(a, 4 * i + 2) * g(b, 8 + j) + g(a, 4 * i + 3) * g(b, 12 + j) for i in range(4) for j in range(4)))


def rigid_inverse(m: Column) -> Column:
    """The inverse of a rotation and translation: the transpose, and the translation turned back."""
    g = lambda k: F.get(m, F.lit(k))
    rows = []
    for i in range(3):
        rows += [g(i), g(4 + i), g(8 + i), -(g(i) * g(3) + g(4 + i) * g(7) + g(8 + i) * g(11))]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def relative_pose(to: Column, of: Column, tr: Column) -> Column:
    """The transform from frame `of` to frame `to`, both poses of a camera that tr leads to from the sensor."""
    return matmul(matmul(rigid_inverse(tr), rigid_inverse(to)), matmul(of, tr))


def rotation_degrees(m: Column) -> Column:
    trace = F.get(m, F.lit(0)) + F.get(m, F.lit(5)) + F.get(m, F.lit(10))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))


def lagged_frames(frames: DataFrame, gaps: Sequence[int], keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Each frame beside the frame `gap` before it, for several gaps in one join; frames without one are absent."""
    now = frames.withColumn("gap", F.explode(F.array(*map(F.lit, gaps)))).withColumn("prev_frame", F.col("frame") - F.col("gap"))
    before = frames.select(*keys, *(F.col(c).alias(f"prev_{c}") for c in frames.columns if c not in keys))
    return now.join(before, [*keys, "prev_frame"])


def continuity(frames: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """The previous frame, the time since it, and the number of the unbroken run that a frame belongs to."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys).orderBy("frame")
    out = frames.withColumns({"prev_frame": F.lag("frame").over(own), "dt": F.col("ts") - F.lag("ts").over(own)})
    new = F.when(F.col("prev_frame").isNull() | (F.col("frame") - F.col("prev_frame") != 1), 1).otherwise(0)
    return out.withColumn("_new", new).withColumn("run", F.sum("_new").over(own)).drop("_new")


def projected(points: DataFrame, height: int = 64, width: int = 1024, up: float = 3.0, down: float = -25.0) -> DataFrame:
    """r, u (column), v (row) and valid of each point on a spherical image, in double precision."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    r = F.sqrt(x * x + y * y + z * z)
    fov = math.radians(up - down)
    low = math.radians(down)
    pitch = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z / F.greatest(r, F.lit(1e-6)))))
    u = F.floor(0.5 * (1 - F.atan2(y, x) / math.pi) * width)
    v = F.floor((1 - (pitch - low) / fov) * height)
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    return points.withColumns({"r": r, "u": inside(u, width), "v": inside(v, height), "valid": F.coalesce((r > 0.1) & ~F.isnan(r) & (r < float("inf")), F.lit(False))})


def range_image(points: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The nearest range of each pixel that a valid point falls on."""
    return points.filter("valid").groupBy(*keys, "v", "u").agg(F.min("r").alias("r"))


def around_pixels(image: DataFrame, keys: Sequence[str] = ("frame",), height: int = 64, width: int = 1024, window: int = DEFAULTS.window) -> DataFrame:
    """For each pixel the ranges that the image has in the window around it, in `near` as (k, r), k by row, then column.

    Rows are clipped, columns wrap around. An image has few pixels for each frame, so its pixels go to their neighbours once
    and points need only their own.
    """
    half = window // 2
    side = range(-half, half + 1)
    # A pixel of row v is read from row v + a by the offset dv if v + a + dv, clipped, is v; mostly a = -dv.
    sent = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(dv).alias("dv"), F.lit(du).alias("du")) for a in side for dv in side for du in side)))
    out = image.withColumn("_s", sent).withColumn("_v", F.col("v") + F.col("_s.a"))
    met = F.least(F.greatest(F.col("_v") + F.col("_s.dv"), F.lit(0)), F.lit(height - 1)) == F.col("v")
    out = out.filter(F.col("_v").between(0, height - 1) & met)
    k = (F.col("_s.dv") + half) * window + F.col("_s.du") + half
    return out.groupBy(*keys, F.col("_v").alias("v"), F.pmod(F.col("u") - F.col("_s.du"), F.lit(width)).alias("u")).agg(F.collect_list(F.struct(k.alias("k"), "r")).alias("near"))


def residual_votes(now: DataFrame, image: DataFrame, keys: Sequence[str] = ("frame",), height: int = 64, width: int = 1024, settings: Settings = DEFAULTS, occlusion: bool = False) -> DataFrame:
    """now (with pid, r, u, v, valid) and a vote: the range of the image's pixels around each point that is closest to
    its own decides: 1 moving if farther than the tolerance, 0 if not, -1 if no pixel there has a range.

    On equal differences the first pixel in row, then column order decides. One equi-join on the points' own pixels.
    """
    near = around_pixels(image, keys, height, width, settings.window)
    met = now.join(near, [*keys, "v", "u"], "left")
    r = F.col("r")
    best = F.when(F.col("valid"), F.array_min(F.transform("near", lambda p: F.struct(F.abs(r - p["r"]).alias("diff"), p["k"].alias("k"), p["r"].alias("prev")))))
    tau = settings.tau0_m + settings.tau1_rel * r
    vote = F.when(F.col("_b").isNull(), -1).when(F.col("_b.diff") <= tau, 0)
    if occlusion:
        vote = vote.when(F.col("_b.prev") < r - tau, 0)
    return met.withColumn("_b", best).withColumn("vote", vote.otherwise(1)).select(*now.columns, "vote")


def joined_votes(votes: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Over several gaps a point is as moving as it looks in any."""
    return votes.groupBy(*keys, "pid").agg(F.max("vote").alias("vote"))


def cluster_verdicts(points: DataFrame, keys: Sequence[str] = ("frame",), settings: Settings = DEFAULTS) -> DataFrame:
    """For each cluster the points, those that vote moving, and the verdict: enough that do, in number and in share."""
    out = points.filter("cluster >= 0").groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vote") == 1).alias("n_moving"))
    return out.withColumn("is_moving", (F.col("n_moving") >= settings.vote_points) & (F.col("n_moving") >= settings.vote_share * F.col("n")))


def with_verdicts(points: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("frame",), critical: str = "critical") -> DataFrame:
    """Points of moving clusters are dynamic; of others static, unless they are vulnerable road users, who always count
    as moving; points of no cluster keep what they have."""
    out = points.join(verdicts.select(*keys, "cluster", F.col("is_moving").alias("_m")), [*keys, "cluster"], "left")
    moving = F.when(F.col(critical), True).when(F.col("_m").isNull(), F.col("moving")).otherwise(F.col("_m"))
    cls = F.when(F.col(critical), DYNAMIC).when(F.col("_m").isNull(), F.col("cls")).when(F.col("_m"), DYNAMIC).otherwise(STATIC)
    return out.withColumns({"moving": moving, "cls": cls}).drop("_m")
