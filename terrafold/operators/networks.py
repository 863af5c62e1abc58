"""What networks get and give: crops, splits and mixes of scans, per-point normals, predictions from class probabilities."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.integers import finite
from terrafold.functions.labels import representative
from terrafold.operators import motion, voxels


def cropped(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """points with `inside`: finite and strictly between the corners of a box."""
    xyz = [F.col(c).cast("double") for c in "xyz"]
    inside = finite(*xyz)
    for c, a, b in zip(xyz, low, high, strict=True):
        inside = inside & (c > a) & (c < b)
    return points.withColumn("inside", F.coalesce(inside, F.lit(False)))


def from_probabilities(points: DataFrame, logits: str = "logits") -> DataFrame:
    """points (inside, logits: an array of 20 numbers) with raw_id and conf (0 to 255): the likeliest class, the first on ties, as
    its raw label, and its share by softmax, rounded half up; 0 and 0 outside the crop or without logits."""
    most = F.array_max(logits)
    best = F.array_position(logits, most) - 1
    share = 1.0 / F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - most))
    there = F.coalesce(F.col("inside") & F.col(logits).isNotNull(), F.lit(False))
    conf = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")
    return points.withColumns({"raw_id": F.when(there, representative(F.when(there, best).otherwise(0).cast("int"))).otherwise(0), "conf": F.when(there, conf).otherwise(0)})


def extended_geometry(native: tuple[Sequence[float], Sequence[float], Sequence[int]], extended: tuple[Sequence[float], Sequence[float], Sequence[int]]) -> tuple[float, ...]:
    """The voxel size that two volumes (low, high, cells) share; volumes with different ones are refused."""
    sizes = [tuple((b - a) / n for a, b, n in zip(low, high, cells, strict=True)) for low, high, cells in (native, extended)]
    if any(abs(a - b) > 1e-12 for a, b in zip(*sizes, strict=True)):
        raise ValueError(f"voxel sizes differ: {sizes[0]} and {sizes[1]}")
    return sizes[0]


def file_sha256(path: str) -> str:
    """The SHA-256 of a local file, read in parts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def voxelised_by_size(points: DataFrame, size: float, scales: Sequence[int], keys: Sequence[str] = ("frame",)) -> DataFrame:
    """points for each scale with i, j, k: the voxel of edge size * scale, counted from the lowest voxel of the key."""
    out = points.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    own = Window.partitionBy(*keys, "scale")
    raw = {n: F.floor(F.col(c).cast("double") / (F.lit(size) * F.col("scale"))) for n, c in zip("ijk", "xyz", strict=True)}
    out = out.withColumns(raw)
    return out.withColumns({n: F.col(n) - F.min(n).over(own) for n in "ijk"})


def centred(points: DataFrame, with_z: bool = True, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """points moved so that the middle of each scan's ground box and, if with_z, its lowest point are the origin."""
    ends = points.groupBy(*keys).agg(*((F.min(c) + F.max(c)).cast("double").alias(f"_{c}") for c in "xy"), F.min("z").cast("double").alias("_z"))
    out = points.join(ends, [*keys])
    moved = {c: F.col(c).cast("double") - F.col(f"_{c}") / 2 for c in "xy"}
    return out.withColumns(moved | ({"z": F.col("z").cast("double") - F.col("_z")} if with_z else {})).drop("_x", "_y", "_z")


def polar(points: DataFrame) -> DataFrame:
    """points with rho and phi on the ground."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return points.withColumns({"rho": F.sqrt(x * x + y * y), "phi": F.atan2(y, x)})


def sphere_crop(points: DataFrame, most: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The `most` points of each scan nearest to its middle point (by order of pid, then place); scans that small stay whole."""
    own = Window.partitionBy(*keys)
    ranked = points.withColumns({"_k": F.row_number().over(own.orderBy("pid", "x", "y", "z")) - 1, "_n": F.count(F.lit(1)).over(own)})
    middle = ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2)).select(*keys, *(F.col(c).cast("double").alias(f"_{c}") for c in "xyz"))
    far = sum(((F.col(c).cast("double") - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    out = ranked.join(middle, [*keys]).withColumn("_r", F.row_number().over(own.orderBy(far, "pid")))
    return out.filter(F.col("_r") <= most).select(*points.columns)


def turned(points: DataFrame, degrees: Column | float, flip_x: bool = False, flip_y: bool = False) -> DataFrame:
    """points turned around the vertical axis, then mirrored."""
    a = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    u, v = x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)
    return points.withColumns({"x": -u if flip_x else u, "y": -v if flip_y else v})


def sector_swapped(a: DataFrame, b: DataFrame, start: float, end: float) -> DataFrame:
    """Scan a with its sector (clockwise angle strictly between start and end, radians) replaced by that of b."""
    inside = (F.lit(0.0) - F.atan2(F.col("y").cast("double"), F.col("x").cast("double"))).between(start, end)
    edge = (F.lit(0.0) - F.atan2(F.col("y").cast("double"), F.col("x").cast("double"))).isin(start, end)
    sector = inside & ~edge
    return a.filter(~sector).unionByName(b.filter(sector))


def pasted_copies(scan: DataFrame, other: DataFrame, label: str, classes: Sequence[int], angles: Sequence[float]) -> DataFrame:
    """A scan with the other's points of some classes, once as they are and once for each angle (radians), turned clockwise."""
    things = other.filter(F.col(label).isin(*classes))
    turn = F.explode(F.array(*(F.struct(F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s")) for t in (0.0, *angles))))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    # A row vector times the matrix (cos, sin; -sin, cos).
    copies = things.withColumn("_t", turn).withColumns({"x": x * F.col("_t.c") - y * F.col("_t.s"), "y": x * F.col("_t.s") + y * F.col("_t.c")}).drop("_t")
    return scan.withColumns({"x": x, "y": y}).unionByName(copies.select(*scan.columns))


def mixed_in(scan: DataFrame, other: DataFrame, least: int = 1) -> DataFrame:
    """A scan with the other's points of instances, whose pids follow the scan's own."""
    top = scan.agg(F.coalesce(F.max("pid") + 1, F.lit(0)).alias("_top"))
    things = other.filter(F.col("inst") >= least).crossJoin(F.broadcast(top))  # one row
    return scan.unionByName(things.withColumn("pid", F.col("pid") + F.col("_top")).select(*scan.columns))


def collated(scans: Sequence[DataFrame]) -> DataFrame:
    """Scans one below the other, with `batch`, their number."""
    out = scans[0].withColumn("batch", F.lit(0))
    for k, s in enumerate(scans[1:], 1):
        out = out.unionByName(s.withColumn("batch", F.lit(k)))
    return out


def shuffled(points: DataFrame, seed: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """points with pid dealt anew in each scan, by a seeded hash."""
    own = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "pid"), "pid")
    return points.withColumn("pid", (F.row_number().over(own) - 1).cast("bigint"))


def nearest_image(points: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Of points with r, u, v the nearest one of each pixel: v, u, x, y, z, pid; ties go to the last pid."""
    best = F.min_by(F.struct("x", "y", "z", "pid"), F.struct("r", -F.col("pid"))).alias("_p")
    return points.groupBy(*keys, "v", "u").agg(best).select(*keys, "v", "u", "_p.*")


def point_normals(points: DataFrame, keys: Sequence[str] = ("frame",), height: int = 64, width: int = 900, up: float = 3.0, down: float = -25.0) -> DataFrame:
    """points (pid, x, y, z) with nx, ny, nz of their pixel: 0 where the image gives no normal. Holes of the image aren't filled."""
    seen = motion.projected(points, height, width, up, down)
    found = voxels.normals(nearest_image(seen, keys), keys, width)
    out = seen.join(found, [*keys, "v", "u"], "left")
    return out.withColumns({f"n{c}": F.coalesce(f"n{c}", F.lit(0.0)) for c in "xyz"}).select(*points.columns, "nx", "ny", "nz")


#: The sequences of each split.
SPLITS = {"train": (0, 1, 2, 3, 4, 5, 6, 7, 9, 10), "val": (8,), "test": tuple(range(11, 22))}


def split(points: DataFrame, name: str) -> DataFrame:
    """The points of a split's sequences, with `label` (the 19 classes, 0 for none) and `inst`; those of the test split have no
    labels: 0 and 0."""
    from terrafold.functions.labels import classified, instance

    kept = points.filter(F.col("seq").cast("int").isin(*SPLITS[name]))
    if name == "test":
        return kept.withColumns({"label": F.lit(0), "inst": F.lit(0).cast("bigint")})
    return classified(kept).withColumns({"label": F.col("learning_id"), "inst": instance(F.col("raw"))}).select(*points.columns, "label", "inst")
