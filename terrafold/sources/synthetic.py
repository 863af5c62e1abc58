"""A synthetic street, ray by ray: ground planes and boxes, nearest hit wins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.operators.motion import matmul, rigid_inverse

#: Boxes of the scene as raw label, centre, size (m); and ground strips as label, |y| from, to, height.
BOXES = (
    (50, (20.0, 14.0, 1.0), (30.0, 4.0, 6.0)), (50, (20.0, -14.0, 1.0), (30.0, 4.0, 6.0)), (10, (12.0, 3.5, -0.9), (4.2, 1.8, 1.5)),
    (252, (25.0, 0.0, -0.9), (4.4, 1.9, 1.5)), (30, (9.0, -4.0, -0.8), (0.6, 0.6, 1.8)), (80, (15.0, 6.5, 1.0), (0.2, 0.2, 5.0)), (71, (18.0, -7.0, 0.5), (0.5, 0.5, 4.0)),
)
STRIPS = ((40, 0.0, 5.0, -1.73), (48, 5.0, 9.0, -1.61), (72, 9.0, 1e9, -1.73))


def street(spark: SparkSession, frames: Sequence[int], beams: int = 64, columns: int = 1024, up: float = 2.0, down: float = -24.0, nearest: float = 2.5, farthest: float = 120.0, step: float = 0.8, noise: float = 0.01, seed: int = 8) -> DataFrame:
    """frame, pid, x, y, z, raw of every ray that hits something; the sensor drives along x by `step` a frame.

    Noise is a hash of frame and ray, so results are the same on any number of machines.
    """
    rays = spark.range(beams * columns).withColumn("frame", F.explode(F.array(*(F.lit(f) for f in frames))))
    beam, column = F.floor(F.col("id") / columns), F.col("id") % columns
    pitch = F.radians(F.lit(up) - beam * ((up - down) / max(1, beams - 1)))
    yaw = (column + 0.5) * (2 * math.pi / columns) - math.pi
    rays = rays.withColumns({"dx": F.cos(pitch) * F.cos(yaw), "dy": F.cos(pitch) * F.sin(yaw), "dz": F.sin(pitch), "ego": F.col("frame") * step})
    hits = []
    for label, a, b, height in STRIPS:
        t = F.lit(height) / F.col("dz")
        y = F.abs(t * F.col("dy"))
        hits.append(F.when((F.col("dz") < 0) & (y >= a) & (y < b), F.struct(t.alias("t"), F.lit(label).alias("raw"))))
    for label, centre, size in BOXES:
        low, high = [], []
        for d, c, s in zip(("dx", "dy", "dz"), centre, size, strict=True):
            shift = F.col("ego") if d == "dx" else F.lit(0.0)
            near, far = (c - s / 2 - shift) / F.col(d), (c + s / 2 - shift) / F.col(d)
            low.append(F.least(near, far))
            high.append(F.greatest(near, far))
        enter, leave = F.greatest(*low), F.least(*high)
        hits.append(F.when((enter > 0) & (enter <= leave), F.struct(enter.alias("t"), F.lit(label).alias("raw"))))
    out = rays.withColumn("hit", F.array_min(F.array_compact(F.array(*hits)))).filter("hit IS NOT NULL")
    u1 = (F.pmod(F.xxhash64(F.lit(seed), "frame", "id"), F.lit(1 << 30)) + 1) / float(1 << 30)
    u2 = F.pmod(F.xxhash64(F.lit(seed + 1), "frame", "id"), F.lit(1 << 30)) / float(1 << 30)
    r = F.col("hit.t") + noise * F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    out = out.withColumn("r", r).filter(F.col("r").between(nearest, farthest))
    return out.select("frame", F.col("id").alias("pid"), *((F.col(f"d{c}") * F.col("r")).cast("float").alias(c) for c in "xyz"), F.lit(1.0).cast("float").alias("remission"), F.col("hit.raw").cast("bigint").alias("raw"))


#: Fixed values of generated scenes (m): heights of the sensor, kerb and terrain; half width of the road, outer edge of the pavement; ends.
SENSOR, KERB, TERRAIN, ROAD_HALF, PAVEMENT = 1.73, 0.12, 0.05, 5.0, 8.0
SCENE_X = (-120.0, 400.0)
#: Reflectivity by raw label.
REMISSION = {40: 0.25, 60: 0.8, 48: 0.3, 72: 0.2, 50: 0.35, 80: 0.5, 70: 0.15, 71: 0.2, 10: 0.6, 252: 0.6, 30: 0.3, 254: 0.3}


def trajectory(spark: SparkSession, n: int, dt: float = 0.1, speed: float = 8.0) -> DataFrame:
    """frame, ts and pose (sensor to world, 4 x 4) of a vehicle that weaves gently: places are running sums of its steps."""
    own = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)  # one small row a frame
    rows = spark.range(n).select(F.col("id").cast("int").alias("frame"), (F.col("id") * F.lit(dt)).alias("ts"))
    rows = rows.withColumn("yaw", 0.035 * F.sin(0.8 * F.col("ts")))
    step = {"x": F.cos("yaw"), "y": F.sin("yaw")}
    rows = rows.withColumns({k: F.coalesce(F.sum(v * speed * dt).over(own), F.lit(0.0)) for k, v in step.items()})
    zero, one = F.lit(0.0), F.lit(1.0)
    c, s = F.cos("yaw"), F.sin("yaw")
    return rows.select("frame", "ts", F.array(c, -s, zero, F.col("x"), s, c, zero, F.col("y"), zero, zero, one, zero, zero, zero, zero, one).alias("pose"))


def camera_poses(poses: DataFrame, tr: Sequence[float]) -> DataFrame:
    """poses of the sensor as those of a camera that tr (sensor to camera, 4 x 4) leads to: tr, pose, and back."""
    t = F.array(*map(F.lit, map(float, tr)))
    return poses.withColumns({"pose": matmul(matmul(t, F.col("pose")), rigid_inverse(t)), "tr": t})


def scene(spark: SparkSession, seed: int) -> DataFrame:
    """Boxes of a street: box, raw, instance, x0 to z1 (m), vx: kerb faces, houses with gaps, poles, trees (trunk and canopy), parked
    cars, a moving car, a moving and a standing person. Gaps and sizes are hashes of the seed; rows follow from their place."""
    road = -SENSOR
    pave, soil = road + KERB, road + TERRAIN
    low, high = SCENE_X
    rows: list[tuple] = []

    def drawn(a: float, b: float, *key: object) -> float:
        return a + (b - a) * int.from_bytes(hashlib.md5(repr((seed, *key)).encode()).digest()[:6]) / 2**48

    def row_of(name: str, start: float, gap: tuple[float, float], one) -> None:
        x, k = start, 0
        while x < high:
            x += one(x, k) + drawn(*gap, name, k, "gap")
            k += 1

    def box(x: tuple[float, float], y: tuple[float, float], z: tuple[float, float], raw: int, instance: int = 0, vx: float = 0.0) -> float:
        rows.append((len(rows), raw, instance, *map(float, (*x, *sorted(y), *z)), vx))
        return x[1] - x[0]

    for side in (-1.0, 1.0):
        box((low, high), (side * ROAD_HALF, side * (ROAD_HALF + 0.02)), (road, pave), 48)

        def house(x: float, k: int, side: float = side) -> float:
            near, deep = side * drawn(12, 15, side, k, "near"), side * drawn(6, 12, side, k, "deep")
            return box((x, x + drawn(10, 22, side, k, "wide")), (near, near + deep), (road, drawn(5, 14, side, k, "high")), 50)

        def pole(x: float, k: int, side: float = side) -> float:
            return 0.0 * box((x, x + 0.2), (side * 6.5 - 0.1, side * 6.5 + 0.1), (pave, 4.5), 80)

        def tree(x: float, k: int, side: float = side) -> float:
            box((x - 0.15, x + 0.15), (side * 9.5 - 0.15, side * 9.5 + 0.15), (soil, 0.6), 71)
            return 0.0 * box((x - 1.5, x + 1.5), (side * 9.5 - 1.5, side * 9.5 + 1.5), (0.6, 3.0), 70)

        row_of(f"houses{side}", low + drawn(0, 10, side, "houses"), (4, 12), house)
        row_of(f"poles{side}", low + drawn(0, 12, side, "poles"), (10, 16), pole)
        row_of(f"trees{side}", low + drawn(0, 20, side, "trees"), (15, 30), tree)
    row_of("cars", 8.0, (9, 20), lambda x, k: 0.0 * box((x, x + 4.2), (-4.7, -2.9), (road, road + 1.5), 10, k + 1))
    last = max(r[2] for r in rows)
    box((20.0, 24.4), (1.2, 3.0), (road, road + 1.5), 252, last + 1, 13.0)
    box((12.0, 12.5), (5.8, 6.3), (pave, pave + 1.75), 254, last + 2, 1.4)
    box((30.0, 30.5), (-6.3, -5.8), (pave, pave + 1.75), 30, last + 3)
    return spark.createDataFrame(rows, "box int, raw int, instance int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, vx double")


def rendered(boxes: DataFrame, poses: DataFrame, beams: int = 64, columns: int = 1024, up: float = 2.0, down: float = -24.8, nearest: float = 2.5, farthest: float = 120.0, noise: float = 0.01, seed: int = 8) -> DataFrame:
    """frame, pid, x, y, z, remission, raw (with the instance in its upper half) of all rays of all frames that hit something.

    poses: frame, ts, pose. A ray meets only boxes that can lie in its column: boxes are sent to the columns between their
    corners' angles, and columns and rays meet in an equi-join. The ground is a road, kerbs, pavements and terrain. The nearest
    hit wins; noise is a hash of frame and ray.
    """
    spark = boxes.sparkSession
    m = lambda k: F.get("pose", F.lit(k))
    width = 2 * math.pi / columns
    rays = spark.range(beams * columns).select(F.col("id").alias("pid"), F.floor(F.col("id") / columns).alias("beam"), (F.col("id") % columns).cast("int").alias("column"))
    pitch = F.radians(F.lit(up) - F.col("beam") * ((up - down) / max(1, beams - 1)))
    yaw = (F.col("column") + 0.5) * width - math.pi
    rays = rays.withColumns({"lx": F.cos(pitch) * F.cos(yaw), "ly": F.cos(pitch) * F.sin(yaw), "lz": F.sin(pitch)})
    shots = rays.crossJoin(F.broadcast(poses))  # a row for each ray and frame is what is asked for
    shots = shots.withColumns({"dx": m(0) * F.col("lx") + m(1) * F.col("ly"), "dy": m(4) * F.col("lx") + m(5) * F.col("ly"), "dz": F.col("lz"), "ox": m(3), "oy": m(7)})
    # The ground: the plane of each strip, if it is met within it.
    t = lambda z: F.lit(z) / F.col("dz")
    hits = []
    for z, a, b, raw in ((-SENSOR, 0.0, ROAD_HALF, 40), (-SENSOR + KERB, ROAD_HALF, PAVEMENT, 48), (-SENSOR + TERRAIN, PAVEMENT, 1e9, 72)):
        far = F.abs(F.col("oy") + t(z) * F.col("dy"))
        label = F.when((far > 1.95) & (far < 2.1), 60).otherwise(raw) if raw == 40 else F.lit(raw)
        hits.append(F.when((F.col("dz") < 0) & (far >= a) & (far < b), F.struct(t(z).alias("t"), label.cast("bigint").alias("raw"))))
    ground = shots.select("frame", "pid", F.array_min(F.array_compact(F.array(*hits))).alias("hit")).filter("hit IS NOT NULL")
    moved = boxes.crossJoin(F.broadcast(poses)).withColumns({c: F.col(c) + F.col("vx") * F.col("ts") for c in ("x0", "x1")})  # a few hundred boxes a frame
    # Angles of the corners as the sensor sees them, unwrapped around the first.
    for k, (x, y) in enumerate((x, y) for x in ("x0", "x1") for y in ("y0", "y1")):
        gx, gy = F.col(x) - m(3), F.col(y) - m(7)
        moved = moved.withColumn(f"a{k}", F.atan2(gy * m(0) - gx * m(4), gx * m(0) + gy * m(4)))
    rel = [F.pmod(F.col(f"a{k}") - F.col("a0") + math.pi, F.lit(2 * math.pi)) - math.pi for k in range(4)]
    moved = moved.withColumns({"low": F.least(*rel), "high": F.greatest(*rel)})
    first, last = F.floor((F.col("a0") + F.col("low") + math.pi) / width) - 1, F.ceil((F.col("a0") + F.col("high") + math.pi) / width) + 1
    whole = F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))
    some = F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(columns).cast("bigint"))))
    moved = moved.withColumn("columns", F.when(F.col("high") - F.col("low") >= math.pi, whole).otherwise(some))
    sent = moved.withColumn("column", F.explode("columns")).withColumn("column", F.col("column").cast("int")).drop("columns", "low", "high", "a0", "a1", "a2", "a3")
    met = shots.join(sent.drop("ts", "pose"), ["frame", "column"])
    near, far = [], []
    for d, o, a, b in (("dx", F.col("ox"), "x0", "x1"), ("dy", F.col("oy"), "y0", "y1"), ("dz", F.lit(0.0), "z0", "z1")):
        u, v = (F.col(a) - o) / F.col(d), (F.col(b) - o) / F.col(d)
        near.append(F.least(u, v))
        far.append(F.greatest(u, v))
    enter, leave = F.greatest(*near), F.least(*far)
    label = F.col("raw").cast("bigint") + F.col("instance").cast("bigint") * 65536
    struck = met.filter((enter > 0) & (enter <= leave)).select("frame", "pid", F.struct(enter.alias("t"), label.alias("raw")).alias("hit"))
    best = ground.unionByName(struck).groupBy("frame", "pid").agg(F.min("hit").alias("hit"))
    out = best.join(rays.select("pid", "lx", "ly", "lz"), "pid")
    u1 = (F.pmod(F.xxhash64(F.lit(seed), "frame", "pid"), F.lit(1 << 30)) + 1) / float(1 << 30)
    u2 = F.pmod(F.xxhash64(F.lit(seed + 1), "frame", "pid"), F.lit(1 << 30)) / float(1 << 30)
    r = F.col("hit.t") + noise * F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    out = out.withColumn("r", r).filter(F.col("r").between(nearest, farthest))
    bright = F.create_map(*(F.lit(x) for k, v in REMISSION.items() for x in (k, v)))
    remission = F.element_at(bright, F.col("hit.raw").bitwiseAND(65535).cast("int")).cast("float")
    return out.select("frame", "pid", *((F.col(f"l{c}") * F.col("r")).cast("float").alias(c) for c in "xyz"), remission.alias("remission"), F.col("hit.raw").alias("raw"))
