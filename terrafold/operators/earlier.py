"""Earlier variants of the map, which differ from the present one: lengths in metres, classes 0 to 3 and 255, saturating counts.

Classes here: 0 drivable, 1 other ground, 2 static, 3 dynamic, 255 unknown. Rings are half-open in the larger of |x| and |y|.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import Preset
from terrafold.functions.labels import semantic
from terrafold.operators import clusters
from terrafold.operators.stencil import EIGHT

DRIVABLE, GROUND, STATIC, DYNAMIC, UNKNOWN = 0, 1, 2, 3, 255
#: Raw ids by class; the numbering of 22 classes, by raw id; those that can move, in either numbering.
DRIVABLE_IDS, GROUND_IDS = (40, 44, 60), (48, 49, 72)
STATIC_IDS = (10, 11, 13, 15, 16, 18, 20, 50, 51, 52, 70, 71, 80, 81, 99)
DYNAMIC_IDS = (30, 31, 32, 252, 253, 254, 255, 256, 257, 258, 259)
NUMBERS = {
    10: 0, 11: 1, 13: 4, 15: 3, 16: 5, 18: 6, 20: 7, 30: 8, 31: 9, 32: 10, 40: 11, 44: 12, 48: 13, 49: 14, 60: 15, 72: 16, 50: 17, 51: 18, 70: 2,
    71: 19, 80: 20, 81: 21, 252: 0, 253: 9, 254: 8, 255: 10, 256: 5, 257: 4, 258: 6, 259: 7,
}
#: A guard (cells) against rounding below an edge; a count's most; heights (m) of overhangs and of free space.
GUARD, MOST_COUNT, OVERHANG_M, FREE_M = 1e-9, 255, 0.30, 10.0
#: Fixed values of what can be crossed: slope (degrees), step and clearance (m).
MAX_SLOPE, MAX_STEP_M, MIN_CLEARANCE_M = 15.0, 0.10, 2.0


def classes(raw: Column) -> Column:
    """The class of a raw label."""
    s = semantic(raw)
    return F.when(s.isin(*DRIVABLE_IDS), DRIVABLE).when(s.isin(*GROUND_IDS), GROUND).when(s.isin(*STATIC_IDS), STATIC).when(s.isin(*DYNAMIC_IDS), DYNAMIC).otherwise(UNKNOWN)


def numbers(raw: Column) -> Column:
    """The number of a raw label among the 22 classes, 255 if it has none."""
    pairs = F.create_map(*(F.lit(x) for k, v in NUMBERS.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(pairs, semantic(raw).cast("int")), F.lit(UNKNOWN))


def label_dim(spark: SparkSession) -> DataFrame:
    """raw_id, number and class of all raw ids that have one: 33 rows."""
    ids = sorted({*DRIVABLE_IDS, *GROUND_IDS, *STATIC_IDS, *DYNAMIC_IDS})
    return spark.createDataFrame([(k,) for k in ids], "raw_id bigint").select("raw_id", numbers(F.col("raw_id")).alias("number"), classes(F.col("raw_id")).alias("cls"))


def class_of_number(number: Column) -> Column:
    """The class of one of the 22 numbers."""
    by = {n: c for c, ids in ((DRIVABLE, DRIVABLE_IDS), (GROUND, GROUND_IDS), (STATIC, STATIC_IDS), (DYNAMIC, (30, 31, 32))) for k in ids if (n := NUMBERS.get(k)) is not None}
    pairs = F.create_map(*(F.lit(x) for k, v in sorted(by.items()) for x in (k, v)))
    return F.coalesce(F.try_element_at(pairs, number.cast("int")), F.lit(UNKNOWN))


def movable(label: Column, space: str) -> Column:
    """Whether a label of a space (raw, number or class) is of something that can move."""
    if space == "raw":
        return semantic(label).isin(*(k for k in STATIC_IDS if k <= 20), *DYNAMIC_IDS)
    if space == "number":
        return label.isin(0, 1, 3, 4, 5, 6, 7, 8, 9, 10)
    if space == "class":
        return label.isin(STATIC, DYNAMIC)
    raise ValueError(f"no label space {space!r}")


def located(points: DataFrame, preset: Preset, z_range: tuple[float, float] = (-3.0, 5.0)) -> DataFrame:
    """ring, ix, iy of x, y (m) in double precision; points outside all rings or the closed range of heights go."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    far = F.greatest(F.abs(x), F.abs(y))
    ring, ix, iy = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0).cast("bigint")), F.when(F.lit(False), F.lit(0).cast("bigint"))
    for k, r in enumerate(preset.rings):
        out, cell = r.r / 1000, r.cell / 1000
        index = lambda c: F.least(F.greatest(F.floor((c + out) / cell + GUARD), F.lit(0)), F.lit(r.side - 1))  # noqa: B023, E731
        ring, ix, iy = ring.when(far < out, F.lit(k)), ix.when(far < out, index(x)), iy.when(far < out, index(y))
    return points.withColumns({"ring": ring, "ix": ix, "iy": iy}).filter(F.col("ring").isNotNull() & z.between(*z_range))


def cells(located_points: DataFrame, keys: Sequence[str] = ("frame",), rule: str = "safety", least: tuple[int, int] = (2, 2)) -> DataFrame:
    """Cells of points with z (m), cls (in these classes), moving, vru and conf (0 to 1): count (at most MOST_COUNT), cls,
    ground_z (mean), top_z (highest point that isn't ground, unknown ones too), overhang_z, conf and dyn_frac (0 to 255,
    shares of the saturated count), moving, vru.

    rule: safety (enough dynamic, then enough static points, then the commoner ground, drivable on ties) or majority (ties in
    order of class).
    """
    z, cls = F.col("z").cast("double"), F.col("cls")
    dynamic = (cls == DYNAMIC) | F.col("moving") | F.col("vru")
    ground = cls.isin(DRIVABLE, GROUND)
    held = located_points.groupBy(*keys, "ring", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(dynamic).alias("n3"), F.count_if(~dynamic & (cls == STATIC)).alias("n2"), F.count_if(~dynamic & (cls == DRIVABLE)).alias("n0"),
        F.count_if(~dynamic & (cls == GROUND)).alias("n1"), F.avg(F.when(ground, z)).alias("ground_z"), F.max(F.when(~ground, z)).alias("top_z"),
        F.sum(F.col("conf").cast("double")).alias("_c"), F.bool_or("moving").alias("moving"), F.bool_or("vru").alias("vru"),
    )
    n0, n1, n2, n3 = (F.col(f"n{k}") for k in range(4))
    if rule == "safety":
        found = F.when(n3 >= least[0], DYNAMIC).when(n2 >= least[1], STATIC).when(n0 + n1 == 0, UNKNOWN).when(n0 >= n1, DRIVABLE).otherwise(GROUND)
    else:
        most = F.greatest(n0, n1, n2, n3)
        found = F.when(n0 == most, DRIVABLE).when(n1 == most, GROUND).when(n2 == most, STATIC).otherwise(DYNAMIC)
    count = F.least("n", F.lit(MOST_COUNT).cast("bigint"))
    byte = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)).cast("int")
    above = F.when(F.col("top_z") - F.col("ground_z") > OVERHANG_M, F.col("top_z"))
    return held.select(*keys, "ring", "ix", "iy", count.alias("count"), found.alias("cls"), "ground_z", "top_z", above.alias("overhang_z"), byte(F.col("_c") / count * 255.0).alias("conf"), byte(n3 / count * 255.0).alias("dyn_frac"), "moving", "vru")


def derived(found: DataFrame, preset: Preset, keys: Sequence[str] = ("frame",), limits: tuple[float, float, float] = (MAX_SLOPE, MAX_STEP_M, MIN_CLEARANCE_M)) -> DataFrame:
    """cells() with slope_deg (one-sided where a neighbour has no ground), step_m over eight neighbours, clearance_m (FREE_M
    without an overhang) and traversable; the first three are null without ground. One exchange of neighbours."""
    at = [*keys, "ring", "ix", "iy"]
    own = [c for c in found.columns if c not in at]
    sides = {"c": (0, 0)} | EIGHT
    sent = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy")) for s, (dx, dy) in sides.items()))
    out = found.withColumn("_t", F.explode(sent)).select(
        *keys, "ring", (F.col("ix") + F.col("_t.dx")).alias("ix"), (F.col("iy") + F.col("_t.dy")).alias("iy"), F.col("_t.s").alias("_s"), F.col("ground_z").alias("_z"), *(F.when(F.col("_t.s") == "c", F.col(c)).alias(c) for c in own)
    )
    out = out.groupBy(*at).agg(F.max(F.col("_s") == "c").alias("_own"), *(F.max(c).alias(c) for c in own), *(F.max(F.when(F.col("_s") == s, F.col("_z"))).alias(f"_{s}") for s in EIGHT)).filter("_own").drop("_own")
    size = F.when(F.lit(False), F.lit(0.0))
    for k, r in enumerate(preset.rings):
        size = size.when(F.col("ring") == k, F.lit(r.cell / 1000))
    of = {v: f"_{s}" for s, v in EIGHT.items()}

    def along(dx: int, dy: int) -> Column:
        low, high, mid = F.col(of[-dx, -dy]), F.col(of[dx, dy]), F.col("ground_z")
        return F.coalesce((high - low) / (2 * size), (high - mid) / size, (mid - low) / size, F.lit(0.0))

    gx, gy = along(1, 0), along(0, 1)
    has = F.col("ground_z").isNotNull()
    step = F.greatest(*(F.coalesce(F.abs(F.col("ground_z") - F.col(f"_{s}")), F.lit(0.0)) for s in EIGHT))
    out = out.withColumns({"slope_deg": F.when(has, F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))), "step_m": F.when(has, step), "clearance_m": F.when(has, F.coalesce(F.col("overhang_z") - F.col("ground_z"), F.lit(FREE_M)))})
    slope, most, free = limits
    crosses = (F.col("cls") == DRIVABLE) & (F.col("count") > 0) & (F.col("slope_deg") <= slope) & (F.col("step_m") <= most) & (F.col("clearance_m") >= free)
    return out.withColumn("traversable", F.coalesce(crosses, F.lit(False))).drop(*(f"_{s}" for s in EIGHT))


def ring_fill(found: DataFrame, preset: Preset, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Cells that each ring has room for, those that are active, and their share."""
    side = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(preset.rings):
        side = side.when(F.col("ring") == k, F.lit(r.side**2))
    out = found.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("active")).withColumn("allocated", side)
    return out.withColumn("fill", F.round(F.col("active") / F.col("allocated"), 6))


#: Fixed values (mm) of the injected hazards: centre and radius, and depth; strips as x from, to, y from, to; heights; points.
POTHOLE, KERB, OVERHANG = ((7000, 0, 1000), 150), ((5000, 15000, 1800, 2500), 200), ((8000, 9500, -1500, 1500), 1500, 150)


def injected(points: DataFrame, keys: Sequence[str] = ("frame",)) -> tuple[DataFrame, DataFrame]:
    """Scans (pid, x_mm, y_mm, z_mm, cls in these classes) with a pothole, a kerb that leaves it out, and a low slab at fixed
    places; and for each what was changed: pothole, kerb (points), overhang (points added), reference (ground height).

    Ground is drivable or lower than a metre below the sensor; the slab hangs over the median height of that ground.
    """
    keys = list(keys)
    names = ["pid", "x_mm", "y_mm", "z_mm", "cls"]
    ground = (F.col("cls") == DRIVABLE) | (F.col("z_mm") < -1000)
    (cx, cy, radius), depth = POTHOLE
    (x0, x1, y0, y1), rise = KERB
    dx, dy = F.col("x_mm") - cx, F.col("y_mm") - cy
    hole = ground & (dx * dx + dy * dy <= radius * radius)
    strip = ground & F.col("x_mm").between(x0, x1) & F.col("y_mm").between(y0, y1) & ~hole
    marked = points.select(*keys, *names).withColumns({"_g": ground, "_h": hole, "_k": strip})
    (ox0, ox1, oy0, oy1), above, n = OVERHANG
    report = marked.groupBy(*keys).agg(F.count_if("_h").alias("pothole"), F.count_if("_k").alias("kerb"), F.coalesce(F.floor(F.median(F.when(F.col("_g"), F.col("z_mm")))).cast("bigint"), F.lit(-1730).cast("bigint")).alias("reference"))
    report = report.withColumn("overhang", F.lit(n))
    changed = marked.withColumn("z_mm", F.col("z_mm") - F.when(F.col("_h"), depth).otherwise(0) + F.when(F.col("_k"), rise).otherwise(0)).select(*keys, *names)
    slab = report.select(*keys, "reference", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("k"))
    # Spread evenly and without a generator: multiples of two odd steps, modulo the slab's sides.
    slab = slab.select(*keys, (-F.col("k") - 1).alias("pid"), (ox0 + F.col("k") * 617 % (ox1 - ox0 + 1)).alias("x_mm"), (oy0 + F.col("k") * 1361 % (oy1 - oy0 + 1)).alias("y_mm"), (F.col("reference") + above).alias("z_mm"), F.lit(STATIC).alias("cls"))
    return changed.unionByName(slab), report


def voted_boxes(points: DataFrame, keys: Sequence[str] = ("frame",), eps: float = 0.7, least: int = 10, share: float = 0.3) -> DataFrame:
    """Moving things: density clusters of movable points of which at least a share are candidates: keys, part, cls (the commonest
    label, the lowest on ties), agreement, n and the axis-aligned box.

    points: pid, x, y, z, label, movable, candidate.
    """
    keys = list(keys)
    own = [*keys, "part"]
    members = points.filter("movable")
    held = members.join(clusters.dbscan(members, eps, least, keys), [*keys, "pid"]).filter("part >= 0")
    verdict = held.groupBy(*own).agg(F.avg(F.col("candidate").cast("double")).alias("_v"), F.count(F.lit(1)).alias("_n")).filter(F.col("_v") >= share)
    counts = held.groupBy(*own, "label").agg(F.count(F.lit(1)).alias("_c")).groupBy(*own).agg(F.max_by(F.struct("label", "_c"), F.struct("_c", -F.col("label"))).alias("_b"))
    boxes = clusters.aligned_boxes(held, own)
    out = boxes.join(verdict, own).join(counts, own)
    return out.select(*own, F.col("_b.label").alias("cls"), F.round(F.col("_b._c") / F.col("_n"), 6).alias("agreement"), *(c for c in boxes.columns if c not in own))


def residual_candidates(now: DataFrame, before: DataFrame, threshold: float, side: float = 1.0, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """now with distance to the nearest point of the earlier scan (already moved here) and candidate: farther than the
    threshold, or without any earlier point."""
    found = clusters.nearest(now, before, side, keys)
    out = now.join(found, [*keys, "pid"], "left")
    return out.withColumn("candidate", F.coalesce(F.col("distance") > threshold, F.lit(True)))


def scores_by_range(points: DataFrame, edges: Sequence[float], metric: str = "chebyshev", ignored: int = UNKNOWN) -> DataFrame:
    """By distance (lower edges closed; null: all points): n, n_eval (truth isn't ignored), n_correct, accuracy (0 without any), and
    the mean IoU over classes that occur. points: x, y, gt, pred."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    far = F.greatest(F.abs(x), F.abs(y)) if metric == "chebyshev" else F.hypot(x, y)
    bucket = F.when(F.lit(False), F.lit(0))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        bucket = bucket.when((far >= a) & (far < b), F.lit(k))
    marked = points.select(bucket.alias("bucket"), "gt", "pred")
    pairs = marked.groupingSets([[F.col("gt"), F.col("pred")], [F.col("bucket"), F.col("gt"), F.col("pred")]], F.col("bucket"), F.col("gt"), F.col("pred"))
    counts = pairs.agg(F.grouping("bucket").cast("int").alias("overall"), F.count(F.lit(1)).alias("n")).filter("overall = 1 OR bucket IS NOT NULL")
    judged = F.col("gt") != ignored
    total = counts.groupBy("overall", "bucket").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(judged, F.col("n"))), F.lit(0)).alias("n_eval"), F.coalesce(F.sum(F.when(judged & (F.col("gt") == F.col("pred")), F.col("n"))), F.lit(0)).alias("n_correct"))
    both = F.explode(F.array(F.struct(F.col("gt").alias("cls"), F.lit(0).alias("k")), F.struct(F.col("pred").alias("cls"), F.lit(1).alias("k"))))
    each = counts.filter(judged).select("overall", "bucket", both.alias("c"), (F.col("gt") == F.col("pred")).alias("hit"), "n").filter(F.col("c.cls") != ignored).groupBy("overall", "bucket", "c.cls").agg(
        (F.sum(F.when(F.col("hit") & (F.col("c.k") == 0), F.col("n")).otherwise(0)) / F.sum(F.when(F.col("hit") & (F.col("c.k") == 1), 0).otherwise(F.col("n")))).alias("iou")
    )
    mean = each.groupBy("overall", F.col("bucket").alias("_b")).agg(F.round(F.avg("iou"), 6).alias("miou")).withColumnRenamed("overall", "_o")
    out = total.join(mean, (F.col("overall") == F.col("_o")) & F.col("bucket").eqNullSafe(F.col("_b")), "left").drop("_o", "_b")
    return out.withColumn("accuracy", F.round(F.when(F.col("n_eval") > 0, F.col("n_correct") / F.col("n_eval")).otherwise(0.0), 6))
