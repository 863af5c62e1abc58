"""Points to cells: addressing in nested rings, exact accumulation, roll-ups, finalisation.

Rings are a handful of literals, so a point's ring is a CASE expression and never a join. Accumulators hold counts,
sums, minima and maxima only: they merge in any order, so one partial and one final hash aggregate with a single
exchange make all cells of all frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, DRIVABLE, DYNAMIC, FLAG_GROUND, FLAG_OBSTACLE, FLAG_OVERHANG, NO_DATA, STATIC, TERRAIN, UNKNOWN, Z_LIMIT, Preset, Settings
from terrafold.functions.integers import big, clamped, finite, floor_div, half_up, quantised

SUMS = ("n", "n0", "n1", "n2", "n3", "n4", "n_moving", "g_sum", "conf_sum")
LEASTS, MOSTS = ("g_min", "o_min"), ("g_max", "o_max")


def reach(x: Column, y: Column) -> Column:
    """The half-width of the smallest half-open square around the origin that doesn't hold the point's mm."""
    return F.greatest(x, -x - 1, y, -y - 1)


def measured(points: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All points with x_mm, y_mm, z_mm, z_saturated and `ok`: finite and not from the vehicle itself. Coordinates of the
    others are null. z saturates at Z_LIMIT, x and y at 32 bits."""
    x, y, z = (F.col(k).cast("double") for k in "xyz")
    ok = F.coalesce(finite(x, y, z) & ((x * x + y * y) * 1e6 >= settings.min_range_mm**2), F.lit(False))
    out = points.withColumn("ok", ok)
    mm = {f"{n}_mm": F.when(F.col("ok"), quantised(c)) for n, c in (("x", x), ("y", y), ("z", z))}
    out = out.withColumns(mm).withColumn("z_saturated", F.coalesce(F.abs("z_mm") > Z_LIMIT, F.lit(False)))
    limits = {"x_mm": 2**31 - 1, "y_mm": 2**31 - 1, "z_mm": Z_LIMIT}
    return out.withColumns({c: F.when(F.col("ok"), clamped(F.col(c), most)) for c, most in limits.items()})


def quantise(points: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """x, y, z in metres to x_mm, y_mm, z_mm. Non-finite points and returns from the vehicle itself go; z saturates."""
    return measured(points, settings).filter("ok").drop("ok")


def strict_mm(metres: Column) -> Column:
    """Whole millimetres of a finite length within 32 bits; any other is an error."""
    m = metres.cast("double")
    fine = finite(m) & (F.abs(F.rint(m * 1000)) <= 2**31 - 1)
    return F.when(fine, quantised(m)).otherwise(F.raise_error(F.lit("a length isn't finite or beyond 32 bits of millimetres")).cast("bigint"))


def in_box(points: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Points in a box (x from, to, y from, to, mm), its edges included."""
    return points.filter(F.col("x_mm").between(box[0], box[1]) & F.col("y_mm").between(box[2], box[3]))


def locate(points: DataFrame, preset: Preset, keep_outside: bool = False) -> DataFrame:
    """ring, ix, iy of x_mm, y_mm; points outside all rings go, or stay with nulls."""
    x, y = big(F.col("x_mm")), big(F.col("y_mm"))
    ring, ix, iy = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), big(0)), F.when(F.lit(False), big(0))
    m = reach(x, y)
    for k, r in enumerate(preset.rings):
        ring = ring.when(m < r.r, F.lit(k))
        ix = ix.when(m < r.r, floor_div(x, r.cell) + r.offset)
        iy = iy.when(m < r.r, floor_div(y, r.cell) + r.offset)
    out = points.withColumns({"ring": ring, "ix": ix, "iy": iy})
    return out if keep_outside else out.filter("ring IS NOT NULL")


def locate_many(points: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """points once for each preset that holds them, with preset, ring, ix, iy: all presets in one scan."""
    x, y = big(F.col("x_mm")), big(F.col("y_mm"))
    m = reach(x, y)
    spots = []
    for p in presets:
        spot = F.lit(None)
        for k, r in reversed(list(enumerate(p.rings))):
            here = F.struct(F.lit(p.name).alias("preset"), F.lit(k).alias("ring"), (floor_div(x, r.cell) + r.offset).alias("ix"), (floor_div(y, r.cell) + r.offset).alias("iy"))
            spot = F.when(m < r.r, here).otherwise(spot)
        spots.append(spot)
    out = points.withColumn("_at", F.explode(F.array_compact(F.array(*spots))))
    return out.select(*points.columns, "_at.preset", "_at.ring", "_at.ix", "_at.iy")


def by_preset(presets: Sequence[Preset], value) -> Column:
    """value(preset, k, ring) for the preset and ring that a row names."""
    out = F.when(F.lit(False), big(0))
    for p in presets:
        for k, r in enumerate(p.rings):
            out = out.when((F.col("preset") == p.name) & (F.col("ring") == k), big(value(p, k, r)))
    return out


def per_ring(preset: Preset, value, ring: str = "ring") -> Column:
    """value(k, ring) for the ring that a row names."""
    out = F.when(F.lit(False), big(0))
    for k, r in enumerate(preset.rings):
        out = out.when(F.col(ring) == k, big(value(k, r)))
    return out


def global_key(preset: Preset) -> Column:
    """One number for each cell of all rings: the rings' arrays, row by row, one after the other."""
    base = [sum(preset.allocated_cells(j) for j in range(k)) for k in range(len(preset.rings))]
    return per_ring(preset, lambda k, r: base[k]) + big(F.col("iy")) * per_ring(preset, lambda k, r: r.side) + big(F.col("ix"))


def corners(cells: DataFrame, preset: Preset) -> DataFrame:
    """x0_mm, y0_mm: the cell's lower corner; xc_mm, yc_mm: its centre."""
    size, offset = per_ring(preset, lambda k, r: r.cell), per_ring(preset, lambda k, r: r.offset)
    x0, y0 = (F.col("ix") - offset) * size, (F.col("iy") - offset) * size
    half = floor_div(size, 2)
    return cells.withColumns({"x0_mm": x0, "y0_mm": y0, "xc_mm": x0 + half, "yc_mm": y0 + half})


def is_logical(preset: Preset) -> Column:
    """Whether a cell belongs to its ring, that is, isn't in the hole that the inner ring fills."""
    out = F.when(F.lit(False), F.lit(True))
    for k, r in enumerate(preset.rings):
        if not k:
            out = out.when(F.col("ring") == 0, F.lit(True))
            continue
        low, high = r.offset - preset.rings[k - 1].r // r.cell, r.offset + preset.rings[k - 1].r // r.cell
        hole = (F.col("ix") >= low) & (F.col("ix") < high) & (F.col("iy") >= low) & (F.col("iy") < high)
        out = out.when(F.col("ring") == k, ~hole)
    return out


def accumulate(located: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Accumulators of every occupied cell, from cls, moving, conf and z_mm of its points."""
    cls, z = F.col("cls"), big(F.col("z_mm"))
    ground, obstacle = cls.isin(DRIVABLE, TERRAIN), cls.isin(STATIC, DYNAMIC)
    return located.groupBy(*keys, "ring", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(cls == k).alias(f"n{k}") for k in range(5)),
        F.count_if(F.col("moving")).alias("n_moving"),
        F.sum(F.when(ground, z)).alias("g_sum"),
        F.min(F.when(ground, z)).alias("g_min"),
        F.max(F.when(ground, z)).alias("g_max"),
        F.min(F.when(obstacle, z)).alias("o_min"),
        F.max(F.when(obstacle, z)).alias("o_max"),
        F.sum(big(F.col("conf"))).alias("conf_sum"),
    )


def merged(accumulators: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accumulators of the same cell, added up."""
    return accumulators.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in SUMS), *(F.min(c).alias(c) for c in LEASTS), *(F.max(c).alias(c) for c in MOSTS)
    )


def coarsened(accumulators: DataFrame, factor: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Accumulators of square blocks of factor x factor cells: what direct accumulation in larger cells would give."""
    down = {"ix": floor_div(F.col("ix"), factor), "iy": floor_div(F.col("iy"), factor)}
    return merged(accumulators.withColumns(down), [*keys, "ring", "ix", "iy"])


def counters(points: DataFrame, preset: Preset, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """n_raw, n_invalid, n_in_grid, n_out_of_grid and n_z_saturated of each frame of measured() points. Every point is
    invalid, in or out of the grid; conserved() asserts that. Points without the columns ok or z_saturated are all valid, or not saturated."""
    ok, saturated = (F.col(c) if c in points.columns else F.lit(default) for c, default in (("ok", True), ("z_saturated", False)))
    inside = F.coalesce(reach(big(F.col("x_mm")), big(F.col("y_mm"))) < preset.rings[-1].r, F.lit(False))
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(~ok).alias("n_invalid"), F.count_if(ok & inside).alias("n_in_grid"),
        F.count_if(ok & ~inside).alias("n_out_of_grid"), F.count_if(ok & saturated).alias("n_z_saturated"),
    )


def conserved(counts: DataFrame, cells: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """counters() with an error if points got lost: between them, or between them and the counts of accumulate()d cells."""
    held = cells.groupBy(*keys).agg(F.sum("n").alias("_held"))
    out = counts.join(held, [*keys], "left")
    fine = (F.col("n_raw") == F.col("n_invalid") + F.col("n_in_grid") + F.col("n_out_of_grid")) & (F.col("n_in_grid") == F.coalesce("_held", F.lit(0)))
    return out.withColumn("n_in_grid", F.when(fine, F.col("n_in_grid")).otherwise(F.raise_error(F.lit("points got lost")).cast("bigint"))).drop("_held")


#: The largest counts of a cell that compact storage holds, by column; sums of heights and confidence have 32 bits.
LIMITS = {"n": 2**32 - 1, "n0": 65535, "n1": 65535, "n2": 65535, "n3": 65535, "n4": 65535, "n_moving": 65535, "conf_sum": 2**32 - 1}


def guarded(accumulators: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """accumulators, with an error instead of a count that compact storage would wrap."""
    over = F.lit(False)
    for c, most in limits.items():
        over = over | (F.col(c) > most)
    return accumulators.withColumn("n", F.when(over, F.raise_error(F.lit("a cell's count exceeds its storage")).cast("bigint")).otherwise(F.col("n")))


def safety_class(settings: Settings = DEFAULTS) -> Column:
    """DYNAMIC, then STATIC, if enough points and a large enough share; else the most frequent of terrain, unknown and
    drivable, ties in that order."""
    t = settings.thresholds
    n, n0, n1, n2, n3, n4 = (F.col(c) for c in ("n", "n0", "n1", "n2", "n3", "n4"))
    dyn = (n4 >= t.dyn_points) & (n4 * t.dyn_share.denominator >= n * t.dyn_share.numerator)
    obs = (n3 >= t.obs_points) & (n3 * t.obs_share.denominator >= n * t.obs_share.numerator)
    return F.when(dyn, DYNAMIC).when(obs, STATIC).when((n2 >= n0) & (n2 >= n1), TERRAIN).when(n0 >= n1, UNKNOWN).otherwise(DRIVABLE)


def majority_class() -> Column:
    """The most frequent class; ties go to the more dangerous one."""
    most = F.greatest("n0", "n1", "n2", "n3", "n4")
    return F.when(F.col("n4") == most, DYNAMIC).when(F.col("n3") == most, STATIC).when(F.col("n2") == most, TERRAIN).when(F.col("n0") == most, UNKNOWN).otherwise(DRIVABLE)


def finalised(accumulators: DataFrame, settings: Settings = DEFAULTS, rule: str = "safety", ground: str = "mean") -> DataFrame:
    """One row per occupied cell: cls, ground_z, top_z, clearance, moving_frac, conf, count, flags (-32768: no data)."""
    n_ground = F.col("n1") + F.col("n2")
    has_ground, has_top = n_ground > 0, F.col("n3") + F.col("n4") > 0
    gz = half_up(F.col("g_sum"), F.greatest(n_ground, F.lit(1))) if ground == "mean" else F.col("g_min")
    gap = F.col("o_min") - gz
    over = has_ground & has_top & (gap >= settings.contact_height_mm)
    cls = safety_class(settings) if rule == "safety" else majority_class()
    keys = [c for c in accumulators.columns if c not in (*SUMS, *LEASTS, *MOSTS)]
    return accumulators.select(
        *keys,
        cls.cast("int").alias("cls"),
        F.when(has_ground, gz).otherwise(NO_DATA).cast("bigint").alias("ground_z"),
        F.when(has_top, F.col("o_max")).otherwise(NO_DATA).cast("bigint").alias("top_z"),
        F.when(over, F.least(gap, F.lit(Z_LIMIT))).when(has_ground, 0).otherwise(NO_DATA).cast("bigint").alias("clearance"),
        half_up(F.col("n_moving") * 255, F.col("n")).alias("moving_frac"),
        half_up(F.col("conf_sum"), F.col("n")).alias("conf"),
        F.least(F.col("n"), F.lit(65535)).alias("count"),
        (F.when(has_ground, FLAG_GROUND).otherwise(0) + F.when(has_top, FLAG_OBSTACLE).otherwise(0) + F.when(over, FLAG_OVERHANG).otherwise(0)).cast("bigint").alias("flags"),
    )


def cells_of(points: DataFrame, preset: Preset, keys: Sequence[str] = ("frame",), settings: Settings = DEFAULTS, rule: str = "safety") -> DataFrame:
    """Points with mm coordinates to finalised cells: one scan, one exchange."""
    return finalised(accumulate(locate(points, preset), keys), settings, rule)


def all_cells(frames: DataFrame, preset: Preset) -> DataFrame:
    """Every logical cell of every frame (a column of frames stays)."""
    rings = F.explode(F.array(*(F.struct(F.lit(k).alias("ring"), F.lit(r.side).alias("side")) for k, r in enumerate(preset.rings))))
    out = frames.withColumn("_r", rings).select(*frames.columns, "_r.ring", F.explode(F.sequence(big(0), big(F.col("_r.side") - 1))).alias("ix"), F.col("_r.side").alias("_side"))
    out = out.withColumn("iy", F.explode(F.sequence(big(0), big(F.col("_side") - 1)))).drop("_side")
    return out.filter(is_logical(preset))


def dense(cells: DataFrame, frames: DataFrame, preset: Preset) -> DataFrame:
    """Every logical cell; those without points have class UNKNOWN, count 0 and no data."""
    keys = [*frames.columns, "ring", "ix", "iy"]
    empty = {"cls": UNKNOWN, "ground_z": NO_DATA, "top_z": NO_DATA, "clearance": NO_DATA, "moving_frac": 0, "conf": 0, "count": 0, "flags": 0}
    return all_cells(frames, preset).join(cells, keys, "left").select(*keys, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()))


def identical(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated ones as often."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def memory_report(cells: DataFrame, preset: Preset, settings: Settings = DEFAULTS, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Bytes of four maps of each frame: dense voxels, occupied fine cells, one fine 2.5D grid, and these rings."""
    low, high = settings.z_range_mm
    fine, extent = preset.rings[0].cell, preset.rings[-1].r
    flat = (2 * extent // fine) ** 2
    return cells.groupBy(*keys).agg(F.count_if((F.col("ring") == 0) & (F.col("count") > 0)).alias("_n")).select(
        *keys,
        big(flat * ((high - low) // fine) * settings.bytes_per_voxel).alias("dense_3d"),
        (F.col("_n") * (8 + settings.bytes_per_voxel)).alias("sparse_3d"),
        big(flat * 12).alias("uniform_2_5d"),
        big(sum(preset.allocated_cells(k) for k in range(len(preset.rings))) * 12).alias("foveated"),
    )

