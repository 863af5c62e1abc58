"""Cells and their neighbours: slopes, steps, kerbs, potholes, clearance, traversability, and the seams between rings.

A stencil sends every cell to itself and to its neighbours' addresses and groups by address: one exchange gives all
neighbour values together, where a join on shifted addresses would pair whole rings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, DRIVABLE, FLAG_GROUND, FLAG_KERB, FLAG_LOW, FLAG_OBSTACLE, FLAG_OVERHANG, FLAG_POTHOLE, FLAG_STEEP, FLAG_TRAVERSABLE, NO_DATA, UNKNOWN, Preset, Settings, Thresholds
from terrafold.functions.integers import big, floor_div, half_up
from terrafold.operators.grid import accumulate, finalised, in_box, is_logical, locate_many, per_ring

_SIDES = {"l": (-1, 0), "r": (1, 0), "d": (0, -1), "u": (0, 1)}


def has(flag: int, column: str = "flags") -> Column:
    return F.col(column).bitwiseAND(flag) != 0


def with_neighbours(cells: DataFrame, keys: Sequence[str] = ("frame",), sides: dict[str, tuple[int, int]] = _SIDES) -> DataFrame:
    """cells with, for each side s, gz_s (ground height, null without ground) and n_s (points) of the neighbour there."""
    at = [*keys, "ring", "ix", "iy"]
    own = [c for c in cells.columns if c not in at]
    sent = F.array(
        F.struct(F.lit("c").alias("side"), F.lit(0).alias("dx"), F.lit(0).alias("dy")),
        # What lies to the left of a cell has the cell to its right.
        *(F.struct(F.lit(s).alias("side"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy")) for s, (dx, dy) in sides.items()),
    )
    out = cells.withColumn("_to", F.explode(sent)).select(
        *keys, "ring", (F.col("ix") + F.col("_to.dx")).alias("ix"), (F.col("iy") + F.col("_to.dy")).alias("iy"), F.col("_to.side").alias("_side"),
        F.when(has(FLAG_GROUND), F.col("ground_z")).alias("_gz"), F.col("count").alias("_n"), *(F.when(F.col("_to.side") == "c", F.col(c)).alias(c) for c in own),
    )
    picked = [F.max(F.when(F.col("_side") == s, F.col(v))).alias(f"{name}_{s}") for s in sides for v, name in (("_gz", "gz"), ("_n", "n"))]
    out = out.groupBy(*at).agg(F.max(F.col("_side") == "c").alias("_own"), *(F.max(c).alias(c) for c in own), *picked)
    return out.filter("_own").drop("_own")


def step_height(settings: Settings = DEFAULTS, sides: Sequence[str] = tuple(_SIDES)) -> Column:
    """The largest difference of ground heights to neighbours with enough points; 0 without any or without ground."""
    steps = [F.when(F.col(f"n_{s}") >= settings.min_points_step, F.abs(F.col("ground_z") - F.col(f"gz_{s}"))) for s in sides]
    return F.when(has(FLAG_GROUND), F.coalesce(F.greatest(*steps), F.lit(0))).otherwise(0).cast("bigint")


def neighbour_mean(sides: Sequence[str] = tuple(_SIDES)) -> Column:
    """The mean ground height of neighbours with ground, floored; null without any."""
    n = sum((F.when(F.col(f"gz_{s}").isNotNull(), 1).otherwise(0) for s in sides), F.lit(0))
    total = sum((F.coalesce(F.col(f"gz_{s}"), F.lit(0)) for s in sides), big(0))
    return F.when(n > 0, floor_div(total, F.greatest(n, F.lit(1))))


def slope_degrees(preset: Preset) -> Column:
    """Steepness from central differences, one-sided where a neighbour has no ground; null without ground."""
    cell = per_ring(preset, lambda k, r: r.cell).cast("double")

    def along(a: str, b: str) -> Column:
        low, high, mid = F.col(f"gz_{a}"), F.col(f"gz_{b}"), F.col("ground_z")
        both = F.when(low.isNotNull() & high.isNotNull(), (high - low) / (2 * cell))
        return both.when(high.isNotNull(), (high - mid) / cell).when(low.isNotNull(), (mid - low) / cell).otherwise(0.0)

    gx, gy = along("l", "r"), along("d", "u")
    return F.when(has(FLAG_GROUND), F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))))


def low_clearance(settings: Settings = DEFAULTS) -> Column:
    return has(FLAG_OVERHANG) & (F.col("clearance") > 0) & (F.col("clearance") < settings.vehicle_height_mm + settings.clearance_margin_mm)


def derived(cells: DataFrame, preset: Preset, settings: Settings = DEFAULTS, keys: Sequence[str] = ("frame",), fast: bool = False) -> DataFrame:
    """cells with step_mm, slope_deg and all derived flags, from one exchange of neighbours. fast leaves slope and
    clearance out."""
    out = with_neighbours(cells, keys).withColumn("step_mm", step_height(settings))
    slope = F.lit(None).cast("double") if fast else slope_degrees(preset)
    out = out.withColumn("slope_deg", slope)
    kerb = has(FLAG_GROUND) & F.col("step_mm").between(settings.kerb_min_mm, settings.kerb_max_mm)
    mean = neighbour_mean()
    hole = has(FLAG_GROUND) & (F.col("cls") == DRIVABLE) & F.coalesce(mean - F.col("ground_z") >= settings.pothole_depth_mm, F.lit(False))
    steep = F.coalesce(has(FLAG_GROUND) & (F.col("slope_deg") > settings.max_slope_deg), F.lit(False))
    low = F.lit(False) if fast else low_clearance(settings)
    passable = (F.col("cls") == DRIVABLE) & has(FLAG_GROUND) & ~has(FLAG_OBSTACLE) & ~steep & ~kerb & ~low
    flags = F.col("flags")
    for ok, flag in ((kerb, FLAG_KERB), (hole, FLAG_POTHOLE), (steep, FLAG_STEEP), (low, FLAG_LOW), (passable, FLAG_TRAVERSABLE)):
        flags = flags.bitwiseOR(F.when(ok, flag).otherwise(0))
    return out.withColumn("_flags", flags).drop("flags", *(f"{v}_{s}" for v in ("gz", "n") for s in _SIDES)).withColumnRenamed("_flags", "flags")


def three_state() -> Column:
    """0 unknown (no ground or unknown class), 1 traversable, 2 not."""
    return F.when(has(FLAG_TRAVERSABLE), 1).when(~has(FLAG_GROUND) | (F.col("cls") == UNKNOWN), 0).otherwise(2)


def block_reduced(cells: DataFrame, factor: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Coarse cells of a finer ring: ground height is the mean of cells' heights, halves up, the top the highest, class
    and conf those of the block's middle cell in row order, count the sum."""
    middle = (F.col("iy") % factor) * factor + F.col("ix") % factor == factor * factor // 2
    ground = has(FLAG_GROUND)
    out = cells.withColumns({"_x": floor_div(F.col("ix"), factor), "_y": floor_div(F.col("iy"), factor)}).groupBy(*keys, F.col("_x").alias("ix"), F.col("_y").alias("iy")).agg(
        F.count_if(ground).alias("_n"), F.sum(F.when(ground, F.col("ground_z"))).alias("_sum"),
        F.max(F.when(F.col("top_z") != NO_DATA, F.col("top_z"))).alias("_top"), F.max(F.when(middle, F.col("cls"))).alias("_cls"),
        F.max(F.when(middle, F.col("conf"))).alias("_conf"), F.sum("count").alias("_count"),
    )
    return out.select(
        *keys, "ix", "iy", F.coalesce("_cls", F.lit(UNKNOWN)).alias("cls"), F.when(F.col("_n") > 0, half_up(F.col("_sum"), F.greatest("_n", F.lit(1)))).otherwise(NO_DATA).alias("ground_z"),
        F.coalesce("_top", big(NO_DATA)).alias("top_z"), big(NO_DATA).alias("clearance"), big(0).alias("moving_frac"), F.coalesce("_conf", big(0)).alias("conf"),
        F.least("_count", big(65535)).alias("count"),
        (F.when(F.col("_n") > 0, FLAG_GROUND).otherwise(0) + F.when(F.col("_top").isNotNull(), FLAG_OBSTACLE).otherwise(0)).cast("bigint").alias("flags"),
    )


def haloed(cells: DataFrame, preset: Preset, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Rings with their holes filled from the next finer ring, innermost first, where a hole's cell has no ground."""
    names = [*keys, "ring", "ix", "iy", "cls", "ground_z", "top_z", "clearance", "moving_frac", "conf", "count", "flags"]
    rings = [cells.filter(F.col("ring") == 0).select(*names)]
    for k in range(1, len(preset.rings)):
        own = cells.filter(F.col("ring") == k).select(*names)
        inner, ring = preset.rings[k - 1], preset.rings[k]
        factor = ring.cell // inner.cell
        shift = ring.offset - inner.r // ring.cell
        fine = block_reduced(rings[-1], factor, keys).withColumns({"ix": F.col("ix") + shift, "iy": F.col("iy") + shift})
        fine = fine.withColumn("ring", F.lit(k)).filter(~is_logical(preset)).select(*names)
        at = [*keys, "ring", "ix", "iy"]
        both = own.withColumn("_p", F.when(has(FLAG_GROUND), 0).otherwise(2)).unionByName(fine.filter(has(FLAG_GROUND)).withColumn("_p", F.lit(1)))
        values = [c for c in names if c not in at]
        rings.append(both.groupBy(*at).agg(F.min_by(F.struct(*values), "_p").alias("_v")).select(*at, *(F.col(f"_v.{c}").alias(c) for c in values)))
    out = rings[0]
    for r in rings[1:]:
        out = out.unionByName(r)
    return out


def padded_border(cells: DataFrame, preset: Preset, k: int, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The frame of cells, one wide, around ring k, read from the next coarser ring: each takes the coarse cell that
    holds its centre. Positions are -1 and side on ring k's axes; positions without a coarse cell are absent."""
    ring, outer = preset.rings[k], preset.rings[k + 1]
    side = ring.side
    edge = F.explode(F.sequence(big(-1), big(side)))
    ends = F.explode(F.array(big(-1), big(side)))
    spark = cells.sparkSession
    one = spark.range(1)
    across = one.select(edge.alias("ix")).withColumn("iy", ends)
    along = one.select(ends.alias("ix")).withColumn("iy", F.explode(F.sequence(big(0), big(side - 1))))
    border = across.unionByName(along)
    centre = {c: (F.col(c) - ring.offset) * ring.cell + ring.cell // 2 for c in ("ix", "iy")}
    border = border.select(F.col("ix").alias("bx"), F.col("iy").alias("by"), *((floor_div(v, outer.cell) + outer.offset).alias(c) for c, v in centre.items()))
    coarse = cells.filter(F.col("ring") == k + 1)
    return coarse.join(F.broadcast(border), ["ix", "iy"]).select(*keys, F.col("bx").alias("ix"), F.col("by").alias("iy"), "cls", "ground_z", "top_z", "count", "flags")


#: The shares of points that decide a cell's class in zoomed windows.
ZOOM = replace(DEFAULTS, thresholds=Thresholds(dyn_share=Fraction(3, 10), obs_share=Fraction(3, 10)))


def zoomed(points: DataFrame, box: tuple[int, int, int, int], sizes: Sequence[int] = (50, 200), keys: Sequence[str] = ("frame",), settings: Settings = ZOOM) -> DataFrame:
    """A window (x from, to, y from, to, mm, closed) in cells of several sizes around its middle, all in one scan: finalised
    cells with preset (the size), step_mm and kerb in their flags. The extent is half the longer side and half a metre,
    rounded up to whole cells."""
    x0, x1, y0, y1 = box
    half = -(-max(x1 - x0, y1 - y0) // 2) + 500
    presets = [Preset.of(str(c), (-(-half // c) * c, c)) for c in sizes]
    centred = in_box(points, box).withColumns({"x_mm": F.col("x_mm") - (x0 + x1) // 2, "y_mm": F.col("y_mm") - (y0 + y1) // 2})
    own = [*keys, "preset"]
    cells = with_neighbours(finalised(accumulate(locate_many(centred, presets), own), settings), own).withColumn("step_mm", step_height(settings))
    kerb = has(FLAG_GROUND) & F.col("step_mm").between(settings.kerb_min_mm, settings.kerb_max_mm)
    flags = F.col("flags").bitwiseOR(F.when(kerb, FLAG_KERB).otherwise(0))
    return cells.withColumn("flags", flags).drop(*(f"{v}_{s}" for v in ("gz", "n") for s in _SIDES))


def zoom_verdicts(window: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """For each size of zoomed() cells: how many cells, how many with ground, and whether any shows a kerb."""
    return window.groupBy(*keys, F.col("preset").cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("cells"), F.count_if(has(FLAG_GROUND)).alias("ground"), F.bool_or(has(FLAG_KERB)).alias("any_kerb"))


#: The eight cells around a cell.
EIGHT = {f"s{k}": s for k, s in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))}


def best_window(cells: DataFrame, preset: Preset, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Of each frame the cell with ground of the outermost ring with the most confidence, the first in row order on ties: ix, iy, conf."""
    last = len(preset.rings) - 1
    place = F.col("iy") * preset.rings[last].side + F.col("ix")
    best = F.max_by(F.struct("ix", "iy", "conf"), F.struct("conf", -place)).alias("_b")
    return cells.filter((F.col("ring") == last) & has(FLAG_GROUND)).groupBy(*keys).agg(best).select(*keys, "_b.ix", "_b.iy", "_b.conf")


def cell_at(cells: DataFrame, ring: int, ix: int, iy: int) -> DataFrame:
    """The cell at a place, in every frame that has it."""
    return cells.filter((F.col("ring") == ring) & (F.col("ix") == ix) & (F.col("iy") == iy))
