"""Hazards put into scans, and whether derived layers show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.config import DRIVABLE, FLAG_GROUND, FLAG_KERB, FLAG_LOW, FLAG_TRAVERSABLE, STATIC, Preset
from terrafold.functions.integers import big
from terrafold.operators.grid import cells_of, locate, per_ring
from terrafold.operators.stencil import derived, haloed, has


def with_pothole(points: DataFrame, cx: int, cy: int, radius: int, depth: int) -> DataFrame:
    """Drivable points within the radius (mm, closed) lie lower by the depth."""
    dx, dy = F.col("x_mm") - cx, F.col("y_mm") - cy
    inside = (dx * dx + dy * dy <= radius * radius) & (F.col("cls") == DRIVABLE)
    return points.withColumn("z_mm", F.when(inside, F.col("z_mm") - depth).otherwise(F.col("z_mm")))


def with_kerb(points: DataFrame, cx: int, cy: int, length: int, width: int, height: int) -> DataFrame:
    """Drivable points in a strip along x lie higher."""
    inside = (F.abs(F.col("x_mm") - cx) * 2 <= length) & (F.abs(F.col("y_mm") - cy) * 2 <= width) & (F.col("cls") == DRIVABLE)
    return points.withColumn("z_mm", F.when(inside, F.col("z_mm") + height).otherwise(F.col("z_mm")))


def overhang_grid(frames: DataFrame, cx: int, cy: int, z: Column, nx: int = 30, ny: int = 12, length: int = 3000, width: int = 1000) -> DataFrame:
    """Static points of a regular slab over the centre of each frame: frame, pid (negative), x_mm, y_mm, z_mm, cls, ..."""
    k = F.explode(F.sequence(big(0), big(nx * ny - 1)))
    out = frames.withColumn("_z", z).select(*frames.columns, "_z", k.alias("_k"))
    i, j = F.col("_k") % nx, F.floor(F.col("_k") / nx)
    return out.select(
        *frames.columns, (-F.col("_k") - 1).alias("pid"), (cx - length // 2 + F.floor(i * length / (nx - 1))).cast("bigint").alias("x_mm"), (cy - width // 2 + F.floor(j * width / (ny - 1))).cast("bigint").alias("y_mm"),
        F.col("_z").cast("bigint").alias("z_mm"), F.lit(STATIC).alias("cls"), F.lit(False).alias("moving"), big(255).alias("conf"),
    )


def chosen_centres(points: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("frame",), least: int = 10) -> DataFrame:
    """n drivable points of each frame with at least `least`, by a seeded hash: hazard, cx_mm, cy_mm."""
    own = Window.partitionBy(*keys)
    drivable = points.filter(F.col("cls") == DRIVABLE).withColumn("_n", F.count(F.lit(1)).over(own))
    ranked = drivable.withColumn("hazard", F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid")) - 1)
    return ranked.filter((F.col("_n") >= least) & (F.col("hazard") < n)).select(*keys, "hazard", F.col("x_mm").alias("cx_mm"), F.col("y_mm").alias("cy_mm"))


def detected(hazards: DataFrame, cells: DataFrame, preset: Preset, keys: tuple[str, ...] = ("frame",), own: bool = False) -> DataFrame:
    """hazards (hazard, kind, cx_mm, cy_mm, depth_mm) with hit; own: cells have a column hazard, each hazard has its own.

    A kerb shows if any cell within 2 m is flagged, an overhang if any within 1.5 m has low clearance or ground that
    can't be crossed, a pothole if the ground two cells away is higher by half its depth on average. Windows are in
    cells of the ring that holds the hazard. Both sides meet in blocks of cells a window wide: an equi-join.
    """
    at = locate(hazards.withColumns({"x_mm": F.col("cx_mm"), "y_mm": F.col("cy_mm")}), preset).withColumnsRenamed({"ix": "hx", "iy": "hy"})
    cell = per_ring(preset, lambda k, r: r.cell)
    reach = F.when(F.col("kind") == "pothole", big(2)).otherwise(F.greatest(big(1), F.floor(F.when(F.col("kind") == "kerb", 2000).otherwise(1500) / cell)))
    at = at.withColumn("reach", reach)
    wide = max(max(1, 2000 // r.cell) for r in preset.rings)
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    sent = at.withColumn("_s", F.explode(steps)).withColumns({"_bx": F.floor(F.col("hx") / wide) + F.col("_s.a"), "_by": F.floor(F.col("hy") / wide) + F.col("_s.b")})
    blocks = cells.withColumns({"_bx": F.floor(F.col("ix") / wide), "_by": F.floor(F.col("iy") / wide)})
    met = sent.join(blocks, [*keys, *(["hazard"] if own else []), "ring", "_bx", "_by"])
    dx, dy = F.abs(F.col("ix") - F.col("hx")), F.abs(F.col("iy") - F.col("hy"))
    near = (dx <= F.col("reach")) & (dy <= F.col("reach"))
    shown = F.when(F.col("kind") == "kerb", has(FLAG_KERB)).when(F.col("kind") == "overhang", has(FLAG_LOW) | (has(FLAG_GROUND) & ~has(FLAG_TRAVERSABLE)))
    ground, centre, ring2 = has(FLAG_GROUND), (dx == 0) & (dy == 0), ((dx == 2) & (dy == 0)) | ((dx == 0) & (dy == 2))
    out = met.filter(near).groupBy(*keys, "hazard").agg(
        F.max(F.coalesce(shown, F.lit(False))).alias("_shown"), F.max(F.when(centre & ground, F.col("ground_z"))).alias("_z"),
        F.sum(F.when(ring2 & ground, F.col("ground_z"))).alias("_s"), F.count_if(ring2 & ground).alias("_n"),
    )
    drop = F.col("_s") / F.col("_n") - F.col("_z") >= F.floor(F.col("depth_mm") / 2)
    hit = F.when(F.col("kind") == "pothole", F.coalesce(F.when(F.col("_n") > 0, drop), F.lit(False))).otherwise(F.coalesce("_shown", F.lit(False)))
    return hazards.join(out, [*keys, "hazard"], "left").withColumn("hit", hit).drop("_shown", "_z", "_s", "_n")


#: Ranges (mm) from which trials take their sizes, and sizes that don't vary.
POTHOLE_RADIUS, POTHOLE_DEPTH = (300, 600), (80, 150)
KERB_HEIGHT, KERB_LENGTH, KERB_WIDTH = (100, 200), 4000, 300
OVERHANG_HEIGHT, OVERHANG_LENGTH, OVERHANG_WIDTH = (1600, 2400), 3000, 1000
KINDS = ("pothole", "kerb", "overhang")
#: How far from its centre (mm) a hazard can matter to the cells that are asked whether it shows, without two cells.
NEAR_MM = 2000


def drawn(*parts: Column | str | int) -> Column:
    """A whole number below 2**28 that follows from the parts: the first digits of an MD5, so any engine can repeat it."""
    text = F.concat_ws("-", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("bigint")


def trials(points: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("frame",), least: int = 10) -> DataFrame:
    """n injections of one pothole, one kerb and one overhang each in every frame with at least `least` drivable points: keys,
    trial, x_<kind>, y_<kind> (mm, places of drivable points), radius, depth, height, above, base (the ground there).

    Centres and sizes follow from seed, frame, trial and kind.
    """
    own = Window.partitionBy(*keys)
    drivable = points.filter(F.col("cls") == DRIVABLE).select(*keys, "pid", "x_mm", "y_mm", "z_mm")
    numbered = drivable.withColumns({"_k": F.row_number().over(own.orderBy("pid", "x_mm", "y_mm", "z_mm")) - 1, "_n": F.count(F.lit(1)).over(own)}).filter(F.col("_n") >= least)
    sizes = numbered.groupBy(*keys).agg(F.max("_n").alias("_n"))
    asked = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("trial")).withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    frame = [F.col(k).cast("string") for k in keys]
    asked = asked.withColumn("_k", drawn(seed, *frame, F.col("trial").cast("string"), F.col("kind")) % F.col("_n"))
    found = asked.drop("_n").join(numbered.drop("_n", "pid"), [*keys, "_k"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = found.groupBy(*keys, "trial").agg(*(of(k, f"{c}_mm").alias(f"{c}_{k}") for k in KINDS for c in "xy"), of("overhang", "z_mm").alias("base"))

    def size(name: str, low_high: tuple[int, int]) -> Column:
        return (drawn(seed, *frame, F.col("trial").cast("string"), name) % (low_high[1] - low_high[0] + 1) + low_high[0]).alias(name)

    return out.select("*", size("radius", POTHOLE_RADIUS), size("depth", POTHOLE_DEPTH), size("height", KERB_HEIGHT), size("above", OVERHANG_HEIGHT))


def hazard_rows(trial: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row for each hazard of trials(): keys, trial, kind, hazard (a number, distinct in all keys' order of a frame), cx_mm,
    cy_mm, depth_mm and `all`, the trial's row."""
    kind = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(k).alias("kind"), F.col(f"x_{k}").alias("cx_mm"), F.col(f"y_{k}").alias("cy_mm")) for i, k in enumerate(KINDS))))
    held = F.struct(*(c for c in trial.columns if c not in keys)).alias("all")
    out = trial.select(*keys, "trial", held, kind.alias("h"))
    return out.select(*keys, "trial", F.col("h.kind").alias("kind"), (F.col("trial") * len(KINDS) + F.col("h.k")).alias("hazard"), "h.cx_mm", "h.cy_mm", F.col("all.depth").cast("bigint").alias("depth_mm"), "all")


def injected_near(points: DataFrame, hazards: DataFrame, preset: Preset, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """For each hazard the points around it as its trial left them: keys, hazard, pid, x_mm, y_mm, z_mm, cls, moving, conf.

    A hazard's cells depend on points nearby only, so each trial's copy of a scan is made there alone. Points and hazards
    meet in blocks of the plane: an equi-join. All three injections of a trial apply to each of its copies.
    """
    margin = NEAR_MM + 3 * max(r.cell for r in preset.rings)
    block = 2 * margin
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    place = lambda c: F.floor(c / block)
    sent = hazards.withColumn("_s", steps).withColumns({"_bx": place(F.col("cx_mm")) + F.col("_s.a"), "_by": place(F.col("cy_mm")) + F.col("_s.b")})
    here = points.select(*keys, "pid", "x_mm", "y_mm", "z_mm", "cls", "moving", "conf", place(F.col("x_mm")).alias("_bx"), place(F.col("y_mm")).alias("_by"))
    near = (F.abs(F.col("x_mm") - F.col("cx_mm")) <= margin) & (F.abs(F.col("y_mm") - F.col("cy_mm")) <= margin)
    met = here.join(sent, [*keys, "_bx", "_by"]).filter(near)
    t = lambda c: F.col(f"all.{c}")
    px, py = F.col("x_mm") - t("x_pothole"), F.col("y_mm") - t("y_pothole")
    hole = (px * px + py * py <= t("radius") * t("radius")) & (F.col("cls") == DRIVABLE)
    strip = (F.abs(F.col("x_mm") - t("x_kerb")) * 2 <= KERB_LENGTH) & (F.abs(F.col("y_mm") - t("y_kerb")) * 2 <= KERB_WIDTH) & (F.col("cls") == DRIVABLE)
    z = F.col("z_mm") - F.when(hole, t("depth")).otherwise(0) + F.when(strip, t("height")).otherwise(0)
    names = ["pid", "x_mm", "y_mm", "z_mm", "cls", "moving", "conf"]
    changed = met.select(*keys, "hazard", "pid", "x_mm", "y_mm", z.cast("bigint").alias("z_mm"), "cls", "moving", "conf")
    slab = hazards.select(*keys, "hazard", "cx_mm", "cy_mm", "all", F.explode(F.sequence(big(0), big(99))).alias("k"))
    ox = t("x_overhang") - OVERHANG_LENGTH // 2 + drawn(F.col("all.trial").cast("string"), F.col("k").cast("string"), "x") % (OVERHANG_LENGTH + 1)
    oy = t("y_overhang") - OVERHANG_WIDTH // 2 + drawn(F.col("all.trial").cast("string"), F.col("k").cast("string"), "y") % (OVERHANG_WIDTH + 1)
    slab = slab.select(*keys, "hazard", "cx_mm", "cy_mm", (-F.col("k") - 1).alias("pid"), ox.alias("x_mm"), oy.alias("y_mm"), (t("base") + t("above")).cast("bigint").alias("z_mm"))
    slab = slab.filter(near).select(*keys, "hazard", "pid", "x_mm", "y_mm", "z_mm", F.lit(STATIC).alias("cls"), F.lit(False).alias("moving"), big(255).alias("conf"))
    return changed.unionByName(slab).select(*keys, "hazard", *names)


def detection(points: DataFrame, preset: Preset, n: int, seed: int, keys: tuple[str, ...] = ("frame",), halo: bool = True) -> DataFrame:
    """n injections in every frame, and for each hazard whether the layers of the changed scan show it: keys, trial, kind,
    hazard, cx_mm, cy_mm, depth_mm, ring, hit. All trials of all frames are one job."""
    rows = hazard_rows(trials(points, n, seed, keys), keys)
    own = [*keys, "hazard"]
    cells = cells_of(injected_near(points, rows, preset, keys), preset, own)
    layers = derived(haloed(cells, preset, own) if halo else cells, preset, keys=own)
    at = locate(rows.withColumns({"x_mm": F.col("cx_mm"), "y_mm": F.col("cy_mm")}), preset).select(*own, "ring")
    return detected(rows.drop("all"), layers, preset, tuple(keys), own=True).join(at, own)


def preview(points: DataFrame, kind: str, x: int, y: int, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Frames with one hazard at a place (mm), as points with drivable ground within a metre of it; others are absent.

    A pothole of radius 500 and depth 180; a kerb of 3000 by 500, height 160; or a slab of 30 x 12 static points, 3000 by
    1000, 1500 above the median height of that ground.
    """
    if kind not in KINDS:
        raise ValueError(f"no hazard {kind!r}")
    names = ["pid", "x_mm", "y_mm", "z_mm", "cls", "moving", "conf"]
    dx, dy = F.col("x_mm") - x, F.col("y_mm") - y
    ground = points.filter((F.col("cls") == DRIVABLE) & (dx * dx + dy * dy < 1_000_000)).groupBy(*keys).agg(F.median("z_mm").alias("_z"))
    held = points.select(*keys, *names).join(ground, [*keys], "left_semi")
    if kind == "pothole":
        return with_pothole(held, x, y, 500, 180)
    if kind == "kerb":
        return with_kerb(held, x, y, 3000, 500, 160)
    slab = overhang_grid(ground.select(*keys, (F.floor("_z") + 1500).cast("bigint").alias("top")), x, y, F.col("top"))
    return held.unionByName(slab.select(*keys, *names))
