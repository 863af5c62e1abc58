"""From scans to layers: every stage of the map, in order, over all frames of all sequences in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, Preset, Settings
from terrafold.functions.labels import classified
from terrafold.operators import grid, stencil, wire
from terrafold.operators.objects import earlier_scans, estimated, from_instances

KEYS = ("seq", "frame")


@dataclass(frozen=True)
class Layers:
    """What the map holds for each frame: derived cells, counters, memory, objects and display categories."""

    cells: DataFrame
    counters: DataFrame
    memory: DataFrame
    objects: DataFrame | None
    categories: DataFrame


def layers(points: DataFrame, preset: Preset, keys: Sequence[str] = KEYS, settings: Settings = DEFAULTS, rule: str = "safety", halo: bool = True, fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accumulators and derived cells of points with mm coordinates: cells are filled from finer rings at the seams, then
    slope, clearance, step and traversability follow from one exchange of neighbours."""
    held = grid.accumulate(grid.locate(points, preset), keys)
    cells = grid.finalised(held, settings, rule)
    return held, stencil.derived(stencil.haloed(cells, preset, keys) if halo else cells, preset, settings, keys, fast)


def predicted(points: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """points with sem and conf: from predictions (seq, frame, pid, raw_id, conf), or, without any, true labels with full
    confidence. Frames whose points and predictions differ in number are an error."""
    if predictions is None:
        return points.withColumns({"sem": F.col("raw").bitwiseAND(65535), "conf": F.lit(255).cast("bigint")})
    keys = [*KEYS, "pid"]
    out = points.join(predictions.select(*keys, F.col("raw_id").cast("bigint").alias("sem"), F.col("conf").cast("bigint").alias("conf"), F.lit(True).alias("_there")), keys, "full")
    gap = F.col("x").isNull() | F.col("_there").isNull()
    says = F.raise_error(F.format_string("%s/%s: points and predictions differ in number", "seq", "frame")).cast("bigint")
    return out.withColumn("sem", F.when(gap, says).otherwise(F.col("sem"))).drop("_there")


def mapped(points: DataFrame, preset: Preset, frames: DataFrame | None = None, predictions: DataFrame | None = None, gaps: Sequence[int] = (2,), true_motion: bool = True, settings: Settings = DEFAULTS, **options) -> Layers:
    """All layers of raw scans: seq, frame, pid, x, y, z and, for true labels, raw.

    Labels are true ones or predictions. Motion comes from true labels, or is estimated against the scans `gaps` frames
    before, for which frames (seq, frame, pose, tr) are needed; without both, points keep what their labels say.
    """
    labelled = classified(predicted(points, predictions), "sem").withColumns({"cls": F.col("super_cls"), "moving": F.col("is_moving")})
    objects = None
    if true_motion and "raw" in points.columns:
        found = from_instances(labelled, KEYS, settings)
        labelled, objects = found.points, found.objects
    elif frames is not None:
        found = estimated(labelled, earlier_scans(labelled, frames, gaps), KEYS, settings)
        labelled, objects = found.points, found.objects
    measured = grid.measured(labelled, settings)
    held, cells = layers(measured.filter("ok"), preset, settings=settings, **options)
    counts = grid.conserved(grid.counters(measured, preset, KEYS), grid.guarded(held), KEYS)
    at = [*KEYS, "ring", "ix", "iy"]
    votes = wire.vehicle_counts(grid.locate(measured.filter("ok"), preset), KEYS)
    shown = cells.join(votes, at, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("v_static", "v_moving", "v_other")})
    return Layers(cells, counts, grid.memory_report(cells, preset, settings, KEYS), objects, shown.select(*at, wire.category().alias("category")))


def registered(points: DataFrame, preset: Preset, made: Layers, frames: DataFrame | None = None) -> None:
    """Offer what a map is made of and has to SQL: the views points, rings, label_dim, cells, and objects and frames if known."""
    from terrafold.functions.labels import label_dim

    spark = points.sparkSession
    points.createOrReplaceTempView("points")
    rows = [(preset.name, k, r.r, r.cell, r.side, preset.allocated_cells(k), preset.logical_cells(k)) for k, r in enumerate(preset.rings)]
    spark.createDataFrame(rows, "preset string, ring int, r_mm int, cell_mm int, side int, allocated int, logical int").createOrReplaceTempView("rings")
    label_dim(spark).createOrReplaceTempView("label_dim")
    made.cells.createOrReplaceTempView("cells")
    if made.objects is not None:
        made.objects.createOrReplaceTempView("objects")
    if frames is not None:
        frames.createOrReplaceTempView("frames")
