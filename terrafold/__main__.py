"""Commands over a dataset's folder: inspect, verify, stats, evaluate, memory, align, map, zoom, hazard."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import reports
from terrafold.config import DEFAULTS, PRESETS, Preset, Settings, load
from terrafold.functions.labels import classified, instance, representative
from terrafold.functions.ranges import bucket, horizontal
from terrafold.operators import clusters, grid, hazards, metrics, motion, stencil
from terrafold.operators.objects import earlier_scans, movable
from terrafold.pipeline import KEYS, layers, mapped
from terrafold.sources import scans
from terrafold.storage import written

#: Labels of large and of compact things that stand still, farthest range (m), threshold and least motion (m) of alignment.
LARGE, COMPACT, RANGE_M, APART_M, LEAST_MOTION_M = (50, 40, 70), (80, 71, 81), 30.0, 0.15, 0.3
EVALUATION_M = (0, 10, 30, 50, 60, 80, 100)


def standing(points: DataFrame, labels: tuple[int, ...], most: float = RANGE_M) -> DataFrame:
    """Points of some labels (column sem) nearer than `most`."""
    return points.filter(F.col("sem").isin(*labels) & (horizontal(F.col("x"), F.col("y")) < most))


def inspected(points: DataFrame) -> DataFrame:
    """Classes of a scan with name, count and percentage, the commonest first."""
    return metrics.class_histogram(classified(points).withColumn("label", F.coalesce("name", F.lit("unknown"))), "label").orderBy(F.desc("n"), "label")


def statistics(points: DataFrame, edges: tuple[float, ...] = DEFAULTS.buckets_m) -> DataFrame:
    """Points by sequence, class and distance; bucket -1 holds what lies beyond."""
    p = classified(points).withColumn("bucket", bucket(horizontal(F.col("x"), F.col("y")), edges))
    return metrics.data_stats(p)


def evaluated(points: DataFrame, predictions: DataFrame, edges: tuple[float, ...] = EVALUATION_M) -> dict:
    """Predictions against true labels: 19 classes overall and by distance, super-classes, and what was counted."""
    keys = [*KEYS, "pid"]
    true = classified(points).select(*keys, "x", "y", F.col("learning_id").alias("gt"), F.col("super_cls").alias("gt_super"))
    said = classified(predictions.withColumnRenamed("raw_id", "raw")).select(*keys, F.col("learning_id").alias("pred"), F.col("super_cls").alias("pred_super"))
    both = true.join(said, keys).withColumn("bucket", bucket(horizontal(F.col("x"), F.col("y")), edges))
    counts = both.groupBy("bucket", "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    whole = metrics.confusion(both, keys=())
    supers = metrics.confusion(both.drop("gt", "pred").withColumnsRenamed({"gt_super": "gt", "pred_super": "pred"}))
    counted = reports.rows_of(metrics.accounting(both))
    by = {r["bucket"]: r for r in reports.rows_of(metrics.scores_by(counts, ["bucket"]))}
    return {
        "semantic": reports.rows_of(metrics.scores_by(whole, []))[0], "super": reports.rows_of(metrics.scores_by(supers, []))[0],
        "classes": reports.rows_of(metrics.class_scores(whole, ignored=(0,)).orderBy("cls")),
        "accounting": next(r for r in counted if r["overall"]), "by_distance": [r | {k: v for k, v in by.get(r["bucket"], {}).items() if k in ("miou", "accuracy")} for r in counted if not r["overall"]],
    }


def aligned(points: DataFrame, frames: DataFrame, pairs: int, seed: int) -> dict:
    """Distances between things that stand still in consecutive scans, moved by their poses; and, as a control, unmoved."""
    chosen = scans.drawn_frames(motion.lagged_frames(frames.select("seq", "frame", "pose", "tr"), (1,)), pairs, seed, ["seq"])
    moved = written(chosen.select("seq", "frame", "prev_frame", motion.relative_pose(F.col("pose"), F.col("prev_pose"), F.col("tr")).alias("move")), "moves")
    marked = points.withColumn("sem", F.col("raw").bitwiseAND(65535))
    parts = None
    for kind, labels, move in (("large", LARGE, True), ("compact", COMPACT, True), ("control", COMPACT, False)):
        still = standing(marked, labels)
        before = still.withColumnRenamed("frame", "prev_frame").join(moved, ["seq", "prev_frame"])
        gone = F.sqrt(sum((F.get("move", F.lit(k)) ** 2 for k in (3, 7, 11)), F.lit(0.0)))
        before = motion.transformed(before, "move") if move else before.filter(gone >= LEAST_MOTION_M)
        near = clusters.nearest(before.select(*KEYS, "pid", "x", "y", "z"), still, 0.5, KEYS).select(F.lit(kind).alias("kind"), "distance")
        parts = near if parts is None else parts.unionByName(near)
    found = reports.rows_of(metrics.alignment(parts, APART_M))[0]
    return {"pairs": moved.count(), "threshold": APART_M, **found}


def motion_by_gap(points: DataFrame, frames: DataFrame, gaps: tuple[int, ...] = (1, 2, 3, 5), settings: Settings = DEFAULTS) -> DataFrame:
    """Scores of votes and clusters against true motion for each gap between scans, all in one plan.

    Points may move if their class can, whether or not their label says that they do, as networks' labels don't.
    """
    labelled = classified(points).select(*KEYS, "pid", "x", "y", "z", F.col("raw").bitwiseAND(65535).alias("sem"), F.col("super_cls").alias("cls"), representative(F.col("learning_id")).alias("pred"))
    old = earlier_scans(points, frames, gaps)
    own = [*KEYS, "gap"]
    image = motion.range_image(motion.projected(old), own)
    asked = labelled.join(frames.select(*KEYS).join(old.select(*own).distinct(), list(KEYS)), list(KEYS))
    votes = motion.residual_votes(motion.projected(asked.filter(movable(asked.columns))), image, own)
    held = votes.join(clusters.clustered(votes, own, settings), [*own, "pid"])
    verdicts = motion.cluster_verdicts(held, own, settings).filter("is_moving").select(*own, "cluster")
    moving = held.join(verdicts, [*own, "cluster"]).select(*own, "pid", F.lit(True).alias("moving"))
    judged = asked.select(*own, "pid", "sem").join(moving, [*own, "pid"], "left").withColumn("moving", F.coalesce("moving", F.lit(False)))
    scores = metrics.motion_scores(judged, F.col("moving"), F.col("sem").between(252, 259), F.col("sem").isin(10, 13, 18, 20), "gap")
    return scores.filter("overall = 0").withColumnRenamed("bucket", "gap")


def objects_scored(found: DataFrame) -> DataFrame:
    """pooled_objects() of clustered points with true labels (raw)."""
    return metrics.pooled_objects(found.withColumn("inst", instance(F.col("raw"))), KEYS)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terrafold", description=__doc__)
    parser.add_argument("command", choices=["inspect", "verify", "stats", "evaluate", "memory", "align", "map", "zoom", "hazard"])
    parser.add_argument("root", help="folder of a dataset")
    parser.add_argument("--seq", default=None)
    parser.add_argument("--frame", type=int, default=None)
    parser.add_argument("--stride", type=int, default=1)
    parser.add_argument("--config", default=None, help="folder with grid.yaml, derived.yaml and motion.yaml")
    parser.add_argument("--preset", default=None)
    parser.add_argument("--predictions", default=None, help="folder of cached predictions")
    parser.add_argument("--pairs", type=int, default=50)
    parser.add_argument("--seed", type=int, default=1337)
    parser.add_argument("--box", type=float, nargs=4, default=(-2.0, 2.0, -2.0, 2.0), help="x from, to, y from, to (m)")
    parser.add_argument("--rings", type=float, nargs="+", default=None, help="radius and cell of each ring (m), instead of a preset")
    parser.add_argument("--kind", choices=hazards.KINDS, default="kerb")
    parser.add_argument("--at", type=float, nargs=2, default=(5.0, 0.0), help="place of a hazard (m)")
    parser.add_argument("--json", default=None)
    parser.add_argument("--table", default=None, help="path of a Markdown table, or of the Parquet table of a map")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    preset, presets, settings = load(a.config) if a.config else (PRESETS["fovea_default"], PRESETS, DEFAULTS)
    preset = presets[a.preset] if a.preset else preset
    if a.rings:
        preset = Preset.of("custom", *((round(r * 1000), round(c * 1000)) for r, c in zip(a.rings[::2], a.rings[1::2], strict=True))).validated()
    if a.command == "verify":
        found = scans.verified(spark, a.root)
        print(scans.report(found))
        return int(not found.isEmpty())
    points = scans.scans(spark, a.root, a.stride, a.seq, a.frame)
    points = scans.labelled(points, scans.labels(spark, a.root, a.seq, a.frame).filter(F.col("frame") % a.stride == 0))
    table = None
    if a.command == "inspect":
        out = {"classes": reports.rows_of(inspected(points))}
        table = reports.markdown(out["classes"], ["label", "n", "percent"])
    elif a.command == "stats":
        stats = statistics(points, settings.buckets_m)
        names = [f"{x}-{y} m" for x, y in zip(settings.buckets_m[:-1], settings.buckets_m[1:], strict=True)]
        out, table = {"stats": reports.rows_of(stats)}, reports.stats_markdown(stats, names)
    elif a.command == "evaluate":
        out = evaluated(points, scans.archived_predictions(spark, a.predictions))
        names = [f"{x}-{y} m" for x, y in zip(EVALUATION_M[:-1], EVALUATION_M[1:], strict=True)]
        table = reports.semantic_markdown(out["semantic"], out["by_distance"], names)
    elif a.command == "align":
        out = aligned(points, scans.frames(spark, a.root), a.pairs, a.seed)
    elif a.command in ("memory", "map"):
        made = mapped(points, preset, settings=settings)
        out = {"memory": reports.rows_of(metrics.reduction(made.memory))} if a.command == "memory" else {"counters": reports.rows_of(made.counters)}
        if a.command == "map" and a.table:
            made.cells.write.mode("overwrite").parquet(a.table)
    else:
        mm = grid.quantise(classified(points).withColumns({"cls": F.col("super_cls"), "moving": F.col("is_moving"), "conf": F.lit(255).cast("bigint")}), settings)
        if a.command == "zoom":
            out = {"zoom": reports.rows_of(stencil.zoom_verdicts(stencil.zoomed(mm, tuple(round(v * 1000) for v in a.box), (50, 200, 400, 500), KEYS), KEYS))}
        else:
            x, y = (round(v * 1000) for v in a.at)
            cells = layers(hazards.preview(mm, a.kind, x, y, KEYS), preset, settings=settings)[1]
            one = cells.select(*KEYS).distinct().withColumns({"hazard": F.lit(0), "kind": F.lit(a.kind), "cx_mm": F.lit(x).cast("bigint"), "cy_mm": F.lit(y).cast("bigint"), "depth_mm": F.lit(180).cast("bigint")})
            out = {"hazard": reports.rows_of(hazards.detected(one, cells, preset, KEYS).select(*KEYS, "kind", "hit"))}
    text = reports.write_json(out, a.json) if a.json else None
    if table and a.table:
        with open(a.table, "w", encoding="utf-8") as f:
            f.write(table)
    print(table or text or out)
    return int(a.command == "align" and out["verdict"] != "PASS")


if __name__ == "__main__":
    sys.exit(main())
