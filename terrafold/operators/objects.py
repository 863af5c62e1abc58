"""Moving things: votes over several gaps, clusters and their verdicts, objects with boxes, also from true instances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, DYNAMIC, STATIC, Settings
from terrafold.functions.labels import MOVABLE, VULNERABLE, instance, label_dim, semantic
from terrafold.operators import clusters, motion
from terrafold.storage import written

#: Names of vehicles at rest; spans (m) from which an instance is split, at rest and moving; radius of the split.
VEHICLES = ("car", "bicycle", "bus", "motorcycle", "on-rails", "truck", "other-vehicle")
WIDE_M, WIDE_MOVING_M, SPLIT_EPS_M = 5.0, 4.2, 1.8


@dataclass(frozen=True)
class Motion:
    """Points with moving and cls as estimated, and objects: one row each."""

    points: DataFrame
    objects: DataFrame


def movable(columns: Sequence[str], ids: Sequence[int] = MOVABLE, label: str = "pred") -> Column:
    """Whether a point with these columns may belong to something that moves: by its predicted label if there is one, else by its
    true label (raw), else by its class."""
    out = F.col("cls").isin(STATIC, DYNAMIC)
    for name in ("raw", label):  # what is predicted is asked first
        if name in columns:
            out = F.when(F.col(name).isNotNull(), semantic(F.col(name)).isin(*ids)).otherwise(out)
    return out


def voted(points: DataFrame, previous: DataFrame, keys: Sequence[str] = ("frame",), settings: Settings = DEFAULTS, **image) -> DataFrame:
    """points (pid, x, y, z) with vote: the largest over all gaps.

    previous: x, y, z of earlier scans, moved to the frame of now, with keys and gap. All gaps are one job: images and votes
    have the gap among their keys. A point without any image has no evidence: -1.
    """
    keys = list(keys)
    gaps = previous.select(*keys, "gap").distinct()
    scene = motion.range_image(motion.projected(previous, **image), [*keys, "gap"])
    size = {k: v for k, v in image.items() if k in ("height", "width")}
    now = motion.projected(points.select(*keys, "pid", "x", "y", "z"), **image).join(gaps, keys)
    each = motion.residual_votes(now, scene, [*keys, "gap"], settings=settings, **size)
    votes = motion.joined_votes(each, keys)
    return points.join(votes, [*keys, "pid"], "left").withColumn("vote", F.coalesce("vote", F.lit(-1)))


def _named(objects: DataFrame, cls: str) -> DataFrame:
    """objects with name and critical of a raw label; labels nobody knows are class_<id>."""
    dim = label_dim(objects.sparkSession).select(F.col("raw_id").alias(cls), "name", "critical")  # 34 rows
    out = objects.join(F.broadcast(dim), cls, "left")
    return out.withColumns({"name": F.coalesce("name", F.concat(F.lit("class_"), F.col(cls))), "critical": F.coalesce("critical", F.lit(False))})


_BOX = ("cx", "cy", "cz", "length", "width", "height", "yaw")


def estimated(points: DataFrame, previous: DataFrame | None, keys: Sequence[str] = ("frame",), settings: Settings = DEFAULTS, label: str = "sem", **image) -> Motion:
    """Motion from geometry alone: votes against earlier scans, clusters of movable points, verdicts of clusters, boxes.

    points: keys, pid, x, y, z, cls, moving, conf and a raw label (column `label`). Points of moving clusters and of
    vulnerable road users become dynamic, those of other clusters static and at rest; points of no cluster stay as they are.
    Objects: obj (the cluster), name, box, n, mean_conf, moving, vote_frac, critical, instance (null).
    """
    keys = list(keys)
    marked = voted(points, previous, keys, settings, **image) if previous is not None else points.withColumn("vote", F.lit(-1))
    found = clusters.clustered(marked.filter(movable(marked.columns, label=label)), keys, settings)
    held = marked.join(found, [*keys, "pid"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    members = held.filter("cluster >= 0").withColumn("_sem", semantic(F.col(label)))
    verdicts = motion.cluster_verdicts(held, keys, settings)
    commonest = members.groupBy(*keys, "cluster").agg(F.mode("_sem", True).alias("_sem"), F.avg("conf").alias("mean_conf"))
    boxes = clusters.oriented_boxes(members, [*keys, "cluster"], settings.angle_step_deg)
    out = _named(verdicts.join(commonest, [*keys, "cluster"]), "_sem").join(boxes.drop("n"), [*keys, "cluster"])
    vulnerable = F.col("name").isin(*VULNERABLE)
    out = out.withColumns({"moving": F.col("is_moving") | vulnerable, "vote_frac": F.col("n_moving") / F.col("n")})
    objects = out.select(
        *keys, F.col("cluster").alias("obj"), "name", *_BOX, "n", "mean_conf", "moving", "vote_frac", (F.col("critical") | F.col("moving")).alias("critical"), F.lit(None).cast("long").alias("instance")
    )
    verdict = out.select(*keys, "cluster", F.col("moving").alias("_m"))
    after = held.join(verdict, [*keys, "cluster"], "left")
    after = after.withColumns({"moving": F.coalesce("_m", "moving"), "cls": F.when(F.col("_m"), DYNAMIC).when(~F.col("_m"), STATIC).otherwise(F.col("cls"))})
    return Motion(after.select(*points.columns, "vote", "cluster"), objects)


def from_instances(points: DataFrame, keys: Sequence[str] = ("frame",), settings: Settings = DEFAULTS, raw: str = "raw") -> Motion:
    """Motion and objects from true labels: points of moving labels move; instances of at least min_points points become objects.

    An instance whose returns spread wide is split by density into its separate clusters, noise left out, unless all is
    noise. Things that neither move nor are vehicles nor vulnerable road users aren't objects.
    """
    keys = list(keys)
    marked = points.withColumns({"_sem": semantic(F.col(raw)), "_inst": instance(F.col(raw))}).withColumn("_t", F.col("_sem").between(252, 259))
    after = marked.withColumns({"moving": F.col("moving") | F.col("_t"), "cls": F.when(F.col("_t"), DYNAMIC).otherwise(F.col("cls"))})
    own = [*keys, "_inst"]
    things = marked.filter("_inst > 0")
    whole = things.groupBy(*own).agg(
        F.count(F.lit(1)).alias("_n"), F.mode("_sem", True).alias("_whole"), F.bool_or("_t").alias("_any"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_span"),
    )
    kept = _named(whole.filter(F.col("_n") >= settings.min_points), "_whole").filter(F.col("_any") | F.col("critical") | F.col("name").isin(*VEHICLES, *VULNERABLE))
    kept = kept.withColumn("_wide", (F.col("_span") > WIDE_M) | (F.col("_any") & (F.col("_span") > WIDE_MOVING_M)))
    members = things.join(kept.select(*own, "_wide", F.col("critical").alias("_safe"), F.col("name").alias("_name")), own)
    split = clusters.dbscan(members.filter("_wide"), SPLIT_EPS_M, settings.min_points, own)
    parts = members.join(split, [*own, "pid"], "left").withColumn("part", F.when(F.col("_wide"), F.col("part")).otherwise(F.lit(0)))
    some = parts.groupBy(*own).agg(F.max("part").alias("_last"))
    parts = parts.join(some, own).withColumn("part", F.when(F.col("_last") < 0, F.lit(0)).otherwise(F.col("part"))).filter("part >= 0")
    found = parts.groupBy(*own, "part").agg(
        F.count(F.lit(1)).alias("n"), F.mode("_sem", True).alias("_part_sem"), F.avg("conf").alias("mean_conf"), F.bool_or("_t").alias("_moves"),
        F.avg(F.col("_t").cast("double")).alias("vote_frac"), F.bool_or("_safe").alias("_safe"), F.greatest(F.max("_last"), F.lit(0)).alias("_last"),
    ).filter(F.col("n") >= settings.min_points)
    found = _named(found, "_part_sem").filter(F.col("_moves") | F.col("name").isin(*VEHICLES, *VULNERABLE))
    boxes = clusters.oriented_boxes(parts, [*own, "part"], settings.angle_step_deg).drop("n")
    found = found.join(boxes, [*own, "part"])
    vulnerable = F.col("name").isin(*VULNERABLE)
    number = F.when(F.col("_last") > 0, F.col("_inst") * 100 + F.col("part")).otherwise(F.col("_inst"))
    objects = found.select(
        *keys, number.alias("obj"), "name", *_BOX, "n", "mean_conf", (F.col("_moves") | vulnerable).alias("moving"), "vote_frac",
        (F.col("_safe") | F.col("_moves") | vulnerable).alias("critical"), F.col("_inst").alias("instance"),
    )
    return Motion(after.select(*points.columns), objects)


def earlier_scans(points: DataFrame, frames: DataFrame, gaps: Sequence[int], keys: Sequence[str] = ("seq",)) -> DataFrame:
    """x, y, z of the scans so many frames before each frame, moved to its own place: keys, frame, gap, x, y, z.

    frames: keys, frame, pose (of the camera) and tr (sensor to camera). Frames without such a predecessor are absent.
    """
    pairs = motion.lagged_frames(frames.select(*keys, "frame", "pose", "tr"), gaps, keys)
    # A small table, written: the products of matrices would otherwise be repeated in every use of a coordinate.
    pairs = written(pairs.select(*keys, "frame", "gap", "prev_frame", motion.relative_pose(F.col("pose"), F.col("prev_pose"), F.col("tr")).alias("move")), "moves")
    old = points.select(*keys, F.col("frame").alias("prev_frame"), "x", "y", "z")
    return motion.transformed(old.join(pairs, [*keys, "prev_frame"]), "move").select(*keys, "frame", "gap", "x", "y", "z")
