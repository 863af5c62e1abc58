"""Measures: confusion and IoU, buckets, histograms, motion and object scores, intervals, memory against accuracy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.config import Preset
from terrafold.functions.integers import big, floor_div
from terrafold.operators.grid import by_preset, locate_many


def confusion(pairs: DataFrame, gt: str = "gt", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """How often each (truth, prediction) occurs."""
    return pairs.groupBy(*keys, gt, pred).agg(F.count(F.lit(1)).alias("n"))


def _share(num: Column, den: Column) -> Column:
    """num / den in double precision, null if den is 0."""
    return F.when(den > 0, num.cast("double") / den)


def class_scores(counts: DataFrame, gt: str = "gt", pred: str = "pred", ignored: Sequence[int] = ()) -> DataFrame:
    """tp, fp, fn and iou of each class of confusion(); rows whose truth is ignored don't count, predictions of ignored
    classes do, as misses. A class that is neither true nor predicted has no row."""
    used = counts.filter(~F.col(gt).isin(*ignored)) if ignored else counts
    both = F.explode(F.array(F.struct(F.col(gt).alias("cls"), F.lit(0).alias("k")), F.struct(F.col(pred).alias("cls"), F.lit(1).alias("k"))))
    out = used.select(both.alias("c"), (F.col(gt) == F.col(pred)).alias("hit"), "n").groupBy("c.cls").agg(
        F.sum(F.when(F.col("hit") & (F.col("c.k") == 0), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("c.k") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("c.k") == 0), F.col("n")).otherwise(0)).alias("fn"),
    )
    out = out.filter(~F.col("cls").isin(*ignored)) if ignored else out
    return out.withColumn("iou", F.round(_share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), 6))


def summary_scores(counts: DataFrame, gt: str = "gt", pred: str = "pred", ignored: Sequence[int] = ()) -> DataFrame:
    """One row: accuracy (over rows that count) and mean IoU over classes with a row."""
    used = counts.filter(~F.col(gt).isin(*ignored)) if ignored else counts
    hit = F.sum(F.when(F.col(gt) == F.col(pred), F.col("n")).otherwise(0))
    accuracy = used.agg(F.round(_share(hit, F.sum("n")), 6).alias("accuracy"), F.sum("n").alias("n"))
    mean = class_scores(counts, gt, pred, ignored).agg(F.round(F.avg("iou"), 6).alias("miou"))
    return accuracy.crossJoin(mean)  # one row each


def by_bucket(pairs: DataFrame, gt: str = "gt", pred: str = "pred", bucket: str = "bucket") -> DataFrame:
    """Confusion overall (bucket null) and by bucket, from one aggregation."""
    sets = [[gt, pred], [bucket, gt, pred]]
    out = pairs.groupingSets([[F.col(c) for c in s] for s in sets], F.col(bucket), F.col(gt), F.col(pred)).agg(F.count(F.lit(1)).alias("n"), F.grouping(bucket).cast("int").alias("overall"))
    return out.select("overall", bucket, gt, pred, "n")


def instances(points: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Objects (label, instance) of each frame with their points and mean place; instance 0 is no object."""
    inst = F.shiftright(F.col("raw"), 16)
    out = points.withColumns({"sem_id": F.col("raw").bitwiseAND(65535), "inst": inst}).filter("inst > 0")
    return out.groupBy(*keys, "sem_id", "inst").agg(F.count(F.lit(1)).alias("n"), F.sum("x_mm").alias("sx"), F.sum("y_mm").alias("sy"))


def annuli(r: Column, width: float, most: float) -> Column:
    """The ring of this width that holds r; the outer edge belongs to the last one; null outside."""
    last = round(most / width) - 1
    return F.when((r >= 0) & (r <= most), F.least(F.floor(r / width), big(last)))


def density(points: DataFrame, r: Column, width: float, most: float) -> DataFrame:
    """Points and points per square metre of each annulus."""
    out = points.select(annuli(r, width, most).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.col("bin") * width, (F.col("bin") + 1) * width
    return out.withColumn("per_m2", F.round(F.col("n") / (math.pi * (b * b - a * a)), 6))


def backprojection(points: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """preset and squared distance (mm) of each point inside to its cell's centre, for several presets in one scan."""
    out = locate_many(points, presets)
    size, offset = (by_preset(presets, lambda p, k, r, f=f: getattr(r, f)) for f in ("cell", "offset"))
    gap = {c: F.col(f"{c}_mm") - ((F.col(f"i{c}") - offset) * size + floor_div(size, 2)) for c in "xy"}
    return out.withColumn("err2", gap["x"] * gap["x"] + gap["y"] * gap["y"])


#: Ranges of values that percentiles() counts apart; a task orders the distinct values of a key's range.
RANGES = 64


def percentiles(df: DataFrame, value: str, keys: Sequence[str], at: dict[str, float]) -> DataFrame:
    """Exact percentiles, linear between ranks, over all rows; and n. Nulls don't count.

    Values become a histogram at once. Its borders of RANGES ranges are approximate percentiles of its values; counts up to
    each value are sums over ranges and, in a range, over its values, so no task orders all values of a key.
    """
    keys = list(keys)
    if not keys:
        return percentiles(df.withColumn("_all", F.lit(1)), value, ["_all"], at).drop("_all")
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]
    named = lambda t, other: t.withColumnsRenamed({k: f"{other}{k}" for k in keys})
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    borders = counts.groupBy(*keys).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 1000).alias("_b"), F.sum("_n").alias("n"))
    ranged = counts.join(named(borders, "_b_"), same("_b_")).withColumn("_r", F.size(F.filter("_b", lambda b: b < F.col("_v"))))
    ranged = ranged.select(*keys, "_v", "_n", "n", "_r")
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_r").agg(F.sum("_n").alias("_s")).withColumn("_s", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    starts = named(starts, "_s_").withColumnRenamed("_r", "_s_r")
    own = Window.partitionBy(*keys, "_r").orderBy("_v")
    placed = ranged.withColumn("_end", F.sum("_n").over(own)).join(starts, [*same("_s_"), F.col("_r") == F.col("_s_r")])
    placed = placed.withColumn("_end", F.col("_end") + F.col("_s"))
    out = []
    for k, q in enumerate(at.values()):
        rank = F.lit(float(q)) * (F.col("n") - 1)
        # The least value that more than so many rows don't exceed.
        out += [F.min(F.when(F.col("_end") > F.floor(rank), F.col("_v"))).alias(f"_lo{k}"), F.min(F.when(F.col("_end") > F.ceil(rank), F.col("_v"))).alias(f"_hi{k}")]
    got = placed.groupBy(*keys, "n").agg(*out)
    for k, (name, q) in enumerate(at.items()):
        rank = F.lit(float(q)) * (F.col("n") - 1)
        got = got.withColumn(name, F.round(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (rank - F.floor(rank)), 6))
    return got.select(*keys, *at, "n")


def motion_scores(points: DataFrame, moving: Column, truth: Column, parked: Column, bucket: str) -> DataFrame:
    """tp, fp, fn, tn, IoU and the share of parked points called moving; overall (bucket null) and by bucket."""
    marked = points.select(F.col(bucket).alias("bucket"), moving.alias("m"), truth.alias("t"), parked.alias("p"))
    out = marked.groupingSets([[], [F.col("bucket")]], F.col("bucket")).agg(
        F.grouping("bucket").cast("int").alias("overall"),
        F.count_if(F.col("m") & F.col("t")).alias("tp"), F.count_if(F.col("m") & ~F.col("t")).alias("fp"),
        F.count_if(~F.col("m") & F.col("t")).alias("fn"), F.count_if(~F.col("m") & ~F.col("t")).alias("tn"),
        F.count_if(F.col("p")).alias("parked"), F.count_if(F.col("p") & F.col("m")).alias("parked_fp"),
    )
    iou = F.round(_share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), 6)
    return out.withColumns({"iou": iou, "parked_fpr": F.round(_share(F.col("parked_fp"), F.col("parked")), 6)})


def matched_objects(points: DataFrame, keys: Sequence[str] = ("frame",), least: float = 0.5) -> DataFrame:
    """For each predicted cluster its commonest true instance (the lowest on ties; 0 is none), the overlap, and whether
    that is at least the given share of the cluster."""
    counts = points.groupBy(*keys, "cluster", "inst").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*keys, "cluster")
    ranked = counts.withColumn("_k", F.row_number().over(own.orderBy(F.desc("n"), F.asc("inst")))).withColumn("size", F.sum("n").over(own))
    best = ranked.filter("_k = 1")
    return best.select(*keys, "cluster", "inst", "n", "size", ((F.col("n") >= least * F.col("size")) & (F.col("inst") > 0)).alias("matched"))


def wilson(hits: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """The interval of a rate at the given confidence; 0 to 0 without trials."""
    z = round(NormalDist().inv_cdf(0.5 + confidence / 2), 6) if confidence != 0.95 else 1.96
    p, m = hits / F.greatest(n, F.lit(1)), F.greatest(n, F.lit(1)).cast("double")
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    zero = F.when(n == 0, 0.0)
    return zero.otherwise(F.greatest(F.lit(0.0), (mid - half) / scale)), zero.otherwise(F.least(F.lit(1.0), (mid + half) / scale))


def detection_rates(trials: DataFrame, by: Sequence[str], hit: str = "hit") -> DataFrame:
    """Trials, hits, rate and its interval: overall and by each of the columns, from one aggregation."""
    out = trials.groupingSets([[], *[[F.col(c)] for c in by]], *(F.col(c) for c in by)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("hits"), *(F.grouping(c).cast("int").alias(f"all_{c}") for c in by)
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.withColumns({"rate": F.round(_share(F.col("hits"), F.col("n")), 6), "low": F.round(low, 6), "high": F.round(high, 6)})


def tradeoff(errors: DataFrame, presets: Sequence[Preset]) -> DataFrame:
    """Mean back-projection error (mm) of each preset beside the cells it needs and their bytes."""
    spark = errors.sparkSession
    sizes = spark.createDataFrame([(p.name, sum(p.logical_cells(k) for k in range(len(p.rings))), sum(p.allocated_cells(k) for k in range(len(p.rings)))) for p in presets], "preset string, logical bigint, allocated bigint")
    mean = errors.groupBy("preset").agg(F.round(F.avg(F.sqrt(F.col("err2").cast("double"))), 6).alias("mean_mm"), F.count(F.lit(1)).alias("n"))
    return mean.join(F.broadcast(sizes), "preset").withColumn("bytes", F.col("allocated") * 12)


def class_histogram(points: DataFrame, column: str) -> DataFrame:
    """How often each value occurs and its percentage of all rows."""
    counts = points.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") * 100.0 / F.col("_t"), 6).alias("percent"))  # one row


def checked_ids(pairs: DataFrame, most: int, *columns: str) -> DataFrame:
    """pairs, with an error for an id that isn't from 0 to `most`."""
    out = pairs
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c).between(0, most), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} out of range")).cast("bigint")))
    return out


def accounting(points: DataFrame, gt: str = "gt", pred: str = "pred", bucket: str = "bucket", unknown: int = 0) -> DataFrame:
    """Points, those with a truth, those without, and those predicted unknown with their rate; overall (bucket null) and by
    bucket (-1: beyond the last edge)."""
    out = points.groupingSets([[], [F.col(bucket)]], F.col(bucket)).agg(
        F.grouping(bucket).cast("int").alias("overall"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(bucket) >= 0).alias("n_within"),
        F.count_if(F.col(gt) != unknown).alias("n_evaluated"), F.count_if(F.col(gt) == unknown).alias("n_ignored"), F.count_if(F.col(pred) == unknown).alias("n_unknown"),
    )
    return out.withColumn("unknown_rate", F.round(_share(F.col("n_unknown"), F.col("n")), 6)).withColumnRenamed(bucket, "bucket")


def scores_by(counts: DataFrame, keys: Sequence[str], gt: str = "gt", pred: str = "pred", unknown: int = 0) -> DataFrame:
    """n, accuracy and mean IoU of each key from a confusion with these keys. Rows without a truth don't count; predictions
    of the unknown class are misses; classes neither true nor predicted have no IoU."""
    keys = list(keys)
    used = counts.filter(F.col(gt) != unknown)
    both = F.explode(F.array(F.struct(F.col(gt).alias("cls"), F.lit(0).alias("k")), F.struct(F.col(pred).alias("cls"), F.lit(1).alias("k"))))
    each = used.select(*keys, both.alias("c"), (F.col(gt) == F.col(pred)).alias("hit"), "n").groupBy(*keys, "c.cls").agg(
        F.sum(F.when(F.col("hit") & (F.col("c.k") == 0), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("hit") & (F.col("c.k") == 1), 0).otherwise(F.col("n"))).alias("all"),
        F.sum(F.when(F.col("c.k") == 0, F.col("n")).otherwise(0)).alias("true"),
    )
    iou = F.when(F.col("cls") != unknown, F.col("tp") / F.col("all"))
    return each.groupBy(*keys).agg(F.sum("true").alias("n"), F.round(_share(F.sum("tp"), F.sum("true")), 6).alias("accuracy"), F.round(F.avg(iou), 6).alias("miou"))


def data_stats(points: DataFrame, keys: Sequence[str] = ("seq",), cls: str = "super_cls", bucket: str = "bucket") -> DataFrame:
    """Points, moving ones and safety-critical ones by class and bucket, with all sums over either, for each sequence: one aggregation."""
    keys = list(keys)
    sets = [[*keys], [*keys, cls], [*keys, bucket], [*keys, cls, bucket]]
    out = points.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in (*keys, cls, bucket)))
    return out.agg(
        F.grouping(cls).cast("int").alias("all_classes"), F.grouping(bucket).cast("int").alias("all_buckets"),
        F.count(F.lit(1)).alias("n"), F.count_if("is_moving").alias("n_moving"), F.count_if("critical").alias("n_critical"),
    )


def object_buckets(points: DataFrame, groups: dict[str, Sequence[int]], edges_mm: Sequence[int], keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Objects of each group of raw classes by the bucket of their mean place, counted once for each frame; those beyond the
    last edge don't count."""
    found = instances(points, keys).withColumn("r2", (F.col("sx") / F.col("n")) ** 2 + (F.col("sy") / F.col("n")) ** 2)
    group = F.when(F.lit(False), F.lit(""))
    for name, ids in groups.items():
        group = group.when(F.col("sem_id").isin(*ids), F.lit(name))
    place = F.when(F.lit(False), F.lit(0))
    for k, (a, b) in enumerate(zip(edges_mm[:-1], edges_mm[1:], strict=True)):
        most = F.col("r2") <= float(b) ** 2 if k == len(edges_mm) - 2 else F.col("r2") < float(b) ** 2
        place = place.when((F.col("r2") >= float(a) ** 2) & most, F.lit(k))
    marked = found.select(group.alias("group"), place.alias("bucket")).filter("group IS NOT NULL AND bucket IS NOT NULL")
    return marked.groupBy("group", "bucket").agg(F.count(F.lit(1)).alias("n"))


def points_per_cell(density: DataFrame, preset: Preset, width: float, frames: int = 1) -> DataFrame:
    """density() of `frames` scans with ring (of the annulus' middle) and per_cell: points that a cell of that ring gets a scan."""
    middle = (F.col("bin") + 0.5) * width * 1000
    ring, area = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0.0))
    for k, r in enumerate(preset.rings):
        ring, area = ring.when(middle <= r.r, F.lit(k)), area.when(middle <= r.r, F.lit((r.cell / 1000) ** 2))
    return density.withColumn("ring", ring).withColumn("per_cell", F.round(F.coalesce(F.col("per_m2") / frames * area, F.lit(0.0)), 6))


def reduction(memory: DataFrame) -> DataFrame:
    """Mean, 95th percentile, least and most bytes of each kind of map over frames, and how many times smaller the rings are."""
    kinds = ("dense_3d", "sparse_3d", "uniform_2_5d", "foveated")
    each = memory.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("bytes")) for k in kinds))).alias("k")).select("k.*")
    out = percentiles(each, "bytes", ["kind"], {"p95": 0.95}).drop("n")
    ends = each.groupBy("kind").agg(F.avg("bytes").alias("mean"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    own = ends.filter(F.col("kind") == "foveated").agg(F.max("mean").alias("_rings"))
    out = ends.join(out, "kind").crossJoin(F.broadcast(own))  # one row
    return out.select("kind", "mean", "p95", "least", "most", F.round(F.col("mean") / F.greatest(F.col("_rings"), F.lit(1.0)), 1).alias("ratio"))


def cluster_classes(points: DataFrame, keys: Sequence[str] = ("frame",), cls: str = "sem") -> DataFrame:
    """The commonest class of each cluster, the lowest on ties, and its share of the cluster's points."""
    counts = points.filter("cluster >= 0").groupBy(*keys, "cluster", cls).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.struct(cls, "_n"), F.struct("_n", -F.col(cls))).alias("_b")
    out = counts.groupBy(*keys, "cluster").agg(best, F.sum("_n").alias("n"))
    return out.select(*keys, "cluster", F.col(f"_b.{cls}").alias(cls), "n", F.round(F.col("_b._n") / F.col("n"), 6).alias("agreement"))


def pooled_objects(points: DataFrame, keys: Sequence[str] = ("frame",), least: float = 0.5) -> DataFrame:
    """One row over all frames: true objects, predicted ones, matched ones, recall, precision and F1, from sums of counts.

    points: cluster (-1: none) and inst (0: none). A true object that several clusters match counts once.
    """
    truths = points.filter("inst > 0").select(*keys, "inst").distinct().agg(F.count(F.lit(1)).alias("truths"))
    found = matched_objects(points.filter("cluster >= 0"), keys, least)
    hit = F.when(F.col("matched"), F.struct(*keys, "inst"))
    sums = found.agg(F.count(F.lit(1)).alias("predicted"), F.count_if("matched").alias("matched"), F.countDistinct(hit).alias("found"))
    out = truths.crossJoin(sums)  # one row each
    out = out.withColumn("recall", F.round(_share(F.col("found"), F.col("truths")), 6)).withColumn("precision", F.round(_share(F.col("matched"), F.col("predicted")), 6))
    return out.withColumn("f1", F.round(_share(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), 6))


def alignment(distances: DataFrame, threshold: float, control: str = "control") -> DataFrame:
    """One row of the pooled median, 90th percentile and n of distances (kind, distance) by kind, and the verdict: PASS if all
    kinds but the control lie below the threshold in the median and the control doesn't; INCONCLUSIVE if it does too."""
    each = percentiles(distances, "distance", ["kind"], {"median": 0.5, "p90": 0.9})
    good = F.coalesce(F.bool_and(F.when(F.col("kind") != control, F.col("median") < threshold)), F.lit(False))
    apart = F.coalesce(F.bool_or(F.when(F.col("kind") == control, F.col("median") >= threshold)), F.lit(False))
    verdict = F.when(good & apart, "PASS").when(good, "INCONCLUSIVE").otherwise("FAIL")
    return each.agg(F.sort_array(F.collect_list(F.struct("kind", "median", "p90", "n"))).alias("kinds"), verdict.alias("verdict"))


def bounds(points: DataFrame, columns: Sequence[str] = ("x", "y", "z"), keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The least and greatest value of each column: <column>_lo, <column>_hi."""
    return points.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))


def distinct_values(points: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("frame",)) -> DataFrame:
    """How many different values each column has."""
    return points.groupBy(*keys).agg(*(F.countDistinct(c).alias(c) for c in columns))
