"""Further queries: votes and objects, sampling, state, display and payloads, networks' data, earlier variants of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, Preset
from terrafold.functions import labels as L
from terrafold.operators import earlier, grid, metrics, motion, networks, objects, stencil, tracking, voxels, wire
from terrafold.plans.pseudo import SCAN_SQL, scan, table
from terrafold.plans.queries import BUCKET_SQL, CELLS_SQL, NEAR_SQL, ORACLE_SQL, PIXEL_SQL, TINY, XYZ_SQL, _bucketed, _dims, _pixels, _xyz, query, tiny_cells
from terrafold.sources import scans


# --- Alignment, votes over gaps, objects --------------------------------------------------------------------------------
ALIGN_SQL = XYZ_SQL.split(", d AS")[0] + """, l AS (SELECT CASE WHEN pid % 2 = 0 THEN 'large' ELSE 'compact' END AS kind, frame + 1 AS frame, pid, x + 0.03 AS x, y, z FROM p UNION ALL SELECT 'control', frame + 1, pid, x + 300, y, z FROM p WHERE pid % 2 = 1),
n AS (SELECT l.kind, l.frame, l.pid, sqrt(min((l.x - b.x) ** 2 + (l.y - b.y) ** 2 + (l.z - b.z) ** 2)) AS distance FROM l JOIN p b ON b.frame = l.frame GROUP BY ALL),
k AS (SELECT kind, round(quantile_cont(distance, 0.5), 6) AS median, round(quantile_cont(distance, 0.9), 6) AS p90, count(*) AS n FROM n GROUP BY kind),
v AS (SELECT CASE WHEN bool_and(median < 60) FILTER (kind <> 'control') THEN CASE WHEN bool_or(median >= 60) FILTER (kind = 'control') THEN 'PASS' ELSE 'INCONCLUSIVE' END ELSE 'FAIL' END AS verdict FROM k)"""


@query("AGG-30_JN-17_LG-09_alignment", f"{ALIGN_SQL} SELECT kind, median, p90, n, verdict FROM k, v")
def _(spark, d):
    """Labels are frames: the points of each before the points of the next, by kind, and, far off, as a control."""
    from terrafold.operators.clusters import nearest

    p = _xyz(spark, d)
    kind = F.when(F.col("pid") % 2 == 0, "large").otherwise("compact")
    moved = p.select(kind.alias("kind"), (F.col("frame") + 1).alias("frame"), "pid", (F.col("x") + 0.03).alias("x"), "y", "z")
    control = p.filter("pid % 2 = 1").select(F.lit("control").alias("kind"), (F.col("frame") + 1).alias("frame"), "pid", (F.col("x") + 300).alias("x"), "y", "z")
    kinds = p.sparkSession.createDataFrame([("large",), ("compact",), ("control",)], "kind string")
    near = nearest(moved.unionByName(control), p.crossJoin(F.broadcast(kinds)), 8.0, ("kind", "frame"))  # three rows
    return metrics.alignment(near, 60.0).select("verdict", F.explode("kinds").alias("k")).select("k.*", "verdict")


GAPS_SQL = f"""{PIXEL_SQL.replace("px AS (", "px AS MATERIALIZED (").replace("SELECT frame, pid,", "SELECT CAST(pid // 10 % 6 AS INTEGER) AS frame, pid,")},
fr AS (SELECT DISTINCT frame FROM px), g AS (SELECT a.frame, g.gap FROM fr a, (VALUES (1), (2), (3), (5)) g(gap) WHERE a.frame - g.gap IN (SELECT frame FROM fr)), img AS MATERIALIZED (SELECT g.frame, g.gap, v, u, min(r) AS r FROM g JOIN px p ON p.frame = g.frame - g.gap GROUP BY ALL),
o AS (SELECT dv.dv, du.du, (dv.dv + 1) * 3 + du.du + 1 AS k FROM (VALUES (-1), (0), (1)) dv(dv), (VALUES (-1), (0), (1)) du(du)),
now AS MATERIALIZED (SELECT p.*, g.gap FROM px p JOIN g ON g.frame = p.frame),
m AS (SELECT p.frame, p.gap, p.rid, p.r, p.k, abs(p.r - i.r) AS diff FROM (SELECT p.frame, p.gap, p.rid, p.r, o.k, least(greatest(p.v + o.dv, 0), 63) AS nv, (p.u + o.du + 1024) % 1024 AS nu FROM now p CROSS JOIN o) p JOIN img i ON i.frame = p.frame AND i.gap = p.gap AND i.v = p.nv AND i.u = p.nu),
b AS (SELECT gap, rid, min(diff) AS diff FROM m GROUP BY ALL), vt AS (SELECT p.*, CASE WHEN b.rid IS NULL THEN -1 WHEN b.diff <= 0.30 + 0.02 * p.r THEN 0 ELSE 1 END AS vote FROM now p LEFT JOIN b ON b.gap = p.gap AND b.rid = p.rid)"""


def _gap_votes(spark: SparkSession, d: str) -> DataFrame:
    """Six frames out of one scan, each voted on against the frames 1, 2, 3 and 5 before it."""
    p = _pixels(spark, d).withColumn("frame", F.expr("CAST(pid DIV 10 % 6 AS INT)"))
    f = motion.lagged_frames(p.select(F.lit("08").alias("seq"), "frame").distinct(), (1, 2, 3, 5)).select("frame", "gap", "prev_frame")
    image = motion.range_image(p.withColumnRenamed("frame", "prev_frame").join(F.broadcast(f), "prev_frame"), ("frame", "gap"))  # at most 24 rows
    return motion.residual_votes(p.join(F.broadcast(f.select("frame", "gap")), "frame"), image, ("frame", "gap"))


@query("AGG-36_motion_by_gap", f"""{GAPS_SQL}, c AS (SELECT frame, gap, pid % 97 AS cluster, count(*) AS n, count(*) FILTER (vote = 1) AS k FROM vt GROUP BY ALL),
j AS (SELECT v.gap, c.k >= 3 AND c.k >= 0.9 * c.n AS m, v.sem BETWEEN 252 AND 259 AS t, v.sem IN (10, 18, 20) AS p FROM vt v JOIN c ON c.frame = v.frame AND c.gap = v.gap AND c.cluster = v.pid % 97)
SELECT gap, count(*) FILTER (m AND t) AS tp, count(*) FILTER (m AND NOT t) AS fp, count(*) FILTER (NOT m AND t) AS fn, round(count(*) FILTER (m AND t) / CAST(count(*) FILTER (m OR t) AS DOUBLE), 6) AS iou, round(count(*) FILTER (m AND p) / CAST(count(*) FILTER (p) AS DOUBLE), 6) AS parked_fpr FROM j GROUP BY gap""")  # fmt: skip
def _(spark, d):
    from dataclasses import replace

    votes = _gap_votes(spark, d).withColumn("cluster", F.col("pid") % 97)
    own = ["frame", "gap", "cluster"]
    verdicts = motion.cluster_verdicts(votes, ("frame", "gap"), replace(DEFAULTS, vote_share=0.9)).select(*own, "is_moving")
    judged = votes.join(verdicts, own)
    out = metrics.motion_scores(judged, F.col("is_moving"), F.col("sem").between(252, 259), F.col("sem").isin(10, 18, 20), "gap")
    return out.filter("overall = 0").select(F.col("bucket").alias("gap"), "tp", "fp", "fn", "iou", "parked_fpr")


@query("JN-14_joined_votes", f"{GAPS_SQL} SELECT frame, pid, max(vote) AS vote FROM vt GROUP BY ALL")
def _(spark, d):
    return motion.joined_votes(_gap_votes(spark, d))


@query("AGG-37_pooled_objects", f"""{ORACLE_SQL["AGG-22_object_matching"].replace("SELECT frame, cluster, inst, n, size, n >=", ", m AS (SELECT frame, cluster, inst, n, size, n >=")}),
g AS (SELECT count(DISTINCT (frame, raw >> 16)) AS truths FROM pts WHERE raw >> 16 > 0), s AS (SELECT truths, count(*) AS predicted, count(*) FILTER (matched) AS matched, count(DISTINCT (frame, inst)) FILTER (matched) AS found FROM m, g GROUP BY truths),
q AS (SELECT *, round(found / CAST(truths AS DOUBLE), 6) AS recall, round(matched / CAST(predicted AS DOUBLE), 6) AS precision FROM s) SELECT *, CASE WHEN recall + precision > 0 THEN round(2 * recall * precision / (recall + precision), 6) END AS f1 FROM q""")  # fmt: skip
def _(spark, d):
    return metrics.pooled_objects(scan(spark, d).withColumns({"cluster": F.col("pid") % 97, "inst": L.instance(F.col("raw"))}))


SMALL_SQL = f"""WITH {SCAN_SQL}, {_dims()}, sm AS (SELECT frame, pid, raw, sem, conf, raw >> 16 AS inst, x_mm / CAST(10000 AS DOUBLE) AS x, y_mm / CAST(10000 AS DOUBLE) AS y, z_mm / CAST(10000 AS DOUBLE) AS z, sem BETWEEN 252 AND 259 AS t FROM pts),
c AS (SELECT frame, inst, sem, count(*) AS k FROM sm WHERE inst > 0 GROUP BY ALL), mo AS (SELECT frame, inst, sem FROM c QUALIFY row_number() OVER (PARTITION BY frame, inst ORDER BY k DESC, sem) = 1),
w AS (SELECT s.frame, s.inst, count(*) AS n, bool_or(t) AS moves, avg(CAST(t AS INTEGER)) AS vote_frac, avg(conf) AS mean_conf FROM sm s WHERE inst > 0 GROUP BY ALL HAVING count(*) >= 5),
ok AS (SELECT w.*, dim.name, dim.critical FROM w JOIN mo USING (frame, inst) JOIN dim ON dim.raw_id = mo.sem WHERE moves OR critical OR name IN ('car', 'bicycle', 'bus', 'motorcycle', 'on-rails', 'truck', 'other-vehicle')),
a AS (SELECT s.frame, s.inst, k, radians(k * 5.0) AS t, min(x * cos(radians(k * 5.0)) + y * sin(radians(k * 5.0))) AS x0, max(x * cos(radians(k * 5.0)) + y * sin(radians(k * 5.0))) AS x1, min(y * cos(radians(k * 5.0)) - x * sin(radians(k * 5.0))) AS y0, max(y * cos(radians(k * 5.0)) - x * sin(radians(k * 5.0))) AS y1 FROM sm s, range(18) r(k) WHERE inst > 0 GROUP BY ALL),
bx AS (SELECT frame, inst, round(greatest(x1 - x0, y1 - y0), 5) AS length, round(least(x1 - x0, y1 - y0), 5) AS width FROM a QUALIFY row_number() OVER (PARTITION BY frame, inst ORDER BY (x1 - x0) * (y1 - y0), k) = 1)"""


@query("CL-07_FLT-07_instance_objects", f"{SMALL_SQL} SELECT frame, inst AS obj, name, n, moves OR critical AS moving, round(vote_frac, 6) AS vote_frac, round(mean_conf, 6) AS mean_conf, moves OR critical AS critical, length, width FROM ok JOIN bx USING (frame, inst)")
def _(spark, d):
    """Scans a tenth as large, so that no instance spreads wide."""
    p = scan(spark, d).withColumns({c: F.col(f"{c}_mm") / 10000.0 for c in "xyz"})
    out = objects.from_instances(p).objects
    return out.select("frame", "obj", "name", "n", "moving", F.round("vote_frac", 6).alias("vote_frac"), F.round("mean_conf", 6).alias("mean_conf"), "critical", F.round("length", 5).alias("length"), F.round("width", 5).alias("width"))


@query("CL-08_FLT-04_estimated", f"""{XYZ_SQL.replace("WITH p", "WITH RECURSIVE p")}, lb AS (SELECT pid, [10, 30, 50, 252][pid % 4 + 1] AS sem FROM p), q AS (SELECT p.* FROM p JOIN lb ON lb.pid = p.pid WHERE lb.sem IN (10, 30)),
e AS (SELECT frame, pid, other FROM d WHERE d2 <= (5 + 0.1 * r) ** 2 AND pid IN (SELECT pid FROM q) AND other IN (SELECT pid FROM q)), u AS (SELECT frame, pid, other FROM e UNION SELECT frame, other, pid FROM e),
c AS (SELECT frame, pid, pid AS root FROM q UNION SELECT c.frame, c.pid, u.other FROM c JOIN u ON u.pid = c.root AND u.frame = c.frame), m AS (SELECT frame, pid, min(root) AS root FROM c GROUP BY ALL),
s AS (SELECT frame, root, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 5), k AS (SELECT frame, root, row_number() OVER (PARTITION BY frame ORDER BY n DESC, root) - 1 AS cluster FROM s),
t AS (SELECT m.frame, m.pid, k.cluster, lb.sem FROM m JOIN k ON k.frame = m.frame AND k.root = m.root JOIN lb ON lb.pid = m.pid), w AS (SELECT frame, cluster, CASE WHEN count(*) FILTER (sem = 10) >= count(*) FILTER (sem = 30) THEN 10 ELSE 30 END AS sem FROM t GROUP BY ALL)
SELECT p.frame, p.pid, coalesce(t.cluster, -1) AS cluster, CASE WHEN w.sem = 30 THEN true ELSE false END AS moving, CASE WHEN w.sem = 30 THEN 4 WHEN w.sem = 10 THEN 3 ELSE 1 END AS cls FROM p LEFT JOIN t ON t.frame = p.frame AND t.pid = p.pid LEFT JOIN w ON w.frame = t.frame AND w.cluster = t.cluster""")  # fmt: skip
def _(spark, d):
    """A first frame, without an earlier scan: clusters of what can move; those that are mostly people move."""
    from dataclasses import replace

    sem = F.element_at(F.array(*map(F.lit, (10, 30, 50, 252))), (F.col("pid") % 4 + 1).cast("int")).cast("bigint")
    p = _xyz(spark, d).withColumns({"sem": sem, "cls": F.lit(1), "moving": F.lit(False), "conf": F.lit(255)})
    return objects.estimated(p, None, settings=replace(DEFAULTS, eps0_m=5.0, eps1_rel=0.1)).points.select("frame", "pid", "cluster", "moving", "cls")


@query("FLT-03_standing_points", f"WITH {SCAN_SQL} SELECT frame, sem, count(*) AS n FROM pts WHERE sem IN (80, 71, 81) AND sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) < 9000 GROUP BY ALL")
def _(spark, d):
    from terrafold.__main__ import COMPACT, standing

    p = scan(spark, d).withColumns({"x": F.col("x_mm"), "y": F.col("y_mm")})
    return standing(p, COMPACT, 9000.0).groupBy("frame", "sem").agg(F.count(F.lit(1)).alias("n"))


@query("JN-05_colours", f"WITH {SCAN_SQL} SELECT CASE WHEN pid % 11 = 0 THEN 7 ELSE sem END AS sem, CASE WHEN pid % 11 = 0 THEN 'unknown-7' WHEN sem = 10 THEN 'car' ELSE 'else' END AS name, CASE WHEN pid % 11 <> 0 AND sem = 10 THEN 100 ELSE 0 END AS red, CASE WHEN pid % 11 <> 0 AND sem = 10 THEN 245 ELSE 0 END AS blue, count(*) AS n FROM pts WHERE pid % 11 = 0 OR sem = 10 GROUP BY ALL")
def _(spark, d):
    p = scan(spark, d).filter("pid % 11 = 0 OR sem = 10").withColumn("raw", F.when(F.col("pid") % 11 == 0, 7).otherwise(F.col("sem")))
    return L.coloured(p.select("raw")).groupBy(F.col("raw").alias("sem"), "name", "red", "blue").agg(F.count(F.lit(1)).alias("n"))


@query("JN-01_unknown_ids", f"WITH {SCAN_SQL} SELECT CAST(7 AS BIGINT) AS id, count(*) AS n FROM pts WHERE pid % 11 = 0")
def _(spark, d):
    return L.unknown_ids(scan(spark, d).withColumn("raw", F.when(F.col("pid") % 11 == 0, 7).otherwise(F.col("raw"))))


# --- Frames: order, sampling, caches, state -------------------------------------------------------------------------------
@query("SRC-07_18_stride", "WITH f AS (SELECT o_orderkey AS frame, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT frame, k // 3 AS idx, k // 3 - (n + 2) // 3 AS negative FROM f WHERE k % 3 = 0")
def _(spark, d):
    return scans.strided(table(spark, d, "orders").select(F.col("o_orderkey").alias("frame")), 3)


@query("SRT-05_sampled_frames", "WITH f AS (SELECT o_custkey AS seq, o_orderkey AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), i AS (SELECT DISTINCT seq, CAST(floor(i * (n - 1) / CAST(4 AS DOUBLE)) AS BIGINT) AS k FROM f, range(5) r(i)) SELECT f.seq, f.frame FROM f JOIN i ON i.seq = f.seq AND i.k = f.k")
def _(spark, d):
    """Five evenly spaced orders of each customer."""
    return scans.sampled_frames(table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("frame")), 5, ["seq"])


@query("SRC-05_times", "SELECT CAST(o.o_custkey AS VARCHAR) AS seq, o.o_orderkey AS frame, round(coalesce(t.o_totalprice, o.o_orderkey * CAST(0.1 AS DOUBLE)), 6) AS ts FROM orders o LEFT JOIN orders t ON t.o_orderkey = o.o_orderkey AND t.o_orderkey % 4 <> 0")
def _(spark, d):
    """Orders as frames; every fourth has no time."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("seq"), F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("t"))
    return scans.timed(o.drop("t"), o.filter("frame % 4 <> 0")).withColumn("ts", F.round("ts", 6))


@query("SNK-02_uncached", "SELECT o_custkey % 25 AS seq, o_orderkey % 7 AS frame, count(*) AS n FROM orders WHERE (o_custkey % 25, o_orderkey % 7) NOT IN (SELECT n_nationkey, n_regionkey FROM nation) GROUP BY ALL")
def _(spark, d):
    """Predictions of frames that aren't cached yet."""
    p = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("seq"), (F.col("o_orderkey") % 7).alias("frame"))
    cached = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_regionkey").cast("bigint").alias("frame"))
    return scans.uncached(p, cached).groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-10_oracle_predictions", f"WITH {SCAN_SQL} SELECT frame, sem AS raw_id, 255 AS conf, count(*) AS n FROM pts GROUP BY ALL")
def _(spark, d):
    return scans.oracle_predictions(scan(spark, d)).groupBy("frame", "raw_id", "conf").agg(F.count(F.lit(1)).alias("n"))


@query("ST-10_memory_by_run", """WITH f AS (SELECT user_id AS seq, event_id AS frame, event_id % 3 = 0 AS moving FROM events), l AS (SELECT *, lag(frame) OVER (PARTITION BY seq ORDER BY frame) AS p FROM f),
r AS (SELECT seq, frame, moving, CAST(sum(CASE WHEN p IS NULL OR frame - p <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY frame) AS BIGINT) AS run FROM l), h AS (SELECT *, count(*) FILTER (moving) OVER (PARTITION BY seq, run ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM r) SELECT seq, frame, run, hits, hits >= 2 AS moves FROM h""")
def _(spark, d):
    """A jump of frames begins a run, and with it memory anew."""
    f = table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 3 == 0).alias("moving"))
    return tracking.moving_by_hits(motion.continuity(f), keys=("seq", "run")).select("seq", "frame", "run", "hits", "moves")


@query("ST-11_last_payload", f"{CELLS_SQL} SELECT 'a' AS seq, 1 AS frame, count(*) AS cells FROM cells WHERE frame = 1 UNION ALL SELECT 'b', 0, count(*) FROM cells WHERE frame = 0")
def _(spark, d):
    """Two sequences, one of which ends with the first frame: the document of the last frame of each."""
    p = scan(spark, d).drop("seq").withColumn("seq", F.explode(F.array(F.lit("a"), F.lit("b")))).filter("seq = 'a' OR frame = 0")
    own = ("seq", "frame")
    docs = wire.payloads(wire.packed(grid.cells_of(p, TINY, own), own), p.groupBy(*own).agg(F.count(F.lit(1)).alias("n_raw")), own)
    last = wire.last_payloads(wire.gunzipped(wire.gzipped(docs)))
    rings = F.from_json("payload", "rings array<struct<n_cells: bigint>>")["rings"]
    return last.select("seq", "frame", F.aggregate(rings, F.lit(0).cast("bigint"), lambda a, r: a + r["n_cells"]).alias("cells"))


# --- Sets, sums, densities ----------------------------------------------------------------------------------------------
@query("SET-02_distinct", f"WITH {SCAN_SQL} SELECT frame, count(DISTINCT sem) AS sem, count(DISTINCT raw >> 16) AS inst FROM pts GROUP BY frame")
def _(spark, d):
    return metrics.distinct_values(scan(spark, d).withColumn("inst", L.instance(F.col("raw"))), ("sem", "inst"))


@query("AGG-13_accounting", f"""WITH {SCAN_SQL}, {_dims()}, b AS (SELECT {BUCKET_SQL} AS bucket, a.learning_id AS gt, c.learning_id AS pred FROM pts JOIN dim a ON sem = a.raw_id JOIN dim c ON pred = c.raw_id)
SELECT CAST(GROUPING(bucket) AS INTEGER) AS overall, bucket, count(*) AS n, count(*) FILTER (bucket >= 0) AS n_within, count(*) FILTER (gt <> 0) AS n_evaluated, count(*) FILTER (gt = 0) AS n_ignored, count(*) FILTER (pred = 0) AS n_unknown,
round(count(*) FILTER (pred = 0) / CAST(count(*) AS DOUBLE), 6) AS unknown_rate FROM b GROUP BY GROUPING SETS ((), (bucket))""")  # fmt: skip
def _(spark, d):
    return metrics.accounting(_learnt(spark, d))


def _learnt(spark: SparkSession, d: str) -> DataFrame:
    """bucket, and true and predicted ids of the 19 classes and of the super-classes."""
    p = L.classified(_bucketed(scan(spark, d)).select("bucket", "pid", "raw", "pred")).select("bucket", "pred", F.col("learning_id").alias("gt"), F.col("super_cls").alias("gt_super"))
    return L.classified(p, "pred").select("bucket", "gt", "gt_super", F.col("learning_id").alias("pred"), F.col("super_cls").alias("pred_super"))


@query("AGG-12_13_scores_by_bucket", f"""WITH {SCAN_SQL}, {_dims()}, b AS (SELECT {BUCKET_SQL} AS bucket, a.super_cls AS gt, c.super_cls AS pred FROM pts JOIN dim a ON sem = a.raw_id JOIN dim c ON pred = c.raw_id), u AS (SELECT * FROM b WHERE gt <> 0),
k AS (SELECT bucket, gt AS cls FROM u UNION SELECT bucket, pred FROM u), i AS (SELECT k.bucket, k.cls, count(*) FILTER (gt = k.cls AND pred = k.cls) / CAST(count(*) FILTER (gt = k.cls OR pred = k.cls) AS DOUBLE) AS iou FROM k JOIN u ON u.bucket = k.bucket GROUP BY ALL)
SELECT u.bucket, count(*) AS n, round(count(*) FILTER (gt = pred) / CAST(count(*) AS DOUBLE), 6) AS accuracy, (SELECT round(avg(iou) FILTER (cls <> 0), 6) FROM i WHERE i.bucket = u.bucket) AS miou FROM u GROUP BY u.bucket""")  # fmt: skip
def _(spark, d):
    supers = metrics.checked_ids(_learnt(spark, d).select("bucket", F.col("gt_super").alias("gt"), F.col("pred_super").alias("pred")), 4, "gt", "pred")
    return metrics.scores_by(metrics.confusion(supers, keys=("bucket",)), ["bucket"])


@query("AGG-17_object_buckets", f"""WITH {SCAN_SQL}, i AS (SELECT frame, raw & 65535 AS sem, raw >> 16 AS inst, avg(x_mm) ** 2 + avg(y_mm) ** 2 AS r2 FROM pts WHERE raw >> 16 > 0 GROUP BY ALL),
b AS (SELECT CASE WHEN sem IN (10, 18, 20, 252) THEN 'vehicle' WHEN sem IN (30, 254) THEN 'person' END AS "group", CASE WHEN r2 < 4000000 THEN 0 WHEN r2 < 36000000 THEN 1 WHEN r2 <= 144000000 THEN 2 END AS bucket FROM i)
SELECT "group", bucket, count(*) AS n FROM b WHERE "group" IS NOT NULL AND bucket IS NOT NULL GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return metrics.object_buckets(scan(spark, d), {"vehicle": (10, 18, 20, 252), "person": (30, 254)}, (0, 2000, 6000, 12000))


@query("AGG-19_points_per_cell", f"""{ORACLE_SQL["AGG-18_19_density"].replace("SELECT bin, count(*) AS n, round(", ", q AS (SELECT bin, count(*) AS n, round(", 1)}), w AS (SELECT *, (bin + 0.5) * 2000 AS mid FROM q)
SELECT bin, n, per_m2, CASE WHEN mid <= 2000 THEN 0 WHEN mid <= 6000 THEN 1 WHEN mid <= 12000 THEN 2 END AS ring, round(coalesce(per_m2 / 2 * CASE WHEN mid <= 2000 THEN 0.0025 WHEN mid <= 6000 THEN 0.01 WHEN mid <= 12000 THEN 0.04 END, 0), 6) AS per_cell FROM w""")  # fmt: skip
def _(spark, d):
    r = F.sqrt((F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).cast("double")) / 1000
    return metrics.points_per_cell(metrics.density(scan(spark, d), r, 2.0, 20.0), TINY, 2.0, 2)


@query("AGG-27_reduction", f"""{CELLS_SQL}, m AS (SELECT frame, count(*) FILTER (ring = 0) * 9 AS sparse FROM cells GROUP BY frame), e AS (SELECT 'dense_3d' AS kind, 480 * 480 * 160 AS bytes FROM m UNION ALL SELECT 'sparse_3d', sparse FROM m UNION ALL SELECT 'uniform_2_5d', 480 * 480 * 12 FROM m UNION ALL SELECT 'foveated', 35200 * 12 FROM m)
SELECT kind, avg(bytes) AS mean, round(quantile_cont(CAST(bytes AS DOUBLE), 0.95), 6) AS p95, CAST(min(bytes) AS DOUBLE) AS least, CAST(max(bytes) AS DOUBLE) AS most, round(avg(bytes) / 422400, 1) AS ratio FROM e GROUP BY kind""")  # fmt: skip
def _(spark, d):
    return metrics.reduction(grid.memory_report(tiny_cells(spark, d), TINY))


# --- Networks' data -------------------------------------------------------------------------------------------------------
@query("SET-04_NN-12_18_mixed_scans", f"""WITH {SCAN_SQL}, a AS (SELECT pid, cls, raw >> 16 AS inst, y_mm FROM pts WHERE frame = 0), b AS (SELECT pid, cls, raw >> 16 AS inst, y_mm FROM pts WHERE frame = 1),
s AS (SELECT * FROM a WHERE y_mm >= 0 UNION ALL SELECT * FROM b WHERE y_mm < 0) SELECT cls, inst, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids FROM (SELECT * FROM s UNION ALL SELECT pid + (SELECT max(pid) + 1 FROM s), cls, inst, y_mm FROM b WHERE inst >= 1) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """The right-hand side of one scan in the other, then all instances of it."""
    p = scan(spark, d).select("frame", "pid", "cls", L.instance(F.col("raw")).alias("inst"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))
    a, b = p.filter("frame = 0"), p.filter("frame = 1")
    return networks.mixed_in(networks.sector_swapped(a, b, 0.0, 4.0), b).groupBy("cls", "inst").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"))


@query("NN-08_09_normals", f"""WITH {SCAN_SQL}, q AS (SELECT *, (x_mm + 14000) % 64 AS v, (y_mm + 14000) % 1024 AS u, abs(x_mm) + abs(y_mm) AS r FROM pts), i AS (SELECT frame, v, u, CAST(x_mm AS DOUBLE) AS x, CAST(y_mm AS DOUBLE) AS y, CAST(z_mm AS DOUBLE) AS z FROM q QUALIFY row_number() OVER (PARTITION BY frame, v, u ORDER BY r, pid DESC) = 1),
j AS (SELECT i.frame, i.v, i.u, a.x - i.x AS ax, a.y - i.y AS ay, a.z - i.z AS az, b.x - i.x AS bx, b.y - i.y AS b_y, b.z - i.z AS bz FROM i JOIN i a ON a.frame = i.frame AND a.v = i.v AND a.u = (i.u + 1) % 1024 JOIN i b ON b.frame = i.frame AND b.v = i.v + 1 AND b.u = i.u),
n AS (SELECT *, ay * bz - az * b_y AS nx, az * bx - ax * bz AS ny, ax * b_y - ay * bx AS nz FROM j) SELECT frame, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, round(nx / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 6) AS nx, round(nz / nullif(sqrt(nx * nx + ny * ny + nz * nz), 0), 6) AS nz FROM n""")  # fmt: skip
def _(spark, d):
    x, y, z = (F.col(f"{c}_mm") for c in "xyz")
    x, y, z = (F.col(f"{c}_mm") for c in "xyz")
    p = scan(spark, d).select("frame", "pid", ((x + 14000) % 64).cast("int").alias("v"), ((y + 14000) % 1024).cast("int").alias("u"), (F.abs(x) + F.abs(y)).alias("r"), *(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))))
    image = networks.nearest_image(p)
    return voxels.normals(image, width=1024).select("frame", "v", "u", F.round("nx", 6).alias("nx"), F.round("nz", 6).alias("nz"))


@query("NN-12_14_polar", f"WITH {SCAN_SQL}, c AS (SELECT *, x_mm - (min(x_mm) OVER (PARTITION BY frame) + max(x_mm) OVER (PARTITION BY frame)) / 2.0 AS x, y_mm - (min(y_mm) OVER (PARTITION BY frame) + max(y_mm) OVER (PARTITION BY frame)) / 2.0 AS y, z_mm - min(z_mm) OVER (PARTITION BY frame) AS z FROM pts) SELECT pid, round(sqrt(x * x + y * y), 5) AS rho, round(atan2(y, x), 6) AS phi, CAST(z AS DOUBLE) AS z FROM c")
def _(spark, d):
    p = scan(spark, d).withColumns({c: F.col(f"{c}_mm") for c in "xyz"})
    return networks.polar(networks.centred(p)).select("pid", F.round("rho", 5).alias("rho"), F.round("phi", 6).alias("phi"), "z")


@query("NN-05_voxels_by_size", f"""WITH {SCAN_SQL}, v AS (SELECT frame, s.s AS scale, CAST(floor(x_mm / CAST(700 * s.s AS DOUBLE)) AS BIGINT) AS i, CAST(floor(y_mm / CAST(700 * s.s AS DOUBLE)) AS BIGINT) AS j, CAST(floor(z_mm / CAST(700 * s.s AS DOUBLE)) AS BIGINT) AS k FROM pts, (VALUES (1), (2)) s(s)),
w AS (SELECT frame, scale, i - min(i) OVER (PARTITION BY frame, scale) AS i, j - min(j) OVER (PARTITION BY frame, scale) AS j, k - min(k) OVER (PARTITION BY frame, scale) AS k FROM v) SELECT frame, scale, i, j, k, count(*) AS n FROM w GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).select("frame", *(F.col(f"{c}_mm").alias(c) for c in "xyz"))
    return networks.voxelised_by_size(p, 700.0, (1, 2)).groupBy("frame", "scale", "i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


@query("NN-01_FLT-06_crop_and_classes", f"""WITH {SCAN_SQL}, l AS (SELECT pid, x_mm > -5000 AND x_mm < 5000 AND y_mm > -4000 AND y_mm < 6000 AND z_mm > -2500 AND z_mm < 2500 AS inside, list_transform(range(20), lambda i: CAST((pid * 7 + i * 13) % 23 AS DOUBLE) / 4) AS q FROM pts),
m AS (SELECT *, list_max(q) AS top FROM l), s AS (SELECT *, list_position(q, top) AS best, 1 / list_sum(list_transform(q, lambda x: exp(x - top))) AS share FROM m)
SELECT pid, CAST(CASE WHEN inside THEN {list(L.REPRESENTATIVES)}[best] ELSE 0 END AS BIGINT) AS raw_id, CASE WHEN inside THEN CAST(floor(share * 255 + 0.5) AS INTEGER) ELSE 0 END AS conf FROM s""")  # fmt: skip
def _(spark, d):
    p = networks.cropped(scan(spark, d).withColumns({c: F.col(f"{c}_mm") for c in "xyz"}), (-5000, -4000, -2500), (5000, 6000, 2500))
    logits = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((F.col("pid") * 7 + i * 13) % 23).cast("double") / 4)
    return networks.from_probabilities(p.withColumn("logits", logits)).select("pid", "raw_id", "conf")


@query("NN-12_sphere_crop", f"""WITH {SCAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pid, x_mm, y_mm, z_mm) - 1 AS k, count(*) OVER (PARTITION BY frame) AS n FROM pts), c AS (SELECT frame, x_mm AS cx, y_mm AS cy, z_mm AS cz FROM r WHERE k = n // 2)
SELECT r.frame, r.pid FROM r JOIN c ON c.frame = r.frame QUALIFY row_number() OVER (PARTITION BY r.frame ORDER BY (x_mm - cx) ** 2 + (y_mm - cy) ** 2 + (z_mm - cz) ** 2, pid) <= 700""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).select("frame", "pid", *(F.col(f"{c}_mm").alias(c) for c in "xyz"))
    return networks.sphere_crop(p, 700).select("frame", "pid")


@query("NN-12_pasted_copies", f"""WITH {SCAN_SQL} SELECT cls, count(*) AS n, CAST(round(sum(x), 3) AS DOUBLE) AS sx FROM (SELECT cls, CAST(x_mm AS DOUBLE) AS x FROM pts WHERE frame = 0 UNION ALL SELECT cls, x_mm * cos(t.t) - y_mm * sin(t.t) FROM pts, (VALUES (0.0::DOUBLE), (2.0::DOUBLE)) t(t) WHERE frame = 1 AND cls = 3) GROUP BY cls""")
def _(spark, d):
    p = scan(spark, d).select("frame", "pid", "cls", F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))
    out = networks.pasted_copies(p.filter("frame = 0"), p.filter("frame = 1"), "cls", (3,), (2.0,))
    return out.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"))


@query("NN-13_collated", f"WITH {SCAN_SQL} SELECT CAST(frame AS INTEGER) AS batch, cls, count(*) AS n FROM pts GROUP BY ALL")
def _(spark, d):
    p = scan(spark, d)
    return networks.collated([p.filter(f"frame = {k}") for k in (0, 1)]).groupBy("batch", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-17_split", f"WITH {SCAN_SQL}, {_dims()} SELECT learning_id AS label, raw >> 16 AS inst, count(*) AS n FROM pts JOIN dim ON sem = raw_id GROUP BY ALL")
def _(spark, d):
    return networks.split(scan(spark, d), "val").groupBy("label", "inst").agg(F.count(F.lit(1)).alias("n"))


# --- Display ----------------------------------------------------------------------------------------------------------------
@query("WIN-14_pixel_window", f"""{PIXEL_SQL}, img AS (SELECT v, u, min(r) AS r FROM px WHERE frame = 0 GROUP BY ALL), o AS (SELECT dv.dv, du.du FROM (VALUES (-1), (0), (1)) dv(dv), (VALUES (-1), (0), (1)) du(du))
SELECT p.pid, count(*) AS n, min(i.r) AS r FROM px p, o JOIN img i ON i.v = least(greatest(p.v + o.dv, 0), 63) AND i.u = (p.u + o.du + 1024) % 1024 WHERE p.frame = 1 GROUP BY p.pid""")  # fmt: skip
def _(spark, d):
    p = _pixels(spark, d)
    near = motion.around_pixels(motion.range_image(p.filter("frame = 0")).drop("frame"), ())
    met = p.filter("frame = 1").select("pid", "v", "u").join(near, ["v", "u"])
    return met.groupBy("pid").agg(F.sum(F.size("near")).alias("n"), F.min(F.array_min(F.transform("near", lambda x: x["r"]))).alias("r"))


def _byte(text: str) -> str:
    return f"CAST(trunc(least(greatest({text}, 0), 255)) AS INTEGER)"


@query("DSP-02_03_textures", f"""{CELLS_SQL}, t AS (SELECT *, least(greatest((CASE WHEN top_z <> -32768 THEN top_z ELSE ground_z END / CAST(1000 AS DOUBLE) + 2.5::DOUBLE) / 6, 0), 1) * 2 AS h, moving_frac / CAST(255 AS DOUBLE) AS m, conf / CAST(255 AS DOUBLE) AS c FROM cells)
SELECT frame, ring, [80, 120, 120][ring + 1] - 1 - ix AS row, [80, 120, 120][ring + 1] - 1 - iy AS col, [100, 46, 180, 231, 52][cls + 1] AS class_r, [140, 230, 220, 240, 255][cls + 1] AS class_a, [120, 230, 230, 240, 255][cls + 1] AS cross_a,
{_byte("CASE WHEN h < 1 THEN h * 30 ELSE 30 + (h - 1) * 225 END")} AS height_r, {_byte("CASE WHEN h < 1 THEN 120 + h * 60 ELSE 180 - (h - 1) * 150 END")} AS height_b, {_byte("(1 - abs(m - 0.5) * 2) * 200")} AS moving_g, {_byte("greatest(floor(m * 200 + 55), 80)")} AS moving_a, {_byte("c * 220")} AS conf_g FROM t""")  # fmt: skip
def _(spark, d):
    out = wire.textures(tiny_cells(spark, d), TINY)
    picked = {"class_r": "class.r", "class_a": "class.a", "cross_a": "traversability.a", "height_r": "height.r", "height_b": "height.b", "moving_g": "moving.g", "moving_a": "moving.a", "conf_g": "confidence.g"}
    return out.select("frame", "ring", "row", "col", *(F.col(v).alias(k) for k, v in picked.items()))


@query("DSP-04_viewer_colours", f"""{NEAR_SQL}, j AS (SELECT *, CASE WHEN top_z <> -32768 OR ground_z <> -32768 THEN least(greatest((CASE WHEN top_z <> -32768 THEN top_z ELSE ground_z END / CAST(1000 AS DOUBLE) + 2.5::DOUBLE) / 6.5::DOUBLE, 0), 1) END AS h FROM der)
SELECT frame, ring, ix, iy, CASE WHEN all_flags & 64 = 64 THEN 177 WHEN all_flags & 16 = 16 THEN 255 WHEN all_flags & 1 = 0 THEN 109 WHEN all_flags & 8 = 8 THEN 55 ELSE 231 END AS cross_r, round(0.2 + conf / CAST(255 AS DOUBLE) * 0.8, 6) AS conf_a,
CASE WHEN moving_frac / CAST(255 AS DOUBLE) > 0.1 THEN 238 ELSE 69 END AS moving_r, CASE WHEN h IS NOT NULL THEN CAST(floor(least(greatest(255 * (1.5 - abs(4 * h - 2)), 0), 255) + 0.5) AS INTEGER) END AS height_g FROM j""")  # fmt: skip
def _(spark, d):
    out = stencil.derived(tiny_cells(spark, d), TINY)
    c = {k: wire.viewer_colour(k) for k in ("traversability", "conf", "moving", "height")}
    return out.select("frame", "ring", "ix", "iy", c["traversability"]["r"].alias("cross_r"), F.round(c["conf"]["a"], 6).alias("conf_a"), c["moving"]["r"].alias("moving_r"), c["height"]["g"].alias("height_g"))


FULL_SQL = f"""{CELLS_SQL}, v AS (SELECT frame, ring, ix, iy, count(*) FILTER (sem IN {L.STATIC_VEHICLES + L.MOVING_VEHICLES} AND NOT moving) AS vs, count(*) FILTER (sem IN {L.STATIC_VEHICLES + L.MOVING_VEHICLES} AND moving) AS vm,
count(*) FILTER (sem NOT IN {L.STATIC_VEHICLES + L.MOVING_VEHICLES} AND cls IN (3, 4)) AS vo FROM loc GROUP BY ALL), g AS (SELECT c.frame, c.ring, CASE c.cls WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN CASE WHEN vs > vo THEN 2 ELSE 4 END ELSE CASE WHEN vm > vo THEN 3 ELSE 5 END END AS category FROM cells c JOIN v USING (frame, ring, ix, iy))"""


@query("SNK-06_07_full_payloads", f"""{FULL_SQL}, p AS (SELECT frame, count(*) AS n_raw FROM pts GROUP BY frame), o AS (SELECT frame, count(*) AS objects FROM (SELECT DISTINCT frame, raw >> 16 FROM pts WHERE raw >> 16 > 0) GROUP BY frame), rf AS (SELECT p.frame, n_raw, r.ring, r.side FROM p, (VALUES (0, 80), (1, 120), (2, 120), (3, 60)) r(ring, side))
SELECT rf.frame, n_raw, rf.ring, side, count(g.category) AS cells, CAST(coalesce(sum(g.category), 0) AS BIGINT) AS categories, any_value(o.objects) AS objects, CAST(35200 * 12 + 3600 * 12 AS BIGINT) AS foveated FROM rf LEFT JOIN g ON g.frame = rf.frame AND g.ring = rf.ring JOIN o ON o.frame = rf.frame GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """Documents with counters, memory, objects and display groups, packed and unpacked; a ring without points is there too."""
    preset = Preset("with_empty_ring", (*TINY.rings, Preset.of("x", (12000, 400)).rings[0]))
    p = scan(spark, d)
    loc = grid.locate(p, TINY)
    cells = grid.finalised(grid.accumulate(loc))
    at = ["frame", "ring", "ix", "iy"]
    groups = cells.join(wire.vehicle_counts(loc), at).select(*at, wire.category().alias("category"))
    things = p.select("frame", L.instance(F.col("raw")).alias("obj")).filter("obj > 0").distinct()
    counts = p.groupBy("frame").agg(F.count(F.lit(1)).alias("n_raw"))
    docs = wire.payloads(wire.packed(cells), counts, preset=preset, groups=groups, memory=grid.memory_report(cells, preset), objects=things)
    doc = F.from_json("payload", "counters struct<n_raw: bigint>, memory struct<foveated: bigint>, objects array<struct<obj: bigint>>, rings array<struct<ring_idx: int, side: int, n_cells: bigint, display_group: array<int>>>")
    out = wire.gunzipped(wire.gzipped(docs)).select("frame", doc.alias("d")).select("frame", "d.*", F.explode("d.rings").alias("r"))
    total = F.aggregate(F.coalesce("r.display_group", F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda a, g: a + g)
    return out.select("frame", F.col("counters.n_raw").alias("n_raw"), F.col("r.ring_idx").alias("ring"), F.col("r.side").alias("side"), F.col("r.n_cells").alias("cells"), total.alias("categories"), F.size("objects").cast("bigint").alias("objects"), F.col("memory.foveated").alias("foveated"))


# --- Earlier variants -----------------------------------------------------------------------------------------------------
_V0 = "CASE WHEN sem IN (40, 44, 60) THEN 0 WHEN sem IN (48, 49, 72) THEN 1 WHEN sem IN (10, 11, 13, 15, 16, 18, 20, 50, 51, 52, 70, 71, 80, 81, 99) THEN 2 WHEN sem IN (30, 31, 32) OR sem BETWEEN 252 AND 259 THEN 3 ELSE 255 END"
V0_SQL = f"""WITH {SCAN_SQL}, e0 AS (SELECT frame, pid, x_mm / CAST(1000 AS DOUBLE) AS x, y_mm / CAST(1000 AS DOUBLE) AS y, z_mm / CAST(1000 AS DOUBLE) AS z, {_V0} AS c, moving AS mv, sem IN (30, 31, 32) OR sem BETWEEN 253 AND 255 AS vru, conf / CAST(255 AS DOUBLE) AS cf FROM pts WHERE z_mm BETWEEN -3000 AND 5000),
e1 AS (SELECT *, CASE WHEN greatest(abs(x), abs(y)) < 2 THEN 0 WHEN greatest(abs(x), abs(y)) < 6 THEN 1 WHEN greatest(abs(x), abs(y)) < 12 THEN 2 END AS ring FROM e0), e2 AS (SELECT *, [2, 6, 12][ring + 1] AS o, [0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE][ring + 1] AS s, [80, 120, 120][ring + 1] AS side FROM e1 WHERE ring IS NOT NULL),
e3 AS (SELECT *, CAST(least(greatest(floor((x + o) / s + 1e-9), 0), side - 1) AS BIGINT) AS ix, CAST(least(greatest(floor((y + o) / s + 1e-9), 0), side - 1) AS BIGINT) AS iy, c = 3 OR mv OR vru AS dy FROM e2),
e4 AS (SELECT frame, ring, ix, iy, count(*) AS n, count(*) FILTER (dy) AS n3, count(*) FILTER (NOT dy AND c = 2) AS n2, count(*) FILTER (NOT dy AND c = 0) AS n0, count(*) FILTER (NOT dy AND c = 1) AS n1, avg(z) FILTER (c IN (0, 1)) AS gz, max(z) FILTER (c NOT IN (0, 1)) AS tz, sum(cf) AS cs, bool_or(mv) AS moving, bool_or(vru) AS vru FROM e3 GROUP BY ALL),
ec AS (SELECT frame, ring, ix, iy, least(n, 255) AS count, CASE WHEN n3 >= 2 THEN 3 WHEN n2 >= 2 THEN 2 WHEN n0 + n1 = 0 THEN 255 WHEN n0 >= n1 THEN 0 ELSE 1 END AS cls, gz, tz, CASE WHEN tz - gz > 0.30 THEN tz END AS oz, CAST(trunc(least(n3 / CAST(least(n, 255) AS DOUBLE) * 255, 255)) AS INTEGER) AS dyn_frac, cs / least(n, 255) * 255 AS cf, moving, vru FROM e4)"""


def _earlier(spark: SparkSession, d: str) -> DataFrame:
    sem = F.col("sem")
    vru = sem.isin(30, 31, 32) | sem.between(253, 255)
    p = scan(spark, d).select("frame", "pid", *((F.col(f"{c}_mm") / 1000.0).alias(c) for c in "xyz"), earlier.classes(sem).alias("cls"), "moving", vru.alias("vru"), (F.col("conf") / 255.0).alias("conf"))
    return earlier.cells(earlier.located(p, TINY))


@query("LG-01_02_03_04_05_cells", f"{V0_SQL} SELECT frame, ring, ix, iy, count, cls, round(gz, 6) AS ground_z, tz AS top_z, oz AS overhang_z, dyn_frac, moving, vru FROM ec")
def _(spark, d):
    return _earlier(spark, d).drop("conf").withColumn("ground_z", F.round("ground_z", 6))


@query("LG-06_ring_fill", f"{V0_SQL} SELECT frame, ring, count(*) AS active, [6400, 14400, 14400][ring + 1] AS allocated, round(count(*) / CAST([6400, 14400, 14400][ring + 1] AS DOUBLE), 6) AS fill FROM ec GROUP BY frame, ring")
def _(spark, d):
    return earlier.ring_fill(_earlier(spark, d), TINY)


@query("LG-14_derived", f"""{V0_SQL}, g AS (SELECT *, [0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE][ring + 1] AS s FROM ec), st AS (SELECT a.frame, a.ring, a.ix, a.iy, max(coalesce(abs(a.gz - b.gz), 0)) AS step FROM g a LEFT JOIN g b ON a.frame = b.frame AND a.ring = b.ring AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 WHERE a.gz IS NOT NULL GROUP BY ALL),
sl AS (SELECT a.*, coalesce((r.gz - l.gz) / (2 * a.s), (r.gz - a.gz) / a.s, (a.gz - l.gz) / a.s, 0) AS gx, coalesce((u.gz - o.gz) / (2 * a.s), (u.gz - a.gz) / a.s, (a.gz - o.gz) / a.s, 0) AS gy FROM g a
  LEFT JOIN g r ON r.frame = a.frame AND r.ring = a.ring AND r.ix = a.ix + 1 AND r.iy = a.iy LEFT JOIN g l ON l.frame = a.frame AND l.ring = a.ring AND l.ix = a.ix - 1 AND l.iy = a.iy LEFT JOIN g u ON u.frame = a.frame AND u.ring = a.ring AND u.ix = a.ix AND u.iy = a.iy + 1 LEFT JOIN g o ON o.frame = a.frame AND o.ring = a.ring AND o.ix = a.ix AND o.iy = a.iy - 1),
dv AS (SELECT sl.frame, sl.ring, sl.ix, sl.iy, cls, CASE WHEN gz IS NOT NULL THEN degrees(atan(sqrt(gx * gx + gy * gy))) END AS slope, step, CASE WHEN gz IS NOT NULL THEN coalesce(oz - gz, 10) END AS clr FROM sl LEFT JOIN st USING (frame, ring, ix, iy))
SELECT frame, ring, ix, iy, round(slope, 4) AS slope_deg, round(step, 6) AS step_m, round(clr, 6) AS clearance_m, coalesce(cls = 0 AND slope <= 15 AND step <= 0.10 AND clr >= 2, false) AS traversable FROM dv""")  # fmt: skip
def _(spark, d):
    out = earlier.derived(_earlier(spark, d), TINY)
    return out.select("frame", "ring", "ix", "iy", F.round("slope_deg", 4).alias("slope_deg"), F.round("step_m", 6).alias("step_m"), F.round("clearance_m", 6).alias("clearance_m"), "traversable")


@query("LG-15_injected_hazards", f"""WITH {SCAN_SQL}, e AS (SELECT frame, z_mm, {_V0} = 0 OR z_mm < -1000 AS g, (x_mm - 7000) * (x_mm - 7000) + y_mm * y_mm <= 1000000 AS h, x_mm BETWEEN 5000 AND 15000 AND y_mm BETWEEN 1800 AND 2500 AS k FROM pts)
SELECT frame, count(*) FILTER (g AND h) AS pothole, count(*) FILTER (g AND k AND NOT h) AS kerb, CAST(floor(median(z_mm) FILTER (g)) AS BIGINT) AS reference, 150 AS overhang, CAST(sum(z_mm - CASE WHEN g AND h THEN 150 ELSE 0 END + CASE WHEN g AND k AND NOT h THEN 200 ELSE 0 END) + 150 * (floor(median(z_mm) FILTER (g)) + 1500) AS BIGINT) AS sz FROM e GROUP BY frame""")  # fmt: skip
def _(spark, d):
    changed, report = earlier.injected(scan(spark, d).withColumn("cls", earlier.classes(F.col("sem"))))
    return report.join(changed.groupBy("frame").agg(F.sum("z_mm").alias("sz")), "frame")


@query("LG-16_scores_by_range", f"""WITH {SCAN_SQL}, p AS (SELECT {_V0} AS gt, {_V0.replace("sem", "pred")} AS pr, greatest(abs(x_mm), abs(y_mm)) AS r FROM pts), b AS (SELECT 0 AS overall, CASE WHEN r < 4000 THEN 0 WHEN r < 9000 THEN 1 WHEN r < 13000 THEN 2 END AS bucket, gt, pr FROM p WHERE r < 13000 UNION ALL SELECT 1, NULL, gt, pr FROM p),
u AS (SELECT * FROM b WHERE gt <> 255), k AS (SELECT overall, bucket, gt AS cls FROM u UNION SELECT overall, bucket, pr FROM u WHERE pr <> 255), i AS (SELECT k.overall, k.bucket, k.cls, count(*) FILTER (gt = k.cls AND pr = k.cls) / CAST(count(*) FILTER (gt = k.cls OR pr = k.cls) AS DOUBLE) AS iou FROM k JOIN u ON u.overall = k.overall AND u.bucket IS NOT DISTINCT FROM k.bucket GROUP BY ALL)
SELECT b.overall, b.bucket, count(*) AS n, count(*) FILTER (gt <> 255) AS n_eval, count(*) FILTER (gt <> 255 AND gt = pr) AS n_correct, round(count(*) FILTER (gt <> 255 AND gt = pr) / CAST(count(*) FILTER (gt <> 255) AS DOUBLE), 6) AS accuracy, (SELECT round(avg(iou), 6) FROM i WHERE i.overall = b.overall AND i.bucket IS NOT DISTINCT FROM b.bucket) AS miou FROM b GROUP BY b.overall, b.bucket""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).select(F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), earlier.classes(F.col("sem")).alias("gt"), earlier.classes(F.col("pred")).alias("pred"))
    return earlier.scores_by_range(p, (0, 4000, 9000, 13000))


@query("LG-10_18_labels", f"WITH {SCAN_SQL} SELECT sem, {_V0} AS cls, CASE sem WHEN 10 THEN 0 WHEN 40 THEN 11 WHEN 48 THEN 13 WHEN 70 THEN 2 WHEN 252 THEN 0 WHEN 99 THEN 255 END AS number, sem <> 40 AND sem <> 48 AND sem <> 70 AND sem <> 99 AS movable, count(*) AS n FROM pts WHERE sem IN (10, 40, 48, 70, 252, 99) GROUP BY ALL")
def _(spark, d):
    p = scan(spark, d).filter(F.col("sem").isin(10, 40, 48, 70, 252, 99))
    return p.groupBy("sem", earlier.classes(F.col("sem")).alias("cls"), earlier.numbers(F.col("sem")).alias("number"), earlier.movable(F.col("sem"), "raw").alias("movable")).agg(F.count(F.lit(1)).alias("n"))


@query("LG-12_voted_boxes", f"""{ORACLE_SQL["CL-02_LG-11_dbscan"].rsplit(" SELECT p.frame, p.pid, coalesce", 1)[0]}, dbs AS (SELECT p.frame, p.pid, p.x, coalesce(l.part, b.part, -1) AS part FROM p LEFT JOIN l ON l.frame = p.frame AND l.pid = p.pid LEFT JOIN b ON b.frame = p.frame AND b.pid = p.pid),
q AS (SELECT frame, part, count(*) AS n, min(x) AS lo, max(x) AS hi FROM dbs WHERE part >= 0 GROUP BY ALL HAVING avg(CASE WHEN pid % 3 = 0 THEN 1 ELSE 0 END) >= 0.3),
cc AS (SELECT frame, part, pid % 5 AS label, count(*) AS k FROM dbs GROUP BY ALL), cb AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY frame, part ORDER BY k DESC, label) = 1)
SELECT q.frame, q.part, cb.label AS cls, round(cb.k / CAST(q.n AS DOUBLE), 6) AS agreement, q.n, round((q.lo + q.hi) / 2, 6) AS cx, round(q.hi - q.lo, 6) AS dx FROM q JOIN cb ON cb.frame = q.frame AND cb.part = q.part""")  # fmt: skip
def _(spark, d):
    p = _xyz(spark, d).withColumns({"label": F.col("pid") % 5, "movable": F.lit(True), "candidate": F.col("pid") % 3 == 0})
    out = earlier.voted_boxes(p, eps=9.0, least=4)
    return out.select("frame", "part", "cls", "agreement", "n", F.round("cx", 6).alias("cx"), F.round("dx", 6).alias("dx"))
