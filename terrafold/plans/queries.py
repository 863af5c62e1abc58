"""Queries of the engine over the driver's tables, by operator number, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, PRESETS, Preset
from terrafold.functions import labels as L
from terrafold.functions.integers import quantised
from terrafold.functions.ranges import bucket, bucket_label
from terrafold.operators import clusters, grid, hazards, metrics, motion, stencil, tracking, voxels, wire
from terrafold.pipeline import layers
from terrafold.plans.pseudo import SCAN_SQL, scan, table
from terrafold.sources import scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TINY = PRESETS["tiny_test"]
COARSE = Preset.of("tiny_uniform", (12000, 200))


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- SQL shared by the checks ---------------------------------------------------------------------------------------
FDIV = "CAST(floor(({0}) / CAST({1} AS DOUBLE)) AS BIGINT)"


def _located(name: str, preset: Preset, source: str = "pts") -> str:
    ring = " ".join(f"WHEN m < {r.r} THEN {k}" for k, r in enumerate(preset.rings))
    size = f"[{', '.join(str(r.cell) for r in preset.rings)}][ring + 1]"
    offset = f"[{', '.join(str(r.offset) for r in preset.rings)}][ring + 1]"
    return f"""{name} AS (SELECT *, {FDIV.format("x_mm", size)} + {offset} AS ix, {FDIV.format("y_mm", size)} + {offset} AS iy, {size} AS cell, {offset} AS off FROM (
  SELECT *, CASE {ring} END AS ring FROM (SELECT *, greatest(x_mm, -x_mm - 1, y_mm, -y_mm - 1) AS m FROM {source})) WHERE ring IS NOT NULL)"""


def _accumulated(name: str, source: str) -> str:
    classes = ", ".join(f"count(*) FILTER (cls = {k}) AS n{k}" for k in range(5))
    return f"""{name} AS (SELECT frame, ring, ix, iy, count(*) AS n, {classes}, count(*) FILTER (moving) AS n_moving,
  CAST(sum(z_mm) FILTER (cls IN (1, 2)) AS BIGINT) AS g_sum, min(z_mm) FILTER (cls IN (1, 2)) AS g_min, max(z_mm) FILTER (cls IN (1, 2)) AS g_max,
  min(z_mm) FILTER (cls IN (3, 4)) AS o_min, max(z_mm) FILTER (cls IN (3, 4)) AS o_max, CAST(sum(conf) AS BIGINT) AS conf_sum
  FROM {source} GROUP BY frame, ring, ix, iy)"""


SAFETY = "CASE WHEN n4 >= 2 AND n4 * 5 >= n THEN 4 WHEN n3 >= 2 AND n3 * 5 >= n THEN 3 WHEN n2 >= n0 AND n2 >= n1 THEN 2 WHEN n0 >= n1 THEN 0 ELSE 1 END"
MAJORITY = "CASE WHEN n4 = greatest(n0, n1, n2, n3, n4) THEN 4 WHEN n3 = greatest(n0, n1, n2, n3, n4) THEN 3 WHEN n2 = greatest(n0, n1, n2, n3, n4) THEN 2 WHEN n0 = greatest(n0, n1, n2, n3, n4) THEN 0 ELSE 1 END"


def _half_up(num: str, den: str) -> str:
    return f"CAST(floor((({num}) + floor(({den}) / 2.0)) / CAST({den} AS DOUBLE)) AS BIGINT)"


def _finalised(name: str, source: str, cls: str = SAFETY) -> str:
    gz = _half_up("g_sum", "greatest(n1 + n2, 1)")
    return f"""{name}_0 AS (SELECT *, {cls} AS cls, CASE WHEN n1 + n2 > 0 THEN {gz} END AS gz, n1 + n2 > 0 AS hg, n3 + n4 > 0 AS ho FROM {source}),
{name} AS (SELECT frame, ring, ix, iy, cls, coalesce(gz, -32768) AS ground_z, CASE WHEN ho THEN o_max ELSE -32768 END AS top_z,
  CASE WHEN hg AND ho AND o_min - gz >= 300 THEN least(o_min - gz, 32767) WHEN hg THEN 0 ELSE -32768 END AS clearance,
  {_half_up("n_moving * 255", "n")} AS moving_frac, {_half_up("conf_sum", "n")} AS conf, least(n, 65535) AS count,
  CAST(CASE WHEN hg THEN 1 ELSE 0 END + CASE WHEN ho THEN 2 ELSE 0 END + CASE WHEN hg AND ho AND o_min - gz >= 300 THEN 4 ELSE 0 END AS BIGINT) AS flags FROM {name}_0)"""


CELLS_SQL = f"WITH {SCAN_SQL}, {_located('loc', TINY)}, {_accumulated('acc', 'loc')}, {_finalised('cells', 'acc')}"


def near_sql(cells: str, sizes: str = "[50, 100, 200][ring + 1]", key: str = "frame") -> str:
    """The CTEs from a table of cells to der: step_mm, slope, kerb, hole, steep, low and all_flags."""
    return f"""nb AS (SELECT c.*, {", ".join(f"CASE WHEN {s}.flags & 1 = 1 THEN {s}.ground_z END AS gz_{s}, {s}.count AS n_{s}" for s in "lrdu")} FROM {cells} c
  {" ".join(f"LEFT JOIN {cells} {s} ON {s}.{key} = c.{key} AND {s}.ring = c.ring AND {s}.ix = c.ix + ({dx}) AND {s}.iy = c.iy + ({dy})" for s, (dx, dy) in {"l": (-1, 0), "r": (1, 0), "d": (0, -1), "u": (0, 1)}.items())}),
st AS (SELECT *, CASE WHEN flags & 1 = 1 THEN coalesce(greatest({", ".join(f"CASE WHEN n_{s} >= 2 THEN abs(ground_z - gz_{s}) END" for s in "lrdu")}), 0) ELSE 0 END AS step_mm,
  {" + ".join(f"CASE WHEN gz_{s} IS NULL THEN 0 ELSE 1 END" for s in "lrdu")} AS nn, {" + ".join(f"coalesce(gz_{s}, 0)" for s in "lrdu")} AS ns, {sizes} AS cell FROM nb),
sl AS (SELECT *, CASE WHEN flags & 1 = 1 THEN degrees(atan(sqrt(gx * gx + gy * gy))) END AS slope FROM (SELECT *,
  {", ".join(f"CASE WHEN gz_{a} IS NOT NULL AND gz_{b} IS NOT NULL THEN (gz_{b} - gz_{a}) / (2.0 * cell) WHEN gz_{b} IS NOT NULL THEN (gz_{b} - ground_z) / CAST(cell AS DOUBLE) WHEN gz_{a} IS NOT NULL THEN (ground_z - gz_{a}) / CAST(cell AS DOUBLE) ELSE 0 END AS g{g}" for g, a, b in (("x", "l", "r"), ("y", "d", "u")))} FROM st)),
fl AS (SELECT *, flags & 1 = 1 AND step_mm BETWEEN 60 AND 250 AS kerb, flags & 1 = 1 AND cls = 1 AND nn > 0 AND floor(ns / CAST(greatest(nn, 1) AS DOUBLE)) - ground_z >= 80 AS hole,
  flags & 1 = 1 AND coalesce(slope > 15, false) AS steep, flags & 4 = 4 AND clearance > 0 AND clearance < 2200 AS low FROM sl),
der AS (SELECT *, CAST(flags | CASE WHEN kerb THEN 16 ELSE 0 END | CASE WHEN hole THEN 128 ELSE 0 END | CASE WHEN steep THEN 32 ELSE 0 END | CASE WHEN low THEN 64 ELSE 0 END
  | CASE WHEN cls = 1 AND flags & 1 = 1 AND flags & 2 = 0 AND NOT steep AND NOT kerb AND NOT low THEN 8 ELSE 0 END AS BIGINT) AS all_flags FROM fl)"""


NEAR_SQL = f"{CELLS_SQL}, {near_sql('cells')}"


def _dims() -> str:
    return "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, '{b}', {c}, {d}, {e}, {f})" for a, b, c, d, e, f in L.LABELS) + ") t(raw_id, name, learning_id, super_cls, is_moving, critical))"


def tiny_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells_of(scan(spark, sf_dir), TINY)


# --- Points, addressing, accumulation ---------------------------------------------------------------------------------
@query("PRJ-01_quantise", "SELECT o_orderkey AS id, CAST(round_even(o_totalprice / 7.0 * 1000, 0) AS BIGINT) AS mm FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), quantised(F.col("o_totalprice") / 7.0).alias("mm"))


@query("PRJ-03_label_split", f"WITH {SCAN_SQL} SELECT raw & 65535 AS sem, raw >> 16 AS inst, count(*) AS n FROM pts GROUP BY ALL")
def _(spark, d):
    return scan(spark, d).groupBy(L.semantic(F.col("raw")).alias("sem"), L.instance(F.col("raw")).alias("inst")).agg(F.count(F.lit(1)).alias("n"))


@query("PRJ-05_06_AGG-15_buckets", f"""WITH {SCAN_SQL}, r AS (SELECT sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) / 1000 AS r FROM pts),
b AS (SELECT CASE WHEN r < 2 THEN 0 WHEN r < 6 THEN 1 WHEN r < 12 THEN 2 WHEN r <= 20 THEN 3 ELSE -1 END AS bucket FROM r)
SELECT bucket, CASE bucket WHEN 0 THEN '0-2 m' WHEN 1 THEN '2-6 m' WHEN 2 THEN '6-12 m' WHEN 3 THEN '12-20 m' END AS label, count(*) AS n FROM b GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    edges = (0, 2, 6, 12, 20)
    r = F.sqrt((F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).cast("double")) / 1000
    out = scan(spark, d).select(bucket(r, edges).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("label", bucket_label(F.col("bucket"), edges))


@query("FLT-01_02_filters", f"WITH {SCAN_SQL} SELECT frame, count(*) AS n FROM pts WHERE CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE) >= 1000000 GROUP BY frame")
def _(spark, d):
    p = scan(spark, d).withColumns({c: F.col(f"{c}_mm") / 1000.0 for c in "xyz"})
    return grid.quantise(p).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query("FLT-05_world_box", f"WITH {SCAN_SQL} SELECT pid, frame, x_mm, y_mm FROM pts WHERE x_mm BETWEEN -1500 AND 2500 AND y_mm BETWEEN 100 AND 900")
def _(spark, d):
    return grid.in_box(scan(spark, d), (-1500, 2500, 100, 900)).select("pid", "frame", "x_mm", "y_mm")


@query("JN-01_02_04_labels", f"""WITH {SCAN_SQL}, {_dims()} SELECT coalesce(super_cls, 0) AS super_cls, coalesce(learning_id, 0) AS learning_id, coalesce(is_moving, false) AS is_moving,
coalesce(critical, false) AS critical, raw_id IS NOT NULL AS known, count(*) AS n FROM (SELECT CASE WHEN pid % 11 = 0 THEN 7 ELSE raw END AS raw FROM pts) LEFT JOIN dim ON raw & 65535 = raw_id GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).withColumn("raw", F.when(F.col("pid") % 11 == 0, 7).otherwise(F.col("raw")))
    return L.classified(p).groupBy("super_cls", "learning_id", "is_moving", "critical", "known").agg(F.count(F.lit(1)).alias("n"))


@query("JN-03_05_names", f"""WITH {SCAN_SQL}, {_dims()}, rep AS (SELECT unnest({list(L.REPRESENTATIVES)}) AS rep, unnest(range(20)) AS k)
SELECT sem, name, CAST(rep.rep AS BIGINT) AS representative, count(*) AS n FROM pts JOIN dim ON sem = raw_id JOIN rep ON k = learning_id GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = L.classified(scan(spark, d)).groupBy("sem", "name", "learning_id").agg(F.count(F.lit(1)).alias("n"))
    return p.select("sem", "name", L.representative(F.col("learning_id")).alias("representative"), "n")


@query("JN-07_ADR-01_02_addresses", f"""WITH {SCAN_SQL}, {_located("loc", TINY)} SELECT pid, ring, ix, iy, [0, 6400, 20800][ring + 1] + iy * [80, 120, 120][ring + 1] + ix AS key FROM loc""")
def _(spark, d):
    return grid.locate(scan(spark, d), TINY).select("pid", "ring", "ix", "iy", grid.global_key(TINY).alias("key"))


@query("ADR-03_04_05_cells", f"""WITH {SCAN_SQL}, {_located("loc", TINY)}, u AS (SELECT DISTINCT ring, ix, iy, cell, off FROM loc)
SELECT ring, ix, iy, (ix - off) * cell AS x0_mm, (iy - off) * cell AS y0_mm, (ix - off) * cell + cell // 2 AS xc_mm, (iy - off) * cell + cell // 2 AS yc_mm,
NOT (ring > 0 AND abs((ix - off) * cell * 2 + cell) < [0, 4000, 12000][ring + 1] AND abs((iy - off) * cell * 2 + cell) < [0, 4000, 12000][ring + 1]) AS logical FROM u""")  # fmt: skip
def _(spark, d):
    u = grid.locate(scan(spark, d), TINY).select("ring", "ix", "iy").distinct()
    return grid.corners(u, TINY).withColumn("logical", grid.is_logical(TINY))


@query("ADR-06_ring_sizes", """SELECT preset, ring, allocated, allocated - hole * hole AS logical FROM (VALUES ('fovea_default', 0, 160000, 0), ('fovea_default', 1, 360000, 200), ('fovea_default', 2, 360000, 300), ('fovea_default', 3, 250000, 300),
('ps_literal', 0, 160000, 0), ('ps_literal', 1, 160000, 40)) t(preset, ring, allocated, hole)""")  # fmt: skip
def _(spark, d):
    rows = [(n, k, p.allocated_cells(k), p.logical_cells(k)) for n in ("fovea_default", "ps_literal") for p in [PRESETS[n]] for k in range(len(p.rings))]
    return spark.createDataFrame(rows, "preset string, ring int, allocated int, logical int")


@query("AGG-01_rasterize", f"WITH {SCAN_SQL}, {_located('loc', TINY)}, {_accumulated('acc', 'loc')} SELECT * FROM acc")
def _(spark, d):
    return grid.accumulate(grid.locate(scan(spark, d), TINY))


@query("AGG-01_FIN_safety", f"{CELLS_SQL} SELECT * FROM cells")
def flagship(spark, d):
    """Cells of all frames: one scan, one exchange."""
    return tiny_cells(spark, d)


@query("AGG-01_FIN_majority", f"WITH {SCAN_SQL}, {_located('loc', TINY)}, {_accumulated('acc', 'loc')}, {_finalised('cells', 'acc', MAJORITY)} SELECT * FROM cells")
def _(spark, d):
    return grid.cells_of(scan(spark, d), TINY, rule="majority")


COARSE_SQL = f"WITH {SCAN_SQL}, {_located('loc', Preset.of('c', (12000, 400)))}, {_accumulated('acc', 'loc')} SELECT * FROM acc"


@query("AGG-05_06_reduce_block", COARSE_SQL)
def _(spark, d):
    return grid.coarsened(grid.accumulate(grid.locate(scan(spark, d), Preset.of("f", (12000, 100)))), 4)


RAISED_SQL = f"""WITH {SCAN_SQL}, m AS (SELECT frame, pid, cls, moving, conf, CAST(x_mm AS BIGINT) AS x0, CAST(y_mm AS BIGINT) AS y0, CAST(z_mm * 20 AS BIGINT) AS z0, pid % 50 = 0 AS broken FROM pts),
q AS (SELECT *, NOT broken AND x0 * x0 + y0 * y0 >= 1000000 AS ok, greatest(x0, -x0 - 1, y0, -y0 - 1) AS m FROM m)"""


def _raised(spark: SparkSession, d: str) -> DataFrame:
    """Points in metres, heights twentyfold so that some saturate; every fiftieth isn't finite."""
    z = F.when(F.col("pid") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("z_mm") * 20 / 1000.0)
    return scan(spark, d).select("frame", "pid", "cls", "moving", "conf", (F.col("x_mm") / 1000.0).alias("x"), (F.col("y_mm") / 1000.0).alias("y"), z.alias("z"))


@query("PRJ-02_FLT-01_02_measured", f"{RAISED_SQL} SELECT pid, ok, CASE WHEN ok THEN x0 END AS x_mm, CASE WHEN ok THEN least(greatest(z0, -32767), 32767) END AS z_mm, ok AND abs(z0) > 32767 AS z_saturated FROM q")
def _(spark, d):
    return grid.measured(_raised(spark, d)).select("pid", "ok", "x_mm", "z_mm", "z_saturated")


@query("AGG-07_counters", f"""{RAISED_SQL} SELECT frame, count(*) AS n_raw, count(*) FILTER (NOT ok) AS n_invalid, count(*) FILTER (ok AND m < 12000) AS n_in_grid, count(*) FILTER (ok AND m >= 12000) AS n_out_of_grid,
count(*) FILTER (ok AND abs(z0) > 32767) AS n_z_saturated FROM q GROUP BY frame""")  # fmt: skip
def _(spark, d):
    """With an error if points got lost between counters and cells, or a cell's count would overflow."""
    p = grid.measured(_raised(spark, d))
    held = grid.guarded(grid.accumulate(grid.locate(p.filter("ok"), TINY)))
    return grid.conserved(grid.counters(p, TINY), held)


@query("AGG-09_dense", f"""WITH {SCAN_SQL}, {_located("loc", Preset.of("u", (12000, 400)))}, {_accumulated("acc", "loc")}, {_finalised("cells", "acc")},
g AS (SELECT f.frame, x.x AS ix, y.y AS iy FROM (VALUES (0), (1)) f(frame), range(60) x(x), range(60) y(y))
SELECT g.frame, 0 AS ring, g.ix, g.iy, coalesce(cls, 0) AS cls, coalesce(ground_z, -32768) AS ground_z, coalesce(top_z, -32768) AS top_z, coalesce(clearance, -32768) AS clearance, coalesce(moving_frac, 0) AS moving_frac,
coalesce(conf, 0) AS conf, coalesce(count, 0) AS count, coalesce(flags, 0) AS flags FROM g LEFT JOIN cells c ON c.frame = g.frame AND c.ix = g.ix AND c.iy = g.iy""")  # fmt: skip
def _(spark, d):
    p = Preset.of("u", (12000, 400))
    return grid.dense(grid.cells_of(scan(spark, d), p), spark.range(2).select(F.col("id").cast("int").alias("frame")), p)


@query("AGG-28_memory", f"{CELLS_SQL} SELECT frame, CAST(480 * 480 * 160 AS BIGINT) AS dense_3d, count(*) FILTER (ring = 0 AND count > 0) * 9 AS sparse_3d, CAST(480 * 480 * 12 AS BIGINT) AS uniform_2_5d, CAST((6400 + 14400 + 14400) * 12 AS BIGINT) AS foveated FROM cells GROUP BY frame")
def _(spark, d):
    return grid.memory_report(tiny_cells(spark, d), TINY)


@query("AGG-33_class_histogram", f"WITH {SCAN_SQL} SELECT sem, count(*) AS n, round(count(*) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS percent FROM pts GROUP BY sem")
def _(spark, d):
    return metrics.class_histogram(scan(spark, d), "sem")


# --- Neighbours and derived layers -------------------------------------------------------------------------------------
@query("WIN-04_07_09_steps", f"{NEAR_SQL} SELECT frame, ring, ix, iy, step_mm, kerb, hole FROM fl")
def _(spark, d):
    out = stencil.derived(tiny_cells(spark, d), TINY)
    return out.select("frame", "ring", "ix", "iy", "step_mm", stencil.has(16).alias("kerb"), stencil.has(128).alias("hole"))


@query("WIN-05_06_slope", f"{NEAR_SQL} SELECT frame, ring, ix, iy, round(slope, 6) AS slope_deg, steep FROM fl")
def _(spark, d):
    return stencil.derived(tiny_cells(spark, d), TINY).select("frame", "ring", "ix", "iy", F.round("slope_deg", 6).alias("slope_deg"), stencil.has(32).alias("steep"))


@query("WIN-10_11_13_flags", f"{NEAR_SQL} SELECT frame, ring, ix, iy, all_flags AS flags FROM der")
def _(spark, d):
    return stencil.derived(tiny_cells(spark, d), TINY).select("frame", "ring", "ix", "iy", "flags")


@query("WIN-12_three_state", f"{NEAR_SQL}, s AS (SELECT frame, ring, CASE WHEN all_flags & 8 = 8 THEN 1 WHEN all_flags & 1 = 0 OR cls = 0 THEN 0 ELSE 2 END AS state FROM der) SELECT frame, ring, state, count(*) AS n FROM s GROUP BY ALL")
def _(spark, d):
    out = stencil.derived(tiny_cells(spark, d), TINY).withColumn("state", stencil.three_state())
    return out.groupBy("frame", "ring", "state").agg(F.count(F.lit(1)).alias("n"))


@query("WIN-02_block_reduce", f"""{CELLS_SQL}, f AS (SELECT *, {FDIV.format("ix", 2)} AS bx, {FDIV.format("iy", 2)} AS b_y, (iy % 2) * 2 + ix % 2 = 2 AS mid FROM cells WHERE ring = 0)
SELECT frame, bx AS ix, b_y AS iy, coalesce(max(cls) FILTER (mid), 0) AS cls, CASE WHEN count(*) FILTER (flags & 1 = 1) > 0 THEN {_half_up("sum(ground_z) FILTER (flags & 1 = 1)", "greatest(count(*) FILTER (flags & 1 = 1), 1)")} ELSE -32768 END AS ground_z,
coalesce(max(top_z) FILTER (top_z <> -32768), -32768) AS top_z, CAST(least(sum(count), 65535) AS BIGINT) AS count FROM f GROUP BY frame, bx, b_y""")  # fmt: skip
def _(spark, d):
    return stencil.block_reduced(tiny_cells(spark, d).filter("ring = 0"), 2).select("frame", "ix", "iy", "cls", "ground_z", "top_z", "count")


def _filled(name: str, source: str, shift: int) -> str:
    ground = "count(*) FILTER (flags & 1 = 1)"
    return f"""{name} AS (SELECT frame, {FDIV.format("ix", 2)} + {shift} AS ix, {FDIV.format("iy", 2)} + {shift} AS iy, coalesce(max(cls) FILTER ((iy % 2) * 2 + ix % 2 = 2), 0) AS cls,
  {_half_up("sum(ground_z) FILTER (flags & 1 = 1)", f"greatest({ground}, 1)")} AS ground_z, coalesce(max(top_z) FILTER (top_z <> -32768), -32768) AS top_z, CAST(least(sum(count), 65535) AS BIGINT) AS count,
  CAST(1 + CASE WHEN count(*) FILTER (top_z <> -32768) > 0 THEN 2 ELSE 0 END AS BIGINT) AS flags FROM {source} GROUP BY 1, 2, 3 HAVING {ground} > 0)"""


HALO_SQL = f"""{CELLS_SQL}, c0 AS (SELECT * FROM cells WHERE ring = 0), {_filled("f1", "c0", 40)},
c1 AS (SELECT frame, ix, iy, cls, ground_z, top_z, count, flags, clearance FROM cells WHERE ring = 1 UNION ALL SELECT frame, ix, iy, cls, ground_z, top_z, count, flags, -32768 FROM f1), {_filled("f2", "c1", 30)},
haloed AS (SELECT frame, 0 AS ring, ix, iy, cls, ground_z, top_z, count, flags, clearance FROM c0 UNION ALL SELECT frame, 1, ix, iy, cls, ground_z, top_z, count, flags, clearance FROM c1
UNION ALL SELECT frame, 2, ix, iy, cls, ground_z, top_z, count, flags, clearance FROM cells WHERE ring = 2 UNION ALL SELECT frame, 2, ix, iy, cls, ground_z, top_z, count, flags, -32768 FROM f2)"""  # fmt: skip


@query("WIN-01_halo", f"{HALO_SQL} SELECT frame, ring, ix, iy, cls, ground_z, count, flags FROM haloed")
def _(spark, d):
    return stencil.haloed(tiny_cells(spark, d), TINY).select("frame", "ring", "ix", "iy", "cls", "ground_z", "count", "flags")


@query("WIN-13_stages", f"{HALO_SQL}, {near_sql('haloed')} SELECT frame, ring, ix, iy, step_mm, round(slope, 6) AS slope_deg, all_flags AS flags FROM der")
def _(spark, d):
    """Halo, slope, clearance, step and traversability, one after the other."""
    out = layers(scan(spark, d), TINY, ("frame",))[1]
    return out.select("frame", "ring", "ix", "iy", "step_mm", F.round("slope_deg", 6).alias("slope_deg"), "flags")


@query("WIN-03_padded_ring", f"""{CELLS_SQL}, b AS (SELECT x.x - 1 AS bx, y.y - 1 AS b_y FROM range(122) x(x), range(122) y(y) WHERE x.x IN (0, 121) OR y.y IN (0, 121)),
w AS (SELECT bx, b_y, {FDIV.format("(bx - 60) * 100 + 50", 200)} + 60 AS ix, {FDIV.format("(b_y - 60) * 100 + 50", 200)} + 60 AS iy FROM b)
SELECT c.frame, w.bx AS ix, w.b_y AS iy, c.cls, c.ground_z, c.top_z, c.count, c.flags FROM w JOIN cells c ON c.ring = 2 AND c.ix = w.ix AND c.iy = w.iy""")  # fmt: skip
def _(spark, d):
    return stencil.padded_border(tiny_cells(spark, d), TINY, 1)


def zoom_sql(box: tuple[int, int, int, int], sizes: tuple[int, ...]) -> str:
    x0, x1, y0, y1 = box
    half = -(-max(x1 - x0, y1 - y0) // 2) + 500
    cls = SAFETY.replace("n4 * 5 >= n", "n4 * 10 >= n * 3").replace("n3 * 5 >= n", "n3 * 10 >= n * 3")
    parts = ", ".join(f"{_located(f'l{c}', Preset.of('z', (-(-half // c) * c, c)), 'box')}, {_accumulated(f'a{c}', f'l{c}')}, {_finalised(f'c{c}', f'a{c}', cls)}, " + near_sql(f"c{c}", str(c)).replace("nb AS", f"nb{c} AS").replace("FROM nb)", f"FROM nb{c})").replace("st AS", f"st{c} AS").replace("FROM st)", f"FROM st{c})").replace("sl AS", f"sl{c} AS").replace("FROM sl)", f"FROM sl{c})").replace("fl AS", f"fl{c} AS").replace("FROM fl)", f"FROM fl{c})").replace("der AS", f"der{c} AS") for c in sizes)
    rows = " UNION ALL ".join(f"SELECT frame, {c} AS cell, count(*) AS cells, count(*) FILTER (flags & 1 = 1) AS ground, bool_or(kerb) AS any_kerb FROM fl{c} GROUP BY frame" for c in sizes)
    return f"""WITH {SCAN_SQL}, box AS (SELECT frame, pid, x_mm - {(x0 + x1) // 2} AS x_mm, y_mm - {(y0 + y1) // 2} AS y_mm, z_mm, cls, moving, conf FROM pts WHERE x_mm BETWEEN {x0} AND {x1} AND y_mm BETWEEN {y0} AND {y1}), {parts} {rows}"""


@query("WIN-15_zoom", zoom_sql((-1500, 3500, -1500, 3500), (50, 200)))
def _(spark, d):
    return stencil.zoom_verdicts(stencil.zoomed(scan(spark, d), (-1500, 3500, -1500, 3500), (50, 200)))


@query("API-02_previews", zoom_sql((-2500, 2500, -2500, 2500), (50, 200, 400, 500)))
def _(spark, d):
    return stencil.zoom_verdicts(stencil.zoomed(scan(spark, d), (-2500, 2500, -2500, 2500), (50, 200, 400, 500)))


# --- Measures ----------------------------------------------------------------------------------------------------------
@query("AGG-11_32_confusion", f"WITH {SCAN_SQL} SELECT sem AS gt, pred, count(*) AS n FROM pts GROUP BY ALL")
def _(spark, d):
    return metrics.confusion(scan(spark, d).withColumnRenamed("sem", "gt"))


IOU_SQL = f"""WITH {SCAN_SQL}, c AS (SELECT sem AS gt, pred, count(*) AS n FROM pts WHERE sem <> 99 GROUP BY ALL),
k AS (SELECT DISTINCT gt AS cls FROM c UNION SELECT pred FROM c WHERE pred <> 99),
s AS (SELECT cls, CAST((SELECT coalesce(sum(n), 0) FROM c WHERE gt = cls AND pred = cls) AS BIGINT) AS tp, CAST((SELECT coalesce(sum(n), 0) FROM c WHERE gt <> cls AND pred = cls) AS BIGINT) AS fp,
CAST((SELECT coalesce(sum(n), 0) FROM c WHERE gt = cls AND pred <> cls) AS BIGINT) AS fn FROM k)"""


@query("AGG-12_class_scores", f"{IOU_SQL} SELECT cls, tp, fp, fn, round(tp / CAST(tp + fp + fn AS DOUBLE), 6) AS iou FROM s")
def _(spark, d):
    return metrics.class_scores(metrics.confusion(scan(spark, d).withColumnRenamed("sem", "gt")), ignored=(99,))


@query("AGG-11_accuracy_miou", f"{IOU_SQL} SELECT (SELECT round(sum(n) FILTER (gt = pred) / CAST(sum(n) AS DOUBLE), 6) FROM c) AS accuracy, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n, (SELECT round(avg(round(tp / CAST(tp + fp + fn AS DOUBLE), 6)), 6) FROM s) AS miou")
def _(spark, d):
    return metrics.summary_scores(metrics.confusion(scan(spark, d).withColumnRenamed("sem", "gt")), ignored=(99,))


BUCKET_SQL = "CASE WHEN x_mm * x_mm + y_mm * y_mm < 25000000 THEN 0 WHEN x_mm * x_mm + y_mm * y_mm < 100000000 THEN 1 ELSE 2 END"


def _bucketed(p: DataFrame) -> DataFrame:
    d2 = F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")
    return p.withColumn("bucket", F.when(d2 < 25000000, 0).when(d2 < 100000000, 1).otherwise(2))


@query("AGG-13_14_by_bucket", f"""WITH {SCAN_SQL}, b AS (SELECT *, {BUCKET_SQL} AS bucket FROM pts)
SELECT CAST(GROUPING(bucket) AS INTEGER) AS overall, bucket, sem AS gt, pred, count(*) AS n FROM b GROUP BY GROUPING SETS ((sem, pred), (bucket, sem, pred))""")  # fmt: skip
def _(spark, d):
    return metrics.by_bucket(_bucketed(scan(spark, d)).withColumnRenamed("sem", "gt"))


@query("AGG-16_38_data_stats", f"""WITH {SCAN_SQL}, {_dims()}, b AS (SELECT *, '08' AS seq, {BUCKET_SQL} AS bucket FROM pts JOIN dim ON sem = raw_id)
SELECT seq, super_cls, bucket, CAST(GROUPING(super_cls) AS INTEGER) AS all_classes, CAST(GROUPING(bucket) AS INTEGER) AS all_buckets, count(*) AS n, count(*) FILTER (is_moving) AS n_moving, count(*) FILTER (critical) AS n_critical
FROM b GROUP BY GROUPING SETS ((seq), (seq, super_cls), (seq, bucket), (seq, super_cls, bucket))""")  # fmt: skip
def _(spark, d):
    return metrics.data_stats(L.classified(_bucketed(scan(spark, d))))


@query("AGG-17_instances", f"WITH {SCAN_SQL} SELECT frame, raw & 65535 AS sem_id, raw >> 16 AS inst, count(*) AS n, CAST(sum(x_mm) AS BIGINT) AS sx, CAST(sum(y_mm) AS BIGINT) AS sy FROM pts WHERE raw >> 16 > 0 GROUP BY ALL")
def _(spark, d):
    return metrics.instances(scan(spark, d))


@query("AGG-18_19_density", f"""WITH {SCAN_SQL}, r AS (SELECT sqrt(CAST(x_mm * x_mm + y_mm * y_mm AS DOUBLE)) / 1000 AS r FROM pts), b AS (SELECT CAST(least(floor(r / 2.0), 9) AS BIGINT) AS bin FROM r WHERE r <= 20)
SELECT bin, count(*) AS n, round(count(*) / (pi() * ((bin + 1) * 2.0 * ((bin + 1) * 2.0) - bin * 2.0 * (bin * 2.0))), 6) AS per_m2 FROM b GROUP BY bin""")  # fmt: skip
def _(spark, d):
    return metrics.density(scan(spark, d), F.sqrt((F.col("x_mm") * F.col("x_mm") + F.col("y_mm") * F.col("y_mm")).cast("double")) / 1000, 2.0, 20.0)


ERR_SQL = f"""WITH {SCAN_SQL}, {_located("lt", TINY)}, {_located("lu", COARSE)},
e AS (SELECT 'tiny_test' AS preset, * FROM lt UNION ALL SELECT 'tiny_uniform' AS preset, * FROM lu), d AS (SELECT preset, x_mm - ((ix - off) * cell + cell // 2) AS dx, y_mm - ((iy - off) * cell + cell // 2) AS dy FROM e),
q AS (SELECT preset, CAST(dx * dx + dy * dy AS BIGINT) AS err2 FROM d)"""


@query("AGG-20_backprojection", f"{ERR_SQL} SELECT preset, round(quantile_cont(CAST(err2 AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(err2 AS DOUBLE), 0.9), 6) AS p90, count(*) AS n FROM q GROUP BY preset")
def _(spark, d):
    return metrics.percentiles(metrics.backprojection(scan(spark, d), (TINY, COARSE)), "err2", ["preset"], {"p50": 0.5, "p90": 0.9})


@query("AGG-29_tradeoff", f"""{ERR_SQL} SELECT preset, round(avg(sqrt(CAST(err2 AS DOUBLE))), 6) AS mean_mm, count(*) AS n, CAST(CASE preset WHEN 'tiny_test' THEN 6400 + 14400 - 1600 + 14400 - 3600 ELSE 14400 END AS BIGINT) AS logical,
CAST(CASE preset WHEN 'tiny_test' THEN 35200 ELSE 14400 END AS BIGINT) AS allocated, CAST(CASE preset WHEN 'tiny_test' THEN 35200 * 12 ELSE 14400 * 12 END AS BIGINT) AS bytes FROM q GROUP BY preset""")  # fmt: skip
def _(spark, d):
    return metrics.tradeoff(metrics.backprojection(scan(spark, d), (TINY, COARSE)), (TINY, COARSE))


@query("AGG-21_motion_scores", f"""WITH {SCAN_SQL}, b AS (SELECT {BUCKET_SQL} AS bucket, moving AS m, sem BETWEEN 252 AND 259 AS t, sem IN (10, 18) AS p FROM pts),
g AS (SELECT bucket, CAST(GROUPING(bucket) AS INTEGER) AS overall, count(*) FILTER (m AND t) AS tp, count(*) FILTER (m AND NOT t) AS fp, count(*) FILTER (NOT m AND t) AS fn, count(*) FILTER (NOT m AND NOT t) AS tn,
count(*) FILTER (p) AS parked, count(*) FILTER (p AND m) AS parked_fp FROM b GROUP BY GROUPING SETS ((), (bucket)))
SELECT *, round(tp / CAST(nullif(tp + fp + fn, 0) AS DOUBLE), 6) AS iou, round(parked_fp / CAST(nullif(parked, 0) AS DOUBLE), 6) AS parked_fpr FROM g""")  # fmt: skip
def _(spark, d):
    return metrics.motion_scores(_bucketed(scan(spark, d)), F.col("moving"), F.col("sem").between(252, 259), F.col("sem").isin(10, 18), "bucket")


@query("AGG-22_object_matching", f"""WITH {SCAN_SQL}, c AS (SELECT frame, pid % 97 AS cluster, raw >> 16 AS inst, count(*) AS n FROM pts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, cluster ORDER BY n DESC, inst) AS k, CAST(sum(n) OVER (PARTITION BY frame, cluster) AS BIGINT) AS size FROM c)
SELECT frame, cluster, inst, n, size, n >= 0.5 * size AND inst > 0 AS matched FROM r WHERE k = 1""")  # fmt: skip
def _(spark, d):
    return metrics.matched_objects(scan(spark, d).withColumns({"cluster": F.col("pid") % 97, "inst": L.instance(F.col("raw"))}))


WILSON = "CASE WHEN n = 0 THEN 0 ELSE round({0}((p + 3.8416 / (2.0 * n) {1} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), {2}), 6) END"


@query("AGG-23_24_detection_rates", f"""WITH {SCAN_SQL}, t AS (SELECT cls AS kind, {BUCKET_SQL} AS bucket, moving AS hit FROM pts),
g AS (SELECT kind, bucket, count(*) AS n, count(*) FILTER (hit) AS hits, CAST(GROUPING(kind) AS INTEGER) AS all_kind, CAST(GROUPING(bucket) AS INTEGER) AS all_bucket, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS p FROM t GROUP BY GROUPING SETS ((), (kind), (bucket)))
SELECT kind, bucket, n, hits, all_kind, all_bucket, round(p, 6) AS rate, {WILSON.format("greatest", "-", "0.0")} AS low, {WILSON.format("least", "+", "1.0")} AS high FROM g""")  # fmt: skip
def _(spark, d):
    t = _bucketed(scan(spark, d)).select(F.col("cls").alias("kind"), "bucket", F.col("moving").alias("hit"))
    return metrics.detection_rates(t, ["kind", "bucket"])


@query("AGG-25_26_27_percentiles", "SELECT o_orderpriority AS stage, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return metrics.percentiles(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "stage"), "o_totalprice", ["stage"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("AGG-31_LG-11_cluster_class", f"""WITH {SCAN_SQL}, c AS (SELECT frame, pid % 97 AS cluster, sem, count(*) AS k FROM pts GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY frame, cluster) AS n FROM c)
SELECT frame, cluster, sem, CAST(n AS BIGINT) AS n, round(k / CAST(n AS DOUBLE), 6) AS agreement FROM t QUALIFY row_number() OVER (PARTITION BY frame, cluster ORDER BY k DESC, sem) = 1""")  # fmt: skip
def _(spark, d):
    return metrics.cluster_classes(scan(spark, d).withColumn("cluster", F.col("pid") % 97))


# --- Motion, joins, clusters -------------------------------------------------------------------------------------------
def _poses(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of frames out of events: users are sequences, their events in order are frames."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("seq"), F.row_number().over(w).alias("frame"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


@query("JN-13_lagged_frames", """WITH f AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, event_id FROM events)
SELECT a.seq, CAST(a.frame AS INTEGER) AS frame, a.event_id, g.gap, b.event_id AS prev_event_id FROM f a CROSS JOIN (VALUES (1), (2), (3), (5)) g(gap) JOIN f b ON b.seq = a.seq AND b.frame = a.frame - g.gap""")
def _(spark, d):
    return motion.lagged_frames(_poses(spark, d).select("seq", "frame", "event_id"), (1, 2, 3, 5)).select("seq", "frame", "event_id", "gap", "prev_event_id")


@query("ST-05_continuity", """WITH f AS (SELECT user_id AS seq, event_id AS frame FROM events), l AS (SELECT *, lag(frame) OVER (PARTITION BY seq ORDER BY frame) AS prev_frame FROM f)
SELECT seq, frame, prev_frame, CAST(sum(CASE WHEN prev_frame IS NULL OR frame - prev_frame <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY frame) AS BIGINT) AS run FROM l""")
def _(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return motion.continuity(f).select("seq", "frame", "prev_frame", "run")


@query("PRJ-07_transform", f"WITH {SCAN_SQL} SELECT pid, CAST(-y_mm + 500 AS DOUBLE) AS x, CAST(x_mm - 250 AS DOUBLE) AS y, CAST(z_mm + 10 AS DOUBLE) AS z FROM pts")
def _(spark, d):
    p = scan(spark, d).select("pid", F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), F.col("z_mm").alias("z"))
    m = F.array(*map(F.lit, (0.0, -1.0, 0.0, 500.0, 1.0, 0.0, 0.0, -250.0, 0.0, 0.0, 1.0, 10.0, 0.0, 0.0, 0.0, 1.0)))
    return motion.transformed(p.withColumn("m", m), "m").select("pid", "x", "y", "z")


def _xyz(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = lambda k: (F.get("embedding", F.lit(k)).cast("double") * 100).alias("xyz"[k])
    return e.select(F.col("label").alias("frame"), F.col("vec_id").alias("pid"), v(0), v(1), v(2))


XYZ_SQL = "WITH p AS (SELECT label AS frame, vec_id AS pid, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings), d AS (SELECT a.frame, a.pid, b.pid AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2, sqrt(a.x * a.x + a.y * a.y + a.z * a.z) AS r FROM p a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid)"


@query("JN-15_radius_join", f"{XYZ_SQL} SELECT frame, pid, other, round(d2, 6) AS d2 FROM d WHERE d2 <= (5 + 0.1 * r) ** 2")
def _(spark, d):
    p = _xyz(spark, d)
    eps = 5 + 0.1 * F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return clusters.radius_join(p, 5 + 0.1 * 180, eps).withColumn("d2", F.round("d2", 6))


@query("JN-11_nearest", f"{XYZ_SQL}, n AS (SELECT frame, pid, min(d2) AS d2 FROM d WHERE pid % 2 = 0 AND other % 2 = 1 GROUP BY ALL) SELECT frame, pid, round(sqrt(d2), 6) AS distance FROM n")
def _(spark, d):
    p = _xyz(spark, d)
    return clusters.nearest(p.filter("pid % 2 = 0"), p.filter("pid % 2 = 1"), 8.0).withColumn("distance", F.round("distance", 6))


@query("CL-01_clusters", f"""{XYZ_SQL.replace("WITH p", "WITH RECURSIVE p")}, e AS (SELECT frame, pid, other FROM d WHERE d2 <= (5 + 0.1 * r) ** 2), u AS (SELECT frame, pid, other FROM e UNION SELECT frame, other, pid FROM e),
c AS (SELECT frame, pid, pid AS root FROM p UNION SELECT c.frame, c.pid, u.other FROM c JOIN u ON u.pid = c.root AND u.frame = c.frame), m AS (SELECT frame, pid, min(root) AS root FROM c GROUP BY ALL),
s AS (SELECT frame, root, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 5), k AS (SELECT frame, root, row_number() OVER (PARTITION BY frame ORDER BY n DESC, root) - 1 AS cluster FROM s)
SELECT m.frame, m.pid, coalesce(k.cluster, -1) AS cluster FROM m LEFT JOIN k ON k.frame = m.frame AND k.root = m.root""")  # fmt: skip
def _(spark, d):
    from dataclasses import replace

    return clusters.clustered(_xyz(spark, d), settings=replace(DEFAULTS, eps0_m=5.0, eps1_rel=0.1))


@query("CL-02_LG-11_dbscan", f"""{XYZ_SQL.replace("WITH p", "WITH RECURSIVE p")}, e AS (SELECT frame, pid, other FROM d WHERE d2 <= 81),
k AS (SELECT p.frame, p.pid FROM p LEFT JOIN e ON e.frame = p.frame AND e.pid = p.pid GROUP BY ALL HAVING count(e.other) + 1 >= 4), c AS (SELECT e.frame, e.pid, e.other FROM e JOIN k a ON a.frame = e.frame AND a.pid = e.pid JOIN k b ON b.frame = e.frame AND b.pid = e.other),
w AS (SELECT frame, pid, pid AS root FROM k UNION SELECT w.frame, w.pid, c.other FROM w JOIN c ON c.pid = w.root AND c.frame = w.frame), m AS (SELECT frame, pid, min(root) AS root FROM w GROUP BY ALL),
n AS (SELECT frame, root, row_number() OVER (PARTITION BY frame ORDER BY root) - 1 AS part FROM (SELECT DISTINCT frame, root FROM m)), l AS (SELECT m.frame, m.pid, n.part FROM m JOIN n ON n.frame = m.frame AND n.root = m.root),
b AS (SELECT e.frame, e.pid, min(l.part) AS part FROM e JOIN l ON l.frame = e.frame AND l.pid = e.other GROUP BY ALL) SELECT p.frame, p.pid, coalesce(l.part, b.part, -1) AS part FROM p LEFT JOIN l ON l.frame = p.frame AND l.pid = p.pid LEFT JOIN b ON b.frame = p.frame AND b.pid = p.pid""")  # fmt: skip
def _(spark, d):
    return clusters.dbscan(_xyz(spark, d), 9.0, 4)


@query("LG-13_aligned_boxes", XYZ_SQL.split(", d AS")[0] + " SELECT frame, count(*) AS n, round((min(x) + max(x)) / 2, 6) AS cx, round(max(x) - min(x), 6) AS dx, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 4) AS volume FROM p GROUP BY frame")
def _(spark, d):
    b = clusters.aligned_boxes(_xyz(spark, d), ["frame"])
    return b.select("frame", "n", F.round("cx", 6).alias("cx"), F.round("dx", 6).alias("dx"), F.round("volume", 4).alias("volume"))


@query("CL-03_oriented_boxes", XYZ_SQL.split(", d AS")[0] + """, a AS (SELECT k, radians(k * 5.0) AS t FROM range(18) r(k)), q AS (SELECT frame, k, t, min(x * cos(t) + y * sin(t)) AS x0, max(x * cos(t) + y * sin(t)) AS x1, min(y * cos(t) - x * sin(t)) AS y0, max(y * cos(t) - x * sin(t)) AS y1 FROM p, a GROUP BY ALL)
SELECT frame, round(greatest(x1 - x0, y1 - y0), 6) AS length, round(least(x1 - x0, y1 - y0), 6) AS width, round(CASE WHEN x1 - x0 >= y1 - y0 THEN t ELSE t + pi() / 2 END, 6) AS yaw FROM q QUALIFY row_number() OVER (PARTITION BY frame ORDER BY (x1 - x0) * (y1 - y0), k) = 1""")  # fmt: skip
def _(spark, d):
    return clusters.oriented_boxes(_xyz(spark, d), ["frame"]).select("frame", *(F.round(c, 6).alias(c) for c in ("length", "width", "yaw")))


@query("CL-04_cluster_vote", f"WITH {SCAN_SQL} SELECT frame, pid % 97 AS cluster, count(*) AS n, count(*) FILTER (moving) AS n_moving, count(*) FILTER (moving) >= 3 AND count(*) FILTER (moving) >= 0.3 * count(*) AS is_moving FROM pts GROUP BY ALL")
def _(spark, d):
    return motion.cluster_verdicts(scan(spark, d).withColumns({"cluster": F.col("pid") % 97, "vote": F.col("moving").cast("int")}))


@query("CL-05_06_verdicts", f"""WITH {SCAN_SQL}, {_dims()}, v AS (SELECT frame, pid % 97 AS cluster, count(*) FILTER (moving) >= 3 AND count(*) FILTER (moving) >= 0.15 * count(*) AS m FROM pts GROUP BY ALL)
SELECT p.frame, p.pid, critical OR m AS moving, CASE WHEN critical OR m THEN 4 ELSE 3 END AS cls FROM pts p JOIN v ON v.frame = p.frame AND v.cluster = p.pid % 97 JOIN dim ON raw_id = sem""")  # fmt: skip
def _(spark, d):
    from dataclasses import replace

    p = L.classified(scan(spark, d)).withColumns({"cluster": F.col("pid") % 97, "vote": F.col("moving").cast("int")})
    v = motion.cluster_verdicts(p, settings=replace(DEFAULTS, vote_share=0.15))
    return motion.with_verdicts(p, v).select("frame", "pid", "moving", "cls")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """An integer pseudo-projection: pixels and ranges without trigonometry."""
    return scan(spark, d).select("frame", "pid", "sem", "moving", ((F.col("x_mm") + 14000) % 64).cast("int").alias("v"), ((F.col("y_mm") + 14000) % 1024).cast("int").alias("u"), ((F.abs("x_mm") + F.abs("y_mm")) / 1000.0).alias("r"), F.lit(True).alias("valid"))


PIXEL_SQL = f"WITH {SCAN_SQL}, px AS (SELECT frame, pid, (x_mm + 14000) % 64 AS v, (y_mm + 14000) % 1024 AS u, (abs(x_mm) + abs(y_mm)) / 1000.0 AS r, row_number() OVER () AS rid, sem, moving FROM pts)"


@query("JN-10_range_image", f"{PIXEL_SQL} SELECT frame, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, min(r) AS r FROM px GROUP BY ALL")
def _(spark, d):
    return motion.range_image(_pixels(spark, d))


@query("JN-12_residual_votes", f"""{PIXEL_SQL}, img AS (SELECT v, u, min(r) AS r FROM px WHERE frame = 0 GROUP BY ALL), o AS (SELECT dv.dv, du.du, (dv.dv + 1) * 3 + du.du + 1 AS k FROM (VALUES (-1), (0), (1)) dv(dv), (VALUES (-1), (0), (1)) du(du)),
m AS (SELECT p.rid, p.r, i.r AS prev, k, abs(p.r - i.r) AS diff FROM px p, o JOIN img i ON i.v = least(greatest(p.v + o.dv, 0), 63) AND i.u = (p.u + o.du + 1024) % 1024 WHERE p.frame = 1),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY rid ORDER BY diff, k) = 1) SELECT p.pid, CASE WHEN b.rid IS NULL THEN -1 WHEN b.diff <= 0.30 + 0.02 * p.r THEN 0 ELSE 1 END AS vote FROM px p LEFT JOIN b ON b.rid = p.rid WHERE p.frame = 1""")  # fmt: skip
def _(spark, d):
    p = _pixels(spark, d)
    image = motion.range_image(p.filter("frame = 0")).withColumn("frame", F.lit(1))
    return motion.residual_votes(p.filter("frame = 1"), image).select("pid", "vote")


@query("PRJ-10_projection", f"""WITH {SCAN_SQL}, p AS (SELECT frame, x_mm / CAST(1000 AS DOUBLE) AS x, y_mm / CAST(1000 AS DOUBLE) AS y, z_mm / CAST(1000 AS DOUBLE) AS z FROM pts), r AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM p),
i AS (SELECT frame, CAST(least(greatest(floor((1 - (asin(least(1, greatest(-1, z / greatest(r, 1e-6)))) - radians(-25)) / radians(28)) * 64), 0), 63) AS INTEGER) AS v, CAST(least(greatest(floor(0.5 * (1 - atan2(y, x) / pi()) * 1024), 0), 1023) AS INTEGER) AS u FROM r)
SELECT frame, v, u, count(*) AS n FROM i GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).select("frame", "pid", *((F.col(f"{c}_mm") / 1000.0).alias(c) for c in "xyz"))
    return motion.projected(p).groupBy("frame", "v", "u").agg(F.count(F.lit(1)).alias("n"))


# --- Hazards, display, wire --------------------------------------------------------------------------------------------
HAZARD_SQL = f"""WITH {SCAN_SQL}, h AS (SELECT frame, pid, x_mm, y_mm, cls, moving, conf, z_mm - CASE WHEN cls = 1 AND (x_mm - 1000) * (x_mm - 1000) + (y_mm - 500) * (y_mm - 500) <= 250000 THEN 180 ELSE 0 END
+ CASE WHEN cls = 1 AND abs(x_mm + 3000) * 2 <= 3000 AND abs(y_mm - 2000) * 2 <= 500 THEN 160 ELSE 0 END AS z_mm FROM pts)"""


def _hazardous(spark: SparkSession, d: str) -> DataFrame:
    p = hazards.with_pothole(scan(spark, d), 1000, 500, 500, 180)
    return hazards.with_kerb(p, -3000, 2000, 3000, 500, 160).select("frame", "pid", "x_mm", "y_mm", "z_mm", "cls", "moving", "conf")


@query("HZ-01_02_06_injection", f"{HAZARD_SQL} SELECT frame, pid, z_mm FROM h")
def _(spark, d):
    return _hazardous(spark, d).select("frame", "pid", "z_mm")


@query("HZ-03_06_SET-01_overhang", f"""{HAZARD_SQL}, k AS (SELECT k FROM range(360) r(k)), g AS (SELECT frame, -k - 1 AS pid, CAST(500 + floor(k % 30 * 3000 / 29.0) AS BIGINT) AS x_mm, CAST(-500 + floor(floor(k / 30.0) * 1000 / 11.0) AS BIGINT) AS y_mm, 900 AS z_mm, 3 AS cls FROM (SELECT DISTINCT frame FROM h), k),
a AS (SELECT frame, pid, x_mm, y_mm, z_mm, cls FROM h UNION ALL SELECT * FROM g) SELECT frame, cls, count(*) AS n, CAST(sum(x_mm) AS BIGINT) AS sx, CAST(sum(y_mm) AS BIGINT) AS sy, CAST(sum(z_mm) AS BIGINT) AS sz FROM a GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = _hazardous(spark, d)
    slab = hazards.overhang_grid(p.select("frame").distinct(), 2000, 0, F.lit(900))
    out = p.unionByName(slab)
    return out.groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"{c}_mm").alias(f"s{c}") for c in "xyz"))


def detection_sql(n: int, seed: int) -> str:
    """The trials of hazards.detection() without a halo; a hazard's number stands for the frame of its cells."""

    def drawn(*parts: str) -> str:
        return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 7) AS BIGINT)"

    def size(name: str, low: int, high: int) -> str:
        return f"{drawn(f_seed, 'CAST(frame AS VARCHAR)', 'CAST(trial AS VARCHAR)', repr(name))} % {high - low + 1} + {low} AS {name}"

    f_seed = f"'{seed}'"
    centres = ", ".join(f"max(CASE WHEN kind = '{k}' THEN {c}_mm END) AS {c}_{k}" for k in hazards.KINDS for c in "xy")
    margin = hazards.NEAR_MM + 3 * 200
    ring = _located("pl", TINY, "(SELECT *, cx AS x_mm, cy AS y_mm FROM hz)")
    return f"""WITH {SCAN_SQL}, dr AS (SELECT frame, x_mm, y_mm, z_mm, row_number() OVER (PARTITION BY frame ORDER BY pid, x_mm, y_mm, z_mm) - 1 AS k, count(*) OVER (PARTITION BY frame) AS n FROM pts WHERE cls = 1),
asked AS (SELECT f.frame, t.t AS trial, kinds.kind, {drawn(f_seed, "CAST(f.frame AS VARCHAR)", "CAST(t.t AS VARCHAR)", "kinds.kind")} % f.n AS k FROM (SELECT frame, max(n) AS n FROM dr GROUP BY frame HAVING max(n) >= 10) f, range({n}) t(t), (VALUES ('pothole'), ('kerb'), ('overhang')) kinds(kind)),
tr AS (SELECT frame, trial, {centres}, max(CASE WHEN kind = 'overhang' THEN z_mm END) AS base FROM asked JOIN dr USING (frame, k) GROUP BY frame, trial),
sized AS (SELECT *, {size("radius", *hazards.POTHOLE_RADIUS)}, {size("depth", *hazards.POTHOLE_DEPTH)}, {size("height", *hazards.KERB_HEIGHT)}, {size("above", *hazards.OVERHANG_HEIGHT)} FROM tr),
hz AS (SELECT s.*, q.k, q.kind, s.trial * 3 + q.k AS hazard, (s.trial * 3 + q.k) * 2 + s.frame AS hid, CASE q.k WHEN 0 THEN x_pothole WHEN 1 THEN x_kerb ELSE x_overhang END AS cx, CASE q.k WHEN 0 THEN y_pothole WHEN 1 THEN y_kerb ELSE y_overhang END AS cy
  FROM sized s, (VALUES (0, 'pothole'), (1, 'kerb'), (2, 'overhang')) q(k, kind)),
inj AS (SELECT h.hid AS frame, p.x_mm, p.y_mm, CAST(p.z_mm - CASE WHEN p.cls = 1 AND (p.x_mm - x_pothole) * (p.x_mm - x_pothole) + (p.y_mm - y_pothole) * (p.y_mm - y_pothole) <= radius * radius THEN depth ELSE 0 END
    + CASE WHEN p.cls = 1 AND abs(p.x_mm - x_kerb) * 2 <= {hazards.KERB_LENGTH} AND abs(p.y_mm - y_kerb) * 2 <= {hazards.KERB_WIDTH} THEN height ELSE 0 END AS BIGINT) AS z_mm, p.cls, p.moving, p.conf
    FROM hz h JOIN pts p ON p.frame = h.frame AND p.x_mm BETWEEN cx - {margin} AND cx + {margin} AND p.y_mm BETWEEN cy - {margin} AND cy + {margin}
  UNION ALL SELECT hid, x_mm, y_mm, z_mm, 3, false, 255 FROM (SELECT hid, cx, cy, x_overhang - 1500 + {drawn("CAST(trial AS VARCHAR)", "CAST(q.q AS VARCHAR)", "'x'")} % 3001 AS x_mm, y_overhang - 500 + {drawn("CAST(trial AS VARCHAR)", "CAST(q.q AS VARCHAR)", "'y'")} % 1001 AS y_mm, CAST(base + above AS BIGINT) AS z_mm FROM hz, range(100) q(q))
    WHERE x_mm BETWEEN cx - {margin} AND cx + {margin} AND y_mm BETWEEN cy - {margin} AND cy + {margin}),
{_located("loc", TINY, "inj")}, {_accumulated("acc", "loc")}, {_finalised("cells", "acc")}, {near_sql("cells")}, {ring},
w AS (SELECT a.hid, a.kind, a.depth, abs(c.ix - a.ix) AS dx, abs(c.iy - a.iy) AS dy, c.all_flags AS f, c.ground_z, CASE a.kind WHEN 'pothole' THEN 2 WHEN 'kerb' THEN greatest(1, 2000 // a.cell) ELSE greatest(1, 1500 // a.cell) END AS reach
  FROM pl a JOIN der c ON c.frame = a.hid AND c.ring = a.ring),
v AS (SELECT hid, any_value(kind) AS kind, any_value(depth) AS depth, bool_or(CASE kind WHEN 'kerb' THEN f & 16 = 16 WHEN 'overhang' THEN f & 64 = 64 OR (f & 1 = 1 AND f & 8 = 0) ELSE false END) AS shown, max(CASE WHEN dx = 0 AND dy = 0 AND f & 1 = 1 THEN ground_z END) AS z,
  avg(CASE WHEN ((dx = 2 AND dy = 0) OR (dx = 0 AND dy = 2)) AND f & 1 = 1 THEN ground_z END) AS around FROM w WHERE dx <= reach AND dy <= reach GROUP BY hid),
hits AS (SELECT a.kind, a.ring, CASE WHEN a.kind = 'pothole' THEN coalesce(v.around - v.z >= floor(a.depth / 2.0), false) ELSE coalesce(v.shown, false) END AS hit FROM pl a LEFT JOIN v ON v.hid = a.hid),
g AS (SELECT kind, ring, count(*) AS n, count(*) FILTER (hit) AS hits, CAST(GROUPING(kind) AS INTEGER) AS all_kind, CAST(GROUPING(ring) AS INTEGER) AS all_ring, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS p FROM hits GROUP BY GROUPING SETS ((), (kind), (ring)))
SELECT kind, ring, n, hits, all_kind, all_ring, round(p, 6) AS rate, {WILSON.format("greatest", "-", "0.0")} AS low, {WILSON.format("least", "+", "1.0")} AS high FROM g"""


@query("HZ-05_07_WIN-16_detection", detection_sql(50, 1337))
def _(spark, d):
    """50 injections in every frame: a pothole, a kerb and an overhang each, whether the layers show them, rates and intervals."""
    return metrics.detection_rates(hazards.detection(scan(spark, d), TINY, 50, 1337, halo=False), ["kind", "ring"])


PREVIEW_SQL = f"""WITH {SCAN_SQL}, gr AS (SELECT frame, floor(median(z_mm)) + 1500 AS top FROM pts WHERE cls = 1 AND (x_mm - 900) * (x_mm - 900) + (y_mm + 700) * (y_mm + 700) < 1000000 GROUP BY frame)"""


@query("HZ-06_API-04_previews", f"""{PREVIEW_SQL}, p AS (SELECT * FROM pts WHERE frame IN (SELECT frame FROM gr)),
a AS (SELECT 'pothole' AS kind, frame, z_mm - CASE WHEN cls = 1 AND (x_mm - 900) * (x_mm - 900) + (y_mm + 700) * (y_mm + 700) <= 250000 THEN 180 ELSE 0 END AS z FROM p
UNION ALL SELECT 'kerb', frame, z_mm + CASE WHEN cls = 1 AND abs(x_mm - 900) * 2 <= 3000 AND abs(y_mm + 700) * 2 <= 500 THEN 160 ELSE 0 END FROM p UNION ALL SELECT 'overhang', frame, z_mm FROM p UNION ALL SELECT 'overhang', frame, top FROM gr, range(360))
SELECT kind, frame, count(*) AS n, CAST(sum(z) AS BIGINT) AS sz FROM a GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    parts = [hazards.preview(scan(spark, d), k, 900, -700).withColumn("kind", F.lit(k)) for k in hazards.KINDS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("kind", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("z_mm").alias("sz"))


@query("DSP-01_JN-18_categories", f"""{CELLS_SQL}, v AS (SELECT frame, ring, ix, iy, count(*) FILTER (sem IN (10, 11, 13, 15, 16, 18, 20, 252, 256, 257, 258, 259) AND NOT moving) AS vs, count(*) FILTER (sem IN (10, 11, 13, 15, 16, 18, 20, 252, 256, 257, 258, 259) AND moving) AS vm,
count(*) FILTER (sem NOT IN (10, 11, 13, 15, 16, 18, 20, 252, 256, 257, 258, 259) AND cls IN (3, 4)) AS vo FROM loc GROUP BY ALL)
SELECT c.frame, c.ring, c.ix, c.iy, CASE c.cls WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN CASE WHEN vs > vo THEN 2 ELSE 4 END ELSE CASE WHEN vm > vo THEN 3 ELSE 5 END END AS category
FROM cells c JOIN v ON v.frame = c.frame AND v.ring = c.ring AND v.ix = c.ix AND v.iy = c.iy""")  # fmt: skip
def _(spark, d):
    loc = grid.locate(scan(spark, d), TINY)
    at = ["frame", "ring", "ix", "iy"]
    return grid.finalised(grid.accumulate(loc)).join(wire.vehicle_counts(loc), at).select(*at, wire.category().alias("category"))


@query("WIRE-01_02_round_trip", f"{CELLS_SQL} SELECT frame, ring, ix, iy, cls, ground_z, top_z, moving_frac, conf, flags FROM cells")
def _(spark, d):
    cells = tiny_cells(spark, d).filter("ground_z > -32769 AND abs(ground_z) < 32769 AND abs(top_z) < 32769")
    wide = [F.col(c).cast("bigint").alias(c) for c in ("ix", "iy", "ground_z", "top_z", "moving_frac", "conf", "flags")]
    return wire.unpacked(wire.packed(cells)).select("frame", "ring", "cls", *wide)


@query("SNK-06_payloads", f"{CELLS_SQL} SELECT frame, count(DISTINCT ring) AS rings, count(*) AS cells FROM cells GROUP BY frame")
def _(spark, d):
    p = scan(spark, d)
    out = wire.payloads(wire.packed(grid.cells_of(p, TINY)), grid.counters(p, TINY))
    doc = F.from_json("payload", "rings array<struct<n_cells: long>>")
    return out.select("frame", F.size(doc["rings"]).cast("long").alias("rings"), F.aggregate(doc["rings"], F.lit(0).cast("long"), lambda a, r: a + r["n_cells"]).alias("cells"))


@query("DSP-02_03_texture", f"{CELLS_SQL} SELECT frame, ring, [80, 120, 120][ring + 1] - 1 - ix AS row, [80, 120, 120][ring + 1] - 1 - iy AS col, CAST(floor(least(1.0, greatest(0.0, (ground_z + 2000) / CAST(3000 AS DOUBLE))) * 255) AS INTEGER) AS shade FROM cells WHERE ground_z <> -32768")
def _(spark, d):
    row, col = wire.texture_place(grid.per_ring(TINY, lambda k, r: r.side))
    return tiny_cells(spark, d).filter("ground_z <> -32768").select("frame", "ring", row.alias("row"), col.alias("col"), wire.height_colour(F.col("ground_z"), -2000, 1000).alias("shade"))


# --- Sets, order, state ------------------------------------------------------------------------------------------------
@query("SRC-15_SET-03_differences", "SELECT doc_id, 'document without label' AS problem FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label without document' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, d):
    return scans.only_in_one(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"], "document without label", "label without document")


@query("SRT-04_nearest_points", f"WITH {SCAN_SQL} SELECT frame, pid FROM pts QUALIFY row_number() OVER (PARTITION BY frame ORDER BY (x_mm - 100) * (x_mm - 100) + (y_mm + 200) * (y_mm + 200), pid) <= 500")
def _(spark, d):
    return voxels.nearest_points(scan(spark, d), 500, F.lit(100), F.lit(-200)).select("frame", "pid")


@query("SRT-06_best_window", f"{CELLS_SQL} SELECT frame, arg_max(ix, conf * 1000000 - (iy * 120 + ix)) AS ix, arg_max(iy, conf * 1000000 - (iy * 120 + ix)) AS iy, max(conf) AS conf FROM cells WHERE ring = 2 AND flags & 1 = 1 GROUP BY frame")
def _(spark, d):
    return stencil.best_window(tiny_cells(spark, d), TINY)


@query("NN-04_07_voxels", f"""WITH {SCAN_SQL}, v AS (SELECT frame, s.s AS scale, (x_mm + 14000) // (500 * s.s) AS i, (y_mm + 14000) // (500 * s.s) AS j, (z_mm + 4000) // (500 * s.s) AS k, conf FROM pts, (VALUES (1), (2), (4)) s(s))
SELECT frame, scale, i, j, k, count(*) AS n, round(avg(conf), 6) AS conf FROM v GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).withColumns({c: F.col(f"{c}_mm") for c in "xyz"})
    return voxels.voxel_means(voxels.voxelised(p, (-14000, -14000, -4000), 500, (1, 2, 4)), ["conf"]).withColumn("conf", F.round("conf", 6))


@query("NN-05_06_point_features", f"""WITH {SCAN_SQL}, v AS (SELECT frame, pid, x_mm, (x_mm + 14000) // 500 AS i, (y_mm + 14000) // 500 AS j, (z_mm + 4000) // 500 AS k FROM pts)
SELECT frame, pid, round(x_mm - avg(x_mm) OVER (PARTITION BY frame, i, j, k), 6) AS mx, CAST(x_mm + 14000 - i * 500 AS DOUBLE) AS ox FROM v""")  # fmt: skip
def _(spark, d):
    p = scan(spark, d).withColumns({c: F.col(f"{c}_mm") for c in "xyz"})
    out = voxels.point_features(voxels.voxelised(p, (-14000, -14000, -4000), 500, (1,)), (-14000, -14000, -4000), 500)
    return out.select("frame", "pid", F.round("mx", 6).alias("mx"), F.col("ox").cast("double").alias("ox"))


@query("NN-11_summed_votes", "WITH s AS (SELECT l_orderkey AS key, l_linenumber AS cls, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY ALL) SELECT key, cls, CAST(s AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, cls) = 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("cls"), F.col("l_quantity").cast("bigint").alias("score"))
    return voxels.summed_votes(li, "key", "cls", "score")


@query("ST-01_hysteresis_window", "WITH f AS (SELECT user_id AS seq, event_id AS frame, event_id % 3 = 0 AS moving FROM events), h AS (SELECT seq, frame, count(*) FILTER (moving) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM f) SELECT seq, frame, hits, hits >= 2 AS moves FROM h")
def _(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("frame"), (F.col("event_id") % 3 == 0).alias("moving"))
    return tracking.moving_by_hits(f, keys=("seq",)).select("seq", "frame", "hits", "moves")


@query("ST-01_tracker")
def _(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("event_id") % 2 == 0, "car").otherwise("person")
    frame = F.dense_rank().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    o = e.select(F.col("user_id").cast("string").alias("seq"), frame.cast("int").alias("frame"), F.col("event_id").alias("obj"), name.alias("name"), (F.col("value") % 3).alias("x"), (F.col("value") % 2).alias("y"), F.lit(0.0).alias("z"), (F.col("event_id") % 3 == 0).alias("moving"), F.lit(None).cast("long").alias("instance"))
    eye = F.array(*(F.lit(float(i == j)) for i in range(4) for j in range(4)))
    return tracking.tracked(o.withColumns({"pose": eye, "dt": F.lit(0.1)})).select("seq", "frame", "obj", "track_id", "moving", F.round("speed_mps", 6).alias("speed_mps"))


WORLD_SQL = f"""{CELLS_SQL}, wc AS (SELECT *, ((ix - off) * size + size // 2) / 1000.0::DOUBLE + frame * 0.4::DOUBLE AS wx, ((iy - off) * size + size // 2) / 1000.0::DOUBLE AS wy FROM (SELECT *, [40, 60, 60][ring + 1] AS off, [50, 100, 200][ring + 1] AS size FROM cells)),
wp AS (SELECT *, CAST(floor(wx / 0.2::DOUBLE + 200) AS INTEGER) AS col, CAST(floor(wy / 0.2::DOUBLE + 200) AS INTEGER) AS row FROM wc),
ob AS (SELECT frame, ring, row, col, arg_max(ground_z, (iy * 1000 + ix)) AS ground_z, arg_max(top_z, (iy * 1000 + ix)) AS top_z, arg_max(cls, (iy * 1000 + ix)) AS cls, arg_max(flags, (iy * 1000 + ix)) AS flags FROM wp
  WHERE count > 2 AND cls <> 4 AND flags & 2 = 0 AND ground_z <> -32768 AND row BETWEEN 0 AND 399 AND col BETWEEN 0 AND 399 GROUP BY frame, ring, row, col),
sq AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY frame, ring) AS k FROM ob),
fo AS (SELECT row, col, k, CAST(ground_z AS BIGINT) AS gz, top_z AS tz, cls, flags, frame FROM sq WHERE k = 1
  UNION ALL SELECT s.row, s.col, s.k, CAST(trunc(0.30::DOUBLE * s.ground_z + (1 - 0.30::DOUBLE) * f.gz) AS BIGINT), greatest(f.tz, s.top_z), s.cls, s.flags, s.frame FROM fo f JOIN sq s ON s.row = f.row AND s.col = f.col AND s.k = f.k + 1),
wm AS (SELECT row, col, gz AS ground_z, CAST(tz AS BIGINT) AS top_z, cls, flags, 2 - frame AS age FROM fo QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY k DESC) = 1)"""


def _world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, poses of a vehicle that moves by 0.4 m a frame, and the map after both frames."""
    eye = F.array(*(F.lit(float(i == j)) if (i, j) != (0, 3) else F.col("frame") * 0.4 for i in range(4) for j in range(4)))
    poses = spark.range(2).select(F.lit("08").alias("seq"), F.col("id").cast("int").alias("frame")).withColumn("pose", eye)
    cells = grid.cells_of(scan(spark, d), TINY, ("seq", "frame"))
    return cells, poses, tracking.world_map(tracking.world_cells(cells, TINY, poses, 0.2, 400), 1)


@query("ST-02_03_09_world_map", WORLD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT '08' AS seq, * FROM wm")
def _(spark, d):
    return _world(spark, d)[2]


@query("JN-19_ST-04_backfill", WORLD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, al AS (SELECT f.frame, r.ring, x.x AS ix, y.y AS iy, r.off, r.size FROM (SELECT DISTINCT frame FROM cells) f, (VALUES (0, 40, 50, 80, 0), (1, 60, 100, 120, 2000), (2, 60, 200, 120, 6000)) r(ring, off, size, side, hole), range(120) x(x), range(120) y(y)
  WHERE x.x < r.side AND y.y < r.side AND NOT (abs((x.x - r.off) * r.size * 2 + r.size) < r.hole * 2 AND abs((y.y - r.off) * r.size * 2 + r.size) < r.hole * 2)),
em AS (SELECT a.*, CAST(floor((((ix - off) * size + size // 2) / 1000.0::DOUBLE + frame * 0.4::DOUBLE) / 0.2::DOUBLE + 200) AS INTEGER) AS col, CAST(floor(((iy - off) * size + size // 2) / 1000.0::DOUBLE / 0.2::DOUBLE + 200) AS INTEGER) AS row FROM al a ANTI JOIN cells c ON c.frame = a.frame AND c.ring = a.ring AND c.ix = a.ix AND c.iy = a.iy)
SELECT '08' AS seq, frame, ring, ix, iy, cls, ground_z, false AS filled FROM cells UNION ALL SELECT '08', e.frame, e.ring, e.ix, e.iy, w.cls, w.ground_z, true FROM em e JOIN wm w ON w.row = e.row AND w.col = e.col""")  # fmt: skip
def _(spark, d):
    cells, poses, world = _world(spark, d)
    out = tracking.backfilled(cells, world, TINY, poses, 0.2, 400)
    return out.select("seq", "frame", "ring", "ix", "iy", "cls", "ground_z", "filled")


@query("LG-26_bounds", f"WITH {SCAN_SQL} SELECT frame, min(x_mm) AS x_lo, max(x_mm) AS x_hi, min(y_mm) AS y_lo, max(y_mm) AS y_hi, min(z_mm) AS z_lo, max(z_mm) AS z_hi FROM pts GROUP BY frame")
def _(spark, d):
    return metrics.bounds(scan(spark, d), ("x_mm", "y_mm", "z_mm")).withColumnsRenamed({f"{c}_mm_{e}": f"{c}_{e}" for c in "xyz" for e in ("lo", "hi")})
