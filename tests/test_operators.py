import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.config import DEFAULTS, PRESETS, ConfigError, Preset, m_to_mm
from terrafold.functions.integers import floor_div, half_up, quantised
from terrafold.operators import clusters, grid, motion, stencil, tracking, wire
from terrafold.sources import scans, synthetic


def test_lengths_and_presets():
    assert m_to_mm("0.05") == 50
    with pytest.raises(ConfigError):
        m_to_mm(0.0005)
    assert sum(PRESETS["fovea_default"].logical_cells(k) for k in range(4)) == 910_000
    assert sum(PRESETS["fovea_default"].allocated_cells(k) for k in range(4)) == 1_130_000
    for p in PRESETS.values():
        p.validated()
    for bad in (Preset.of("a"), Preset.of("b", (100, 30)), Preset.of("c", (200, 100), (100, 100)), Preset.of("d", (200, 100), (600, 50)), Preset.of("e", (300, 100), (800, 200))):
        with pytest.raises(ConfigError):
            bad.validated()


def test_integers(spark):
    rows = [(n, d) for n in range(-13, 14) for d in (1, 2, 3, 7)]
    df = spark.createDataFrame(rows, "n long, d long").select("n", "d", floor_div(F.col("n"), F.col("d")).alias("f"), half_up(F.col("n"), F.col("d")).alias("h"))
    for r in df.collect():
        assert r.f == r.n // r.d and r.h == (r.n + r.d // 2) // r.d
    half = spark.createDataFrame([(0.0005,), (0.0015,), (-0.0025,)], "x double").select(quantised(F.col("x")).alias("q"))
    assert [r.q for r in half.collect()] == [int(v) for v in np.rint(np.array([0.0005, 0.0015, -0.0025]) * 1000)]


def test_boundaries_are_half_open(spark):
    df = spark.createDataFrame([(-2000, 0), (2000, 0), (-2001, 0), (11999, -12000), (12000, 0)], "x_mm long, y_mm long")
    got = {(r.x_mm): r.ring for r in grid.locate(df, PRESETS["tiny_test"], keep_outside=True).collect()}
    assert got == {-2000: 0, 2000: 1, -2001: 1, 11999: 2, 12000: None}


def test_saturation_and_bad_points(spark):
    df = spark.createDataFrame([(2.0, 0.0, 99.0), (float("nan"), 0.0, 0.0), (0.1, 0.1, 0.0), (3.0, None, 0.0), (float("inf"), 1.0, 0.0)], "x double, y double, z double")
    got = grid.quantise(df).collect()
    assert [(r.x_mm, r.z_mm, r.z_saturated) for r in got] == [(2000, 32767, True)]


def test_cell_by_hand(spark):
    rows = [(0, 10, 10, -1700, 1, False, 10), (0, 20, 30, -1650, 2, False, 20), (0, 40, 40, 200, 3, False, 30)]
    df = spark.createDataFrame(rows, "frame int, x_mm long, y_mm long, z_mm long, cls int, moving boolean, conf int")
    r = grid.accumulate(grid.locate(df, PRESETS["tiny_test"])).collect()[0]
    assert (r.g_min, r.g_max, r.g_sum, r.o_min, r.o_max, r.conf_sum, r.n) == (-1700, -1650, -3350, 200, 200, 60, 3)
    c = grid.cells_of(df, PRESETS["tiny_test"]).collect()[0]
    assert (c.ground_z, c.top_z, c.clearance, c.conf, c.flags) == (-1675, 200, 1875, 20, 7)


def test_dense_and_identity(spark):
    frames = spark.createDataFrame([(0,)], "frame int")
    p = Preset.of("p", (200, 100), (800, 200))
    empty = spark.createDataFrame([], "frame int, x_mm long, y_mm long, z_mm long, cls int, moving boolean, conf int")
    d = grid.dense(grid.cells_of(empty, p), frames, p)
    assert d.count() == p.logical_cells(0) + p.logical_cells(1)
    assert grid.identical(d, d) and not grid.identical(d, d.limit(3))


def terrain(spark, height):
    rows = [(0, 0, ix, iy, 1, height((ix - 50) * 100 + 50), -32768, 0, 0, 0, 5, 1) for ix in range(100) for iy in range(100)]
    return spark.createDataFrame(rows, "frame int, ring int, ix long, iy long, cls int, ground_z long, top_z long, clearance long, moving_frac long, conf long, count long, flags long")


def test_slope_and_kerb(spark):
    p = Preset.of("p", (5000, 100))
    ramp = stencil.derived(terrain(spark, lambda x: x), p)
    inner = ramp.filter("ix BETWEEN 1 AND 98 AND iy BETWEEN 1 AND 98")
    assert inner.filter(F.abs(F.col("slope_deg") - 45) > 1e-9).isEmpty()
    kerb = stencil.derived(terrain(spark, lambda x: 0 if x < 0 else 120), p)
    assert {r.ix for r in kerb.filter(stencil.has(16)).select("ix").distinct().collect()} == {49, 50}
    assert kerb.agg(F.max("step_mm")).first()[0] == 120


def test_poses(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    a = np.array([[c, -s, 0, 1], [s, c, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]])
    tr = np.array([[0, -1, 0, 0.1], [0, 0, -1, 0.2], [1, 0, 0, 0.3], [0, 0, 0, 1]])
    b = a @ np.array([[1, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), tr.ravel().tolist())], "a array<double>, b array<double>, tr array<double>")
    r = df.select(motion.relative_pose(F.col("a"), F.col("b"), F.col("tr")).alias("m"), motion.rotation_degrees(F.col("a")).alias("deg")).first()
    want = np.linalg.inv(tr) @ np.linalg.inv(a) @ b @ tr
    assert np.allclose(np.array(r.m).reshape(4, 4), want) and abs(r.deg - math.degrees(0.3)) < 1e-9


def test_still_and_moving_scenes(spark):
    pts = [(0, i, 10.0, 0.2 * (i % 7) - 0.6, -1.0 + 0.1 * (i % 5)) for i in range(200)]
    df = motion.projected(spark.createDataFrame(pts, "frame int, pid long, x double, y double, z double"))
    image = motion.range_image(df)
    assert {r.vote for r in motion.residual_votes(df, image).select("vote").distinct().collect()} == {0}
    near = motion.projected(spark.createDataFrame([(0, 1, 5.0, 0.0, -0.4)], "frame int, pid long, x double, y double, z double"))
    assert motion.residual_votes(near, image).first().vote in (1, -1)


def test_clusters_and_boxes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, (cx, cy) in enumerate(((5.0, 0.0), (9.0, 4.0))):
        for i in range(40 + 20 * k):
            rows.append((0, len(rows), cx + rng.uniform(-0.3, 0.3), cy + rng.uniform(-0.3, 0.3), 0.0))
    rows.append((0, len(rows), 30.0, 30.0, 0.0))
    df = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double")
    got = {r.pid: r.cluster for r in clusters.clustered(df).collect()}
    assert [got[0], got[45], got[len(rows) - 1]] == [1, 0, -1]
    assert {r.part for r in clusters.dbscan(df, 0.5, 5).collect()} == {-1, 0, 1}
    for yaw in (0.0, 30.0, 75.0):
        t = math.radians(yaw)
        pts = [(0, float(u * math.cos(t) - v * math.sin(t)), float(u * math.sin(t) + v * math.cos(t)), 0.0) for u in np.linspace(-2, 2, 9) for v in np.linspace(-1, 1, 5)]
        b = clusters.oriented_boxes(spark.createDataFrame(pts, "obj int, x double, y double, z double"), ["obj"]).first()
        assert abs(b.length - 4) < 1e-6 and abs(b.width - 2) < 1e-6 and abs(math.remainder(b.yaw - t, math.pi)) < 1e-6


def test_tracks(spark):
    eye = np.eye(4)
    state, seen = tracking.TrackState(), []
    for k in range(4):
        seen.append(tracking.fold_tracks(state, [{"name": "car", "x": 5 + k * 0.5, "y": 0.0, "z": 0.0, "moving": False, "instance": None}], eye if k else None, 0.1)[0])
    assert [o["track_id"] for o in seen] == [1, 1, 1, 1] and [o["moving"] for o in seen] == [False, True, True, True]
    assert abs(seen[3]["speed_mps"] - 5.0) < 1e-9
    for _ in range(3):
        tracking.fold_tracks(state, [], eye, 0.1)
    assert not state.tracks


def test_world_map_blends_and_expires(spark):
    rows = [("a", 0, 0, 1, 1, 100, -32768, 1, 1), ("a", 1, 0, 1, 1, 200, 50, 1, 1), ("a", 0, 0, 2, 2, 7, -32768, 1, 1)]
    df = spark.createDataFrame(rows, "seq string, frame int, ring int, row int, col int, ground_z long, top_z long, cls int, flags long")
    got = {(r.row, r.col): (r.ground_z, r.top_z, r.age) for r in tracking.world_map(df, 1).collect()}
    assert got == {(1, 1): (130, 50, 1), (2, 2): (7, -32768, 2)}
    assert {(r.row, r.col) for r in tracking.world_map(df, 59).collect()} == {(1, 1)}


def test_dataset_round_trip(spark, tmp_path):
    pts = synthetic.street(spark, [0, 1], beams=8, columns=64).withColumn("seq", F.lit("04"))
    pts = pts.withColumn("pid", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("frame").orderBy("pid")) - 1)
    assert pts.count() > 100
    scans.write_scans(pts, str(tmp_path))
    (tmp_path / "poses").mkdir()
    (tmp_path / "poses" / "04.txt").write_text("1 0 0 1 0 1 0 2 0 0 1 3\n1 0 0 2 0 1 0 2 0 0 1 3\n")
    (tmp_path / "sequences" / "04" / "calib.txt").write_text("P0: 1 0 0 0 0 1 0 0 0 0 1 0\nTr: 0 -1 0 0 0 0 -1 0 1 0 0 0\n")
    root = f"file://{tmp_path}"
    back = scans.labelled(scans.scans(spark, root), scans.labels(spark, root))
    cols = ["seq", "frame", "pid", "x", "y", "z", "raw"]
    assert grid.identical(back.select(*cols), pts.select("seq", "frame", F.col("pid").cast("long").alias("pid"), "x", "y", "z", "raw"))
    assert scans.scans(spark, root, stride=2).select("frame").distinct().count() == 1
    assert [r.pose[3] for r in scans.poses(spark, root).orderBy("frame").collect()] == [1.0, 2.0]
    assert {r.name for r in scans.calibrations(spark, root).collect()} == {"P0", "Tr"}
    assert scans.verified(spark, root).isEmpty()
    (tmp_path / "sequences" / "04" / "velodyne" / "000001.bin").write_bytes(b"123")
    assert "scan isn't whole points" in {r.problem for r in scans.verified(spark, root).collect()}


def test_wire_round_trip(spark):
    cells = spark.createDataFrame([(0, 0, 3, 4, -100, 200, 3, 1, 0, 255, 9), (0, 0, 1, 2, 5, -32768, 1, 2, 7, 8, 1)], "frame int, ring int, iy long, ix long, ground_z long, top_z long, flags long, cls int, moving_frac long, conf long, count long")
    back = wire.unpacked(wire.packed(cells))
    assert sorted(tuple(r) for r in back.select("iy", "ix", "ground_z", "top_z", "conf").collect()) == [(1, 2, 5, -32768, 8), (3, 4, -100, 200, 255)]


def test_stream_equals_batch(spark, tmp_path):
    from terrafold.streaming import playback

    rows = [("s", f, i, 100 * i - 400, 50 * f, 10, 1, False, 9) for f in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "seq string, frame int, pid long, x_mm long, y_mm long, z_mm long, cls int, moving boolean, conf int")
    df.repartition(3, "frame").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = playback.frames(spark, str(tmp_path / "in"), df.schema)
    playback.play(stream, PRESETS["tiny_test"], lambda c, k: c.write.mode("append").parquet(out), str(tmp_path / "ck")).awaitTermination()
    assert grid.identical(spark.read.parquet(out), grid.cells_of(df, PRESETS["tiny_test"], ("seq", "frame")))
    assert DEFAULTS.contact_height_mm == 300
