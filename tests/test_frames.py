"""Whole scans: generated streets through files, layers, objects, predictions, commands and streams."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold import __main__ as commands
from terrafold import config, reports
from terrafold.config import DEFAULTS, PRESETS, ConfigError, Preset
from terrafold.functions import labels as L
from terrafold.operators import clusters, earlier, grid, hazards, metrics, motion, networks, objects, stencil, tracking, wire
from terrafold.pipeline import mapped, registered
from terrafold.sources import decode, scans, synthetic
from terrafold.streaming import playback

TR = (0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, -0.08, 1.0, 0.0, 0.0, -0.27, 0.0, 0.0, 0.0, 1.0)
N = 3


@pytest.fixture(scope="module")
def street(spark, tmp_path_factory):
    """A dataset of four scans on disk, its folder and its points."""
    root = tmp_path_factory.mktemp("data")
    path = synthetic.trajectory(spark, N)
    points = synthetic.rendered(synthetic.scene(spark, 7), path, beams=32, columns=256).withColumn("seq", F.lit("04"))
    points.write.parquet(str(root / "points"))
    points = spark.read.parquet(str(root / "points"))
    scans.write_scans(points.withColumn("remission", F.col("remission")), str(root))
    number = lambda m: " ".join(repr(float(v)) for v in m[:12])
    (root / "poses").mkdir()
    rows = sorted(synthetic.camera_poses(path, TR).collect(), key=lambda r: r.frame)
    (root / "poses" / "04.txt").write_text("\n".join(number(r.pose) for r in rows) + "\n")
    seq = root / "sequences" / "04"
    (seq / "calib.txt").write_text("".join(f"{n}: {number(np.eye(4).ravel())}\n" for n in ("P0", "P1", "P2", "P3")) + f"Tr: {number(TR)}\n")
    (seq / "times.txt").write_text("\n".join(str(r.ts) for r in rows) + "\n")
    return str(root), points


def test_generated_street(spark, street):
    _, points = street
    rows = points.filter("frame = 0").collect()
    assert {40, 48, 72, 50, 80, 10} <= {r.raw & 65535 for r in rows} and len({(r.frame, r.pid) for r in rows}) == len(rows)
    road = [r for r in rows if r.raw == 40]
    assert all(abs(r.z + 1.73) < 0.05 and abs(r.y) < 5.3 for r in road) and all(2.5 <= np.hypot(np.hypot(r.x, r.y), r.z) <= 120.1 for r in rows)
    poses = {r.frame: r.pose for r in synthetic.trajectory(spark, 5, dt=0.5).collect()}
    x = y = 0.0
    for k in range(5):
        assert np.allclose((poses[k][3], poses[k][7]), (x, y))
        yaw = 0.035 * np.sin(0.8 * k * 0.5)
        x, y = x + 4.0 * np.cos(yaw), y + 4.0 * np.sin(yaw)
    # Every box that a ray meets is found in the columns it is sent to: all columns give the same scan.
    one, path = synthetic.scene(spark, 7).filter("box < 12"), synthetic.trajectory(spark, 1)
    want = sorted((r.pid, r.raw) for r in synthetic.rendered(one, path, 16, 128, noise=0.0).collect())
    boxes = [r.asDict() for r in one.collect()]
    got = []
    for pid in range(16 * 128):
        pitch, yaw = np.radians(2.0 - (pid // 128) * 26.8 / 15), (pid % 128 + 0.5) * 2 * np.pi / 128 - np.pi
        d = np.array([np.cos(pitch) * np.cos(yaw), np.cos(pitch) * np.sin(yaw), np.sin(pitch)])
        hits = []
        for z, a, b, raw in ((-1.73, 0, 5, 40), (-1.61, 5, 8, 48), (-1.68, 8, 1e9, 72)):
            if d[2] < 0 and a <= abs(z / d[2] * d[1]) < b:
                far = abs(z / d[2] * d[1])
                hits.append((z / d[2], 60 if raw == 40 and 1.95 < far < 2.1 else raw))
        for x in boxes:
            lo, hi = np.array([x["x0"], x["y0"], x["z0"]]) / d, np.array([x["x1"], x["y1"], x["z1"]]) / d
            enter, leave = np.minimum(lo, hi).max(), np.maximum(lo, hi).min()
            if 0 < enter <= leave:
                hits.append((enter, x["raw"] + 65536 * x["instance"]))
        if hits and 2.5 <= min(hits)[0] <= 120:
            got.append((pid, min(hits)[1]))
    assert got == want


def test_files_and_checks(spark, street, tmp_path):
    root, points = street
    back = scans.labelled(scans.scans(spark, root), scans.labels(spark, root))
    assert back.count() == points.count() and back.agg(F.sum("raw")).first()[0] == points.agg(F.sum("raw")).first()[0]
    assert scans.scans(spark, root, seq="04", frame=2).select("frame").distinct().collect() == [(2,)]
    assert scans.scans(spark, root, stride=2).select("frame").distinct().count() == 2
    assert scans.verified(spark, root).isEmpty() and scans.report(scans.verified(spark, root)) == "[PASS]"
    found = {r.frame: r for r in scans.frames(spark, root).collect()}
    assert sorted(found) == list(range(N)) and abs(found[2].ts - 0.2) < 1e-9 and np.allclose(found[1].tr, TR)
    import shutil

    bad = tmp_path / "bad"
    shutil.copytree(f"{root}/sequences", bad / "sequences")
    seq = bad / "sequences" / "04"
    (seq / "velodyne" / "000001.bin").write_bytes(b"123")
    (seq / "labels" / "000002.label").unlink()
    (seq / "labels" / "000009.label").write_bytes(b"0000")
    (seq / "velodyne" / "000000.bin").write_bytes(np.full((5, 4), np.nan, "<f4").tobytes())
    (seq / "times.txt").write_text("0\n")
    (seq / "calib.txt").write_text((seq / "calib.txt").read_text().replace("P2", "Q2"))
    problems = {(r.frame, r.problem) for r in scans.verified(spark, str(bad)).collect()}
    assert {(1, "scan isn't whole points"), (2, "scan without labels"), (9, "labels without a scan"), (0, "points and labels differ in number"), (0, "values aren't finite")} <= problems
    assert {(None, "times and scans differ in number"), (None, "calibration doesn't parse"), (None, "poses are missing")} <= problems
    assert scans.report(scans.verified(spark, str(bad))).startswith("[FAIL] 04")
    with pytest.raises(Exception, match="lacks P2"):
        scans.calibrations(spark, str(bad)).collect()
    # A pose file beside the calibration counts only where the shared folder has none.
    (seq / "poses.txt").write_text("1 0 0 9 0 1 0 0 0 0 1 0\n")
    assert scans.poses(spark, str(bad)).first().pose[3] == 9.0
    (bad / "poses").mkdir()
    (bad / "poses" / "04.txt").write_text("1 0 0 5 0 1 0 0 0 0 1 0\n")
    assert [r.pose[3] for r in scans.poses(spark, str(bad)).collect()] == [5.0]


def test_predictions(spark, street, tmp_path):
    root, points = street
    said = scans.oracle_predictions(points)
    path = str(tmp_path / "cache")
    assert scans.write_predictions(said.filter("frame < 2"), path, {"model": "oracle"}) == 2
    assert scans.write_predictions(said, path) == 1 and scans.write_predictions(said, path) == 0
    back = scans.read_predictions(spark, path)
    assert back.count() == points.count() and back.exceptAll(said.select(*back.columns)).isEmpty()
    meta = spark.read.parquet(f"{path}-meta").collect()
    assert sorted(r.n_frames for r in meta) == [0, 1, 2] and {"model": "oracle"} in [r.meta for r in meta]
    folder = tmp_path / "npz" / "04"
    folder.mkdir(parents=True)
    rows = points.filter("frame = 0").orderBy("pid").collect()
    np.savez_compressed(folder / "000000.npz", raw_ids=np.array([min(r.raw & 65535, 99) for r in rows], np.uint8), conf=np.full(len(rows), 7, np.uint8))
    np.save(folder / "000001.npy", np.array([40, 50], np.uint8))
    (folder / "000002.label").write_bytes(np.array([40 + 65536], "<u4").tobytes())
    got = scans.archived_predictions(spark, str(tmp_path / "npz")).collect()
    assert sum(r.frame == 0 and r.conf == 7 for r in got) == len(rows) and [(r.raw_id, r.conf) for r in sorted(got) if r.frame > 0] == [(40, 255), (50, 255), (40, 255)]
    np.savez(folder / "000003.npz", raw_ids=np.zeros(3, np.uint8), conf=np.zeros(2, np.uint8))
    with pytest.raises(Exception, match="equally long"):
        scans.archived_predictions(spark, str(tmp_path / "npz")).count()
    with pytest.raises(Exception, match="differ in number"):
        mapped(points, PRESETS["tiny_test"], predictions=said.filter("pid % 2 = 0")).cells.count()


def test_map_and_views(spark, street):
    _, points = street
    preset = PRESETS["tiny_test"]
    made = mapped(points.filter("frame = 0"), preset)
    counts = made.counters.collect()
    assert len(counts) == 1 and all(r.n_raw == r.n_invalid + r.n_in_grid + r.n_out_of_grid for r in counts)
    registered(points, preset, made)
    things = spark.sql("SELECT * FROM objects").collect()
    assert any(t.name == "moving-car" and t.moving for t in things)
    assert all(t.length >= t.width > 0 and t.n >= DEFAULTS.min_points for t in things)
    assert spark.sql("SELECT count(*) FROM label_dim").first()[0] == 34 and spark.sql("SELECT count(*) FROM rings").first()[0] == 3


def test_estimated_motion(spark):
    """A wall, a parked and a moving box, seen from the same place twice."""
    rng = np.random.default_rng(3)
    rows = []

    def box(x, y, sem, first):
        for k in range(150):
            rows.append((0, first + k, float(x + rng.uniform(0, 2)), float(y + rng.uniform(0, 1.5)), float(rng.uniform(-1.5, 0)), sem, 3, False, 255))

    box(8, -6, 10, 0)  # parked
    box(12, 3, 10, 200)  # moves away along the line of sight
    box(6, 8, 50, 400)  # a wall
    old = [(*r[:2], *(v * (0.7 if 200 <= r[1] < 350 else 1.0) for v in r[2:5]), *r[5:]) for r in rows]
    rows += [(0, 600 + k, 5.0 + 0.1 * k, 0.0, -1.0, 30, 4, True, 255) for k in range(6)]  # somebody stands
    names = "frame int, pid long, x double, y double, z double, sem long, cls int, moving boolean, conf int"
    now = spark.createDataFrame(rows, names)
    before = spark.createDataFrame(old, names).select("frame", F.explode(F.array(F.lit(1), F.lit(2))).alias("gap"), "x", "y", "z")
    got = objects.estimated(now, before)
    points = {r.pid: r for r in got.points.collect()}
    assert not any(points[k].moving for k in range(150)) and all(points[k].cls == 3 for k in range(150))
    assert all(points[k].moving and points[k].cls == 4 for k in range(200, 350))
    assert all(points[k].cluster == -1 and points[k].cls == 3 for k in range(400, 550))
    things = {r.name if not r.moving else r.name + "!": r for r in got.objects.collect()}
    assert set(things) == {"car", "car!", "person!"} and things["car!"].critical and not things["car"].critical and things["person!"].n == 6
    alone = objects.estimated(now, None)
    assert {r.name for r in alone.objects.filter("moving").collect()} == {"person"}
    assert objects.estimated(now.limit(0), None).objects.isEmpty()
    # With occlusion, what an earlier scan saw in front explains a point.
    seen = motion.projected(now.filter("pid < 150"))
    near = motion.range_image(motion.projected(now.filter("pid < 150").withColumns({c: F.col(c) * 0.5 for c in "xyz"})))
    votes = {o: {r.vote: r.n for r in motion.residual_votes(seen, near, occlusion=o).groupBy("vote").agg(F.count(F.lit(1)).alias("n")).collect()} for o in (False, True)}
    assert votes[False].get(1, 0) > 0 and votes[True].get(1, 0) == 0


def test_wide_instances_are_split(spark):
    rows = [(0, k, float(k % 10) * 0.1 + (8.0 if k >= 40 else 0.0), 0.1 * (k % 7), 0.0, 10 + (1 << 16), 3, False, 9) for k in range(80)]
    rows += [(0, 100 + k, 30.0 + 3 * k, 0.0, 0.0, 10 + (2 << 16), 3, False, 9) for k in range(6)]  # all noise: one object
    rows += [(0, 200 + k, 0.0, 40.0 + 0.1 * k, 0.0, 70 + (3 << 16), 3, False, 9) for k in range(9)]  # a plant isn't an object
    p = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double, raw long, cls int, moving boolean, conf int")
    got = sorted(r.obj for r in objects.from_instances(p).objects.collect())
    assert got == [2, 100, 101]


def test_commands(spark, street, tmp_path, capsys):
    root, _ = street
    assert commands.main(["inspect", root, "--seq", "04", "--frame", "0"], spark) == 0
    assert "road" in capsys.readouterr().out
    assert commands.main(["stats", root, "--json", str(tmp_path / "s.json"), "--table", str(tmp_path / "s.md")], spark) == 0
    text = (tmp_path / "s.md").read_text()
    assert "DRIVABLE" in text and "Sequence 04" in text
    total = [r for r in json.loads((tmp_path / "s.json").read_text())["stats"] if r["all_classes"] and r["all_buckets"]]
    assert total[0]["n"] == scans.scans(spark, root).count()
    with pytest.raises(ConfigError):
        commands.main(["map", root, "--rings", "2", "0.05", "1", "0.1"], spark)


def test_alignment(spark, street):
    root, points = street
    got = commands.aligned(points, scans.frames(spark, root), 2, 1)
    by = {k["kind"]: k for k in got["kinds"]}
    assert got["pairs"] == 2 and by["large"]["median"] < by["control"]["median"]
    assert "| gap |" in reports.motion_markdown(spark.createDataFrame([(1, 2, 3, 4, 0.5, None)], "gap int, tp int, fp int, fn int, iou double, parked_fpr double"))


def test_settings_from_files(tmp_path):
    (tmp_path / "grid.yaml").write_text("extent_m: 12\nmin_range_m: 0.5\nactive_preset: a\npresets: {a: {rings: [{r: 2, cell: 0.05}, {r: 12, cell: 0.5}]}}\n")
    (tmp_path / "derived.yaml").write_text("kerb_min_m: 0.05\n")
    preset, presets, settings = config.load(tmp_path)
    assert preset == Preset.of("a", (2000, 50), (12000, 500)) and (settings.min_range_mm, settings.kerb_min_mm) == (500, 50)
    for name, text in (("derived.yaml", "kerb_max_m: 0.5\n"), ("derived.yaml", "kerb_min_m: abc\n"), ("grid.yaml", "active_preset: b\npresets: {a: {rings: [{r: 2, cell: 0.05}]}}\n"), ("grid.yaml", "extent_m: 13\npresets: {a: {rings: [{r: 2, cell: 0.05}]}}\n"), ("grid.yaml", "- 1\n"), ("grid.yaml", "presets: {a: {rings: [{r: 2, cell: 0.0505}]}}\n")):
        was = (tmp_path / name).read_text()
        (tmp_path / name).write_text(text)
        with pytest.raises(ConfigError):
            config.load(tmp_path)
        (tmp_path / name).write_text(was)
    (tmp_path / "grid.yaml").unlink()
    with pytest.raises(ConfigError):
        config.load(tmp_path)


def test_nearest_has_no_bound(spark):
    names = "frame int, pid long, x double, y double, z double"
    left = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 3.0, 0.0, 0.0), (1, 3, 0.0, 0.0, 0.0)], names)
    right = spark.createDataFrame([(0, 0, 5000.0, 0.0, 0.0), (0, 0, 4.0, 0.0, 0.0), (0, 0, 1e5, 0.0, 0.0)], names)
    far = clusters.nearest(left, right.filter("x > 10"), 8.0)
    assert sorted((r.pid, r.distance) for r in far.collect()) == [(1, 5000.0), (2, 4997.0)]
    assert len(far._jdf.queryExecution().toString()) < 100_000
    assert sorted((r.pid, r.distance) for r in clusters.nearest(left, right, 0.5).collect()) == [(1, 4.0), (2, 1.0)]
    assert clusters.nearest(left, right.limit(0), 1.0).isEmpty()


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=5000), "b": rng.integers(0, 3, 700).astype(float), "c": np.array([2.0]), None: rng.normal(size=2)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in metrics.percentiles(df, "v", ["k"], at).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        assert got[k].n == len(x) and all(abs(got[k][n] - np.quantile(x, q)) < 1e-5 for n, q in at.items())
    whole = metrics.percentiles(df.filter("k = 'b'"), "v", [], {"p90": 0.9}).first()
    assert abs(whole.p90 - np.quantile(values["b"], 0.9)) < 1e-9 and whole.n == 700


def test_hazards_show_where_they_are(spark):
    rng = np.random.default_rng(5)
    rows = [(0, k, int(x), int(y), int(-1700 + rng.integers(-3, 4)), 1, False, 255) for k, (x, y) in enumerate(rng.integers(-5000, 5000, (60000, 2)))]
    p = spark.createDataFrame(rows, "frame int, pid long, x_mm long, y_mm long, z_mm long, cls int, moving boolean, conf int")
    preset = Preset.of("one", (6000, 200))
    flat = stencil.derived(grid.cells_of(p, preset), preset)
    rates = {r.kind: r for r in metrics.detection_rates(hazards.detection(p, preset, 6, 1), ["kind"]).filter("all_kind = 0").collect()}
    assert rates["kerb"].rate == rates["overhang"].rate == 1.0 and rates["pothole"].n == 6
    unchanged = hazards.hazard_rows(hazards.trials(p, 6, 1)).drop("all")
    hits = {(r.kind, r.hit) for r in hazards.detected(unchanged, flat, preset).select("kind", "hit").collect()}
    assert ("kerb", True) not in hits and ("pothole", True) not in hits
    assert hazards.trials(p.limit(9), 3, 1).isEmpty()


def test_counts_are_guarded(spark):
    p = spark.createDataFrame([(0, 10, 10, 0, 1, False, 5)] * 4 + [(0, 10**6, 0, 0, 1, False, 5)], "frame int, x_mm long, y_mm long, z_mm long, cls int, moving boolean, conf int")
    preset = PRESETS["tiny_test"]
    held = grid.accumulate(grid.locate(p, preset))
    assert grid.conserved(grid.counters(p, preset), held).first().n_out_of_grid == 1
    with pytest.raises(Exception, match="got lost"):
        grid.conserved(grid.counters(p, preset), held.limit(0)).collect()
    with pytest.raises(Exception, match="exceeds"):
        grid.guarded(held, {"n1": 3}).collect()
    assert grid.strict_mm(F.lit(1.2345)) is not None and spark.range(1).select(grid.strict_mm(F.lit(1.2345)).alias("v")).first().v == 1234
    for bad in (float("nan"), float("inf"), 3e6):
        with pytest.raises(Exception, match="isn't finite or beyond"):
            spark.range(1).select(grid.strict_mm(F.lit(bad)).alias("v")).collect()
    with pytest.raises(Exception, match="out of range"):
        metrics.checked_ids(spark.createDataFrame([(20,)], "gt long"), 19, "gt").collect()


def plain_tracker(frames):
    """Tracks by the rules, one object and one track at a time."""
    tracks, next_id, out = [], 1, []
    for k, objects_ in enumerate(frames):
        shift = np.array([0.5, 0.0, 0.0])  # the vehicle moves by half a metre a frame
        free = {id(t): t for t in tracks} if k else {}
        pairs = sorted(((np.linalg.norm(np.array(o["xyz"]) - (t["xyz"] - shift)), i, j) for i, o in enumerate(objects_) for j, t in enumerate(tracks)), key=lambda x: x[0]) if k else []
        taken = {}
        for far, i, j in pairs:
            o, t = objects_[i], tracks[j]
            same = o["name"].replace("moving-", "") == t["name"].replace("moving-", "")
            if far <= 2.0 and same and i not in taken and id(t) in free and (o["inst"] is None or t["inst"] is None or o["inst"] == t["inst"]):
                taken[i] = free.pop(id(t))
        for i, o in enumerate(objects_):
            moving, speed = o["moving"] or "person" in o["name"], None
            if i in taken:
                t = taken[i]
                v = (np.array(o["xyz"]) - (t["xyz"] - shift))[:2] / 0.1
                t["said"] = (t["said"] + [o["moving"]])[-3:]
                moving = moving or sum(t["said"]) >= 2 or (o["inst"] is None and t["missed"] == 0 and np.hypot(*v) >= 0.5)
                smooth = None
                if moving and t["missed"] == 0:
                    smooth = v if t["v"] is None else 0.75 * t["v"] + 0.25 * v
                    speed = float(np.hypot(*smooth)) if np.hypot(*smooth) >= 0.5 else None
                t.update(xyz=np.array(o["xyz"]), name=o["name"], inst=o["inst"], missed=0, v=smooth)
            else:
                t = {"id": next_id, "xyz": np.array(o["xyz"]), "name": o["name"], "inst": o["inst"], "missed": 0, "v": None, "said": [o["moving"]]}
                next_id += 1
                tracks.append(t)
            out.append((k, i, t["id"], moving, None if speed is None else round(speed, 6)))
        for t in free.values():
            t.update(missed=t["missed"] + 1, v=None)
        tracks = [t for t in tracks if t["missed"] <= 2]
    return out


def test_tracks_in_batches_and_streams(spark, tmp_path):
    rng = np.random.default_rng(11)
    frames = []
    for k in range(12):
        n = int(rng.integers(0, 7))
        frames.append([{"name": str(rng.choice(["car", "moving-car", "person"])), "xyz": tuple(rng.uniform(0, 3, 3).round(2).tolist()), "moving": bool(rng.random() < 0.3), "inst": None if rng.random() < 0.5 else int(rng.integers(1, 4))} for _ in range(n)])
    pose = np.eye(4)
    pose[0, 3] = -0.5
    rows = []
    for k, found in enumerate(frames):
        rows += [("a", k, i, o["name"], *o["xyz"], o["moving"], o["inst"], pose.ravel().tolist() if k else None, 0.1) for i, o in enumerate(found)]
        if not found:
            rows.append(("a", k, None, None, None, None, None, None, None, pose.ravel().tolist(), 0.1))
    names = "seq string, frame int, obj long, name string, x double, y double, z double, moving boolean, instance long, pose array<double>, dt double"
    table = spark.createDataFrame(rows, names)
    key = lambda t: sorted((r.frame, r.obj, r.track_id, r.moving, None if r.speed_mps is None else round(r.speed_mps, 6)) for r in t.collect())
    want = sorted(plain_tracker(frames), key=lambda r: r[:2])
    assert key(tracking.tracked(table)) == want
    for k in range(12):
        table.filter(F.col("frame") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = tracking.tracked_stream(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want
    # A jump of frames begins anew.
    jumped = tracking.tracked(spark.createDataFrame([("a", k, 0, "car", 0.0, 0.0, 0.0, False, None, np.eye(4).ravel().tolist(), 0.1) for k in (0, 1, 5)], names))
    assert [r.track_id for r in sorted(jumped.collect(), key=lambda r: r.frame)] == [1, 1, 1]


def test_world_maps_in_ranges_and_streams(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = sorted({(int(f), int(r), int(c)): (int(f), int(ring), int(r), int(c), int(rng.integers(-1800, -1500)), int(rng.integers(-100, 400)), int(rng.integers(0, 4)), 1) for f, ring, r, c in rng.integers(0, (150, 2, 4, 4), (400, 4))}.values())
    observed = spark.createDataFrame([("a", *r) for r in rows], "seq string, frame int, ring int, row int, col int, ground_z long, top_z long, cls int, flags long")
    state = {}
    for f, ring, r, c, gz, tz, cls, flags in rows:
        was = state.get((r, c))
        if was is None or f - was[4] >= tracking.LIFE:
            state[r, c] = (gz, tz, cls, flags, f)
        else:
            state[r, c] = (int(0.30 * gz + (1 - 0.30) * was[0]), max(was[1], tz), cls, flags, f)
    want = sorted((*k, *v[:4], 150 - v[4]) for k, v in state.items() if 150 - v[4] < tracking.LIFE)
    key = lambda t: sorted((r.row, r.col, r.ground_z, r.top_z, r.cls, r.flags, r.age) for r in t.collect())
    for frames in (1000, 64, 7):
        assert key(tracking.world_map(observed, 149, range_frames=frames)) == want
    world = tracking.WorldMap(spark, str(tmp_path / "w"))
    assert world.now(0) is None
    for k in range(10):
        part = observed.filter(F.col("frame").between(15 * k, 15 * k + 14))
        world.update(part, k)
        if k == 4:
            world.update(part, k)  # a batch that comes twice
    assert key(world.now(149)) == want
    world.reset()
    assert world.now(149) is None
    world.update(observed.filter("frame = 149"), 10)
    assert world.now(149).count() == sum(r[0] == 149 for r in rows)
    assert tracking.world_map(observed.limit(0), 3).isEmpty()


def test_streams_and_players(spark, street, tmp_path):
    _, points = street
    mm = grid.quantise(L.classified(points).withColumns({"cls": F.col("super_cls"), "moving": F.col("is_moving"), "conf": F.lit(255).cast("bigint")})).select("seq", "frame", "pid", "x_mm", "y_mm", "z_mm", "cls", "moving", "conf", "raw")
    for k in range(N):
        mm.filter(F.col("frame") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    preset, got = PRESETS["tiny_test"], []
    sink = lambda cells, k: got.append((k, sorted(r.frame for r in cells.select("frame").distinct().collect()), cells.count()))
    playback.play(playback.frames(spark, str(tmp_path / "p"), mm.schema), preset, sink, str(tmp_path / "c1")).awaitTermination()
    want = {r.frame: r.n for r in grid.cells_of(mm, preset).groupBy("frame").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [k for k, _, _ in got] == list(range(N)) and {f[0]: n for _, f, n in got} == want
    got.clear()
    playback.play(playback.frames(spark, str(tmp_path / "p"), mm.schema, start=2), preset, sink, str(tmp_path / "c2")).awaitTermination()
    assert sorted(f[0] for _, f, _ in got if f) == [2]
    pairs = playback.frames(spark, str(tmp_path / "p"), mm.schema).select(F.col("cls").alias("gt"), F.when(F.col("pid") % 3 == 0, 0).otherwise(F.col("cls")).alias("pred"))
    q = playback.confusion_so_far(pairs).writeStream.format("memory").queryName("so_far").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM so_far").first()[0] == mm.count()
    docs = mm.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n")).select("seq", "frame", F.to_json(F.struct("n")).alias("payload"))
    for k in (2, 0, 1):
        docs.filter(F.col("frame") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    playback.latest(stream, str(tmp_path / "last"), str(tmp_path / "c3")).awaitTermination()
    assert [r.frame for r in playback.last_of(spark, str(tmp_path / "last"), 2).collect()] == [2]
    spark.createDataFrame([(0.0,), (0.5,), (1.5,), (0.2,)], "s double").selectExpr("timestamp_seconds(s) AS ts").coalesce(1).write.parquet(str(tmp_path / "t"))
    seconds = playback.counts_by_second(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "t")))
    q = seconds.writeStream.format("memory").queryName("by_second").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("by_second").collect()) == [1, 3]
    shown = []
    player = playback.Player(spark, 3, lambda k: shown.append(k) or f"frame {k}", str(tmp_path / "c4"))
    assert player.joined() == "frame 0" and player.joined() == "frame 0" and shown == [0]
    assert player.step(-1) == "frame 2" and player.step() == "frame 0" and player.seek(99) == "frame 2" and not player.playing
    player.set_speed(99)
    assert player.state() == {"frame": 2, "frames": 3, "playing": False, "speed": 10.0}
    shown.clear()
    player.play()
    began = time.time()
    while len(shown) < 5 and time.time() - began < 60:
        time.sleep(0.1)
    player.pause()
    assert shown[:5] == [2, 0, 1, 2, 0] and not player.playing


def test_table_function(spark):
    decode.register(spark)
    data = np.arange(8, dtype="<f4").tobytes()
    spark.createDataFrame([(1, bytearray(data)), (2, None)], "id int, content binary").createOrReplaceTempView("files")
    got = spark.sql("SELECT id, p.* FROM files, LATERAL scan_points(content) p ORDER BY pid").collect()
    assert [(r.id, r.pid, r.x, r.remission) for r in got] == [(1, 0, 0.0, 3.0), (1, 1, 4.0, 7.0)]


def test_networks_data(spark, street):
    _, points = street
    one = points.filter("frame = 0")
    n = networks.point_normals(one, height=32, width=256, up=2.0, down=-24.8).filter("nz <> 0")
    assert n.filter("raw = 40").agg(F.percentile_approx(F.abs("nz"), 0.5)).first()[0] > 0.9
    assert networks.extended_geometry(((0, 0), (2, 4), (10, 20)), ((-2, -4), (4, 8), (30, 60))) == (0.2, 0.2)
    with pytest.raises(ValueError, match="differ"):
        networks.extended_geometry(((0,), (2,), (10,)), ((0,), (2,), (11,)))
    assert networks.file_sha256(__file__) and len(networks.file_sha256(__file__)) == 64
    turned = networks.turned(one.select("pid", "x", "y"), 90.0, flip_x=True).join(one.select("pid", F.col("x").alias("a"), F.col("y").alias("b")), "pid").filter("abs(x - b) > 1e-4 OR abs(y - a) > 1e-4")
    assert turned.isEmpty()
    dealt = networks.shuffled(one.select("frame", "pid"), 3)
    assert sorted(r.pid for r in dealt.collect()) == list(range(one.count()))
    assert networks.split(one.withColumn("seq", F.lit("11")), "test").agg(F.max("label")).first()[0] == 0 and networks.split(one, "val").isEmpty()
    near = earlier.residual_candidates(one.limit(50), one.limit(50).withColumn("x", F.col("x") + 0.01), 0.5)
    assert near.filter("candidate").isEmpty() and near.count() == 50
    assert stencil.cell_at(spark.createDataFrame([(0, 1, 2), (0, 1, 3)], "ring int, ix int, iy int"), 0, 1, 3).count() == 1
    drawn = scans.drawn_frames(points.select("seq", "frame").distinct(), 2, 5, ["seq"])
    assert drawn.count() == 2 and sorted(drawn.collect()) == sorted(scans.drawn_frames(points.select("seq", "frame").distinct(), 2, 5, ["seq"]).collect())
    assert reports.class_names()[10] == "car"
    assert wire.texture("class") is not None
    with pytest.raises(ValueError, match="no layer"):
        wire.texture("nothing")
