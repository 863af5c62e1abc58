"""Queries that once read a part of their table, over whole tables and against plain Python."""

import time

import numpy as np

import terrafold.plans.more_queries  # noqa: F401
from terrafold.operators import tracking
from terrafold.operators.tracking import TrackState, fold_tracks
from terrafold.plans.queries import QUERIES
from terrafold.sources import scans


def test_stride_numbers_all_frames_by_ranges(spark, tmp_path):
    frames = sorted(set(np.random.default_rng(3).integers(-500, 100_000, 2000).tolist()))
    spark.createDataFrame([(f,) for f in reversed(frames)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    kept = frames[::3]
    want = [(f, k, k - len(kept)) for k, f in enumerate(kept)]
    assert sorted(map(tuple, QUERIES["SRC-07_18_stride"](spark, str(tmp_path)).collect())) == want
    df = spark.createDataFrame([(f,) for f in frames], "frame long")
    assert sorted(map(tuple, scans.strided(df, 3, range_rows=150).collect())) == want
    assert scans.strided(df.limit(0), 3).count() == 0


def test_tracker_folds_every_user(spark, tmp_path):
    rng = np.random.default_rng(4)
    users = (0, 39, 40, 77, 1499)
    rows = [(i, int(rng.integers(0, 25)), users[i % 5], float(rng.uniform(0, 100))) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, second long, user_id long, value double")
    df.selectExpr("event_id", "timestamp_seconds(second) AS ts", "user_id", "value").write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for u in users:
        state, own = TrackState(), [r for r in rows if r[2] == u]
        for frame, second in enumerate(sorted({r[1] for r in own})):
            objects = [
                {"obj": i, "name": "person" if i % 2 else "car", "x": v % 3, "y": v % 2, "z": 0.0, "moving": i % 3 == 0, "instance": None}
                for i, t, _, v in sorted(own)
                if t == second
            ]
            for o in fold_tracks(state, objects, np.eye(4) if frame else None, 0.1):
                want.append((str(u), frame, o["obj"], o["track_id"], o["moving"], None if o["speed_mps"] is None else round(o["speed_mps"], 4)))
    got = [(*r[:5], None if r[5] is None else round(r[5], 4)) for r in QUERIES["ST-01_tracker"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) == len(rows)


def test_tracks_fold_quickly_and_alike_by_numbers_and_arrays(monkeypatch):
    """Small frames in plain numbers, large ones in arrays: the same tracks; a long sequence of small frames takes seconds, not minutes."""
    rng = np.random.default_rng(6)
    eye = np.eye(4)
    eye[0, 3] = 0.25

    def folded(frames):
        state, out = TrackState(), []
        for k, objects in enumerate(frames):
            out += [(o["track_id"], o["moving"], o["speed_mps"], o["vx"]) for o in fold_tracks(state, objects, eye if k else None, 0.1)]
        return out

    def frames(n, most):
        sizes = rng.integers(0, most, n).tolist()
        return [[{"name": ("car", "moving-car", "person")[j % 3], "x": x, "y": y, "z": z, "moving": j % 4 == 0, "instance": (None, 3, 4)[j % 7 % 3]} for j, (x, y, z) in enumerate(rng.integers(0, 6, (m, 3)).astype(float).tolist())] for m in sizes]

    some = frames(60, 40)
    monkeypatch.setattr(tracking, "MANY_PAIRS", 0, raising=False)
    by_arrays = folded(some)
    monkeypatch.setattr(tracking, "MANY_PAIRS", 10**9, raising=False)
    assert folded(some) == by_arrays
    many = frames(20_000, 3)
    began = time.process_time()
    assert len(folded(many)) == sum(map(len, many))
    assert time.process_time() - began < 1.2  # 60 microseconds a frame
