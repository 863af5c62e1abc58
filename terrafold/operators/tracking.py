"""Tracks of objects from frame to frame, and a world map that remembers static ground.

Both keep state. Tracks fold frame by frame with one function, which batches and streams call. The map folds ranges of
frames: what a range brings is joined to the map so far and folded in SQL, and a stream's batches are such ranges.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.config import DYNAMIC, FLAG_OBSTACLE, NO_DATA, Preset
from terrafold.functions.labels import VULNERABLE
from terrafold.operators.grid import all_cells, corners
from terrafold.shipping import ship_package
from terrafold.storage import written


@dataclass(frozen=True)
class TrackSettings:
    """Frames of history, moving frames that make a track move, gate, least speed, frames unseen, weight of the past."""

    window: int = 3
    hits: int = 2
    gate_m: float = 2.0
    least_mps: float = 0.5
    missed: int = 2
    past: float = 0.75


@dataclass(slots=True)
class Track:
    """kind is the name without moving-; instance None: none; velocity None: none; missed: frames unseen; moved: whether it
    said so in its last frames, newest last."""

    id: int
    kind: str
    instance: int | None
    centre: tuple[float, float, float]
    velocity: tuple[float, float] | None
    missed: int
    moved: tuple[bool, ...]


@dataclass
class TrackState:
    """Tracks, oldest first, the id of the next one and the last frame. Frames hold few objects, so plain numbers are faster than arrays."""

    tracks: list[Track] = field(default_factory=list)
    next_id: int = 1
    frame: int | None = None

    def to_json(self) -> str:
        return json.dumps({"tracks": [[getattr(t, k) for k in Track.__slots__] for t in self.tracks], "next_id": self.next_id, "frame": self.frame})

    @classmethod
    def from_json(cls, text: str) -> TrackState:
        d = json.loads(text)
        tracks = [Track(*(tuple(v) if isinstance(v, list) else v for v in t)) for t in d["tracks"]]
        return cls(tracks, d["next_id"], d["frame"])


#: From so many pairs of an object and a track on, they are compared by arrays.
MANY_PAIRS = 256


def _pairs(objects: list[dict], kinds: list[str], instances: list[int | None], tracks: list[Track], before: list[tuple[float, float, float]], gate: float) -> dict[int, int]:
    """The track of each object that goes on with one: of all allowed pairs the nearest first, each object and track once;
    ties go to the first object, then track."""
    if len(objects) * len(tracks) < MANY_PAIRS:
        allowed = []
        for i, o in enumerate(objects):
            for j, t in enumerate(tracks):
                if kinds[i] == t.kind and (instances[i] is None or t.instance is None or instances[i] == t.instance):
                    dx, dy, dz = o["x"] - before[j][0], o["y"] - before[j][1], o["z"] - before[j][2]
                    apart = math.sqrt(dx * dx + dy * dy + dz * dz)
                    if apart <= gate:
                        allowed.append((apart, i, j))
        allowed = [(i, j) for _, i, j in sorted(allowed)]
    else:
        here, there = np.array([(o["x"], o["y"], o["z"]) for o in objects], float), np.array(before)
        square = sum((here[:, None, k] - there[None, :, k]) ** 2 for k in range(3))
        own, other = (np.array([-1 if v is None else v for v in values], np.int64) for values in (instances, [t.instance for t in tracks]))
        clash = (own[:, None] >= 0) & (other[None] >= 0) & (own[:, None] != other[None])
        same = np.array(kinds, object)[:, None] == np.array([t.kind for t in tracks], object)[None]
        apart = np.sqrt(square)
        i, j = np.nonzero((apart <= gate) & same & ~clash)
        order = np.argsort(apart[i, j], kind="stable")  # i and j ascend
        allowed = zip(i[order].tolist(), j[order].tolist(), strict=True)
    pair, taken = {}, set()
    most = min(len(objects), len(tracks))
    for i, j in allowed:
        if i not in pair and j not in taken:
            pair[i] = j
            taken.add(j)
            if len(pair) == most:
                break
    return pair


def fold_tracks(state: TrackState, objects: list[dict], pose: np.ndarray | Sequence[float] | None, dt: float, s: TrackSettings = TrackSettings()) -> list[dict]:
    """Move the state on by one frame; returns the objects with track_id, moving, speed_mps, vx and vy.

    objects: name, x, y, z, moving, instance (or None). pose (4 x 4, or its 16 numbers by rows) leads from the previous frame to
    this one; without it every object begins a track. An object may go on with a track of its kind whose place, moved by pose, lies
    within the gate, unless both have instances and these differ. An object moves if it says so, is a vulnerable road user, said so in
    enough of its track's last frames, or, without an instance, is faster than the least speed since the frame before.
    Velocities of what moves are smoothed, turned into this frame's axes; slow ones aren't told.
    """
    tracks, pair, before = state.tracks, {}, []
    kinds = [o["name"].removeprefix("moving-") for o in objects]
    instances = [None if o["instance"] is None or o["instance"] < 0 else o["instance"] for o in objects]
    if pose is not None and tracks and objects:
        m = pose if isinstance(pose, list) else np.asarray(pose, float).ravel().tolist()
        for t in tracks:
            x, y, z = t.centre
            before.append((m[0] * x + m[1] * y + m[2] * z + m[3], m[4] * x + m[5] * y + m[6] * z + m[7], m[8] * x + m[9] * y + m[10] * z + m[11]))
        pair = _pairs(objects, kinds, instances, tracks, before, s.gate_m)
    out, new = [], []
    for i, o in enumerate(objects):
        says, centre, velocity = bool(o["moving"]), (o["x"], o["y"], o["z"]), None
        moving, j = says or o["name"] in VULNERABLE, pair.get(i)
        if j is None:
            t = Track(state.next_id, kinds[i], instances[i], centre, None, 0, (False,) * (s.window - 1) + (says,))
            state.next_id += 1
            new.append(t)
        else:
            t, seen = tracks[j], tracks[j].missed == 0
            now = (centre[0] - before[j][0]) / max(1e-4, dt), (centre[1] - before[j][1]) / max(1e-4, dt)
            t.moved = (*t.moved[1:], says)
            moving = moving or sum(t.moved) >= s.hits or (instances[i] is None and seen and math.hypot(*now) >= s.least_mps)
            if moving and seen:
                velocity = now
                if t.velocity is not None:
                    x, y = t.velocity
                    velocity = s.past * (m[0] * x + m[1] * y) + (1 - s.past) * now[0], s.past * (m[4] * x + m[5] * y) + (1 - s.past) * now[1]
            t.instance, t.centre, t.velocity, t.missed = instances[i], centre, velocity, 0
        speed = None if velocity is None else math.hypot(*velocity)
        vx, vy = velocity if speed is not None and speed >= s.least_mps else (None, None)
        out.append(o | {"track_id": t.id, "moving": moving, "speed_mps": None if vx is None else speed, "vx": vx, "vy": vy})
    if pose is not None or not objects:
        seen_now = set(pair.values())
        for j, t in enumerate(tracks):
            if j not in seen_now:
                t.missed, t.velocity = t.missed + 1, None
        tracks = [t for t in tracks if t.missed <= s.missed]
    state.tracks = tracks + new
    return out


TRACKED = "seq string, frame int, obj long, track_id long, moving boolean, speed_mps double, vx double, vy double"


_TYPES = pa.schema([("seq", pa.string()), ("frame", pa.int32()), ("obj", pa.int64()), ("track_id", pa.int64()), ("moving", pa.bool_()), ("speed_mps", pa.float64()), ("vx", pa.float64()), ("vy", pa.float64())])
_INPUT = {"seq": "string", "frame": "int", "obj": "long", "name": "string", "x": "double", "y": "double", "z": "double", "moving": "boolean", "instance": "long", "pose": "array<double>", "dt": "double"}


def _fold_frame(state: TrackState, rows: list[tuple], out: list[tuple]) -> None:
    """Fold the rows of a frame, each as _INPUT has it, and append rows as TRACKED has them."""
    seq, frame, *_, pose, dt = rows[0]
    if state.frame is not None and frame != state.frame + 1:
        state.tracks, state.next_id, state.frame = [], 1, None  # a jump begins anew
    objects = [{"obj": r[2], "name": r[3], "x": r[4], "y": r[5], "z": r[6], "moving": r[7], "instance": r[8]} for r in rows if r[2] is not None]
    pose = None if state.frame is None else pose
    state.frame = frame
    for o in fold_tracks(state, objects, pose, dt or 0.1):
        out.append((seq, frame, o["obj"], o["track_id"], o["moving"], o["speed_mps"], o["vx"], o["vy"]))


def _tracked(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPES, strict=True)], schema=_TYPES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as _INPUT has them; null coordinates are not numbers, and equal poses that follow each other are one list."""
    columns = {c: batch.column(c) for c in _INPUT}
    for c in "xyz":
        columns[c] = columns[c].fill_null(math.nan)
    pose = columns["pose"]
    sizes = pose.value_lengths().to_numpy(zero_copy_only=False)
    poses: list = [None] * len(pose)
    if len(pose) and (sizes == 16).all() and not pose.flatten().null_count:
        flat = pose.flatten().to_numpy().reshape(-1, 16)
        for k in np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]).any(1))).tolist():
            poses[k] = flat[k].tolist()
        for k in range(1, len(poses)):
            poses[k] = poses[k] or poses[k - 1]
    else:
        poses = pose.to_pylist()
    return zip(*(poses if c == "pose" else columns[c].to_pylist() for c in _INPUT), strict=True)


def tracked(objects: DataFrame) -> DataFrame:
    """Tracks of objects (seq, frame, obj, name, x, y, z, moving, instance, pose, dt), each sequence folded by frame.

    pose is the transform from the frame before, null for none. A frame without objects is a row with a null obj.
    Sequences are read in order, so a task holds one frame and the tracks of one sequence.
    """

    ship_package(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, out = TrackState(), [], []
        for batch in batches:
            for row in _rows(batch):
                if held and (row[1] != held[0][1] or row[0] != held[0][0]):
                    _fold_frame(state, held, out)
                    if row[0] != held[0][0]:
                        state = TrackState()
                    held = []
                held.append(row)
            yield _tracked(out)
            out = []
        if held:
            _fold_frame(state, held, out)
            yield _tracked(out)

    rows = objects.select(*(F.col(c).cast(t).alias(c) for c, t in _INPUT.items()))
    return rows.repartition("seq").sortWithinPartitions("seq", "frame", F.col("obj").asc_nulls_last()).mapInArrow(run, TRACKED)


def tracked_stream(objects: DataFrame) -> DataFrame:
    """tracked() over a stream whose batches hold whole frames in order; state is kept by sequence."""
    ship_package(objects.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = TrackState.from_json(held.get[0]) if held.exists else TrackState()
        rows = pd.concat(list(batches)).sort_values(["frame", "obj"])
        values = [[None if v is None or v is pd.NA or (v != v and c not in "xyz") else v for v in (rows[c] if c != "pose" else (None if p is None else [float(x) for x in p] for p in rows[c]))] for c in _INPUT]
        out = []
        for _, frame in groupby(zip(*values, strict=True), key=lambda r: r[1]):
            _fold_frame(state, [(*r[:1], int(r[1]), None if r[2] is None else int(r[2]), *r[3:8], None if r[8] is None else int(r[8]), *r[9:]) for r in frame], out)
        held.update((state.to_json(),))
        yield pd.DataFrame(out, columns=_TYPES.names)

    return objects.groupBy("seq").applyInPandasWithState(run, TRACKED, "state string", "append", "NoTimeout")


def moving_by_hits(objects: DataFrame, window: int = 3, hits: int = 2, keys: Sequence[str] = ("seq", "track_id")) -> DataFrame:
    """Whether a track moved in enough of its last frames: the tracker's memory as a window."""
    own = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(window - 1), 0)
    return objects.withColumn("hits", F.count_if(F.col("moving")).over(own)).withColumn("moves", F.col("hits") >= hits)


#: Fixed values of the world map: weight of a new height, frames a cell lives unseen, points a cell must exceed.
BLEND, LIFE, TRUST = 0.30, 60, 2


def _in_world(cells: DataFrame, poses: DataFrame, cell_m: float, size: int, z: Column, keys: Sequence[str]) -> DataFrame:
    """cells (with corners()) at row and col of the map; those outside it go."""
    own = Window.partitionBy(*keys).orderBy("frame")
    at = poses.withColumns({"ox": F.first(F.get("pose", F.lit(3))).over(own), "oy": F.first(F.get("pose", F.lit(7))).over(own)})
    out = cells.join(at.select(*keys, "frame", "pose", "ox", "oy"), [*keys, "frame"])
    x, y = F.col("xc_mm") / 1000.0, F.col("yc_mm") / 1000.0
    m = lambda k: F.get("pose", F.lit(k))
    place = lambda w, o: F.floor((w - F.col(o)) / cell_m + size / 2).cast("int")
    out = out.withColumns({"col": place(m(0) * x + m(1) * y + m(2) * z + m(3), "ox"), "row": place(m(4) * x + m(5) * y + m(6) * z + m(7), "oy")})
    return out.filter(F.col("col").between(0, size - 1) & F.col("row").between(0, size - 1)).drop("pose", "ox", "oy")


def world_cells(cells: DataFrame, preset: Preset, poses: DataFrame, cell_m: float, size: int, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Static cells with ground of more than TRUST points, at their places in the map: row, col, by frame and ring.

    poses: seq, frame, pose (sensor to world, row-major). The map's origin is the first pose; cells that share a place
    in a frame and ring are one, the last in row order.
    """
    ok = (F.col("count") > TRUST) & (F.col("cls") != DYNAMIC) & (F.col("flags").bitwiseAND(FLAG_OBSTACLE) == 0) & (F.col("ground_z") != NO_DATA)
    out = _in_world(corners(cells.filter(ok), preset), poses, cell_m, size, F.col("ground_z") / 1000.0, keys)
    last = F.max_by(F.struct("ground_z", "top_z", "cls", "flags"), F.struct("iy", "ix"))
    return out.groupBy(*keys, "frame", "ring", "row", "col").agg(last.alias("v")).select(*keys, "frame", "ring", "row", "col", "v.*")


def _blended(new: Column, old: Column) -> Column:
    """Towards zero to whole mm, as 16-bit casts do."""
    value = BLEND * new.cast("double") + (1 - BLEND) * old.cast("double")
    return F.greatest(F.lit(-32767), F.least(F.lit(32767), value)).cast("bigint")


#: Frames of a range that is folded at once, and the columns of the map so far.
RANGE_FRAMES = 64
_KEPT = ("ground_z", "top_z", "cls", "flags", "last")


def folded_world(observed: DataFrame, state: DataFrame | None, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """The map so far, moved on by what world_cells() of later frames show: keys, row, col, ground_z, top_z, cls, flags, last
    (the frame that last saw the cell).

    Heights are blended in order of frame and ring, tops the highest, class and flags the latest. A cell that wasn't seen
    for LIFE frames begins anew. A cell brings at most one entry for each frame and ring, so frames bound what is held.
    """
    at = [*keys, "row", "col"]
    new = observed.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("frame", "ring", "ground_z", "top_z", "cls", "flags"))).alias("_o"))
    whole = F.struct(*(F.col(c).cast(t).alias(c) for c, t in zip(_KEPT, ("bigint", "bigint", "int", "bigint", "int"), strict=True)))
    if state is None:
        both = new.withColumns({c: F.lit(None) for c in _KEPT})
    else:
        both = new.join(state, at, "full").withColumn("_o", F.coalesce("_o", F.from_json(F.lit("[]"), new.schema["_o"].dataType.simpleString())))

    def seen(acc: Column, o: Column) -> Column:
        fresh = acc["last"].isNull() | (o["frame"] - acc["last"] >= LIFE)
        height = F.when(fresh, o["ground_z"].cast("bigint")).otherwise(_blended(o["ground_z"], acc["ground_z"]))
        top = F.when(fresh, o["top_z"].cast("bigint")).otherwise(F.greatest(acc["top_z"], o["top_z"].cast("bigint")))
        parts = (height, top, o["cls"].cast("int"), o["flags"].cast("bigint"), o["frame"].cast("int"))
        return F.struct(*(v.alias(c) for c, v in zip(_KEPT, parts, strict=True)))

    return both.select(*at, F.aggregate("_o", whole, seen).alias("_s")).select(*at, "_s.*")


def _alive(state: DataFrame, last_frame: Column | int, keys: Sequence[str]) -> DataFrame:
    age = ((F.lit(last_frame) if isinstance(last_frame, int) else last_frame) - F.col("last") + 1).cast("int")
    return state.withColumn("age", age).filter(F.col("age") < LIFE).select(*keys, "row", "col", "ground_z", "top_z", "cls", "flags", "age")


def world_map(observed: DataFrame, last_frame: Column | int, keys: Sequence[str] = ("seq",), range_frames: int = RANGE_FRAMES) -> DataFrame:
    """The map after last_frame, from world_cells() of any number of frames: folded_world(), with age in frames; cells unseen
    for LIFE frames are gone. Ranges of frames are folded one after the other, the map being written in between."""
    low, high = observed.agg(F.min("frame"), F.max("frame")).first()
    if low is None:
        low = high = 0
    state = None
    for k in range(low, high + 1, range_frames):
        part = observed if high - low < range_frames else observed.filter(F.col("frame").between(k, k + range_frames - 1))
        state = folded_world(part, state, keys)
        if k + range_frames <= high:
            state = written(state, "world")
    return _alive(state, last_frame, keys)


class WorldMap:
    """A map that grows with a stream: update() from foreachBatch with world_cells() of a batch of whole frames in order.

    The map after each batch is a table under `path`, so a stream that begins again after a failure goes on from there, and
    a batch that comes twice counts once. reset() forgets all, as after a seek.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("seq",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.batch, self.base = -1, -1

    def _read(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={batch}")

    def update(self, observed: DataFrame, batch: int) -> DataFrame:
        state = None if batch - 1 <= self.base else self._read(batch - 1)
        folded_world(observed, state, self.keys).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self.batch = batch
        return self._read(batch)

    def now(self, last_frame: int) -> DataFrame | None:
        """The map as world_map() gives it; none before the first batch."""
        return _alive(self._read(self.batch), last_frame, self.keys) if self.batch > self.base else None

    def reset(self) -> None:
        self.base = self.batch


def backfilled(cells: DataFrame, world: DataFrame, preset: Preset, poses: DataFrame, cell_m: float, size: int, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """cells with the empty ones of each frame that the map knows: its ground_z, top_z, cls and flags, a count of 1, no
    confidence; `filled` tells them. A cell's place in the map is that of its centre, moved by the frame's pose."""
    at = [*keys, "frame", "ring", "ix", "iy"]
    frames = cells.select(*keys, "frame").distinct()
    empty = corners(all_cells(frames, preset).join(cells.select(*at), at, "left_anti"), preset)
    placed = _in_world(empty, poses, cell_m, size, F.lit(0.0), keys)
    found = placed.join(world, [*keys, "row", "col"])
    values = {"cls": F.col("cls"), "ground_z": F.col("ground_z"), "top_z": F.col("top_z"), "flags": F.col("flags"), "count": F.lit(1), "clearance": F.lit(NO_DATA), "moving_frac": F.lit(0), "conf": F.lit(0)}
    names = [c for c in cells.columns if c in at or c in values]
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    filled = found.select(*(F.col(c) if c in at else values[c].cast(kinds[c]).alias(c) for c in names), F.lit(True).alias("filled"))
    return cells.select(*names, F.lit(False).alias("filled")).unionByName(filled)
