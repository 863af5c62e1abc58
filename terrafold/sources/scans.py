"""Binary scans and labels, text calibrations and poses, as tables; checks of whole datasets; the reverse way out.

A dataset is root/sequences/<seq>/velodyne/<frame>.bin, labels/<frame>.label, calib.txt, times.txt, and
root/poses/<seq>.txt or poses.txt beside the calibration. Everything is read by Spark's own readers, so roots may lie
wherever Spark can read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.shipping import ship_package
from terrafold.storage import written

POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("remission", "<f4")])
#: Frames of one range of numbers in strided(), about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 10_000, 256
#: What a calibration holds.
CALIBRATIONS = ("P0", "P1", "P2", "P3", "Tr")
_PLACE = r"sequences/([^/]+)/[^/]+/([0-9]+)\.[a-z]+$"


def _files(spark: SparkSession, root: str, kind: str, suffix: str, seq: str | None = None, frame: int | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if frame is None:
        files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(f"{root}/sequences" + (f"/{seq}" if seq else ""))
        files = files.filter(F.col("path").contains(f"/{kind}/"))
    else:  # the one file, no listing of others
        files = reader.load(f"{root}/sequences/{seq}/{kind}/{frame:06d}.{suffix}")
    return files.withColumns({"seq": F.regexp_extract("path", _PLACE, 1), "frame": F.regexp_extract("path", _PLACE, 2).cast("int")})


def scans(spark: SparkSession, root: str, stride: int = 1, seq: str | None = None, frame: int | None = None) -> DataFrame:
    """seq, frame, pid, x, y, z, remission of every point; files of a size that isn't whole points are an error.

    stride keeps every so-many-th frame, under its own number. seq reads that sequence's folder only, seq and frame that file
    only. Filters on seq and frame are applied before decoding.
    """

    ship_package(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, frame, content, path in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(content) % POINT.itemsize:
                    raise ValueError(f"{path}: {len(content)} bytes are no whole number of points")
                points = np.frombuffer(content, POINT)
                n = len(points)
                yield pa.RecordBatch.from_arrays([pa.array([seq] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int64)), *(pa.array(points[c].copy()) for c in POINT.names)], names=["seq", "frame", "pid", *POINT.names])

    files = _files(spark, root, "velodyne", "bin", seq, frame).filter(F.col("frame") % stride == 0)
    return files.select("seq", "frame", "content", "path").mapInArrow(decode, "seq string, frame int, pid long, x float, y float, z float, remission float")


def strided(frames: DataFrame, stride: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """frame, idx and negative of every stride-th row of `frame` in its order: its place among those kept, from 0, and from the end.

    Frames are numbered by range of their values, each from where the ranges before it end; no task sees all of them.
    Only the ranges' borders and counts come to the driver, MOST_RANGES at most.
    """
    n = frames.count()
    ranges = min(MOST_RANGES, -(-n // range_rows))
    borders = []
    if ranges > 1:
        borders = sorted(set(frames.agg(F.percentile_approx("frame", [k / ranges for k in range(1, ranges)], 10_000)).first()[0]))

    def part(low: int, high: int) -> Column:
        """The number of borders below the frame, if it lies from low to high."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("frame") > borders[mid], part(mid + 1, high)).otherwise(part(low, mid))

    marked = frames.select("frame", part(0, len(borders)).alias("_range"))
    counts, before, held = dict(marked.groupBy("_range").count().collect()), [], 0
    for k in range(len(borders) + 1):
        before.append(held)
        held += counts.get(k, 0)
    own = Window.partitionBy("_range").orderBy("frame")
    k = F.row_number().over(own) - 1 + F.get(F.array(*(F.lit(b).cast("long") for b in before)), F.col("_range"))
    out = marked.withColumn("_k", k).filter(F.col("_k") % stride == 0)
    idx = F.floor(F.col("_k") / stride)
    return out.select("frame", idx.alias("idx"), (idx - -(-n // stride)).alias("negative"))


def labels(spark: SparkSession, root: str, seq: str | None = None, frame: int | None = None) -> DataFrame:
    """seq, frame, pid, raw of every label; instance and class are packed in one number. seq, frame: as for scans()."""

    ship_package(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, frame, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = np.frombuffer(content, "<u4")
                n = len(raw)
                yield pa.RecordBatch.from_arrays([pa.array([seq] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int64)), pa.array(raw.astype(np.int64))], names=["seq", "frame", "pid", "raw"])

    return _files(spark, root, "labels", "label", seq, frame).select("seq", "frame", "content").mapInArrow(decode, "seq string, frame int, pid long, raw long")


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.cast("double"))


def _square(m: Column) -> Column:
    return F.concat(m, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def poses(spark: SparkSession, root: str) -> DataFrame:
    """seq, frame, pose (4 x 4, row-major): line k of a pose file is frame k. A sequence's file lies in the folder of poses or
    beside its calibration; where both are, the folder's counts."""
    files = spark.read.text(f"{root}", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("path", F.input_file_name())
    shared = F.nullif(F.regexp_extract("path", r"/poses/([^/]+)\.txt$", 1), F.lit(""))
    own = F.nullif(F.regexp_extract("path", r"/sequences/([^/]+)/poses\.txt$", 1), F.lit(""))
    found = files.withColumns({"seq": F.coalesce(shared, own), "_own": shared.isNull()}).filter("seq IS NOT NULL")
    found = found.groupBy("seq").agg(F.min_by("value", "_own").alias("value"))
    lines = found.select("seq", F.posexplode(F.split(F.rtrim("value"), "\n")).alias("frame", "line"))
    lines = lines.filter(F.trim("line") != "").withColumn("m", _numbers(F.col("line")))
    checked = F.when(F.size("m") == 12, F.col("m")).otherwise(F.raise_error(F.lit("a pose has 12 numbers")).cast("array<double>"))
    return lines.select("seq", "frame", _square(checked).alias("pose"))


def calibrations(spark: SparkSession, root: str) -> DataFrame:
    """seq, name (P0 to P3, Tr), matrix (4 x 4) of every calib.txt; a file without one of the five is an error."""
    files = spark.read.text(f"{root}/sequences", wholetext=True, recursiveFileLookup=True, pathGlobFilter="calib.txt").withColumn("seq", F.regexp_extract(F.input_file_name(), r"sequences/([^/]+)/calib\.txt$", 1))
    lines = files.select("seq", F.filter(F.split(F.rtrim("value"), "\n"), lambda x: x.contains(":")).alias("lines"))
    names = F.transform("lines", lambda x: F.trim(F.substring_index(x, ":", 1)))
    lacking = F.array_except(F.array(*map(F.lit, CALIBRATIONS)), names)
    lines = lines.select("seq", F.when(F.size(lacking) == 0, F.col("lines")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("calibration of"), "seq", F.lit("lacks"), F.array_join(lacking, ", "))).cast("array<string>")).alias("lines"))
    lines = lines.select("seq", F.explode("lines").alias("line"))
    m = _numbers(F.substring_index("line", ":", -1))
    checked = F.when(F.size("m") == 12, F.col("m")).otherwise(F.raise_error(F.lit("a calibration has 12 numbers")).cast("array<double>"))
    out = lines.select("seq", F.trim(F.substring_index("line", ":", 1)).alias("name"), m.alias("m")).filter(F.col("name").isin(*CALIBRATIONS))
    return out.select("seq", "name", _square(checked).alias("matrix"))


def frames(spark: SparkSession, root: str) -> DataFrame:
    """seq, frame, ts, pose (of the camera) and tr (sensor to camera) of every frame that has a pose."""
    placed = poses(spark, root).join(calibrations(spark, root).filter("name = 'Tr'").select("seq", F.col("matrix").alias("tr")), "seq")
    return times(spark, root, placed)


def times(spark: SparkSession, root: str, frames: DataFrame, period: float = 0.1) -> DataFrame:
    """frames (seq, frame, ...) with ts from times.txt, or frame * period where there is none."""
    files = spark.read.text(f"{root}/sequences", wholetext=True, recursiveFileLookup=True, pathGlobFilter="times.txt").withColumn("seq", F.regexp_extract(F.input_file_name(), r"sequences/([^/]+)/times\.txt$", 1))
    lines = files.select("seq", F.posexplode(F.split(F.rtrim("value"), "\n")).alias("frame", "t"))
    return timed(frames, lines.select("seq", "frame", F.expr("try_cast(trim(t) AS double)").alias("t")), period)


def timed(frames: DataFrame, times: DataFrame, period: float = 0.1) -> DataFrame:
    """frames (seq, frame, ...) with ts from times (seq, frame, t), or frame * period where there is none."""
    return frames.join(times, ["seq", "frame"], "left").withColumn("ts", F.coalesce("t", F.col("frame") * F.lit(float(period)))).drop("t")


def labelled(points: DataFrame, raw: DataFrame) -> DataFrame:
    """points with their raw labels; frames whose numbers of points and labels differ are an error."""
    keys = ["seq", "frame", "pid"]
    out = points.join(raw, keys, "full")
    gap = F.col("x").isNull() | F.col("raw").isNull()
    return out.withColumn("raw", F.when(gap, F.raise_error(F.format_string("%s/%s: points and labels differ in number", "seq", "frame")).cast("bigint")).otherwise(F.col("raw")))


def only_in_one(left: DataFrame, right: DataFrame, keys: list[str], says_left: str, says_right: str) -> DataFrame:
    """Keys that only one of two tables has, with a problem that says which."""
    parts = ((left, right, says_left), (right, left, says_right))
    a, b = (x.select(*keys).distinct().join(y.select(*keys), keys, "left_anti").withColumn("problem", F.lit(t)) for x, y, t in parts)
    return a.unionByName(b)


def verified(spark: SparkSession, root: str, sample: int = 50) -> DataFrame:
    """Problems of a dataset, one row each: seq, frame (null: the sequence), problem. Sound datasets give none; nothing is raised.

    Scans and labels must pair up and agree in size; poses and times must be as many as scans, and finite; calibrations must
    parse, with a transform that can be inverted; and of each sequence `sample` evenly spaced scans must be finite.
    """
    bins = _files(spark, root, "velodyne", "bin").select("seq", "frame", F.col("length").alias("n_bytes"))
    tags = _files(spark, root, "labels", "label").select("seq", "frame", F.col("length").alias("l_bytes"))
    own = Window.partitionBy("seq")
    tagged = bins.join(tags.select("seq").distinct(), "seq", "left_semi")
    missing = only_in_one(tagged, tags, ["seq", "frame"], "scan without labels", "labels without a scan")
    sizes = F.array_compact(F.array(
        F.when(F.col("n_bytes") % POINT.itemsize != 0, F.lit("scan isn't whole points")),
        F.when(F.col("n_bytes") / POINT.itemsize != F.col("l_bytes") / 4, F.lit("points and labels differ in number")),
    ))
    sized = bins.join(tags, ["seq", "frame"], "left").select("seq", "frame", F.explode(sizes).alias("problem"))
    scans_of = bins.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("path", F.input_file_name())
    kinds = {"poses": r"/(?:poses/([^/]+)|sequences/([^/]+)/poses)\.txt$", "times": r"/sequences/([^/]+)/(times)\.txt$", "calib": r"/sequences/([^/]+)/(calib)\.txt$"}
    found = None
    for kind, place in kinds.items():
        first, second = F.regexp_extract("path", place, 1), F.regexp_extract("path", place, 2)
        seq = F.when(first != "", first).otherwise(second)
        rows = texts.filter(F.col("path").rlike(place)).select(seq.alias("seq"), F.filter(F.split(F.rtrim("value"), "\n"), lambda x: F.trim(x) != "").alias("lines"))
        number = lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.try_cast("double"))
        finite = lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))
        if kind == "calib":
            parsed = F.transform("lines", lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), number(F.substring_index(x, ":", -1)).alias("m")))
            good = F.transform(F.filter(parsed, lambda p: (F.size(p["m"]) == 12) & F.forall(p["m"], finite)), lambda p: p["name"])  # noqa: B023
            tr = F.get(F.filter(parsed, lambda p: p["name"] == "Tr"), F.lit(0))["m"]
            g = lambda k: F.get(tr, F.lit(k))  # noqa: B023, E731
            det = g(0) * (g(5) * g(10) - g(6) * g(9)) - g(1) * (g(4) * g(10) - g(6) * g(8)) + g(2) * (g(4) * g(9) - g(5) * g(8))
            bad = F.when(F.size(F.array_except(F.array(*map(F.lit, CALIBRATIONS)), good)) > 0, F.lit("calibration doesn't parse")).when(F.abs(det) < 1e-6, F.lit("Tr is singular"))
            some = scans_of.join(rows, "seq", "left").select("seq", F.when(F.col("lines").isNull(), F.lit("calibration is missing")).otherwise(bad).alias("problem"))
        else:
            width = 12 if kind == "poses" else 1
            odd = F.exists("lines", lambda x: ~((F.size(number(x)) == width) & F.forall(number(x), finite)))  # noqa: B023
            best = rows.groupBy("seq").agg(F.first("lines").alias("lines"))
            bad = F.when(F.size("lines") != F.col("n"), F.lit(f"{kind} and scans differ in number")).when(odd, F.lit(f"{kind} don't parse or aren't finite"))
            absent = F.lit("poses are missing") if kind == "poses" else F.lit("times are missing: a tenth of a second a frame is assumed")
            some = scans_of.join(best, "seq", "left").select("seq", F.when(F.col("lines").isNull(), absent).otherwise(bad).alias("problem"))
        some = some.filter("problem IS NOT NULL")
        found = some if found is None else found.unionByName(some)
    ranked = bins.withColumns({"_k": F.row_number().over(own.orderBy("frame")) - 1, "_n": F.count(F.lit(1)).over(own)}).filter(F.col("n_bytes") % POINT.itemsize == 0)
    step = F.greatest(F.col("_n") - 1, F.lit(1)) / F.lit(max(1, sample - 1))
    picked = ranked.filter((F.col("_n") <= sample) | (F.floor(F.ceil(F.col("_k") / step) * step) == F.col("_k"))).select("seq", "frame")
    contents = _files(spark, root, "velodyne", "bin").join(F.broadcast(picked), ["seq", "frame"]).select("seq", "frame", "content")

    def odd_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [not np.isfinite(np.frombuffer(c, "<f4")).all() for c in batch.column("content").to_pylist()]
            yield batch.select(["seq", "frame"]).filter(pa.array(bad, pa.bool_()))

    ship_package(spark)
    values = contents.mapInArrow(odd_values, "seq string, frame int").withColumn("problem", F.lit("values aren't finite"))
    return missing.unionByName(sized).unionByName(found.withColumn("frame", F.lit(None).cast("int"))).unionByName(values)


def report(problems: DataFrame) -> str:
    """verified() in words: a line for each sequence with problems, and below it up to three frames of each problem."""
    rows = problems.groupBy("seq", "problem").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("frame")), 1, 3).alias("frames")).orderBy("seq", "problem").collect()
    out = []
    for k, r in enumerate(rows):
        if not k or rows[k - 1].seq != r.seq:
            out.append(f"[FAIL] {r.seq}")
        out.append(f"    {r.problem}: {r.n}" + (f" (frames {', '.join(map(str, r.frames))})" if r.frames else ""))
    return "\n".join(out) or "[PASS]"


def write_scans(points: DataFrame, folder: str) -> None:
    """Write one .bin (and .label, if there is a raw column) for each frame of points into a folder that all machines
    share; frames are single tasks."""
    from pathlib import Path

    has_raw = "raw" in points.columns
    columns = ["x", "y", "z", "remission", *(["raw"] if has_raw else [])]

    ship_package(points.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        seq, frame = table["seq"][0].as_py(), table["frame"][0].as_py()
        out = np.empty(table.num_rows, POINT)
        for c in POINT.names:
            out[c] = table[c].to_numpy()
        base = Path(folder) / "sequences" / seq
        parts = [("velodyne", "bin", out.tobytes())] + ([("labels", "label", table["raw"].to_numpy().astype("<u4").tobytes())] if has_raw else [])
        for kind, suffix, content in parts:
            (base / kind).mkdir(parents=True, exist_ok=True)
            (base / kind / f"{frame:06d}.{suffix}").write_bytes(content)
        return pa.table({"seq": [seq], "frame": pa.array([frame], pa.int32())})

    points.select("seq", "frame", "pid", *columns).groupBy("seq", "frame").applyInArrow(run, "seq string, frame int").count()


def uncached(frames: DataFrame, cached: DataFrame) -> DataFrame:
    """The rows of frames (seq, frame, ...) of which cached has no frame."""
    return frames.join(cached.select("seq", "frame").distinct(), ["seq", "frame"], "left_anti")


def write_predictions(predictions: DataFrame, path: str, meta: dict[str, str] | None = None) -> int:
    """Append predictions (seq, frame, pid, raw_id, conf) of frames that the table at path doesn't have yet; how many frames.

    meta (such as a model's name and checksum) and the time go to a table beside it, one row for each call.
    """
    spark = predictions.sparkSession
    try:
        predictions = uncached(predictions, spark.read.parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    kept = written(predictions, "predictions")
    kept.write.mode("append").partitionBy("seq", "frame").parquet(path)
    n = kept.select("seq", "frame").distinct().count()
    row = spark.createDataFrame([(n, meta or {})], "n_frames long, meta map<string, string>").withColumn("written_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}-meta")
    return n


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """seq, frame, pid, raw_id, conf of write_predictions()."""
    found = spark.read.parquet(path)
    return found.select(F.format_string("%02d", F.col("seq").cast("int")).alias("seq") if dict(found.dtypes)["seq"] == "int" else F.col("seq"), "frame", "pid", "raw_id", "conf")


def archived_predictions(spark: SparkSession, root: str) -> DataFrame:
    """The same from root/<seq>/<frame>.npz archives (raw_ids, conf), <frame>.npy arrays or <frame>.label files of raw ids, of
    which the latter two have full confidence. Archives whose arrays differ in shape or have several dimensions are an error."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{npz,npy,label}").load(root)
    place = r"/([^/]+)/([0-9]+)\.(npz|npy|label)$"
    files = files.select(F.regexp_extract("path", place, 1).alias("seq"), F.regexp_extract("path", place, 2).cast("int").alias("frame"), F.regexp_extract("path", place, 3).alias("kind"), "content", "path")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, frame, kind, content, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == "npz":
                    with np.load(io.BytesIO(content)) as z:
                        ids, conf = z["raw_ids"], z["conf"]
                else:
                    ids = np.load(io.BytesIO(content)) if kind == "npy" else np.frombuffer(content, "<u4") & 0xFFFF
                    conf = np.full(ids.shape, 255)
                if ids.shape != conf.shape or ids.ndim != 1:
                    raise ValueError(f"{path}: raw_ids {ids.shape} and conf {conf.shape} must be equally long rows")
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([seq] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), pa.array(ids.astype(np.int64)), pa.array(conf.astype(np.int32))], names=["seq", "frame", "pid", "raw_id", "conf"])

    return files.mapInArrow(decode, "seq string, frame int, pid long, raw_id long, conf int")


def oracle_predictions(raw: DataFrame) -> DataFrame:
    """True labels (seq, frame, pid, raw) as predictions with full confidence; a null label is an error."""
    known = F.when(F.col("raw").isNotNull(), F.col("raw").bitwiseAND(65535)).otherwise(F.raise_error(F.lit("true labels are needed")).cast("bigint"))
    return raw.select("seq", "frame", "pid", known.alias("raw_id"), F.lit(255).alias("conf"))


def sampled_frames(frames: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """n evenly spaced frames of each key, the first and the last among them, cut to whole places; fewer if there are fewer."""
    keys = keys or []
    own = Window.partitionBy(*(keys or [F.lit(1)]))
    ranked = frames.withColumns({"_k": F.row_number().over(own.orderBy("frame")) - 1, "_n": F.count(F.lit(1)).over(own)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(float(max(1, n - 1)))))
    return ranked.filter(F.array_contains(wanted, F.col("_k"))).select(*frames.columns)


def drawn_frames(frames: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n frames of each key without replacement, by a seeded hash."""
    own = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "frame"), "frame")
    return frames.withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= n).drop("_k")
