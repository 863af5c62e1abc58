"""Packing documents into sequences by patterns whose counts non-negative least squares finds.

A document is its token ids and an end id; longer ones than a sequence are cut. Only the histogram of piece lengths
(at most `capacity` numbers) comes to the driver. There, all patterns of one to three lengths that fill a sequence
exactly are enumerated over the lengths that occur, repeat counts are fitted to the histogram by non-negative least
squares, rounded without exceeding it, and what remains is packed by best fit over the remaining histogram. The plan
is bounded by patterns, not by documents. Each piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.shared import ship_package, written
from terrafold.llm.textbytes import slices
from terrafold.llm.tokens import word_bpe

CAPACITY = 2048
#: Sequences of a range, about, in which sequences are numbered by position.
BUCKET_ROWS = 500
#: Patterns are made of at most so many different lengths, the most frequent ones; others are left to best fit.
MOST_LENGTHS = 2048
#: Most ranges in which sequences are numbered by position.
MOST_RANGES = 4096
_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", order: str | None = None) -> DataFrame:
    """doc_id, row, piece, start, length and checksum of each piece of each row; row (the column order, if given) tells
    repeated doc_ids apart.

    Null and empty texts are one piece that holds the end id alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    content = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))  # a fixed file of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(content.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part, bpe, capacity)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(order) if order else F.monotonically_increasing_id()).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def _cut(part: pa.RecordBatch, bpe, capacity: int) -> pa.RecordBatch:
    texts = pc.fill_null(part.column("text"), "").to_pylist()
    ids, at = bpe.encode(texts)
    n = len(texts)
    # An end id after each document.
    ends = at[1:] + np.arange(n)
    all_ids = np.zeros(len(ids) + n, "<u4")
    own = np.ones(len(all_ids), bool)
    own[ends] = False
    all_ids[own] = ids
    begins = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, np.int64)
    sizes = ends - begins + 1
    each = -(-sizes // capacity)
    doc = np.repeat(np.arange(n), each)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = piece * capacity
    length = np.minimum(capacity, sizes[doc] - start)
    raw = memoryview(all_ids.tobytes())
    place = begins[doc] + start
    sums = [zlib.crc32(raw[4 * p : 4 * (p + k)]) for p, k in zip(place.tolist(), length.tolist(), strict=True)]
    columns = [part.column("doc_id").take(pa.array(doc)), part.column("row").take(pa.array(doc)), piece.astype(np.int32), start, length, np.array(sums, np.int64)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of one to three of these lengths that fill a sequence; 0 stands for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    c = np.flatnonzero(there)
    found = []
    for a in np.flatnonzero(there[1:])[::-1] + 1:
        b = c[(c <= a) & (c <= capacity - a)]
        rest = capacity - a - b
        ok = (rest <= b) & there[rest]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], rest[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that minimise the weighted squares of (lengths used - histogram).

    Projected gradient steps with momentum. Misses weigh less the shorter the length, as short pieces fill gaps later.
    """
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / max(1, size - 1)) + 0.05
    weight[0] = 0
    flat = shapes.ravel()
    # Each column is scaled by its norm, so that one step length suits all.
    norm = np.sqrt((weight[shapes] ** 2).sum(1)) + 1e-12
    weights = (weight[shapes] / norm[:, None]).ravel()
    target = weight * histogram
    v = np.ones(len(shapes))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = (weights * np.bincount(flat, weights * np.repeat(v, 3), size)[flat]).reshape(-1, 3).sum(1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        residual = np.bincount(flat, weights * np.repeat(y, 3), size) - target
        step = np.maximum(0, y - (weights * residual[flat]).reshape(-1, 3).sum(1) / (1.05 * top))
        if ((y - step) * (step - x)).sum() > 0:
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = step, step + (t - 1) / later * (step - x), later
    return x / norm


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """Groups of equal sequences, (how many, [(length, times)]), that hold every piece of the histogram; sequences in all."""
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        groups.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    frequent = np.argsort(-left, kind="stable")[:MOST_LENGTHS]
    shapes = patterns(np.sort(frequent[left[frequent] > 0]), capacity)
    if len(shapes):
        fitted = np.rint(fit(shapes, left.astype(float))).astype(np.int64)
        chosen = np.flatnonzero(fitted)
        for k in chosen[np.argsort(-fitted[chosen], kind="stable")].tolist():
            times: dict[int, int] = defaultdict(int)
            for a in shapes[k].tolist():
                if a:
                    times[a] += 1
            n = min(int(fitted[k]), *(int(left[a]) // m for a, m in times.items()))
            if n > 0:
                groups.append((n, list(times.items())))
                for a, m in times.items():
                    left[a] -= n * m
    groups += _best_fit(left, capacity)
    return groups, sum(n for n, _ in groups)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of the remaining histogram, longest first; equal sequences are handled together."""
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room left
    rooms = np.zeros(capacity + 1, bool)
    for a in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[a])
        while todo:
            fits = np.flatnonzero(rooms[a:])
            if not len(fits):
                per = capacity // a
                for n, m in ((todo // per, per), (1, todo % per)):
                    if n and m:
                        open_[capacity - m * a].append((n, ((a, m),)))
                        rooms[capacity - m * a] = True
                break
            room = a + int(fits[0])
            n, held = open_[room].pop()
            rooms[room] = bool(open_[room])
            per = room // a
            full = min(n, todo // per)
            rest = todo - full * per
            if full:
                open_[room - per * a].append((full, (*held, (a, per))))
                rooms[room - per * a] = True
                todo -= full * per
            if full < n:
                part = min(rest, per)
                if full + (part > 0) < n:
                    open_[room].append((n - full - (part > 0), held))
                    rooms[room] = True
                if part:
                    open_[room - part * a].append((1, (*held, (a, part))))
                    rooms[room - part * a] = True
                    todo -= part
    return [(n, list(held)) for groups in open_.values() for n, held in groups]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: pieces of `length` ranked from `rank` on, times * n of them, lie in n sequences from `first` on."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for n, held in groups:
        offset = 0
        for a, m in held:
            rows.append((a, taken[a], n, first, offset))
            taken[a] += n * m
            offset += a * m
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "first", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", order: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed whole: null texts as empty, repeated rows each on their own, a null doc_id like any
    other. Sequences have no gaps before their end. Empty tables give no rows; further columns are ignored.
    order: a column of different numbers from 0, such as mix_position. Pieces then go to sequences in this order as far
    as lengths allow, and sequences are numbered by the mean position of their pieces.
    """
    spark = docs.sparkSession
    if capacity < 1 or capacity >= 1 << 20:
        raise ValueError("capacity must be from 1 to 2**20 - 1")
    found = written(pieces(docs, tokenizer, capacity, text, order), "pieces")
    lengths = found.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in lengths:
        histogram[length] = n
    groups, _ = plan(histogram, capacity)
    if order:
        return _in_order(found, groups, histogram)
    table = spark.sparkContext.broadcast(places(groups))  # bounded by the number of patterns
    shares = spark.createDataFrame(_buckets(histogram), "length long, buckets int")
    marked = found.join(F.broadcast(shares), "length")  # at most `capacity` rows
    marked = marked.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.col("buckets")).cast("int")).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1)
    ranked = ranked.join(starts, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t["length"] << 42) | t["rank"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            at = np.searchsorted(keys, (length << 42) | rank, "right") - 1
            q = rank - t["rank"][at]
            n = t["n"][at]
            columns = [batch.column(k) for k in names] + [pa.array(t["first"][at] + q % n), pa.array(t["offset"][at] + q // n * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _buckets(histogram: np.ndarray) -> list[tuple[int, int]]:
    """For each length, into how many buckets its n pieces are dealt to be ranked: the root of n, so that neither the pieces of
    a bucket nor the buckets of a length, which one task each counts, are more than about that."""
    return [(k, max(1, math.isqrt(int(n)))) for k, n in enumerate(histogram.tolist()) if n]


def _ranked(rows: DataFrame, share: Column, keys: list[str], histogram: np.ndarray) -> DataFrame:
    """rows with `rank`, from 0 in their length by (share, keys); share is from 0 to 1 and cuts a length into buckets."""
    shares = rows.sparkSession.createDataFrame(_buckets(histogram), "length long, buckets int")  # at most `capacity` rows
    marked = rows.join(F.broadcast(shares), "length").withColumn("_share", share)
    marked = marked.withColumn("bucket", F.least(F.floor(F.col("_share") * F.col("buckets")).cast("int"), F.col("buckets") - 1))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("_share", *keys)
    ranked = marked.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "bucket"])
    return ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("buckets", "bucket", "before", "_share")


def _in_order(found: DataFrame, groups: list[tuple[int, list[tuple[int, int]]]], histogram: np.ndarray) -> DataFrame:
    """The plan filled in the order of row: each sequence aims at a share of the way, and of each length it takes the pieces there."""
    spark = found.sparkSession
    rows, first = [], 0
    for g, (n, held) in enumerate(groups):
        offset, aim = 0, (g + 1) * 0.6180339887498949 % 1  # spreads groups of one sequence as well
        for a, m in held:
            rows.append((a, m, n, first, offset, aim))
            offset += a * m
        first += n
    plan_rows = spark.createDataFrame(rows, "length long, m int, n long, first long, at long, aim double")  # bounded by patterns
    chunks = plan_rows.withColumn("k0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long"))))
    chunks = chunks.repartition(spark.sparkContext.defaultParallelism, "length", "first", "k0")
    slots = chunks.withColumn("k", F.explode(F.sequence("k0", F.least(F.col("k0") + 999, F.col("n") - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    slots = slots.select("length", (F.col("first") + F.col("k")).alias("sequence"), (F.col("at") + F.col("c") * F.col("length")).alias("offset"), ((F.col("k") + F.col("aim")) / F.col("n")).alias("share"))
    size = (found.agg(F.max("row")).first()[0] or 0) + 1
    slots = _ranked(slots, F.col("share"), ["sequence", "offset"], histogram).select("length", "rank", "sequence", "offset")
    filled = _ranked(found, F.col("row") / size, ["row", "piece"], histogram).join(slots.hint("merge"), ["length", "rank"])
    filled = written(filled, "filled")
    ranges = min(MOST_RANGES, max(1, first // BUCKET_ROWS))
    means = filled.groupBy("sequence").agg(F.avg("row").alias("mean"))
    means = means.withColumn("range", F.least(F.floor(F.col("mean") / size * ranges).cast("int"), F.lit(ranges - 1)))
    means = written(means, "sequence-means")
    counts, before, held = dict(means.groupBy("range").count().collect()), [], 0  # at most MOST_RANGES rows
    for k in range(ranges):
        before.append((k, held))
        held += counts.get(k, 0)
    starts = spark.createDataFrame(before, "range int, before long")
    own = Window.partitionBy("range").orderBy("mean", "sequence")
    numbers = means.withColumn("number", F.row_number().over(own) - 1).join(F.broadcast(starts), "range")
    numbers = numbers.select("sequence", (F.col("number") + F.col("before")).cast("long").alias("sequence_id"))
    return filled.join(numbers.hint("merge"), "sequence").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
