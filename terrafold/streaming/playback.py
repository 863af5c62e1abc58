"""Frames as a stream: files in order, cells a batch, a player with its controls, the last payload for late viewers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrafold.config import Preset
from terrafold.operators.grid import cells_of
from terrafold.operators.metrics import confusion

#: Frames a second at speed 1, and the slowest and fastest speed.
HZ, SLOWEST, FASTEST = 10.0, 0.1, 10.0


def frames(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1, start: int | None = None) -> DataFrame:
    """A Parquet folder of points as a stream, so many files a batch; start leaves earlier frames out (seek)."""
    out = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return out if start is None else out.filter(F.col("frame") >= start)


def play(points: DataFrame, preset: Preset, sink: Callable[[DataFrame, int], None], checkpoint: str, hz: float | None = None, derive: Callable[[DataFrame], DataFrame] = lambda c: c):
    """Run a stream of points (with mm coordinates) into `sink(cells, batch)`, at so many batches a second, or all that
    is there and then stop. Batches never overlap; the checkpoint resumes after the last one."""

    def batch(df: DataFrame, k: int) -> None:
        sink(derive(cells_of(df, preset, ("seq", "frame"))), k)

    writer = points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if hz is None else writer.trigger(processingTime=f"{round(1000 / hz)} milliseconds")
    return writer.start()


class Player:
    """Plays the frames 0 to n - 1 of a sequence, over and over: one frame at a time goes to show(frame), which returns what
    viewers get. Frames are paced by Spark's clock: a rate source ticks, and each batch shows the next frame.

    One thread shows frames, so they never overlap; a frame that takes longer than its time makes playback slower and skips
    none. `last` is what was shown last: a new viewer gets it without any work.
    """

    def __init__(self, spark: SparkSession, n: int, show: Callable[[int], object], checkpoint: str):
        self.spark, self.n, self.show, self.checkpoint = spark, n, show, checkpoint
        self.at, self.speed, self.last, self.shown = 0, 1.0, None, None
        self._query, self._runs = None, 0

    def _now(self) -> object:
        self.last, self.shown = self.show(self.at), self.at
        return self.last

    def joined(self) -> object:
        """What a new viewer gets."""
        return self._now() if self.shown is None else self.last

    @property
    def playing(self) -> bool:
        return self._query is not None and self._query.isActive

    def state(self) -> dict:
        return {"frame": self.at, "frames": self.n, "playing": self.playing, "speed": self.speed}

    def play(self) -> None:
        if self.playing or not self.n:
            return

        def tick(df: DataFrame, k: int) -> None:
            self._now()
            self.at = (self.at + 1) % self.n

        self._runs += 1
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{self.checkpoint}/{self._runs}")
        self._query = writer.trigger(processingTime=f"{max(1, round(1000 / (HZ * self.speed)))} milliseconds").start()

    def pause(self) -> None:
        if self._query is not None:
            self._query.stop()
        self._query = None

    def seek(self, frame: int) -> object:
        """Show this frame, or the nearest there is, and go on from there if playing."""
        was = self.playing
        self.pause()
        self.at = max(0, min(frame, self.n - 1))
        out = self._now()
        if was:
            self.play()
        return out

    def step(self, delta: int = 1) -> object:
        """So many frames on or back, around the ends."""
        return self.seek((self.at + delta) % max(1, self.n))

    def set_speed(self, speed: float) -> None:
        was = self.playing
        self.pause()
        self.speed = max(SLOWEST, min(speed, FASTEST))
        if was:
            self.play()


def latest(documents: DataFrame, path: str, checkpoint: str):
    """Keep the last document (seq, frame, payload) of each sequence of a stream in one table: each batch writes path/batch=k,
    merged with the one before. last_of() reads it."""
    from terrafold.operators.wire import last_payloads

    def batch(df: DataFrame, k: int) -> None:
        held = df if k == 0 else df.unionByName(df.sparkSession.read.parquet(f"{path}/batch={k - 1}"))
        last_payloads(held).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_of(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """seq, frame, payload after a batch of latest()."""
    return spark.read.parquet(f"{path}/batch={batch}").select("seq", "frame", "payload")


def confusion_so_far(pairs: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """A confusion matrix that grows with the stream (update or complete mode)."""
    return confusion(pairs, gt, pred)


def counts_by_second(points: DataFrame, ts: str = "ts", late: str = "1 second") -> DataFrame:
    """Points of each second of event time; those that come later than allowed are dropped. An addition of this engine."""
    return points.withWatermark(ts, late).groupBy(F.window(ts, "1 second")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
