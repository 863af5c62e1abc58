"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written, for clear_written().
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or, where it is unset and all runs on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.gettempdir()}/terrafold-shared"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it; this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrafold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_parts(spark: SparkSession, frames: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """The rows of all frames as one table, as written() gives it; each frame is written before the next is asked for."""
    path = f"{shared_dir(spark)}/terrafold-{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    _written.append(path)
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written() tables that no result will read again: all that depends on them has been written itself. Others are left alone."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
            name = path.rsplit("/", 1)[-1]
            for held in [w for w in _written if w.rsplit("/", 1)[-1] == name]:
                _written.remove(held)
                _delete(table.sparkSession, held)


def collected(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage between long steps: its heap shrinks again, and Spark deletes the shuffles and
    broadcasts that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that this process has written, once no result that reads them is needed any more; how many."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n
