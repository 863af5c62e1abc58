"""A deterministic scan out of line items, in exact integers, for checks against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.integers import floor_div

#: Raw labels that the pseudo-scan deals out.
RAW = (10, 40, 48, 50, 70, 72, 252, 30, 11, 44, 49, 51, 60, 71, 80, 81, 254, 18, 20, 99)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame, pid, x_mm, y_mm, z_mm, cls, moving, conf, raw, pred of two frames."""
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    n = n.cast("bigint")
    h = (p * 37 + n * 11 + s) % 20
    raw, pred = F.lit(0), F.lit(0)
    raw = F.element_at(F.array(*map(F.lit, RAW)), (h + 1).cast("int"))
    pred = F.element_at(F.array(*map(F.lit, RAW)), ((h + F.when(n % 5 == 0, 1).otherwise(0)) % 20 + 1).cast("int"))
    out = table(spark, sf_dir, "lineitem").select(
        (o % 2).cast("int").alias("frame"),
        (o * 10 + n).alias("pid"),
        ((o * 7919 + n * 104729 + p * 31) % 28001 - 14000).alias("x_mm"),
        ((o * 6007 + s * 3571 + n * 911) % 28001 - 14000).alias("y_mm"),
        F.when(h < 12, 1).when(h < 15, 2).when(h < 17, 3).when(h < 18, 4).otherwise(0).alias("cls"),
        (s % 7 == 0).alias("moving"),
        ((p * 13 + n) % 256).alias("conf"),
        raw.cast("bigint").alias("sem"),
        (raw + 65536 * (s % 300)).cast("bigint").alias("raw"),
        pred.cast("bigint").alias("pred"),
        p.alias("_p"),
    )
    x, y = F.col("x_mm") + 14000, F.col("y_mm") + 14000
    ground = floor_div(x, 20) - 1700 + F.when(F.col("y_mm") >= 4000, 120).otherwise(0) - F.when((floor_div(x, 1000) + floor_div(y, 1000)) % 7 == 0, 150).otherwise(0)
    z = F.when(F.col("cls").isin(3, 4), ground + 200 + F.col("_p") % 2500).otherwise(ground + F.col("_p") % 7)
    return out.withColumn("z_mm", z).drop("_p").withColumn("seq", F.lit("08"))


#: The same in DuckDB's dialect.
SCAN_SQL = f"""
raw0 AS (SELECT CAST(l_orderkey % 2 AS INTEGER) AS frame, l_orderkey * 10 + l_linenumber AS pid,
  (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 28001 - 14000 AS x_mm,
  (l_orderkey * 6007 + l_suppkey * 3571 + l_linenumber * 911) % 28001 - 14000 AS y_mm,
  (l_partkey * 37 + l_linenumber * 11 + l_suppkey) % 20 AS h, l_suppkey % 7 = 0 AS moving, (l_partkey * 13 + l_linenumber) % 256 AS conf,
  l_partkey AS p, l_suppkey AS s, l_linenumber AS ln FROM lineitem),
raw1 AS (SELECT *, CASE WHEN h < 12 THEN 1 WHEN h < 15 THEN 2 WHEN h < 17 THEN 3 WHEN h < 18 THEN 4 ELSE 0 END AS cls,
  CAST(floor((x_mm + 14000) / 20.0) AS BIGINT) - 1700 + CASE WHEN y_mm >= 4000 THEN 120 ELSE 0 END
  - CASE WHEN CAST(floor((x_mm + 14000) / 1000.0) + floor((y_mm + 14000) / 1000.0) AS BIGINT) % 7 = 0 THEN 150 ELSE 0 END AS gz0,
  [{", ".join(map(str, RAW))}][h + 1] AS sem, [{", ".join(map(str, RAW))}][(h + CASE WHEN ln % 5 = 0 THEN 1 ELSE 0 END) % 20 + 1] AS pred FROM raw0),
pts AS (SELECT frame, pid, x_mm, y_mm, CASE WHEN cls IN (3, 4) THEN gz0 + 200 + p % 2500 ELSE gz0 + p % 7 END AS z_mm,
  cls, moving, conf, CAST(sem AS BIGINT) AS sem, CAST(sem + 65536 * (s % 300) AS BIGINT) AS raw, CAST(pred AS BIGINT) AS pred FROM raw1)"""
