"""The label dimension: raw ids, the 19-class ids, super-classes, and lookups as broadcast joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the public SemanticKITTI labels: raw id, name, 19-class id, super-class, moving, safety-critical.
LABELS = (
    (0, "unlabeled", 0, 0, False, False),
    (1, "outlier", 0, 0, False, False),
    (10, "car", 1, 3, False, False),
    (11, "bicycle", 2, 3, False, False),
    (13, "bus", 5, 3, False, False),
    (15, "motorcycle", 3, 3, False, False),
    (16, "on-rails", 5, 3, False, False),
    (18, "truck", 4, 3, False, False),
    (20, "other-vehicle", 5, 3, False, False),
    (30, "person", 6, 4, False, True),
    (31, "bicyclist", 7, 4, False, True),
    (32, "motorcyclist", 8, 4, False, True),
    (40, "road", 9, 1, False, False),
    (44, "parking", 10, 1, False, False),
    (48, "sidewalk", 11, 2, False, False),
    (49, "other-ground", 12, 2, False, False),
    (50, "building", 13, 3, False, False),
    (51, "fence", 14, 3, False, False),
    (52, "other-structure", 0, 3, False, False),
    (60, "lane-marking", 9, 1, False, False),
    (70, "vegetation", 15, 3, False, False),
    (71, "trunk", 16, 3, False, False),
    (72, "terrain", 17, 2, False, False),
    (80, "pole", 18, 3, False, False),
    (81, "traffic-sign", 19, 3, False, False),
    (99, "other-object", 0, 3, False, False),
    (252, "moving-car", 1, 4, True, False),
    (253, "moving-bicyclist", 7, 4, True, True),
    (254, "moving-person", 6, 4, True, True),
    (255, "moving-motorcyclist", 8, 4, True, True),
    (256, "moving-on-rails", 5, 4, True, False),
    (257, "moving-bus", 5, 4, True, False),
    (258, "moving-truck", 4, 4, True, False),
    (259, "moving-other-vehicle", 5, 4, True, False),
)
#: Raw ids that stand for the 19 classes.
REPRESENTATIVES = (0, 10, 11, 15, 18, 20, 30, 31, 32, 40, 44, 48, 49, 50, 51, 70, 71, 72, 80, 81)
#: Labels that can move, by raw id.
MOVABLE = (10, 11, 13, 15, 16, 18, 20, 30, 31, 32)
#: Names of vulnerable road users, at rest and moving.
VULNERABLE = tuple(f"{m}{n}" for m in ("", "moving-") for n in ("person", "bicyclist", "motorcyclist"))
STATIC_VEHICLES = (10, 11, 13, 15, 16, 18, 20)
MOVING_VEHICLES = (252, 256, 257, 258, 259)


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "raw_id bigint, name string, learning_id int, super_cls int, is_moving boolean, critical boolean")


def semantic(raw: Column) -> Column:
    return raw.cast("bigint").bitwiseAND(65535)


def instance(raw: Column) -> Column:
    return F.shiftright(raw.cast("bigint"), 16)


def classified(points: DataFrame, raw: str = "raw") -> DataFrame:
    """points with name, learning_id, super_cls, is_moving, critical and known; unknown ids are class 0."""
    dim = label_dim(points.sparkSession)  # 34 rows
    out = points.withColumn("_sem", semantic(F.col(raw))).join(F.broadcast(dim), F.col("_sem") == F.col("raw_id"), "left")
    filled = {"learning_id": 0, "super_cls": 0, "is_moving": False, "critical": False}
    return out.withColumn("known", F.col("raw_id").isNotNull()).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()}).drop("_sem", "raw_id")


def representative(learning_id: Column) -> Column:
    """The raw id that stands for a 19-class id; others are an error."""
    ids = F.array(*(F.lit(x).cast("bigint") for x in REPRESENTATIVES))
    ok = learning_id.between(0, len(REPRESENTATIVES) - 1)
    return F.when(ok, F.element_at(ids, F.when(ok, learning_id + 1).otherwise(1).cast("int"))).otherwise(F.raise_error(F.lit("class id out of range")).cast("bigint"))


#: Fixed values of the public dataset: display colours (red, green, blue) by raw id.
COLOURS = {
    0: (0, 0, 0), 1: (255, 0, 0), 10: (100, 150, 245), 11: (100, 230, 245), 13: (100, 80, 250), 15: (30, 60, 150), 16: (0, 0, 255), 18: (80, 30, 180),
    20: (0, 0, 255), 30: (255, 30, 30), 31: (255, 40, 200), 32: (150, 30, 90), 40: (255, 0, 255), 44: (255, 150, 255), 48: (75, 0, 75), 49: (175, 0, 75),
    50: (255, 200, 0), 51: (255, 120, 50), 52: (255, 150, 0), 60: (150, 255, 170), 70: (0, 175, 0), 71: (135, 60, 0), 72: (150, 240, 80), 80: (255, 240, 150),
    81: (255, 0, 0), 99: (50, 255, 255), 252: (100, 150, 245), 253: (255, 40, 200), 254: (255, 30, 30), 255: (150, 30, 90), 256: (0, 0, 255), 257: (100, 80, 250),
    258: (80, 30, 180), 259: (0, 0, 255),
}


def coloured(points: DataFrame, raw: str = "raw") -> DataFrame:
    """points with name (unknown-<id> for ids nobody knows) and red, green, blue (black for them)."""
    rows = [(k, n, *COLOURS[k]) for k, n, *_ in LABELS]
    dim = points.sparkSession.createDataFrame(rows, "_id bigint, name string, red int, green int, blue int")  # 34 rows
    out = points.withColumn("_sem", semantic(F.col(raw))).join(F.broadcast(dim), F.col("_sem") == F.col("_id"), "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("red", "green", "blue")}
    return out.withColumns(filled | {"name": F.coalesce("name", F.concat(F.lit("unknown-"), F.col("_sem")))}).drop("_sem", "_id")


def unknown_ids(points: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw ids that aren't among the labels, and how often each occurs."""
    known = F.col("id").isin(*(k for k, *_ in LABELS))
    return points.select(semantic(F.col(raw)).alias("id")).filter(~known).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
