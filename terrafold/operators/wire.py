"""What viewers get: display categories, packed rings, frames as JSON."""

from __future__ import annotations

import gzip
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.config import DYNAMIC, FLAG_GROUND, FLAG_KERB, FLAG_LOW, FLAG_TRAVERSABLE, NO_DATA, STATIC, Preset
from terrafold.functions.labels import MOVING_VEHICLES, STATIC_VEHICLES
from terrafold.operators.grid import per_ring
from terrafold.shipping import ship_package

#: Fixed layout of a packed cell, little-endian, 12 bytes.
CELL = np.dtype([("iy", "<i2"), ("ix", "<i2"), ("ground_z", "<i2"), ("top_z", "<i2"), ("flags", "u1"), ("cls", "u1"), ("moving_frac", "u1"), ("conf", "u1")])


def vehicle_counts(located: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Votes of each cell's points: vehicles at rest, vehicles in motion, other obstacles."""
    vehicle = F.col("sem").isin(*STATIC_VEHICLES, *MOVING_VEHICLES)
    return located.groupBy(*keys, "ring", "ix", "iy").agg(
        F.count_if(vehicle & ~F.col("moving")).alias("v_static"), F.count_if(vehicle & F.col("moving")).alias("v_moving"), F.count_if(~vehicle & F.col("cls").isin(STATIC, DYNAMIC)).alias("v_other")
    )


def category() -> Column:
    """0 unknown, 1 drivable, 2 vehicle at rest, 3 vehicle in motion, 4 other static things, 5 terrain and other moving things."""
    static = F.when(F.col("v_static") > F.col("v_other"), 2).otherwise(4)
    dynamic = F.when(F.col("v_moving") > F.col("v_other"), 3).otherwise(5)
    return F.when(F.col("cls") == 0, 0).when(F.col("cls") == 1, 1).when(F.col("cls") == 2, 5).when(F.col("cls") == STATIC, static).otherwise(dynamic)


def packed(cells: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """One row per frame and ring: n_cells and cells_b64, the occupied cells in row order."""

    ship_package(cells.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        import base64

        table = table.sort_by([("iy", "ascending"), ("ix", "ascending")])
        out = np.empty(table.num_rows, CELL)
        for c in CELL.names:
            out[c] = table[c].to_numpy().astype(CELL[c])
        one = table.slice(0, 1).select([*keys, "ring"])
        return one.append_column("n_cells", pa.array([table.num_rows], pa.int64())).append_column("cells_b64", pa.array([base64.b64encode(out.tobytes()).decode()]))

    names = [*keys, "ring", *CELL.names]
    part = cells.filter(F.col("count") > 0).select(*names)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.select(*keys, "ring").schema.fields)
    return part.groupBy(*keys, "ring").applyInArrow(run, f"{kinds}, n_cells long, cells_b64 string")


def unpacked(rings: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """The cells of packed()."""

    ship_package(rings.sparkSession)

    def run(batches):
        import base64

        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(base64.b64decode(row["cells_b64"]), CELL)
                columns = [pa.array([row[k]] * len(cells), batch.schema.field(k).type) for k in (*keys, "ring")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(cells[c].astype(np.int32)) for c in CELL.names)], names=[*keys, "ring", *CELL.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rings.select(*keys, "ring").schema.fields)
    return rings.select(*keys, "ring", "cells_b64").mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} int" for c in CELL.names))


def payloads(rings: DataFrame, counters: DataFrame, keys: Sequence[str] = ("frame",), version: int = 2, preset: Preset | None = None, groups: DataFrame | None = None, memory: DataFrame | None = None, objects: DataFrame | None = None, model: str = "oracle") -> DataFrame:
    """One JSON document per frame: version, keys, model, counters, rings in order, and what else is given.

    preset: rings have their sizes, and rings without cells are there too; groups: keys, ring, ix, iy, category of the cells,
    in the order of the packed ones; memory, objects: one and any number of rows a frame.
    """
    keys = list(keys)
    out = counters.withColumn("schema_version", F.lit(version)).withColumn("model", F.lit(model))
    inner = [F.col("ring").alias("ring_idx"), "n_cells", "cells_b64"]
    held = rings
    if groups is not None:
        shown = groups.groupBy(*keys, "ring").agg(F.sort_array(F.collect_list(F.struct("iy", "ix", "category"))).alias("_g"))  # the cells of a ring
        held = held.join(shown, [*keys, "ring"], "left").withColumn("display_group", F.transform("_g", lambda g: g["category"]))
        inner.append("display_group")
    if preset is not None:
        sizes = F.array(*(F.struct(F.lit(k).alias("ring"), F.lit(r.cell).alias("cell_mm"), F.lit(r.r).alias("r_max_mm"), F.lit(r.side).alias("side")) for k, r in enumerate(preset.rings)))
        all_rings = counters.select(*keys, F.explode(sizes).alias("_r")).select(*keys, "_r.*")
        held = all_rings.join(held, [*keys, "ring"], "left").withColumns({"n_cells": F.coalesce("n_cells", F.lit(0).cast("bigint")), "cells_b64": F.coalesce("cells_b64", F.lit(""))})
        inner += ["cell_mm", "r_max_mm", "side"]
    by = held.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("rings"))
    parts = ["schema_version", *keys, "model", F.struct(*(c for c in counters.columns if c not in keys)).alias("counters"), "rings"]
    out = out.join(by, keys, "left")
    if preset is not None:
        out = out.withColumn("preset", F.lit(preset.name))
        parts.append("preset")
    if memory is not None:
        out = out.join(memory.select(*keys, F.struct(*(c for c in memory.columns if c not in keys)).alias("memory")), keys, "left")
        parts.append("memory")
    if objects is not None:
        listed = objects.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("obj", *(c for c in objects.columns if c not in [*keys, "obj"])))).alias("_o"))
        out = out.join(listed, keys, "left").withColumn("objects", F.coalesce("_o", F.from_json(F.lit("[]"), listed.schema["_o"].dataType.simpleString()))).drop("_o")
        parts.append("objects")
    return out.select(*keys, F.to_json(F.struct(*parts)).alias("payload"))


def gzipped(documents: DataFrame, column: str = "payload", level: int = 1) -> DataFrame:
    """documents with the column as gzip of its UTF-8 bytes; the same text gives the same bytes, null stays null."""
    from pyspark.sql.functions import pandas_udf

    ship_package(documents.sparkSession)

    @pandas_udf("binary")
    def packed_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), level, mtime=0))

    return documents.withColumn(column, packed_text(column))


def gunzipped(documents: DataFrame, column: str = "payload") -> DataFrame:
    """The texts of gzipped()."""
    from pyspark.sql.functions import pandas_udf

    ship_package(documents.sparkSession)

    @pandas_udf("string")
    def text(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else gzip.decompress(d).decode())

    return documents.withColumn(column, text(column))


def last_payloads(documents: DataFrame, keys: Sequence[str] = ("seq",), frame: str = "frame") -> DataFrame:
    """The document of each sequence's last frame: what a new viewer gets."""
    return documents.groupBy(*keys).agg(F.max(frame).alias(frame), F.max_by("payload", frame).alias("payload"))


#: Red, green, blue and opacity of classes 0 to 4, and of what can be crossed.
CLASS_COLOURS = ((100, 100, 110, 140), (46, 204, 113, 230), (180, 110, 50, 220), (231, 76, 60, 240), (52, 152, 219, 255))
CROSSING_COLOURS = ((100, 100, 110, 120), (46, 204, 113, 230), (231, 76, 60, 230), (231, 76, 60, 240), (231, 76, 60, 255))
TEXTURES = ("class", "height", "traversability", "moving", "confidence")


def _rgba(*parts: Column) -> Column:
    """Parts as whole numbers from 0 to 255, cut towards zero."""
    whole = [F.least(F.greatest(p.cast("double"), F.lit(0.0)), F.lit(255.0)).cast("int") for p in parts]
    return F.struct(*(w.alias(c) for w, c in zip(whole, "rgba", strict=True)))


def _palette(rows: Sequence[tuple[int, int, int, int]]) -> Column:
    out = F.when(F.lit(False), _rgba(*(F.lit(0),) * 4))
    for k, row in enumerate(rows):
        out = out.when(F.col("cls") == k, _rgba(*map(F.lit, row)))
    return out


def texture(layer: str) -> Column:
    """r, g, b and a of an occupied cell in one of the TEXTURES."""
    if layer == "class":
        return _palette(CLASS_COLOURS)
    if layer == "traversability":
        return _palette(CROSSING_COLOURS)
    if layer == "height":
        z = F.when(F.col("top_z") != NO_DATA, F.col("top_z")).otherwise(F.col("ground_z")) / 1000.0
        t = F.least(F.greatest((z + 2.5) / 6.0, F.lit(0.0)), F.lit(1.0)) * 2.0
        low = t < 1.0
        above = t - 1.0
        return _rgba(F.when(low, t * 30.0).otherwise(30.0 + above * 225.0), F.when(low, t * 180.0).otherwise(180.0 + above * 50.0), F.when(low, 120.0 + t * 60.0).otherwise(180.0 - above * 150.0), F.lit(220))
    if layer == "moving":
        f = F.col("moving_frac") / 255.0
        return _rgba(f * 255.0, (1.0 - F.abs(f - 0.5) * 2.0) * 200.0, (1.0 - f) * 240.0, F.greatest(F.floor(f * 200.0 + 55.0), F.lit(80)))
    if layer == "confidence":
        c = F.col("conf") / 255.0
        return _rgba((1.0 - c) * 50.0, c * 220.0, c * 200.0 + 55.0, F.lit(220))
    raise ValueError(f"no layer {layer!r}")


def textures(cells: DataFrame, preset: Preset, layers: Sequence[str] = TEXTURES, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Pixels of occupied cells: keys, ring, row, col and r, g, b, a of each layer in columns of structs. Others are transparent."""
    row, col = texture_place(per_ring(preset, lambda k, r: r.side))
    return cells.filter(F.col("count") > 0).select(*keys, "ring", row.alias("row"), col.alias("col"), *(texture(x).alias(x) for x in layers))


#: Colours of a viewer's modes; opacity from 0 to 1.
LOW_CLEARANCE, KERB, NO_GROUND, CROSSABLE, BLOCKED = (177, 99, 239), (255, 185, 57), (109, 122, 143), (55, 196, 121), (231, 70, 79)


def viewer_colour(layer: str) -> Column:
    """r, g, b and opacity (0 to 1) of a cell in a viewer's layer: height, traversability, moving or conf; null if it has none."""
    flag = lambda f: F.col("flags").bitwiseAND(f) != 0
    solid = lambda rgb, a: F.struct(*(F.lit(v).alias(c) for v, c in zip(rgb, "rgb", strict=True)), (a if isinstance(a, Column) else F.lit(a)).cast("double").alias("a"))
    if layer == "traversability":
        out = F.when(flag(FLAG_LOW), solid(LOW_CLEARANCE, 0.96)).when(flag(FLAG_KERB), solid(KERB, 0.96)).when(~flag(FLAG_GROUND), solid(NO_GROUND, 0.55))
        return out.when(flag(FLAG_TRAVERSABLE), solid(CROSSABLE, 0.94)).otherwise(solid(BLOCKED, 0.94))
    if layer == "moving":
        m = F.col("moving_frac") / 255.0
        return F.when(m > 0.1, solid((238, 74, 84), 0.55 + m * 0.45)).otherwise(solid((69, 144, 221), 0.7))
    if layer == "conf":
        return solid((45, 201, 154), 0.2 + F.col("conf") / 255.0 * 0.8)
    if layer == "height":
        z = F.when(F.col("top_z") != NO_DATA, F.col("top_z")).when(F.col("ground_z") != NO_DATA, F.col("ground_z"))
        t = F.least(F.greatest((z / 1000.0 + 2.5) / 6.5, F.lit(0.0)), F.lit(1.0))
        part = lambda at: F.floor(F.least(F.greatest(255.0 * (1.5 - F.abs(4.0 * t - at)), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")
        a = F.when(F.col("ground_z") != NO_DATA, 0.96).otherwise(0.55)
        return F.when(z.isNotNull(), F.struct(part(3.0).alias("r"), part(2.0).alias("g"), part(1.0).alias("b"), a.alias("a")))
    raise ValueError(f"no layer {layer!r}")


def height_colour(z: Column, low: int, high: int) -> Column:
    """0 to 255 from low to high heights, null stays."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (z - low) / F.lit(float(high - low)))) * 255).cast("int")


def texture_place(side: Column) -> tuple[Column, Column]:
    """Row and column of a cell's pixel: forward is up, left is left."""
    return side - 1 - F.col("ix"), side - 1 - F.col("iy")
