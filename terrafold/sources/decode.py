"""A table function for SQL: the points of a scan's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from terrafold.sources.scans import POINT


@udtf(returnType="pid: bigint, x: float, y: float, z: float, remission: float")
class ScanPoints:
    """scan_points(content): pid, x, y, z, remission; bytes that aren't whole points are an error, null gives no rows."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        if len(content) % 16:
            raise ValueError(f"{len(content)} bytes are no whole number of points")
        points = np.frombuffer(content, np.dtype(POINT))
        yield from zip(range(len(points)), *(points[c].tolist() for c in ("x", "y", "z", "remission")), strict=True)


def register(spark: SparkSession) -> None:
    """Offer scan_points to SQL: SELECT p.* FROM files, LATERAL scan_points(content) p."""
    from terrafold.shipping import ship_package

    ship_package(spark)
    spark.udtf.register("scan_points", ScanPoints)
