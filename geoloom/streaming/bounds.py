"""Structured Streaming forms of the aggregations that make sense on a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bounds(points: DataFrame, time: str, group: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bounds and counts per group and time window; rows later than ``late`` are given up with their state."""
    return points.withWatermark(time, late).groupBy(F.window(time, window), group).agg(
        F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))]
    )


def windowed_cells(points: DataFrame, time: str, side: float, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """How many points each pixel of a grid took per time window."""
    cells = [F.floor(F.col(a) / side).alias(c) for a, c in zip("xy", "ij", strict=True)]
    return points.withWatermark(time, late).groupBy(F.window(time, window), *cells).agg(F.count("*").alias("n"))


def distinct_cells(points: DataFrame, time: str, side: float, late: str = "5 minutes") -> DataFrame:
    """Each cell once within the watermark: voxelization of a stream."""
    cells = points.withWatermark(time, late).select(time, *[F.floor(F.col(a) / side).alias(c) for a, c in zip("xyz", "ijk", strict=True)])
    return cells.dropDuplicatesWithinWatermark(["i", "j", "k"])
