"""Operators on rings: tables (ring, seq, x, y) closed from the last vertex to the first."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.vector import ccw_angle, cross2, minus
from geoloom.operators.joins import by_shuffle
from geoloom.operators.kernels import area2d, least_ball, least_rectangle, per_arrays


def edges(points: DataFrame, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """``points`` with the next vertex (x2, y2); one window, partitioned by ring."""
    w = Window.partitionBy(ring).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.select("*", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in ("x", "y")])


def _wings(points: DataFrame, ring: str, seq: str) -> DataFrame:
    w = Window.partitionBy(ring).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.select(
        "*",
        *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in ("x", "y")],
        *[F.coalesce(F.lag(c).over(w), F.last(c).over(whole)).alias(f"{c}0") for c in ("x", "y")],
    )


def edge_cross() -> Column:
    return F.col("x") * F.col("y2") - F.col("x2") * F.col("y")


def edge_length() -> Column:
    return F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)


def measures(points: DataFrame, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """ring, n, area (counter-clockwise positive), perimeter, centroid, bounds."""
    area = F.sum(edge_cross()) / 2
    return edges(points, ring, seq).groupBy(ring).agg(
        F.count("*").alias("n"), area.alias("area"), F.sum(edge_length()).alias("perimeter"),
        F.try_divide(F.sum((F.col("x") + F.col("x2")) * edge_cross()), 6 * area).alias("cx"),
        F.try_divide(F.sum((F.col("y") + F.col("y2")) * edge_cross()), 6 * area).alias("cy"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )


def polyline_length(points: DataFrame, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Length of the open line."""
    w = Window.partitionBy(ring).orderBy(seq)
    step = F.sqrt((F.lead("x").over(w) - F.col("x")) ** 2 + (F.lead("y").over(w) - F.col("y")) ** 2)
    return points.select(ring, step.alias("step")).groupBy(ring).agg(F.sum("step").alias("length"))


def corners(points: DataFrame, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Every vertex with its turn, interior angle and convexity (convex, concave, straight), and axis turning points."""
    before, after = (F.col("x") - F.col("x0"), F.col("y") - F.col("y0")), (F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    turn = cross2(before, after)
    back = minus((F.col("x0"), F.col("y0")), (F.col("x"), F.col("y")))
    return _wings(points, ring, seq).select(
        ring, seq, "x", "y", turn.alias("turn"), ccw_angle(after, back).alias("interior_angle"),
        F.when(turn > 0, "convex").when(turn < 0, "concave").otherwise("straight").alias("convexity"),
        (before[0] * after[0] < 0).alias("turns_x"), (before[1] * after[1] < 0).alias("turns_y"),
    )


def winding(points: DataFrame, x, y, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Signed angle swept about a centre."""
    a, b = (F.col("x") - x, F.col("y") - y), (F.col("x2") - x, F.col("y2") - y)
    step = F.atan2(cross2(a, b), a[0] * b[0] + a[1] * b[1])
    return edges(points, ring, seq).groupBy(ring).agg(F.sum(step).alias("winding"))


def per_ring(points: DataFrame, kernel, schema: str, ring: str = "ring", seq: str = "seq", many: bool = False) -> DataFrame:
    """``kernel`` (corners in order in, tuples out; of many rings at once with ``many``) for every ring."""
    return per_arrays(points, ring, ["x", "y"], schema, kernel, [seq], many)


def is_rectangular(points: DataFrame, tolerance: float = 0.003, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """(ring, rectangular): whether a ring fills its rectangle of least area, which may be turned."""

    def run(rows: np.ndarray) -> list[tuple]:
        area = abs(area2d(rows))
        return [(bool(area > 0 and abs(least_rectangle(rows)["area"] - area) <= tolerance * area),)]

    return per_ring(points, run, "rectangular boolean", ring, seq)


def is_circular(points: DataFrame, tolerance: float = 0.003, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """(ring, share, circular): the share of its least circle that a ring fills, and whether both areas agree."""

    def run(rows: np.ndarray) -> list[tuple]:
        area, whole = abs(area2d(rows)), math.pi * least_ball(rows)[1] ** 2
        return [(area / whole if whole > 0 else None, bool(area > 0 and abs(whole - area) <= tolerance * area))]

    return per_ring(points, run, "share double, circular boolean", ring, seq)


def circularity(m: DataFrame) -> DataFrame:
    """Measures with 4 pi area / perimeter squared (1 for a circle)."""
    return m.withColumn("circularity", 4 * math.pi * F.abs("area") / (F.col("perimeter") * F.col("perimeter")))


def drop_collinear(points: DataFrame, tolerance: float = 1e-9, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Vertices at which the ring turns."""
    kept = corners(points, ring, seq).where(F.abs("turn") > tolerance)
    return kept.select(ring, seq, "x", "y")


def split_long_edges(points: DataFrame, longest: float, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Edges longer than ``longest`` in 1 + floor(length / longest) equal parts."""
    parts = F.when(edge_length() > longest, 1 + F.floor(edge_length() / longest)).otherwise(1).cast("int")
    t = F.col("part") / F.col("parts")
    cut = edges(points, ring, seq).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.select(ring, seq, "part", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def reverse(points: DataFrame, seq: str = "seq") -> DataFrame:
    return points.withColumn(seq, -F.col(seq))


def mirror(points: DataFrame, dx: float, dy: float) -> DataFrame:
    """Mirror at the line through the origin with direction (dx, dy)."""
    n = dx * dx + dy * dy
    x, y = F.col("x"), F.col("y")
    along = (x * dx + y * dy) / n
    return points.withColumns({"x": 2 * along * dx - x, "y": 2 * along * dy - y})


def nesting(ring_boxes: DataFrame, contains: DataFrame) -> DataFrame:
    """Depth of each ring from the pairs (outer, inner): even depths are outer borders, odd ones holes."""
    depth = contains.groupBy(F.col("inner").alias("ring")).agg(F.count("*").alias("depth"))
    return ring_boxes.join(by_shuffle(depth), "ring", "left").select("ring", F.coalesce("depth", F.lit(0)).alias("depth"), (F.coalesce("depth", F.lit(0)) % 2 == 1).alias("hole"))


def scanline_hits(points: DataFrame, spacing: float, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Crossings (line, x) of rings with the lines y = line * spacing; half open at vertices, so they come in pairs."""
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    first, last = F.floor(low / spacing) + 1, F.floor(high / spacing)
    lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    hits = edges(points, ring, seq).select(ring, "x", "y", "x2", "y2", F.explode(lines).alias("line"))
    at = F.col("line") * spacing
    return hits.select(ring, "line", (F.col("x") + (at - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))).alias("x"))


def area_normal_3d(points: DataFrame, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """(ring, area, nx, ny, nz) of rings in space: half the sum of the products of neighbouring corners, and its direction."""
    w = Window.partitionBy(ring).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = points.select(ring, "x", "y", "z", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in "xyz"])
    parts = {"nx": ("y", "z"), "ny": ("z", "x"), "nz": ("x", "y")}
    sums = nxt.groupBy(ring).agg(*[F.sum(F.col(p) * F.col(f"{q}2") - F.col(q) * F.col(f"{p}2")).alias(n) for n, (p, q) in parts.items()])
    size = F.sqrt(sum((F.col(n) ** 2 for n in ("ny", "nz")), F.col("nx") ** 2))
    return sums.select(ring, (size / 2).alias("area"), *[F.when(size > 0, F.col(n) / size).alias(n) for n in parts])
