"""Convex hulls of planar sets of any size, by pruning, partial hulls and merging.

1. Each task keeps what may be on the hull of what it has seen of a group: points strictly
   inside the polygon of the extremes in 16 directions are dropped batch by batch, and
   when it holds ``HELD`` points it reduces them to their hull.
2. Partial hulls are merged ``SLABS`` at most of a group, each from some of the tasks, then
   those of each group: a hull is made of hull points of any parts.  The set is read
   once, and only hull points of a task's part are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECTIONS = 16
HELD = 200_000
SLABS = 64


def chain(points: np.ndarray) -> np.ndarray:
    """Positions of the hull's corners, counter-clockwise from the least by (x, y); points on a side are none."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    order = order[np.concatenate([[True], (np.diff(points[order], axis=0) != 0).any(axis=1)])] if len(order) else order

    def half(indices: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in indices.tolist():
            x, y = points[i]
            while len(out) > 1:
                (ax, ay), (bx, by) = points[out[-2]], points[out[-1]]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    if len(order) < 3:
        return order
    lower, upper = half(order), half(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def outer(points: np.ndarray) -> np.ndarray:
    """``points`` without those strictly inside the polygon of their extremes, by more than rounding may hide."""
    if len(points) < 4 * DIRECTIONS:
        return points
    angle = 2 * np.pi * np.arange(DIRECTIONS) / DIRECTIONS
    tips = points[(points @ np.stack([np.cos(angle), np.sin(angle)])).argmax(axis=0)]
    if len(np.unique(tips, axis=0)) < 3:
        return points
    size = np.ptp(points[:, 0]) + 1e-300
    inside = np.ones(len(points), bool)
    for p, q in zip(tips, np.roll(tips, -1, axis=0), strict=True):
        # extremes of neighbouring directions may be one point, which says nothing
        if (p != q).any():
            d = q - p
            inside &= d[0] * (points[:, 1] - p[1]) - d[1] * (points[:, 0] - p[0]) > 1e-9 * np.abs(d).sum() * (size + np.abs(points[:, 1] - p[1]))
    return points[~inside]


def _partial(batches: Iterator, kinds) -> Iterator:
    """Hull points (g, slab, x, y) of each group and slab that a task sees."""
    import pyarrow as pa

    held: dict[tuple, list[np.ndarray]] = {}
    count = 0

    def reduce() -> None:
        nonlocal count
        count = 0
        for key, parts in held.items():
            points = outer(np.concatenate(parts))
            held[key] = [points[chain(points)]]
            count += len(held[key][0])

    def rows() -> Iterator:
        for (g, slab), parts in held.items():
            points = parts[0]
            for a in range(0, len(points), 50_000):
                own = points[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), kinds), pa.array(np.full(len(own), slab, np.int32)), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["g", "slab", "x", "y"])

    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        names, slab = groups.dictionary.to_pylist(), batch.column(1).to_numpy()
        number = groups.indices.fill_null(-1).to_numpy()
        points = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
        keys, at = np.unique(np.stack([number, slab], axis=1), axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        for (n, s), part in zip(keys.tolist(), np.split(points[order], np.cumsum(np.bincount(at.ravel()))[:-1]), strict=False):
            kept = outer(part)
            held.setdefault((names[n] if n >= 0 else None, s), []).append(kept)
            count += len(kept)
        if count > HELD:
            reduce()
            if count > HELD // 2:  # many groups, or large hulls: hand them on
                yield from rows()
                held.clear()
                count = 0
    reduce()
    yield from rows()


def hull2d(points: DataFrame, group: str = "g") -> DataFrame:
    """(g, seq, x, y): corners of each group's hull, counter-clockwise from the least by (x, y).

    Points with a coordinate that is null or not finite take no part; a group of one
    place has one corner, one on a line has two.
    """
    finite = (F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf"))
    own = points.where(finite).select(F.col(group).alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = own.schema["g"].dataType

    def partial(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        return _partial(batches, to_arrow_type(kind))

    schema = f"g {kind.simpleString()}, slab int, x double, y double"
    parts = own.select("g", (F.spark_partition_id() % SLABS).alias("slab"), "x", "y").mapInArrow(partial, schema)

    def merged(table):
        import pyarrow as pa

        points = np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], axis=1)
        at = chain(points)
        rows = table.take(pa.array(at))
        return rows

    def last(table):
        import pyarrow as pa

        rows = merged(table)
        return pa.Table.from_arrays([rows.column("g"), pa.array(np.arange(rows.num_rows)), rows.column("x"), rows.column("y")], names=["g", "seq", "x", "y"])

    slabs = parts.groupBy("g", "slab").applyInArrow(merged, schema)
    return slabs.groupBy("g").applyInArrow(last, f"g {kind.simpleString()}, seq bigint, x double, y double")
