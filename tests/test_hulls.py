"""Hulls of large sets against supporting lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import hulls


def corners(points):
    """Corners by their definition: no other point lies right of the line to the next, and none between them."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    at, out = points[0], []
    while True:
        out.append(at)
        best = None
        for q in points:
            if q == at:
                continue
            if best is None:
                best = q
                continue
            turn = (best[0] - at[0]) * (q[1] - at[1]) - (best[1] - at[1]) * (q[0] - at[0])
            if turn < 0 or (turn == 0 and math.dist(at, q) > math.dist(at, best)):
                best = q
        at = best
        if at == points[0]:
            return out


def found(df):
    out = {}
    for r in df.orderBy("g", "seq").collect():
        assert r.seq == len(out.setdefault(r.g, []))
        out[r.g].append((r.x, r.y))
    return out


def test_hulls_of_groups_of_every_kind(spark):
    rng = random.Random(2)
    sets = {
        "ball": [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000)],
        "grid": [(float(i % 20), float(i // 20)) for i in range(400)] * 2,
        "circle": [(math.cos(2 * math.pi * i / 500), math.sin(2 * math.pi * i / 500)) for i in range(500)],
        "far": [(1e6 + rng.random(), -1e6 + rng.random()) for _ in range(500)],
        "line": [(float(i), 2.0 * i) for i in range(50)],
        "upright": [(1.0, float(i)) for i in range(9)],
        "one": [(3.0, 4.0)] * 5,
        "two": [(0.0, 1.0), (2.0, 0.0)],
        None: [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.2, 0.2)],
    }
    rows = [(g, *p, 1) for g, points in sets.items() for p in points] + [("ball", None, 1.0, 1), ("ball", float("nan"), 1.0, 1), ("ball", float("inf"), 1.0, 1), ("gone", None, None, 1)]
    rng.shuffle(rows)
    got = found(hulls.hull2d(spark.createDataFrame(rows, "g string, x double, y double, slab int").repartition(5)))
    assert got == {g: corners(points) for g, points in sets.items()}


def test_inner_points_go_before_the_shuffle(spark):
    points = spark.range(200_000).select(F.lit(1).alias("g"), (F.rand(1) + F.rand(2)).alias("x"), (F.rand(3) + F.rand(4)).alias("y"))
    plan = hulls.hull2d(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.rindex("Filter") and "CartesianProduct" not in plan
    assert hulls.hull2d(points.limit(0)).count() == 0


@pytest.mark.parametrize("held", [3, 50])
def test_partial_hulls_of_small_buffers(held, monkeypatch):
    import pyarrow as pa

    rng = random.Random(held)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(500)]
    monkeypatch.setattr(hulls, "HELD", held)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("g", "slab", "x", "y"), r)) for r in rows[a : a + 40]], schema=pa.schema([("g", pa.string()), ("slab", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])) for a in range(0, 500, 40)]
    kept = {}
    for batch in hulls._partial(iter(batches), pa.string()):
        for r in batch.to_pylist():
            kept.setdefault((r["g"], r["slab"]), []).append((r["x"], r["y"]))
    for key in {r[:2] for r in rows}:
        assert corners(kept[key]) == corners([r[2:] for r in rows if r[:2] == key])


def test_only_hulls_of_tasks_are_shuffled(spark):
    import numpy as np
    from geoloom.operators import hulls as hl

    rows = spark.range(0, 200_000, 1, 4).selectExpr("id % 2 AS g", "cos(id) * sqrt(id % 9973) AS x", "sin(id * 1.7) * sqrt(id % 7919) AS y")
    rows = rows.unionAll(spark.sql("SELECT NULL AS g, CAST(id % 3 AS DOUBLE) AS x, CAST(id % 2 AS DOUBLE) AS y FROM range(300)"))
    got = {}
    for r in hl.hull2d(rows).orderBy("g", "seq").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    own = {}
    for r in rows.collect():
        own.setdefault(r.g, []).append((r.x, r.y))
    for g, points in own.items():
        points = np.array(points)
        assert got[g] == [tuple(p) for p in points[hl.chain(points)].tolist()]
        assert {tuple(p) for p in points[hl.chain(points)].tolist()} <= {tuple(p) for p in hl.outer(points).tolist()}
    # before, every row was sorted by group for the extremes and joined with them by group
    plan = hl.hull2d(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan and plan.rindex("MapInArrow") > plan.rindex("Exchange")
