"""Queries against brute force over all their rows, beside what their SQL states."""

import math

import numpy as np
import pytest

from geoloom.operators import joins, rings
from geoloom.operators import kernels as kn
from geoloom.plans import bindings as bd
from geoloom.plans import catalog


def test_every_ring_is_offset(spark, data):
    wanted = {}
    for p in bd.table(spark, data, "part").select("p_partkey", "p_size").collect():
        n = 3 + p.p_partkey % 6
        r = p.p_size / 50 + 0.25 / math.cos(math.pi / n)
        wanted[p.p_partkey] = n * r * r * math.sin(2 * math.pi / n) / 2
    got = {r.ring: r.area for r in catalog.queries()["polygon_offset_miter"](spark, data).collect()}
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 2e-5 for k in wanted)


def test_turned_rectangles_are_rectangular(spark, data):
    shapes = {"turned": [(0, 0), (4, 3), (2.5, 5), (-1.5, 2)], "upright": [(0, 0), (2, 0), (2, 1), (0, 1)], "ell": [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)], "half a percent off": [(0, 0), (1, 0), (1, 1), (0.1, 1), (0, 0.9)], "flat": [(0, 0), (1, 1), (2, 2)]}
    points = spark.createDataFrame([(k, i, float(x), float(y)) for k, v in shapes.items() for i, (x, y) in enumerate(v)], "ring string, seq long, x double, y double")
    assert {r.ring for r in rings.is_rectangular(points).where("rectangular").collect()} == {"turned", "upright"}
    for name in ("is_circular_ratio", "is_rectangular"):
        got = {r.ring: r.rectangular for r in catalog.queries()[name](spark, data).collect()}
        assert len(got) == bd.table(spark, data, "part").count() and all(v == (k % 6 == 1) for k, v in got.items())


def test_nearest_join_with_coordinates_that_are_no_numbers(spark):
    rows = [(0, 0.0, 0.0), (1, 3.0, 4.0), (2, None, 1.0), (3, 1.0, float("nan")), (4, float("inf"), 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    found = joins.nearest_join(points, points.withColumnRenamed("id", "query"), 3, 1.0).collect()
    assert {(r["query"], r["rank"], r["id"], r["distance"]) for r in found} == {(0, 1, 0, 0.0), (0, 2, 1, 5.0), (1, 1, 1, 0.0), (1, 2, 0, 5.0)}


def test_nearest_join_without_points_ends(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0)], "id long, x double, y double")
    assert joins.nearest_join(points.limit(0), points.withColumnRenamed("id", "query"), 3, 1.0).count() == 0
    assert joins.nearest_join(points, points.limit(0).withColumnRenamed("id", "query"), 3, 1.0).count() == 0


def test_nearest_join_leaves_no_query_out_silently(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 1000.0, 0.0)], "id long, x double, y double")
    with pytest.raises(ValueError, match="after 3 rounds"):
        joins.nearest_join(points, points.withColumnRenamed("id", "query"), 2, 1.0, rounds=3)


def shortest_edges_collapsed(ring, shortest):
    """(index, point) of the kept corners: the least edge by length and its corners' numbers, found anew each time."""
    ring = list(enumerate(ring))
    while len(ring) > 3:
        size, i, j, at = min((math.dist(p, q), i, j, at) for at, ((i, p), (j, q)) in enumerate(zip(ring, [*ring[1:], ring[0]], strict=True)))
        if size >= shortest:
            break
        p, q = ring[at][1], ring[(at + 1) % len(ring)][1]
        ring[at] = i, ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        del ring[(at + 1) % len(ring)]
    return [p for _, p in sorted(ring)]


def test_short_edges_of_real_rings_collapse(spark, data):
    rows, got = {}, {}
    for r in bd.rings(spark, data).orderBy("ring", "seq").collect():
        rows.setdefault(r.ring, []).append((r.x, r.y))
    for r in catalog.queries()["polygon_simplify_rings"](spark, data).orderBy("ring", "corner").collect():
        got.setdefault(r.ring, []).append((r.x, r.y))
    assert got.keys() == rows.keys()
    for k, ring in rows.items():
        wanted = shortest_edges_collapsed(ring, 20.0)
        print("ring", k, "corners", len(ring), "kept", len(wanted))
        assert 3 < len(wanted) < len(ring)
        assert len(got[k]) == len(wanted) and all(math.dist(p, q) < 2e-6 for p, q in zip(got[k], wanted, strict=True))


def test_minkowski_sum_of_a_ring_that_is_not_convex_is_an_error():
    square, ell = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]]), np.array([[0.0, 0], [3, 0], [3, 1], [1, 1], [1, 3], [0, 3]])
    assert kn.area2d(kn.minkowski_convex(square, square[::-1])) == pytest.approx(16)
    for pair in ((ell, square), (square, ell)):
        with pytest.raises(ValueError, match="not convex"):
            kn.minkowski_convex(*pair)


def test_radius_follows_the_density(spark):
    dense = spark.range(4000).selectExpr("id", "cast(id % 1000 as double) / 1000 as x", "cast(id * 7 % 1000 as double) / 1000 as y")
    radius = joins.closer(dense, 3, 4.0, ("x", "y"), 2.0)
    assert radius < 0.1
    equal = dense.selectExpr("id", "1.0D as x", "1.0D as y")
    assert joins.closer(equal, 3, 4.0, ("x", "y"), 2.0) == 4.0
    asked = dense.where("id % 100 = 0").withColumnRenamed("id", "query")
    rows = dense.collect()
    for q in asked.collect()[:5]:
        found = [r.id for r in joins.nearest_join(dense, asked.where(f"query = {q['query']}"), 3, 4.0).orderBy("rank").collect()]
        assert found == [r.id for r in sorted(rows, key=lambda r: (((r.x - q.x) ** 2 + (r.y - q.y) ** 2) ** 0.5, r.id))[:3]]


def test_boxes_meet_on_both_axes(spark):
    from pyspark.sql import functions as F

    column = spark.range(400).select("id", F.lit(0.0).alias("x0"), (F.col("id") * 20.0).alias("y0"), F.lit(1.0).alias("x1"), (F.col("id") * 20.0 + 9).alias("y1"))
    found = joins.box_overlaps(column, column, 8.0)
    assert sorted((r.a, r.b) for r in found.collect()) == [(i, i) for i in range(400)]
    assert "_y" in found._jdf.queryExecution().analyzed().toString()
