"""Catalogue of queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import matrix as mx
from geoloom.functions import surfaces as sf
from geoloom.functions import vector as vc
from geoloom.operators import assembly, isosurface, joins, mesh, rings, statistics, voxels
from geoloom.operators.joins import by_shuffle
from geoloom.plans import bindings as bd
from geoloom.plans import expressions, files, repairs, shapes, solids, surfaces, topology  # noqa: F401
from geoloom.plans.bindings import mesh_vertices
from geoloom.plans.registry import QUERIES, SQL, near, oracle_sql, queries, query, rounded  # noqa: F401


def p3() -> tuple:
    return vc.vector("x", "y", "z")


# ---------------------------------------------------------------- rings


@query(f"WITH {bd.RING_EDGES} SELECT ring, round(sum(x * y2 - x2 * y) / 2, 4) + 0.0 AS area, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 4) + 0.0 AS perimeter FROM ring_edges GROUP BY ring")
def ring_area_perimeter(spark, d):
    return rounded(rings.measures(bd.rings(spark, d)).select("ring", "area", "perimeter"))


@query(f"WITH {bd.RING_EDGES} SELECT ring, round(sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)), 4) + 0.0 AS cx, round(sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)), 4) + 0.0 AS cy FROM ring_edges GROUP BY ring")
def ring_centroid(spark, d):
    return rounded(rings.measures(bd.rings(spark, d)).select("ring", "cx", "cy"))


@query(f"WITH {bd.RINGS} SELECT ring, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM rings GROUP BY ring")
def ring_bounds(spark, d):
    return rings.measures(bd.rings(spark, d)).select("ring", "n", "min_x", "max_x", "min_y", "max_y")


WINGS = bd.RINGS + """, wings AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2,
 coalesce(lag(x) OVER w, last_value(x) OVER v) AS x0, coalesce(lag(y) OVER w, last_value(y) OVER v) AS y0 FROM rings
 WINDOW w AS (PARTITION BY ring ORDER BY seq), v AS (PARTITION BY ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 turns AS (SELECT *, (x - x0) * (y2 - y) - (y - y0) * (x2 - x) AS turn FROM wings)"""


@query(f"WITH {WINGS} SELECT ring, count(*) FILTER (turn > 0) AS convex, count(*) FILTER (turn < 0) AS concave, count(*) FILTER (turn = 0) AS straight FROM turns GROUP BY ring")
def ring_convexity_counts(spark, d):
    c = rings.corners(bd.rings(spark, d))
    return c.groupBy("ring").agg(*[F.count_if(F.col("convexity") == k).alias(k) for k in ("convex", "concave", "straight")])


@query(f"WITH {WINGS} SELECT ring, count(*) FILTER ((x - x0) * (x2 - x) < 0) AS turns_x, count(*) FILTER ((y - y0) * (y2 - y) < 0) AS turns_y FROM turns GROUP BY ring")
def ring_monotone_changes(spark, d):
    return rings.corners(bd.rings(spark, d)).groupBy("ring").agg(F.count_if("turns_x").alias("turns_x"), F.count_if("turns_y").alias("turns_y"))


@query(f"WITH {WINGS} SELECT ring, round(sum(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END), 3) AS angles FROM (SELECT ring, atan2((x2 - x) * (y0 - y) - (y2 - y) * (x0 - x), (x2 - x) * (x0 - x) + (y2 - y) * (y0 - y)) AS a FROM turns) GROUP BY ring")
def ring_interior_angles(spark, d):
    return rounded(rings.corners(bd.rings(spark, d)).groupBy("ring").agg(F.sum("interior_angle").alias("angles")), 3)


@query(f"WITH {bd.RING_EDGES} SELECT ring, round(sum(atan2((x - 50.5) * (y2 - 48.5) - (y - 48.5) * (x2 - 50.5), (x - 50.5) * (x2 - 50.5) + (y - 48.5) * (y2 - 48.5))), 4) + 0.0 AS winding FROM ring_edges GROUP BY ring")
def ring_winding_about_point(spark, d):
    return rounded(rings.winding(bd.rings(spark, d), 50.5, 48.5))


@query(f"WITH {bd.RINGS} SELECT ring, round(sum(s), 4) AS length FROM (SELECT ring, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS s FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)) GROUP BY ring")
def polyline_length(spark, d):
    return rounded(rings.polyline_length(bd.rings(spark, d)))


@query("SELECT p_partkey AS ring, round((3 + p_partkey % 6) * (p_size / 50.0) ** 2 * sin(2 * pi() / (3 + p_partkey % 6)) / 2, 6) AS area, round(2 * (3 + p_partkey % 6) * (p_size / 50.0) * sin(pi() / (3 + p_partkey % 6)), 6) AS perimeter FROM part")
def ngon_closed_form(spark, d):
    return rounded(rings.measures(bd.ngons(spark, d)).select("ring", "area", "perimeter"), 6)


@query("SELECT p_partkey AS ring, round(pi() / (n * tan(pi() / n)), 6) AS circularity, n = 4 AS rectangular FROM (SELECT p_partkey, 3 + p_partkey % 6 AS n FROM part)")
def is_circular_ratio(spark, d):
    n = bd.ngons(spark, d)
    m = rings.circularity(rings.measures(n)).join(by_shuffle(rings.is_rectangular(n)), "ring")
    return m.select("ring", near("circularity", 6).alias("circularity"), "rectangular")


@query("SELECT ring, round(n * sin(2 * pi() / n) / (2 * pi()), 6) AS share, abs(n * sin(2 * pi() / n) / (2 * pi()) - 1) <= 0.003 AS circular FROM (SELECT p_partkey AS ring, 3 + p_partkey % 90 AS n FROM part)")
def is_circular(spark, d):
    """Regular rings of 3 to 92 corners fill their least circle to a known share; only those of many corners count as circles."""
    k = F.col("p_partkey")
    corners = bd.table(spark, d, "part").select(k.alias("ring"), (3 + k % 90).alias("n"), (F.col("p_size") / 50).alias("r")).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    angle = 2 * math.pi * F.col("seq") / F.col("n")
    found = rings.is_circular(corners.select("ring", "seq", (3 + F.col("r") * F.cos(angle)).alias("x"), (4 + F.col("r") * F.sin(angle)).alias("y")))
    return found.select("ring", near("share", 6).alias("share"), "circular")


@query("SELECT p_partkey AS ring, 3 + p_partkey % 6 = 4 AS rectangular FROM part")
def is_rectangular(spark, d):
    return rings.is_rectangular(bd.ngons(spark, d))


@query(f"WITH {bd.RING_EDGES}, cut AS (SELECT *, CASE WHEN l > 20 THEN 1 + CAST(floor(l / 20) AS INT) ELSE 1 END AS parts FROM (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS l FROM ring_edges)) SELECT ring, CAST(sum(parts) AS BIGINT) AS vertices FROM cut GROUP BY ring")
def ring_complexify(spark, d):
    return rings.split_long_edges(bd.rings(spark, d), 20.0).groupBy("ring").agg(F.count("*").alias("vertices"))


@query(f"WITH {bd.RING_EDGES}, hits AS (SELECT ring, line, x + (line * 10 - y) / (y2 - y) * (x2 - x) AS hx FROM ring_edges, LATERAL (SELECT unnest(generate_series(CAST(floor(least(y, y2) / 10) + 1 AS BIGINT), CAST(floor(greatest(y, y2) / 10) AS BIGINT))) AS line)) SELECT ring, line, count(*) AS hits, round(sum(hx), 3) + 0.0 AS total FROM hits GROUP BY ring, line")
def scanline_hits(spark, d):
    h = rings.scanline_hits(bd.rings(spark, d), 10.0)
    return h.groupBy("ring", "line").agg(F.count("*").alias("hits"), near(F.sum("x"), 3).alias("total"))


@query(f"WITH {bd.RING_EDGES} SELECT ring, round(-sum(x * y2 - x2 * y) / 2, 2) + 0.0 AS area FROM ring_edges GROUP BY ring")
def ring_mirror_area(spark, d):
    return rounded(rings.measures(rings.mirror(bd.rings(spark, d), 1.0, 2.0)).select("ring", "area"), 2)


# ---------------------------------------------------------------- vectors and matrices


@query(f"WITH {bd.POINTS3D} SELECT id, round(x / l, 6) AS ux, round(y / l, 6) AS uy, round(z / l, 6) AS uz, round(x + 2 * y - z, 6) + 0.0 AS dot, round(-y - 2 * z, 6) + 0.0 AS cx, round(x + z, 6) AS cy, round(2 * x - y, 6) + 0.0 AS cz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM points3d)")
def vec_normalize_dot_cross(spark, d):
    u, n, c = vc.normalize(p3()), (1.0, 2.0, -1.0), vc.cross(p3(), (1.0, 2.0, -1.0))
    return rounded(bd.points3d(spark, d).select("id", *[v.alias(k) for v, k in zip(u, ("ux", "uy", "uz"), strict=True)], vc.dot(p3(), n).alias("dot"), *[v.alias(k) for v, k in zip(c, ("cx", "cy", "cz"), strict=True)]), 6)


@query(f"WITH {bd.POINTS3D} SELECT id, round(x * cos(0.3) - y * sin(0.3) + 1, 6) + 0.0 AS x, round(x * sin(0.3) + y * cos(0.3) + 2, 6) + 0.0 AS y, round(z + 3, 6) AS z FROM points3d")
def rotate_points_z(spark, d):
    p = mx.transform(p3(), mx.product(mx.rotation_z(0.3), mx.translation(1.0, 2.0, 3.0)))
    return rounded(bd.points3d(spark, d).select("id", *[v.alias(k) for v, k in zip(p, "xyz", strict=True)]), 6)


@query(f"WITH {bd.POINTS3D} SELECT id, round(x - 2 * s * 0.6, 6) + 0.0 AS x, round(y, 6) AS y, round(z - 2 * s * 0.8, 6) + 0.0 AS z FROM (SELECT *, x * 0.6 + z * 0.8 - 2 AS s FROM points3d)")
def reflect_points(spark, d):
    p = mx.transform(p3(), mx.reflection((0.6, 0.0, 0.8), 2.0))
    return rounded(bd.points3d(spark, d).select("id", *[v.alias(k) for v, k in zip(p, "xyz", strict=True)]), 6)


@query(f"WITH {bd.POINTS2D} SELECT id, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, 6) AS angle, round(CASE WHEN abs(x) + abs(y) = 0 THEN NULL WHEN x < 0 THEN 2 - y / (abs(x) + abs(y)) WHEN y < 0 THEN 4 + y / (abs(x) + abs(y)) ELSE y / (abs(x) + abs(y)) END, 6) AS pseudo FROM (SELECT *, atan2(2 * y - x, 2 * x + y) AS a FROM points2d)")
def angle_ccw(spark, d):
    p = vc.vector("x", "y")
    return rounded(bd.points2d(spark, d).select("id", vc.ccw_angle((2.0, 1.0), p).alias("angle"), vc.pseudo_angle(*p).alias("pseudo")), 6)


@query(f"WITH {bd.POINTS3D} SELECT coalesce(axis, 'none') AS axis, count(*) AS n FROM (SELECT CASE WHEN x / l >= 0.9 THEN 'XPositive' WHEN x / l <= -0.9 THEN 'XNegative' WHEN y / l >= 0.9 THEN 'YPositive' WHEN y / l <= -0.9 THEN 'YNegative' WHEN z / l >= 0.9 THEN 'ZPositive' WHEN z / l <= -0.9 THEN 'ZNegative' END AS axis FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM points3d)) GROUP BY 1")
def snap_cartesian(spark, d):
    return bd.points3d(spark, d).select(F.coalesce(vc.snap_to_axis(p3(), 0.9), F.lit("none")).alias("axis")).groupBy("axis").agg(F.count("*").alias("n"))


@query(f"WITH {bd.POINTS3D} SELECT id, round(x * (y - 3) - 2 * (z - 12) + 0.5 * (z - 4 * y), 6) + 0.0 AS det FROM points3d")
def matrix_determinant(spark, d):
    x, y, z = p3()
    m = ((x, F.lit(2.0), F.lit(0.5)), (z, y, F.lit(3.0)), (F.lit(4.0), F.lit(1.0), F.lit(1.0)))
    return bd.points3d(spark, d).select("id", near(mx.determinant(m), 6).alias("det"))


@query(f"WITH {bd.POINTS3D} SELECT id, round((x - 2 * y) / -3, 6) + 0.0 AS u, round((y - 2 * x) / -3, 6) + 0.0 AS v, round(z / 2, 6) AS w FROM points3d")
def matrix_solve(spark, d):
    m = ((F.lit(1.0), F.lit(2.0), F.lit(0.0)), (F.lit(2.0), F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    s = mx.solve(m, p3())
    return rounded(bd.points3d(spark, d).select("id", *[v.alias(k) for v, k in zip(s, "uvw", strict=True)]), 6)


@query(f"WITH {bd.POINTS3D} SELECT id, round((-(x + 1) - sqrt((x + 1) ** 2 + 4 * y)) / 2, 6) AS r1, round((-(x + 1) + sqrt((x + 1) ** 2 + 4 * y)) / 2, 6) AS r2 FROM points3d")
def quadratic_roots(spark, d):
    r = sf.quadratic_roots(F.lit(1.0), F.col("x") + 1, -F.col("y"))
    return rounded(bd.points3d(spark, d).select("id", r[0].alias("r1"), r[1].alias("r2")), 6)


# ---------------------------------------------------------------- aggregations and fits


@query(f"WITH {bd.POINTS3D} SELECT g, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM points3d GROUP BY g")
def aabb_per_group(spark, d):
    return bd.points3d(spark, d).groupBy("g").agg(*[(near(f(a), 6) if a == "z" else f(a)).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


@query(f"WITH {bd.POINTS3D}, r AS (SELECT *, round(x + 2 * y - z, 6) AS r FROM points3d) SELECT g, min(r) + 0.0 AS low, max(r) + 0.0 AS high, arg_min(id, (r, id)) AS low_id, arg_min(id, (-r, id)) AS high_id FROM r GROUP BY g")
def extreme_along_direction(spark, d):
    r = bd.points3d(spark, d).withColumn("r", F.round(vc.dot(p3(), (1.0, 2.0, -1.0)), 6))
    return r.groupBy("g").agg((F.min("r") + 0.0).alias("low"), (F.max("r") + 0.0).alias("high"), F.min_by("id", F.struct("r", "id")).alias("low_id"), F.min_by("id", F.struct(-F.col("r"), "id")).alias("high_id"))


DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]


@query(f"WITH {bd.POINTS3D} SELECT g, " + ", ".join(f"round((max({a} * x + {b} * y + {c} * z) - min({a} * x + {b} * y + {c} * z)) / sqrt({a * a + b * b + c * c}), 4) AS d{i}" for i, (a, b, c) in enumerate(DIRECTIONS)) + " FROM points3d GROUP BY g")
def extent_along_13_directions(spark, d):
    reach = [vc.dot(p3(), tuple(map(float, v))) for v in DIRECTIONS]
    return bd.points3d(spark, d).groupBy("g").agg(*[near((F.max(r) - F.min(r)) / math.sqrt(sum(x * x for x in v))).alias(f"d{i}") for i, (r, v) in enumerate(zip(reach, DIRECTIONS, strict=True))])


@query(f"""WITH {bd.POINTS3D}, m AS (SELECT g, median(y) AS md FROM points3d GROUP BY g)
 SELECT g, count(y) AS n, round(avg(y), 4) AS mean, round(any_value(md), 4) AS median, round(var_pop(y), 4) AS variance, round(avg((y - md) ** 2), 4) AS median_variance, round(sqrt(avg((y - 30) ** 2)), 4) AS rmse, round(sqrt(avg((y - 30) ** 2)) / (max(y) - min(y)), 4) AS nrmse FROM points3d JOIN m USING (g) GROUP BY g""")
def stats_median_nth_rmse_nrmse(spark, d):
    return rounded(statistics.summary(bd.points3d(spark, d), "g", "y", 30.0))


@query(f"WITH {bd.POINTS3D}, r AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) AS n FROM points3d) SELECT g, y AS nth FROM r WHERE n = 101")
def stats_nth_order(spark, d):
    return statistics.nth(bd.points3d(spark, d), "g", "y", 100)


@query(f"""WITH {bd.POINTS3D}, s AS (SELECT g, avg(y) AS m, var_pop(y) / (count(*) - 1) AS v, count(*) AS n FROM points3d GROUP BY g)
 SELECT round((a.m - b.m) / sqrt(a.v + b.v), 4) + 0.0 AS t, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1)), 2) AS freedom FROM s a, s b WHERE a.g = 'A' AND b.g = 'R'""")
def welch_t(spark, d):
    p = bd.points3d(spark, d).where(F.col("g").isin("A", "R"))
    s = p.groupBy().agg(*[f(F.when(F.col("g") == g, F.col("y"))).alias(f"{n}_{k}") for g, n in (("A", "a"), ("R", "b")) for k, f in (("mean", F.avg), ("var", F.var_pop), ("n", F.count))])
    t, freedom = statistics.welch("a", "b")
    return s.select(near(t).alias("t"), F.round(freedom, 2).alias("freedom"))


@query(f"WITH {bd.POINTS2D} SELECT g, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) + 0.0 AS r2 FROM points2d GROUP BY g")
def line_fit_2d(spark, d):
    f = statistics.line_fit(bd.points2d(spark, d), "g")
    return f.select("g", near("slope", 6).alias("slope"), near("intercept").alias("intercept"), near("r2", 6).alias("r2"))


@query("SELECT p_partkey AS ring, round(CAST(p_partkey % 20 AS DOUBLE), 5) + 0.0 AS cx, round(floor(p_partkey / 20.0), 5) + 0.0 AS cy, round(p_size / 50.0, 5) AS radius FROM part")
def circle_fit_landau(spark, d):
    return rounded(statistics.circle_fit(bd.ngons(spark, d).select("ring", "x", "y"), "ring"), 5)


@query("SELECT p_partkey AS mesh, round(((p_partkey % 20) * 10) + (p_size / 10.0 + 1) / 2, 6) AS cx, round(5 + (p_partkey % 7 + 1) / 2.0, 6) AS cy, round(5 + (p_partkey % 3 + 1) / 2.0, 6) AS cz, round(sqrt((p_size / 10.0 + 1) ** 2 + (p_partkey % 7 + 1) ** 2 + (p_partkey % 3 + 1) ** 2) / 2, 6) AS radius FROM part")
def sphere_fit(spark, d):
    return rounded(statistics.sphere_fit(mesh_vertices(bd.cuboids(spark, d)), "mesh"), 6)


@query("SELECT p_partkey AS mesh, round(0.0, 6) AS mse, round(5.0, 6) AS d FROM part")
def plane_fit(spark, d):
    bottom = mesh_vertices(bd.cuboids(spark, d)).where("z = 5")
    return statistics.plane_fit(bottom, "mesh").select("mesh", near("mse", 6).alias("mse"), near("d", 6).alias("d"))


# ---------------------------------------------------------------- joins

ASKED = "asked AS (SELECT id AS query, x AS qx, y AS qy FROM points2d WHERE id % 20 = 0)"


def _asked(p: DataFrame) -> DataFrame:
    """The stated query set: every point whose id is divisible by 20."""
    return p.where(F.col("id") % 20 == 0).select(F.col("id").alias("query"), "x", "y")


@query(f"WITH {bd.POINTS2D}, {ASKED} SELECT query, n AS rank, id, round(d, 6) AS distance FROM (SELECT query, id, d, row_number() OVER (PARTITION BY query ORDER BY d, id) AS n FROM (SELECT query, id, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS d FROM asked, points2d)) WHERE n <= 3")
def knn_k3(spark, d):
    p = bd.points2d(spark, d)
    return rounded(joins.nearest_join(p, _asked(p), 3, 4.0), 6)


@query(f"WITH {bd.POINTS2D}, {ASKED} SELECT query, count(*) AS n, round(sum(d), 4) AS total FROM (SELECT query, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS d FROM asked, points2d) WHERE d <= 5 GROUP BY query")
def radius_search(spark, d):
    p = bd.points2d(spark, d)
    return joins.radius_join(p, _asked(p), 5.0).groupBy("query").agg(F.count("*").alias("n"), near(F.sum("distance")).alias("total"))


@query(f"WITH {bd.POINTS2D}, {ASKED} SELECT query, id, g AS payload FROM (SELECT query, id, g, row_number() OVER (PARTITION BY query ORDER BY sqrt((x - qx) ** 2 + (y - qy) ** 2), id) AS n FROM asked, points2d) WHERE n = 1")
def knn_payload(spark, d):
    p = bd.points2d(spark, d)
    return joins.nearest_join(p, _asked(p), 1, 4.0).join(by_shuffle(p.select("id", F.col("g").alias("payload"))), "id").select("query", "id", "payload")


@query(f"WITH {bd.RING_EDGES}, q AS (SELECT id, x AS px, y + 0.5 AS py FROM (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y FROM supplier)) SELECT ring, id FROM q, ring_edges WHERE (y > py) <> (y2 > py) AND px < x + (py - y) / (y2 - y) * (x2 - x) GROUP BY ring, id HAVING count(*) % 2 = 1")
def point_in_polygon(spark, d):
    s = bd.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), ((F.col("s_suppkey") % 97).cast("double") + 0.5).alias("y"))
    e = rings.edges(bd.rings(spark, d)).select("ring", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("x2").alias("ex2"), F.col("y2").alias("ey2"))
    return joins.points_in_rings(s, e, 8.0)


@query(f"WITH {bd.boxes_sql('p', 'part', 'p_partkey')}, {bd.boxes_sql('s', 'supplier', 's_suppkey')} SELECT p.id AS a, s.id AS b FROM p, s WHERE p.x0 < s.x1 AND s.x0 < p.x1 AND p.y0 < s.y1 AND s.y0 < p.y1")
def rect_overlap_join(spark, d):
    return joins.box_overlaps(bd.boxes(spark, d, "part", "p_partkey"), bd.boxes(spark, d, "supplier", "s_suppkey"), 8.0)


LINES = "lines AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 400 AS DOUBLE) AS x1, CAST(p_partkey * 61 % 400 AS DOUBLE) AS y1, CAST(p_partkey * 37 % 400 + p_partkey % 11 - 5 AS DOUBLE) AS x2, CAST(p_partkey * 61 % 400 + p_partkey % 7 - 2.5 AS DOUBLE) AS y2 FROM part)"


def _lines(spark, d):
    k = F.col("p_partkey")
    return bd.table(spark, d, "part").select(k.alias("id"), (k * 37 % 400).cast("double").alias("x1"), (k * 61 % 400).cast("double").alias("y1"), (k * 37 % 400 + k % 11 - 5).cast("double").alias("x2"), (k * 61 % 400 + k % 7 - 2.5).cast("double").alias("y2"))


@query(f"""WITH {LINES}, m AS (SELECT a.id AS a, b.id AS b, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS det, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS t, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS u FROM lines a, lines b WHERE a.id < b.id)
 SELECT a, b, round(t / det, 6) + 0.0 AS t, round(u / det, 6) + 0.0 AS u FROM m WHERE det <> 0 AND t / det BETWEEN 0 AND 1 AND u / det BETWEEN 0 AND 1""")
def segment_intersections(spark, d):
    return rounded(joins.segment_meetings(_lines(spark, d), 8.0), 6)


@query(f"WITH {LINES} SELECT id, round(sqrt((x1 + t * (x2 - x1) - 200) ** 2 + (y1 + t * (y2 - y1) - 200) ** 2), 6) AS distance FROM (SELECT *, CASE WHEN l > 0 THEN least(greatest(((200 - x1) * (x2 - x1) + (200 - y1) * (y2 - y1)) / l, 0), 1) ELSE 0 END AS t FROM (SELECT *, (x2 - x1) ** 2 + (y2 - y1) ** 2 AS l FROM lines))")
def point_segment_distance(spark, d):
    return rounded(_lines(spark, d).select("id", vc.point_segment_distance((200.0, 200.0), vc.vector("x1", "y1"), vc.vector("x2", "y2")).alias("distance")), 6)


@query("SELECT e.event_id, (SELECT o_orderkey FROM orders WHERE o_custkey = e.user_id AND o_orderdate <= e.ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order FROM events e")
def as_of_join(spark, d):
    e = bd.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("time"))
    o = bd.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("time")).agg(F.max("o_orderkey").alias("last_order"))
    return joins.as_of(e, o, "key", "time", "last_order").select("event_id", "last_order")


# ---------------------------------------------------------------- meshes


@query("SELECT p_partkey AS mesh, CAST(8 AS BIGINT) AS vertices, CAST(12 AS BIGINT) AS faces FROM part")
def mesh_weld(spark, d):
    v, f = mesh.weld(bd.cuboids(spark, d), 6)
    return v.groupBy("mesh").agg(F.count("*").alias("vertices")).join(by_shuffle(mesh.clean_faces(f).groupBy("mesh").agg(F.count("*").alias("faces"))), "mesh")


@query(f"WITH {bd.SURFACE} SELECT lo, hi, uses, forward_uses, owner, other FROM edges")
def mesh_edges(spark, d):
    return mesh.edges(bd.surface(spark, d)[1]).select("lo", "hi", "uses", "forward_uses", "owner", "other")


@query(f"WITH {bd.SURFACE} SELECT lo, hi, coalesce(owner, other) AS f FROM edges WHERE uses = 1")
def mesh_boundary_edges(spark, d):
    return mesh.edge_kinds(mesh.edges(bd.surface(spark, d)[1])).where("kind = 'open'").select("lo", "hi", F.coalesce("owner", "other").alias("f"))


@query(f"WITH {bd.SURFACE}, e AS (SELECT count(*) AS edges, count(*) FILTER (uses = 1) AS open, count(*) FILTER (uses = 2 AND forward_uses = 1) AS manifold FROM edges), v AS (SELECT count(DISTINCT v) AS vertices FROM (SELECT a AS v FROM faces UNION ALL SELECT b FROM faces UNION ALL SELECT c FROM faces)), f AS (SELECT count(*) AS faces FROM faces) SELECT vertices, edges, faces, open, manifold, vertices - edges + faces AS euler FROM e, v, f")
def mesh_euler(spark, d):
    return mesh.integrity(bd.surface(spark, d)[1]).select("vertices", "edges", "faces", "open", "manifold", "euler")


@query("SELECT mesh, round(a * b * c, 6) AS volume, round(2 * (a * b + b * c + a * c), 6) AS area, round(px + a / 2, 6) AS cx, round(5 + b / 2.0, 6) AS cy, round(5 + c / 2.0, 6) AS cz, round(a * b * c * (b * b + c * c) / 12, 4) AS ixx FROM (SELECT p_partkey AS mesh, p_size / 10.0 + 1 AS a, p_partkey % 7 + 1 AS b, p_partkey % 3 + 1 AS c, p_partkey % 20 * 10 AS px FROM part)")
def mesh_volume_centroid(spark, d):
    m = mesh.solid_measures(bd.cuboids(spark, d))
    return m.select("mesh", *[near(c, 6).alias(c) for c in ("volume", "area", "cx", "cy", "cz")], near("ixx").alias("ixx"))


@query(f"WITH {bd.SURFACE}, n AS (SELECT f, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM cornered) SELECT f, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nz FROM n")
def mesh_area_normals(spark, d):
    v, f = bd.surface(spark, d)
    return rounded(mesh.face_measures(mesh.with_corners(f, v)).select("f", "area", "nx", "ny", "nz"), 6)


DIHEDRAL = f"""{bd.SURFACE}, raw AS (SELECT f, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM cornered),
 unit AS (SELECT f, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz FROM raw),
 pairs AS (SELECT e.lo, e.hi, p.nx AS a, p.ny AS b, p.nz AS c, q.nx AS d, q.ny AS e, q.nz AS f, h.x - l.x AS x, h.y - l.y AS y, h.z - l.z AS z FROM edges e JOIN unit p ON e.owner = p.f JOIN unit q ON e.other = q.f JOIN vertices l ON e.lo = l.v JOIN vertices h ON e.hi = h.v WHERE uses = 2),
 bent AS (SELECT lo, hi, pi() - atan2(((b * f - c * e) * x + (c * d - a * f) * y + (a * e - b * d) * z) / sqrt(x * x + y * y + z * z), a * d + b * e + c * f) AS angle FROM pairs)"""


@query(f"WITH {DIHEDRAL} SELECT lo, hi, round(angle, 5) AS angle FROM bent")
def mesh_dihedral(spark, d):
    v, f = bd.surface(spark, d)
    return mesh.edge_angles(f, v).select("lo", "hi", near("angle", 5).alias("angle"))


@query(f"WITH {DIHEDRAL} SELECT count(*) AS sharp FROM bent WHERE abs(angle - pi()) >= 1")
def mesh_nonsmooth_edges(spark, d):
    v, f = bd.surface(spark, d)
    return mesh.sharp_edges(mesh.edge_angles(f, v), 1.0).agg(F.count("*").alias("sharp"))


def _cut(spark):
    from geoloom.functions.storage import materialise

    return materialise


FLAT = f"{bd.SURFACE}, low AS (SELECT f.* FROM cornered f WHERE greatest(az, bz, cz) < (SELECT avg(z) + 4 FROM vertices))"


@query(f"""WITH RECURSIVE {FLAT}, h AS (SELECT f, least(a, b) AS lo, greatest(a, b) AS hi FROM low UNION ALL SELECT f, least(b, c), greatest(b, c) FROM low UNION ALL SELECT f, least(c, a), greatest(c, a) FROM low),
 adj AS (SELECT p.f AS a, q.f AS b FROM h p JOIN h q ON p.lo = q.lo AND p.hi = q.hi AND p.f <> q.f),
 reach(f, r) AS (SELECT f, f FROM low UNION SELECT adj.b, reach.r FROM reach JOIN adj ON reach.f = adj.a)
 SELECT f, min(r) AS component FROM reach GROUP BY f""")
def mesh_components(spark, d):
    from geoloom.operators.graph import connected_components

    v, f = bd.surface(spark, d)
    level = v.agg((F.avg("z") + 4).alias("level"))
    low = mesh.with_corners(f, v).join(F.broadcast(level)).where(F.greatest("az", "bz", "cz") < F.col("level")).select("mesh", "f", "a", "b", "c")
    labels = connected_components(mesh.face_neighbours(low).select("a", "b"), _cut(spark))
    return low.select("f").join(by_shuffle(labels.select(F.col("node").alias("f"), "component")), "f", "left").select("f", F.coalesce("component", "f").alias("component"))


def _slice_sql(levels: str) -> str:
    side = "CASE WHEN ({p}z >= z) <> ({q}z >= z) THEN {p}{a} + (z - {p}z) / ({q}z - {p}z) * ({q}{a} - {p}{a}) END AS {n}{a}"
    parts = ", ".join(side.format(p=p, q=q, a=a, n=n) for n, p, q in (("u", "a", "b"), ("v", "b", "c"), ("w", "c", "a")) for a in "xy").replace("by", "by_")
    parts = parts.replace("AS uy", "AS uy").replace("by__", "by_")
    return f"""WITH {bd.SURFACE}, levelled AS (SELECT c.*, level, z FROM cornered c, ({levels}) l), hits AS (SELECT level, f, {parts} FROM levelled WHERE (least(az, bz, cz) < z) AND (greatest(az, bz, cz) >= z))
 SELECT level, count(*) AS segments, round(sum(sqrt((CASE WHEN ux IS NULL THEN vx - wx WHEN vx IS NULL THEN ux - wx ELSE ux - vx END) ** 2 + (CASE WHEN ux IS NULL THEN vy - wy WHEN vx IS NULL THEN uy - wy ELSE uy - vy END) ** 2)), 4) AS length FROM hits GROUP BY level"""


@query(_slice_sql("SELECT CAST(n AS BIGINT) AS level, CAST(n * 2 AS DOUBLE) AS z FROM range(0, 400) t(n)"))
def uniform_slices_lengths(spark, d):
    v, f = bd.surface(spark, d)
    s = mesh.uniform_slices(mesh.with_corners(f, v), 2.0)
    size = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return s.groupBy("level").agg(F.count("*").alias("segments"), near(F.sum(size)).alias("length"))


@query("SELECT p_partkey AS mesh, CAST(8 AS BIGINT) AS segments, round(2 * (p_size / 10.0 + 1) + 2 * (p_partkey % 7 + 1), 6) AS length FROM part")
def slice_segments_z(spark, d):
    s = mesh.slice_segments(bd.cuboids(spark, d), 5.5)
    size = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return s.groupBy("mesh").agg(F.count("*").alias("segments"), near(F.sum(size), 6).alias("length"))


# ---------------------------------------------------------------- voxels and pixels

VOXELS = f"{bd.POINTS3D}, {bd.cells_sql('a', 'A')}, {bd.cells_sql('b', 'R')}"
POINTED = f"{VOXELS}, {bd.NEIGHBOURS}, pointed AS (SELECT i + di AS i, j + dj AS j, k + dk AS k, count(*) AS n FROM a, moves GROUP BY 1, 2, 3)"


def _ab(spark, d):
    return bd.cells(spark, d, "A"), bd.cells(spark, d, "R")


@query(f"WITH {VOXELS} SELECT i, j, k FROM a")
def voxelize_points(spark, d):
    return bd.cells(spark, d, "A")


@query(f"WITH {VOXELS} SELECT i, j, k FROM a UNION SELECT i, j, k FROM b")
def voxel_union(spark, d):
    return voxels.union(*_ab(spark, d))


@query(f"WITH {VOXELS} SELECT i, j, k FROM a INTERSECT SELECT i, j, k FROM b")
def voxel_intersect(spark, d):
    return voxels.intersect(*_ab(spark, d))


@query(f"WITH {VOXELS} SELECT i, j, k FROM a EXCEPT SELECT i, j, k FROM b")
def voxel_subtract(spark, d):
    return voxels.subtract(*_ab(spark, d))


@query(f"WITH {VOXELS} SELECT i, j, k FROM (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 30)) AS j), (SELECT unnest(range(0, 4)) AS k) EXCEPT SELECT i, j, k FROM a")
def voxel_invert(spark, d):
    return voxels.invert(bd.cells(spark, d, "A"), 16, 30, 4)


@query(f"WITH {POINTED} SELECT a.i, a.j, a.k, 6 - n AS open_sides FROM a JOIN pointed p ON a.i = p.i AND a.j = p.j AND a.k = p.k WHERE n < 6")
def voxel_exposed_area(spark, d):
    return voxels.exposed(bd.cells(spark, d, "A"))


@query(f"WITH {POINTED} SELECT a.i, a.j, a.k FROM a JOIN pointed p ON a.i = p.i AND a.j = p.j AND a.k = p.k WHERE n = 6")
def voxel_erode(spark, d):
    return voxels.erode(bd.cells(spark, d, "A"))


@query(f"WITH {POINTED} SELECT i, j, k FROM a UNION SELECT i, j, k FROM pointed")
def voxel_dilate(spark, d):
    return voxels.dilate(bd.cells(spark, d, "A"))


@query(f"WITH {VOXELS} SELECT i, j, unnest(range(f, 6)) AS k FROM (SELECT i, j, min(k) AS f FROM a GROUP BY i, j)")
def voxel_draft(spark, d):
    return voxels.draft(bd.cells(spark, d, "A"), 5)


@query(f"WITH {VOXELS} SELECT j, k, min(i) AS first, max(i) + 1 AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY j, k ORDER BY i) AS g FROM a) GROUP BY j, k, g")
def voxel_runs(spark, d):
    return voxels.runs(bd.cells(spark, d, "A"))


@query(f"WITH {POINTED} SELECT count(*) AS cells, CAST(count(*) * 64 AS DOUBLE) AS volume, round(avg((a.i + 0.5) * 4), 4) AS cx, round(avg((a.j + 0.5) * 4), 4) AS cy, round(avg((a.k + 0.5) * 4), 4) AS cz, CAST(sum(6 - coalesce(n, 0)) * 16 AS DOUBLE) AS surface FROM a LEFT JOIN pointed p ON a.i = p.i AND a.j = p.j AND a.k = p.k")
def voxel_measures(spark, d):
    return rounded(voxels.measures(bd.cells(spark, d, "A"), 4.0))


@query(f"WITH {VOXELS}, bits AS (SELECT i - x AS i, j - y AS j, k - z AS k, 1 << (x + 2 * y + 4 * z) AS b FROM a, (SELECT unnest(range(0, 2)) AS x), (SELECT unnest(range(0, 2)) AS y), (SELECT unnest(range(0, 2)) AS z)) SELECT c AS \"case\", count(*) AS n FROM (SELECT CAST(sum(b) AS BIGINT) AS c FROM bits GROUP BY i, j, k) WHERE c < 255 GROUP BY c")
def marching_cube_cases(spark, d):
    return voxels.cube_cases(bd.cells(spark, d, "A")).groupBy("case").agg(F.count("*").alias("n"))


@query(f"WITH {bd.POINTS3D} SELECT i, j, k, (i << 42) | (j << 21) | k AS cell FROM (SELECT DISTINCT CAST(floor(x / 4) AS BIGINT) AS i, CAST(floor(y / 4) AS BIGINT) AS j, CAST(floor(z / 4) AS BIGINT) AS k FROM points3d WHERE g = 'A')")
def voxel_long_id(spark, d):
    packed = bd.cells(spark, d, "A").select(voxels.pack_id().alias("cell"))
    return packed.select(*voxels.unpack_id("cell"), "cell")


ZBUFFER = f"""{bd.SURFACE}, wide AS (SELECT *, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS area FROM cornered),
 px AS (SELECT w.*, i, j, (i + 0.5) * 0.25 - ax AS u0, (j + 0.5) * 0.25 - ay AS v0 FROM wide w, LATERAL (SELECT unnest(generate_series(CAST(ceil(least(ax, bx, cx) * 4 - 0.5) AS BIGINT), CAST(floor(greatest(ax, bx, cx) * 4 - 0.5) AS BIGINT))) AS i), LATERAL (SELECT unnest(generate_series(CAST(ceil(least(ay, by_, cy) * 4 - 0.5) AS BIGINT), CAST(floor(greatest(ay, by_, cy) * 4 - 0.5) AS BIGINT))) AS j) WHERE area > 0),
 hit AS (SELECT i, j, f, (u0 * (cy - ay) - v0 * (cx - ax)) / area AS u, ((bx - ax) * v0 - (by_ - ay) * u0) / area AS v, az, bz, cz FROM px)"""


@query(f"WITH {ZBUFFER} SELECT i, j, round(max(az + u * (bz - az) + v * (cz - az)), 7) AS z FROM hit WHERE u >= 0 AND v >= 0 AND u + v <= 1 GROUP BY i, j")
def zbuffer_max(spark, d):
    v, f = bd.surface(spark, d)
    return voxels.z_buffer(mesh.with_corners(f, v), 0.25).select("i", "j", near("z", 7).alias("z"))


@query(f"WITH {ZBUFFER} SELECT count(*) AS pixels FROM (SELECT DISTINCT i, j FROM hit WHERE u >= 0 AND v >= 0 AND u + v <= 1)")
def pixel_visible_counts(spark, d):
    v, f = bd.surface(spark, d)
    return voxels.z_buffer(mesh.with_corners(f, v), 0.25).agg(F.count("*").alias("pixels"))


# ---------------------------------------------------------------- surfaces and solids


@query(f"WITH {bd.POINTS3D}, s AS (SELECT id, sqrt((x - 25) ** 2 + (y - 40) ** 2 + (z - 5) ** 2) - 20 AS a, sqrt((x - 25) ** 2 + (y - 40) ** 2) - 10 AS b FROM points3d) SELECT id, round(least(a, b), 6) + 0.0 AS joined, round(greatest(a, b), 6) + 0.0 AS met, round(greatest(a, -b), 6) + 0.0 AS cut, round(greatest(least(a, b), -greatest(a, b)), 6) + 0.0 AS either FROM s")
def csg_field_eval(spark, d):
    a, b = sf.sphere(p3(), (25.0, 40.0, 5.0), 20.0), sf.cylinder(p3(), (25.0, 40.0, 0.0), (0.0, 0.0, 1.0), 10.0)
    return rounded(bd.points3d(spark, d).select("id", sf.join(a, b).alias("joined"), sf.meet(a, b).alias("met"), sf.cut(a, b).alias("cut"), sf.either(a, b).alias("either")), 6)


@query(f"WITH {bd.POINTS3D}, q AS (SELECT id, 2.0 * ((x - 25) * 1 + (y - 40) * 2 + z * 2) AS b, (x - 25) ** 2 + (y - 40) ** 2 + z ** 2 - 400 AS c FROM points3d) SELECT id, round(CASE WHEN b * b - 36 * c >= 0 THEN (-b - sqrt(greatest(b * b - 36 * c, 0))) / 18 END, 6) + 0.0 AS t1, round(CASE WHEN b * b - 36 * c >= 0 THEN (-b + sqrt(greatest(b * b - 36 * c, 0))) / 18 END, 6) + 0.0 AS t2 FROM q")
def sphere_line_hits(spark, d):
    t = sf.line_sphere(p3(), (1.0, 2.0, 2.0), (25.0, 40.0, 0.0), 20.0)
    return rounded(bd.points3d(spark, d).select("id", t[0].alias("t1"), t[1].alias("t2")), 6)


@query(f"WITH {bd.POINTS3D}, q AS (SELECT id, 2.0 * ((x - 25) + 2 * (y - 40)) AS b, (x - 25) ** 2 + (y - 40) ** 2 - 100 AS c FROM points3d) SELECT id, round(CASE WHEN b * b - 20 * c >= 0 THEN (-b - sqrt(greatest(b * b - 20 * c, 0))) / 10 END, 6) + 0.0 AS t1, round(CASE WHEN b * b - 20 * c >= 0 THEN (-b + sqrt(greatest(b * b - 20 * c, 0))) / 10 END, 6) + 0.0 AS t2 FROM q")
def cylinder_line_hits(spark, d):
    t = sf.line_cylinder(p3(), (1.0, 2.0, 2.0), (25.0, 40.0, 0.0), (0.0, 0.0, 1.0), 10.0)
    return rounded(bd.points3d(spark, d).select("id", t[0].alias("t1"), t[1].alias("t2")), 6)


@query(f"WITH {bd.POINTS3D} SELECT id, round(0.6 * x + 0.8 * z - 10, 6) + 0.0 AS distance, round(x - 0.6 * (0.6 * x + 0.8 * z - 10), 6) + 0.0 AS fx, round(z - 0.8 * (0.6 * x + 0.8 * z - 10), 6) + 0.0 AS fz FROM points3d")
def plane_distance(spark, d):
    n = (0.6, 0.0, 0.8)
    foot = vc.project_to_plane(p3(), n, 10.0)
    return rounded(bd.points3d(spark, d).select("id", sf.plane(p3(), n, 10.0).alias("distance"), foot[0].alias("fx"), foot[2].alias("fz")), 6)


@query(f"WITH {bd.POINTS3D} SELECT id, round(sqrt((sqrt((x - 25) ** 2 + (y - 40) ** 2) - 15) ** 2 + (z - 5) ** 2) - 4, 6) + 0.0 AS torus, round(least(greatest(r - 10, abs(z - 4) - 4), 0) + sqrt(greatest(r - 10, 0) ** 2 + greatest(abs(z - 4) - 4, 0) ** 2), 6) + 0.0 AS can FROM (SELECT *, sqrt((x - 25) ** 2 + (y - 40) ** 2) AS r FROM points3d)")
def torus_and_can_distance(spark, d):
    up = (0.0, 0.0, 1.0)
    return rounded(bd.points3d(spark, d).select("id", sf.torus(p3(), (25.0, 40.0, 5.0), up, 15.0, 4.0).alias("torus"), sf.capped_cylinder(p3(), (25.0, 40.0, 0.0), up, 10.0, 8.0).alias("can")), 6)


@query(f"WITH {bd.POINTS3D} SELECT g, count(*) AS inside FROM points3d WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 50 AND z BETWEEN 2 AND 8 GROUP BY g")
def point_in_box(spark, d):
    return bd.points3d(spark, d).where(vc.in_box(p3(), (10.0, 20.0, 2.0), (30.0, 50.0, 8.0))).groupBy("g").agg(F.count("*").alias("inside"))


LAYERS = "layers AS (SELECT g, CAST(floor(x) AS BIGINT) AS level, CAST(count(*) AS DOUBLE) AS area FROM points3d GROUP BY 1, 2)"


def _layers(spark, d):
    return bd.points3d(spark, d).groupBy("g", F.floor("x").alias("level")).agg(F.count("*").cast("double").alias("area"))


@query(f"WITH {bd.POINTS3D}, {LAYERS} SELECT g, round(sum(v), 4) AS volume, round(sum(v * h) / sum(v), 6) AS centre FROM (SELECT g, (lead(level) OVER w - level) * (lead(area) OVER w + area) / 2 AS v, (lead(level) OVER w + level) / 2 AS h FROM layers WINDOW w AS (PARTITION BY g ORDER BY level)) GROUP BY g")
def cross_section_volume(spark, d):
    v = isosurface.layered_volume(_layers(spark, d), "g", "level", "area")
    return v.select("g", near("volume").alias("volume"), near("centre", 6).alias("centre"))


@query(f"WITH {bd.POINTS3D}, {LAYERS}, odd AS (SELECT g, level, area FROM layers WHERE level % 3 <> 2), span AS (SELECT g, unnest(generate_series(min(level), max(level))) AS level FROM odd GROUP BY g) SELECT s.g, s.level, (SELECT arg_max(area, o.level) FROM odd o WHERE o.g = s.g AND o.level <= s.level) AS area FROM span s")
def cross_section_missing_layers(spark, d):
    return isosurface.fill_missing_layers(_layers(spark, d).where("level % 3 <> 2"), "g", "level", "area")


#: Samples of a block along each axis, and how far apart blocks are, in samples.
BLOCK, APART = 14, 16


@query("SELECT s_suppkey AS solid, CAST(0 AS BIGINT) AS open_edges, CAST(2 AS BIGINT) AS euler FROM supplier")
def isosurface_sphere(spark, d):
    """Surfaces of spheres cut from sampled fields, one for each supplier and of its own radius: closed and of one piece."""
    n = F.col("n")
    block = bd.table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCK**3 - 1).cast("long"))).alias("n"))
    cells = block.select("s_suppkey", F.floor(n / BLOCK**2).alias("i"), (F.floor(n / BLOCK) % BLOCK).alias("j"), (n % BLOCK).alias("k"))
    radius = 0.7 + F.col("s_suppkey") % 5 / 10
    placed = cells.select((F.col("i") + APART * F.col("s_suppkey")).alias("i"), "j", "k", *[(F.col(c) * 0.2 - 1.3).alias(x) for c, x in zip("ijk", "xyz", strict=True)], radius.alias("r"))
    samples = placed.withColumn("value", sf.sphere((F.col("x"), F.col("y"), F.col("z")), (0.01, 0.02, 0.03), F.col("r"))).drop("r")
    soup = isosurface.triangles(samples, 0.2)
    soup = soup.withColumn("mesh", F.floor(F.col("i") / APART)).withColumn("f", F.monotonically_increasing_id())
    # a sphere is small, so its faces are dealt by solid once, and no step after that shuffles
    whole = mesh.integrity(mesh.clean_faces(mesh.weld(soup, 9)[1].repartition("mesh")))
    return whole.select(F.col("mesh").alias("solid"), F.col("open").alias("open_edges"), "euler")


# ---------------------------------------------------------------- order, trees


@query(f"WITH {bd.POINTS3D} SELECT g, id, n AS rank FROM (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY round(x + 2 * y - z, 6), id) AS n FROM points3d) WHERE n <= 10")
def sort_along_direction(spark, d):
    r = F.round(vc.dot(p3(), (1.0, 2.0, -1.0)), 6)
    ranked = bd.points3d(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(r, "id")))
    return ranked.where("rank <= 10").select("g", "id", F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE tree(node, parent) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
 flat(node, depth, shift) AS (SELECT node, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, depth + 1, shift + CAST(substr(t.node, 2) AS BIGINT) FROM tree t JOIN flat f ON t.parent = f.node)
 SELECT node, depth, shift FROM flat""")
def assembly_flatten(spark, d):
    c, n, r = (bd.table(spark, d, t) for t in ("customer", "nation", "region"))

    def nodes(t, kind, key, parent):
        return t.select(F.concat(F.lit(kind), F.col(key)).alias("node"), parent.alias("parent"))

    tree = nodes(c, "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey")).unionAll(nodes(n, "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"))).unionAll(nodes(r, "r", "r_regionkey", F.lit(None).cast("string")))
    return assembly.flatten(tree.withColumn("step", F.when(F.col("parent").isNull(), 0).otherwise(F.substring("node", 2, 20).cast("long")).cast("long")))


FLAGSHIP = mesh_volume_centroid
