"""Queries of primitives, hull membership, normals, curves and directions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.operators import mesh, primitives, rings, voxels
from geoloom.operators.joins import by_shuffle
from geoloom.plans import bindings as bd
from geoloom.plans.registry import query, rounded
from geoloom.plans.shapes import CUBOID, NGON

SIDES = 24
PRISM = f"(SELECT p_partkey AS mesh, p_size * 0.0712345678::DOUBLE + 1 AS r, (p_partkey % 7 + 1) * 0.5123456789::DOUBLE AS h, {SIDES} * sin(2 * pi() / {SIDES}) / 2 AS k, 2 * sin(pi() / {SIDES}) AS s FROM part)"


def _prisms(spark, d):
    return bd.table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), (F.col("p_size") * 0.0712345678 + 1).alias("radius"), ((F.col("p_partkey") % 7 + 1) * 0.5123456789).alias("height")).withColumn("inner", F.col("radius") * 0.4)


def _measured(soup):
    m = mesh.solid_measures(soup).select("mesh", "volume", "area")
    whole = mesh.unpaired_edges(mesh.clean_faces(mesh.weld(soup, 6)[1])).select("mesh", F.col("open").alias("open_edges"))
    return rounded(m.join(by_shuffle(whole), "mesh"), 5)


@query(f"SELECT mesh, round(k * r * r * h, 5) AS volume, round(2 * k * r * r + {SIDES} * s * r * h, 5) AS area, CAST(0 AS BIGINT) AS open_edges FROM {PRISM}")
def tessellate_cylinder(spark, d):
    return _measured(primitives.cylinder(_prisms(spark, d), SIDES))


@query(f"SELECT mesh, round(k * r * r * h * 0.84, 5) AS volume, round(2 * k * r * r * 0.84 + {SIDES} * s * r * h * 1.4, 5) AS area, CAST(0 AS BIGINT) AS open_edges FROM {PRISM}")
def tessellate_hollow_cylinder(spark, d):
    return _measured(primitives.hollow_cylinder(_prisms(spark, d), SIDES))


@query(f"SELECT mesh, round(k * r * r * h / 3, 5) AS volume, round(k * r * r + {SIDES} * s * r / 2 * sqrt(h * h + (r * cos(pi() / {SIDES})) ** 2), 5) AS area, CAST(0 AS BIGINT) AS open_edges FROM {PRISM}")
def tessellate_cone(spark, d):
    return _measured(primitives.cone(_prisms(spark, d), SIDES))


@query(f"SELECT mesh, CAST(i AS BIGINT) AS id FROM {CUBOID}, (SELECT unnest(generate_series(0, 9)) AS i) WHERE i * 0.737 + 0.111 <= a AND i * 0.5313 + 0.111 <= b AND i * 0.2717 + 0.111 <= c")
def hull_membership(spark, d):
    """Ten points along a line from near a cuboid's least corner, against the planes of its faces."""
    soup = bd.cuboids(spark, d)
    k = F.col("p_partkey")
    points = bd.table(spark, d, "part").select(k.alias("mesh"), (k % 20 * 10).cast("double").alias("x0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("id"))
    points = points.select("mesh", "id", (F.col("x0") + F.col("id") * 0.737 + 0.111).alias("x"), (5 + F.col("id") * 0.5313 + 0.111).alias("y"), (5 + F.col("id") * 0.2717 + 0.111).alias("z"))
    return primitives.points_in_hulls(points, soup)


@query("SELECT p_partkey AS mesh, CAST(8 AS BIGINT) AS vertices, CAST(8 AS BIGINT) AS outward FROM part")
def vertex_normals(spark, d):
    """Normals at the corners of cuboids are unit vectors that point away from the middle along all three axes."""
    vertices, faces = mesh.weld(bd.cuboids(spark, d), 6)
    cornered = mesh.with_corners(faces, vertices)
    middle = vertices.groupBy("mesh").agg(*[F.avg(x).alias(f"m{x}") for x in "xyz"])
    n = primitives.vertex_normals(cornered).join(by_shuffle(vertices), ["mesh", "v"]).join(by_shuffle(middle), "mesh")
    away = (F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) < 1e-9) & (F.col("nx") * (F.col("x") - F.col("mx")) > 0) & (F.col("ny") * (F.col("y") - F.col("my")) > 0) & (F.col("nz") * (F.col("z") - F.col("mz")) > 0)
    return n.groupBy("mesh").agg(F.count("*").alias("vertices"), F.count_if(away).alias("outward"))


@query(f"SELECT ring, n - 2 AS bends, round((n - 2) * 2 * pi() / n, 5) AS total FROM {NGON}")
def polyline_bends(spark, d):
    """Regular rings as open polylines bend by a full turn over their corners at each inner vertex."""
    b = primitives.corners_by_bend(bd.ngons(spark, d), 0.3)
    return rounded(b.groupBy("ring").agg(F.count("*").alias("bends"), F.sum("bend").alias("total")), 5)


@query("SELECT count(*) AS directions, min(id) AS least FROM (SELECT min(id) AS id FROM (SELECT id, x / l AS x, y / l AS y, z / l AS z FROM (SELECT p_partkey AS id, p_partkey % 4 + 1.0 AS x, p_partkey % 3 + 1.0 AS y, p_partkey % 2 + 1.0 AS z, sqrt((p_partkey % 4 + 1.0) ** 2 + (p_partkey % 3 + 1.0) ** 2 + (p_partkey % 2 + 1.0) ** 2) AS l FROM part)) GROUP BY round(x, 6), round(y, 6), round(z, 6))")
def reduce_directions(spark, d):
    """Directions of a few kinds, half of them turned round and lengthened."""
    k = F.col("p_partkey")
    s = F.when(k % 5 < 2, -2.5).otherwise(1.0)
    t = bd.table(spark, d, "part").select(k.alias("id"), (s * (k % 4 + 1.0)).alias("x"), (s * (k % 3 + 1.0)).alias("y"), (s * (k % 2 + 1.0)).alias("z"))
    return primitives.reduce_directions(t).agg(F.count("*").alias("directions"), F.min("id").alias("least"))


@query("SELECT p_partkey AS helix, round(p_size * 0.0712345678::DOUBLE + 0.1, 5) AS pitch FROM part")
def helix_pitch(spark, d):
    t = bd.table(spark, d, "part").select(F.col("p_partkey").alias("helix"), (F.col("p_size") * 0.0712345678 + 0.1).alias("pitch"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    angle = F.col("i") * 0.9 + 0.3
    p = t.select("helix", "i", (3 * F.cos(angle)).alias("x"), (3 * F.sin(angle)).alias("y"), (F.col("pitch") * angle / (2 * math.pi)).alias("z"))
    return rounded(primitives.helix_pitch(p, "helix", "i"), 5)


@query(f"WITH {bd.RING_EDGES}, q AS (SELECT s_suppkey AS id, s_suppkey % 5 AS ring, s_acctbal / 100 AS px, s_suppkey % 97 + 0.5137::DOUBLE AS py FROM supplier) SELECT ring, id, round(min(sqrt((x + t * (x2 - x) - px) ** 2 + (y + t * (y2 - y) - py) ** 2)), 4) AS distance FROM (SELECT *, CASE WHEN l > 0 THEN least(greatest(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / l, 0), 1) ELSE 0 END AS t FROM (SELECT q.ring, id, px, py, x, y, x2, y2, (x2 - x) ** 2 + (y2 - y) ** 2 AS l FROM q JOIN ring_edges e ON q.ring = e.ring)) GROUP BY ring, id")
def polygon_min_distance(spark, d):
    k = F.col("s_suppkey")
    points = bd.table(spark, d, "supplier").select(k.alias("id"), (k % 5).alias("ring"), (F.col("s_acctbal") / 100).alias("px"), (k % 97 + 0.5137).alias("py"))
    return rounded(primitives.ring_distance(points, rings.edges(bd.rings(spark, d))))


@query(f"""WITH {bd.POINTS3D}, {bd.cells_sql('a', 'A')}, {bd.cells_sql('r', 'R')}, {bd.cells_sql('n', 'N')},
 off AS (SELECT unnest(generate_series(min(i), min(i) + 2)) AS i, j, k FROM r GROUP BY j, k), lit AS (SELECT unnest(generate_series(max(i) + 1, max(i) + 3)) AS i, j, k FROM n GROUP BY j, k)
 SELECT i, j, k FROM a WHERE (i, j, k) NOT IN (SELECT (i, j, k) FROM off) UNION SELECT i, j, k FROM lit""")
def voxel_ranges_on_and_off(spark, d):
    """Cells of one kind of points; in each row, three from the first cell of a second kind are turned off, three behind the last of a third kind on."""
    def rows(flag, first):
        return bd.cells(spark, d, flag).groupBy("j", "k").agg(first.alias("first")).select("j", "k", F.explode(F.sequence("first", F.col("first") + 2)).alias("i")).select("i", "j", "k")

    return voxels.union(voxels.subtract(bd.cells(spark, d, "A"), rows("R", F.min("i"))), rows("N", F.max("i") + 1)).select("i", "j", "k")


@query("SELECT ring, round(hypot, 5) AS radius, round((ax + bx) / 2, 5) AS cx FROM (SELECT p_partkey AS ring, p_size * 0.0712345678::DOUBLE AS ax, p_partkey % 7 * 0.3123456789::DOUBLE AS bx, sqrt((p_size * 0.0712345678::DOUBLE - p_partkey % 7 * 0.3123456789::DOUBLE) ** 2 + 4) / 2 AS hypot FROM part)")
def circle_from_two_points(spark, d):
    from geoloom.functions import vector as vc

    t = bd.table(spark, d, "part").select(F.col("p_partkey").alias("ring"), (F.col("p_size") * 0.0712345678).alias("ax"), (F.col("p_partkey") % 7 * 0.3123456789).alias("bx"))
    a, b = (F.col("ax"), F.lit(1.0)), (F.col("bx"), F.lit(3.0))
    return rounded(t.select("ring", (vc.distance(a, b) / 2).alias("radius"), vc.lerp(a, b, 0.5)[0].alias("cx")), 5)
