"""Queries of mesh repair, regions, containment, assemblies, fits and enclosures, on cuboids that are first damaged in a known way."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import assembly, joins, mesh, repair, rings, statistics, voxels
from geoloom.operators import kernels as kn
from geoloom.operators.joins import by_shuffle
from geoloom.plans import bindings as bd
from geoloom.plans.registry import near, query, rounded
from geoloom.plans.shapes import CUBOID, NGON, cuboid_rows, per_part

SOLID = ["mesh", "faces", "area", "volume"]


def welded(spark, d):
    return mesh.weld(bd.cuboids(spark, d), 6)


@query("SELECT p_partkey AS mesh, CAST(12 AS BIGINT) AS faces, CAST(0 AS BIGINT) AS inconsistent, round((p_size / 10.0 + 1) * (p_partkey % 7 + 1) * (p_partkey % 3 + 1), 5) AS volume FROM part")
def mesh_orient_faces(spark, d):
    """Every fifth face of the cuboids is turned, then all are made to agree."""
    vertices, faces = welded(spark, d)
    turned = F.col("f") % 5 == 3
    bad = faces.select("mesh", "f", "a", F.when(turned, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(turned, F.col("b")).otherwise(F.col("c")).alias("c"))
    good = repair.orient(bad)
    kinds = mesh.integrity(good).select("mesh", "inconsistent")
    measured = mesh.solid_measures(mesh.with_corners(good.drop("flipped"), vertices)).select("mesh", "faces", F.abs("volume").alias("volume"))
    return rounded(measured.join(by_shuffle(kinds), "mesh"), 5)


@query("SELECT p_partkey AS mesh, CAST(2 AS BIGINT) AS pairs, CAST(2 AS BIGINT) AS of_one_body FROM part")
def mesh_part_overused_edges(spark, d):
    """Two cuboids that touch along an edge: the four faces there go in pairs of one body each."""
    soup = bd.cuboids(spark, d)
    sides = bd.table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), (F.col("p_size") / 10 + 1).alias("la"), (F.col("p_partkey") % 7 + 1).cast("double").alias("lb"))
    moved = soup.join(by_shuffle(sides), "mesh")
    shift = {"x": F.col("la"), "y": F.col("lb"), "z": F.lit(0.0)}
    second = moved.select("mesh", (F.col("f") + 12).alias("f"), *[(F.col(f"{c}{x}") + shift[x]).alias(f"{c}{x}") for c in "abc" for x in "xyz"])
    vertices, faces = mesh.weld(soup.unionByName(second), 6)
    pairs = repair.part_overused(faces, vertices)
    return pairs.groupBy("mesh").agg(F.count("*").alias("pairs"), F.count_if((F.col("f") < 12) == (F.col("g") < 12)).alias("of_one_body"))


@query("SELECT p_partkey AS mesh, CAST(8 AS BIGINT) AS open_before, CAST(0 AS BIGINT) AS open_after FROM part")
def mesh_match_single_edges(spark, d):
    """The lid's corners are moved by a thousandth, so that eight edges are single-sided; they find each other."""
    lid = F.col("f").isin(2, 3)
    soup = bd.cuboids(spark, d)
    soup = soup.select("mesh", "f", *[(F.col(f"{c}{x}") + F.when(lid, 0.001).otherwise(0.0)).alias(f"{c}{x}") for c in "abc" for x in "xyz"])
    vertices, faces = mesh.weld(soup, 6)
    twins = repair.match_single_edges(faces, vertices, 0.01)
    before, after = (mesh.integrity(f).select("mesh", F.col("open").alias(n)) for f, n in ((faces, "open_before"), (repair.merge_vertices(faces, twins), "open_after")))
    return before.join(by_shuffle(after), "mesh")


@query("SELECT p_partkey AS mesh, CAST(12 AS BIGINT) AS upright FROM part")
def mesh_sliver_normals(spark, d):
    """With every face taken for a sliver, each takes a neighbour's normal, which is a unit vector along an axis."""
    vertices, faces = welded(spark, d)
    n = repair.sliver_normals(faces, vertices, 1e9)
    size = F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2
    axis = F.greatest(F.abs("nx"), F.abs("ny"), F.abs("nz"))
    return n.groupBy("mesh").agg(F.count_if(F.col("mended") & (F.abs(size - 1) < 1e-9) & (axis > 1 - 1e-9)).alias("upright"))


@query("SELECT p_partkey AS mesh, CAST(6 AS BIGINT) AS flats, CAST(2 AS BIGINT) AS least, CAST(2 AS BIGINT) AS most FROM part")
def mesh_find_flats(spark, d):
    vertices, faces = welded(spark, d)
    sizes = repair.flats(faces, vertices).groupBy("mesh", "region").agg(F.count("*").alias("n"))
    return sizes.groupBy("mesh").agg(F.count("*").alias("flats"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"SELECT mesh, CAST(12 AS BIGINT) AS borders, CAST(12 AS BIGINT) AS convex, CAST(0 AS BIGINT) AS concave, round(4 * (a + b + c), 5) AS length, CAST(4 AS BIGINT) AS adjacent FROM {CUBOID}")
def mesh_borders_of_regions(spark, d):
    """The twelve borders of a cuboid's six sides, their length, and how many sides each touches."""
    vertices, faces = welded(spark, d)
    b = repair.borders(faces, vertices, repair.flats(faces, vertices))
    beside = b.select("mesh", F.explode(F.array("r", "s")).alias("r")).groupBy("mesh", "r").agg(F.count("*").alias("n")).groupBy("mesh").agg(F.max("n").alias("adjacent"))
    return rounded(b.groupBy("mesh").agg(F.count("*").alias("borders"), F.sum("convex").alias("convex"), F.sum("concave").alias("concave"), F.sum("length").alias("length")).join(by_shuffle(beside), "mesh"), 5)


@query("SELECT p_partkey AS mesh, CAST(1 AS BIGINT) AS inner_edges, CAST(4 AS BIGINT) AS outer_edges FROM part")
def mesh_inner_outer_edges(spark, d):
    """Edges of the lid's two faces."""
    _, faces = welded(spark, d)
    e = repair.inner_outer_edges(faces, faces.where(F.col("f").isin(2, 3)))
    return e.groupBy("mesh").agg(F.count_if("inner").alias("inner_edges"), F.count_if(~F.col("inner")).alias("outer_edges"))


@query(f"SELECT mesh, CAST(12 AS BIGINT) AS faces, round(2 * (a * b + b * c + c * a), 5) AS area, round(a * b * c, 5) AS volume, CAST(0 AS BIGINT) AS open_edges FROM {CUBOID}")
def mesh_flip_edges(spark, d):
    """The diagonals of all six sides are flipped: nothing changes but the diagonals."""
    vertices, faces = welded(spark, d)
    angles = mesh.edge_angles(faces, vertices).where(F.abs(F.col("angle") - math.pi) < 1e-6)
    flipped = repair.flip_edges(faces, angles)
    m = mesh.solid_measures(mesh.with_corners(flipped, vertices)).select(*SOLID)
    return rounded(m.join(by_shuffle(mesh.integrity(flipped).select("mesh", F.col("open").alias("open_edges"))), "mesh"), 5)


@query(f"SELECT mesh, CAST(48 AS BIGINT) AS faces, round(2 * (a * b + b * c + c * a), 5) AS area, round(a * b * c, 5) AS volume, CAST(2 AS BIGINT) AS euler FROM {CUBOID}")
def mesh_subdivide(spark, d):
    vertices, faces = mesh.weld(repair.subdivide(bd.cuboids(spark, d)), 6)
    m = mesh.solid_measures(mesh.with_corners(faces, vertices)).select(*SOLID)
    return rounded(m.join(by_shuffle(mesh.integrity(faces).select("mesh", "euler")), "mesh"), 5)


@query(f"SELECT mesh, 0.0 AS x0, 0.0 AS z0, round(a, 5) AS x1, round(CAST(c AS DOUBLE), 5) AS z1, round(-a * b * c, 5) AS volume FROM {CUBOID}")
def mesh_to_origin_and_inside_out(spark, d):
    vertices, faces = welded(spark, d)
    moved = repair.to_origin(vertices)
    b = mesh.bounds(moved).select("mesh", F.col("min_x").alias("x0"), F.col("min_z").alias("z0"), F.col("max_x").alias("x1"), F.col("max_z").alias("z1"))
    return rounded(b.join(by_shuffle(mesh.solid_measures(mesh.with_corners(mesh.inside_out(faces), moved)).select("mesh", "volume")), "mesh"), 5)


@query("SELECT p_partkey AS mesh, CAST(10 AS BIGINT) AS left_over, CAST(4 AS BIGINT) AS open_edges, CAST(12 AS BIGINT) AS again FROM part")
def mesh_remove_and_add_faces(spark, d):
    _, faces = welded(spark, d)
    lid = faces.where(F.col("f").isin(2, 3))
    fewer = repair.remove_faces(faces, lid)
    i = mesh.integrity(fewer).select("mesh", F.col("faces").alias("left_over"), F.col("open").alias("open_edges"))
    return i.join(by_shuffle(fewer.unionByName(lid).groupBy("mesh").agg(F.count("*").alias("again"))), "mesh")


@query("SELECT g, arg_max(p_partkey, (v, -p_partkey)) AS mesh, round(max(v), 5) AS volume FROM (SELECT p_partkey, p_partkey % 10 AS g, (p_size / 10.0 + 1) * (p_partkey % 7 + 1) * (p_partkey % 3 + 1) AS v FROM part) GROUP BY g")
def most_significant_solid(spark, d):
    """Of each ten cuboids that of greatest volume; ties to the smaller id."""
    m = mesh.solid_measures(bd.cuboids(spark, d)).select("mesh", F.round("volume", 5).alias("volume"))
    return m.groupBy((F.col("mesh") % 10).alias("g")).agg(F.max_by("mesh", F.struct("volume", -F.col("mesh"))).alias("mesh"), F.max("volume").alias("volume"))


@query("SELECT p.p_partkey AS mesh, s.s_suppkey AS id FROM part p, supplier s WHERE (s.s_suppkey * 7.3 + 0.137) % 200 BETWEEN p.p_partkey % 20 * 10 AND p.p_partkey % 20 * 10 + p.p_size / 10.0 + 1 AND 5 + s.s_suppkey % 7 + 0.21 BETWEEN 5 AND 5 + p.p_partkey % 7 + 1 AND 5 + s.s_suppkey % 3 + 0.37 BETWEEN 5 AND 5 + p.p_partkey % 3 + 1")
def point_in_solid(spark, d):
    k = F.col("s_suppkey")
    points = bd.table(spark, d, "supplier").select(k.alias("id"), ((k * 7.3 + 0.137) % 200).cast("double").alias("x"), (5 + k % 7 + 0.21).cast("double").alias("y"), (5 + k % 3 + 0.37).cast("double").alias("z"))
    return repair.points_in_solids(points, bd.cuboids(spark, d), 4.0)


@query(f"SELECT mesh, level, CAST(1 AS BIGINT) AS loops, round(2 * (a + b), 5) AS length FROM (SELECT *, unnest(generate_series(6, CAST(4 + c AS BIGINT))) AS level FROM {CUBOID} WHERE c > 1)")
def slice_loops(spark, d):
    """Whole heights strictly within the cuboids: one loop each."""
    s = mesh.uniform_slices(bd.cuboids(spark, d), 1.0).where("level > 5").join(by_shuffle(bd.table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), (F.col("p_partkey") % 3 + 1).alias("c"))), "mesh").where(F.col("level") < 5 + F.col("c"))
    return rounded(repair.slice_loops(s).select("mesh", "level", "loops", "length"), 5)


@query("WITH RECURSIVE tree(node, parent, s, t) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey, 1.0::DOUBLE, c_custkey % 10 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5, n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, 2.0, r_regionkey FROM region), flat(node, s, t) AS (SELECT node, s, t::DOUBLE FROM tree WHERE parent IS NULL UNION ALL SELECT x.node, x.s * f.s, x.t * f.s + f.t FROM tree x JOIN flat f ON x.parent = f.node) SELECT substr(node, 1, 1) AS kind, count(*) AS parts, round(min(t), 5) AS low, round(max(t + s), 5) AS high FROM flat GROUP BY 1")
def assembly_transforms_and_boxes(spark, d):
    """Scaling and shift composed along a tree as 4 x 4 matrices; boxes of the unit cubes placed by them, by kind of node."""
    c, n, r = (bd.table(spark, d, t) for t in ("customer", "nation", "region"))

    def nodes(t, kind, key, parent, scale, shift):
        return t.select(F.concat(F.lit(kind), F.col(key)).alias("node"), parent.alias("parent"), assembly.matrix(F.lit(scale), shift.cast("double")).alias("m"))

    tree = nodes(c, "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), 1.0, F.col("c_custkey") % 10).unionAll(nodes(n, "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), 0.5, F.col("n_nationkey"))).unionAll(nodes(r, "r", "r_regionkey", F.lit(None).cast("string"), 2.0, F.col("r_regionkey")))
    flat = assembly.compose(tree)
    corners = assembly.transformed(flat, spark.createDataFrame([tuple(map(float, v)) for v in bd.CUBE], "x double, y double, z double"))
    box = corners.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count_distinct("node").alias("parts"), F.min("x").alias("low"), F.max("x").alias("high"))
    return rounded(box, 5)


# ---------------------------------------------------------------- fits and enclosures


@query("SELECT p_partkey AS ring, true AS fits FROM part")
def line_fit_3d(spark, d):
    """Five points on a known line: its direction up to sign, and a centre on it."""
    k = F.col("p_partkey")
    t = bd.table(spark, d, "part").select(k.alias("ring"), F.explode(F.array(*[F.lit(float(i)) for i in (-2, -1, 0, 1, 2.5)])).alias("t"))
    k = F.col("ring")
    way = (1.0 + k % 3, 2.0 - k % 5, 0.5 + k % 7)
    fit = statistics.inertia_axes(t.select("ring", *[(3 + F.col("t") * w).alias(x) for x, w in zip("xyz", way, strict=True)]), "ring")
    size = F.sqrt(sum((w * w for w in way[1:]), way[0] * way[0]))
    along = sum((F.col(f"d{x}") * w for x, w in zip("yz", way[1:], strict=True)), F.col("dx") * way[0])
    return fit.select("ring", (F.abs(F.abs(along) - size) < 1e-6).alias("fits"))


@query("SELECT p_partkey AS ring, round(CAST(p_partkey % 5 AS DOUBLE), 5) AS x, round(CAST(p_partkey % 3 AS DOUBLE), 5) AS y, round(CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE 1.0 / (1 + p_partkey % 4) ** 2 END, 5) AS ratio FROM part")
def conic_fit(spark, d):
    """Ellipses of half axes 2 and 2 (1 + k % 4), or circles, through nine of their points."""

    def run(k, s):
        a, b = 2.0, 2.0 * (1 + k % 4)
        angle = np.linspace(0.2, 5.9, 9)
        p = np.column_stack([k % 5 + a * np.cos(angle), k % 3 + b * np.sin(angle)])
        c = kn.conic_fit(p)
        x, y = np.linalg.solve([[2 * c[0], c[1]], [c[1], 2 * c[2]]], [-c[3], -c[4]])
        return float(x), float(y), float(c[2] / c[0])

    return rounded(per_part(spark, d, run, "x double, y double, ratio double"), 5)


@query("SELECT p_partkey AS ring, round(1 + p_partkey % 5, 5) + 0.0 AS radius FROM part")
def quadric_fit_sphere(spark, d):
    """Quadrics fitted to points of spheres: what they give is a sphere of the known radius."""
    pts = [(math.cos(i) * math.cos(j), math.sin(i) * math.cos(j), math.sin(j)) for i in (0.1, 1.3, 2.6, 3.9, 5.2) for j in (-1.1, -0.2, 0.7)]
    k = F.col("p_partkey")
    t = bd.table(spark, d, "part").select(k.alias("ring"), (1.0 + k % 5).alias("r"), F.explode(F.array(*[F.struct(*[F.lit(v).alias(x) for x, v in zip("xyz", p, strict=True)]) for p in pts])).alias("p"))
    fit = statistics.quadric_fit(t.select("ring", *[(F.col("r") * F.col(f"p.{x}")).alias(x) for x in "xyz"]), "ring")
    c = [F.get("coefficients", F.lit(i)) for i in range(10)]
    return rounded(fit.select("ring", F.sqrt(-c[9] / c[0]).alias("radius")), 5)


@query("SELECT p_partkey AS ring, true AS found FROM part")
def axis_from_normals(spark, d):
    """Normals of a cylinder's side: its axis is the direction that is square to them."""
    k = F.col("p_partkey")
    t = bd.table(spark, d, "part").select(k.alias("ring"), F.explode(F.array(*[F.lit(0.4 + 0.7 * i) for i in range(8)])).alias("a"))
    tilt = (F.col("ring") % 13) * 0.1
    n = (F.cos("a") * F.cos(tilt), F.sin("a"), -F.cos("a") * F.sin(tilt))
    axis = statistics.axis_from_normals(t.select("ring", *[v.alias(x) for v, x in zip(n, "xyz", strict=True)]), "ring")
    return axis.select("ring", (F.abs(F.abs(F.col("dx") * F.sin((F.col("ring") % 13) * 0.1) + F.col("dz") * F.cos((F.col("ring") % 13) * 0.1)) - 1) < 1e-9).alias("found"))


@query(f"SELECT ring, round(n * r * r * sin(2 * pi() / n) / 2, 5) AS area, round(cos(0.6), 5) AS nz, round(sin(0.6), 5) AS nx FROM {NGON}")
def polygon_3d_area_and_normal(spark, d):
    """Regular rings in a plane tilted by 0.6 about y."""
    p = bd.ngons(spark, d).select("ring", "seq", (F.col("x") * math.cos(0.6)).alias("x"), "y", (-F.col("x") * math.sin(0.6)).alias("z"))
    return rounded(rings.area_normal_3d(p).select("ring", "area", "nx", "nz"), 5)


@query(f"SELECT ring, round(n * r * r * sin(2 * pi() / n) / 2, 6) AS area, true AS touches FROM {NGON}")
def max_inner_circle(spark, d):
    """The largest circle of a regular ring touches the middles of its sides (to a ten-thousandth of its size)."""

    def touches(p, radius):
        middle = (p + np.roll(p, -1, axis=0)) / 2
        wanted = float(np.linalg.norm(middle - p.mean(axis=0), axis=1).min())
        return bool(abs(radius - wanted) <= 1e-4 * wanted)

    def run(many):
        return [[(kn.area2d(p), touches(p, radius))] for p, (_, radius) in zip(many, kn.inner_circles(many, 1e-5), strict=True)]

    return rounded(rings.per_ring(bd.ngons(spark, d), run, "area double, touches boolean", many=True), 6)


@query(f"SELECT mesh, round(pi() / 4 * least(a * (b * b + c * c), b * (a * a + c * c), c * (a * a + b * b)), 5) AS cylinder, round(a * b * c, 5) AS box FROM {CUBOID}")
def min_cylinder_and_box_along(spark, d):
    """Least cylinder over the hull's directions, and the least box along z of cuboids turned about z."""
    turn = np.array([[math.cos(0.4), math.sin(0.4), 0], [-math.sin(0.4), math.cos(0.4), 0], [0, 0, 1]])
    return rounded(cuboid_rows(spark, d, lambda p: [(kn.least_cylinder(p @ turn)[0], kn.box_along(p @ turn, np.array([0.0, 0, 1])))], "cylinder double, box double"), 5)


@query("SELECT p_partkey AS ring, round(a * a - (a - 0.6) ** 2 / 4, 5) AS area, CAST(8 AS BIGINT) AS triangles FROM (SELECT p_partkey, p_size * 0.1012345678::DOUBLE + 1 AS a FROM part)")
def triangulate_with_hole(spark, d):
    """A square with a square hole."""

    def run(k, s):
        a = s * 0.1012345678 + 1
        outer = np.array([[0.0, 0], [a, 0], [a, a], [0, a]])
        h = (a - 0.6) / 2
        hole = 0.3 + np.array([[0.0, 0], [0, h], [h, h], [h, 0]])
        points, triangles = kn.triangulate_with_holes(outer, [hole])
        return sum(kn.area2d(points[t]) for t in triangles), len(triangles)

    return rounded(per_part(spark, d, run, "area double, triangles long"), 5)


@query(f"SELECT g, arg_max(ring, (size, -ring)) AS largest, arg_min(ring, (size, ring)) AS smallest FROM (SELECT ring, ring % 10 AS g, round(n * r * r * sin(2 * pi() / n) / 2, 6) AS size FROM {NGON}) GROUP BY g")
def largest_and_smallest_polygon(spark, d):
    m = rings.measures(bd.ngons(spark, d)).select("ring", F.round("area", 6).alias("size"))
    return m.groupBy((F.col("ring") % 10).alias("g")).agg(F.max_by("ring", F.struct("size", -F.col("ring"))).alias("largest"), F.min_by("ring", F.struct("size", "ring")).alias("smallest"))


@query(f"WITH {bd.POINTS3D}, {bd.cells_sql('a', 'A')} SELECT i, j, k FROM a WHERE i >= 2 AND i < 8")
def voxel_block_slice_pack(spark, d):
    """Cells of points from index 2 and below 8, through packed ids and ranges."""
    middle = voxels.slice_at(voxels.slice_at(bd.cells(spark, d, "A"), "i", 2)[1], "i", 8)[0]
    packed = middle.select(voxels.pack_id().alias("id"))
    return voxels.cells(voxels.runs(packed.select(*voxels.unpack_id("id")))).select("i", "j", "k")


@query(f"SELECT mesh, CAST(floor((x + a) * 2 + 0.5) - floor(x * 2 + 0.5) AS BIGINT) * 2 * b AS cells FROM {CUBOID}")
def voxels_from_mesh(spark, d):
    """Cells of half a unit filled between the crossings of scan lines at a cuboid's middle height."""
    p = bd.table(spark, d, "part")
    k, x = F.col("p_partkey"), (F.col("p_partkey") % 20 * 10).cast("double")
    rows = p.select(k.alias("mesh"), x.alias("x1"), (x + F.col("p_size") / 10 + 1).alias("x2"), F.explode(F.sequence(F.lit(0).cast("long"), 2 * (k % 7 + 1) - 1)).alias("j"))
    hits = rows.select("mesh", "j", F.col("mesh").alias("k"), F.explode(F.array("x1", "x2")).alias("x"))
    return voxels.fill_from_hits(hits, 0.5).groupBy(F.col("k").alias("mesh")).agg(F.count("*").alias("cells"))


@query("SELECT p_partkey AS id, 1 + greatest(abs(p_partkey % 11 - 5), abs(p_partkey % 7 - 3)) AS cells FROM part")
def grid_line_cells(spark, d):
    k = F.col("p_partkey")
    s = bd.table(spark, d, "part").select(k.alias("id"), (k % 5 + 0.5).alias("x1"), (k % 3 + 0.5).alias("y1"), (k % 5 + k % 11 - 5 + 0.5).alias("x2"), (k % 3 + k % 7 - 3 + 0.5).alias("y2"))
    return voxels.line_cells(s, 1.0).groupBy("id").agg(F.count("*").alias("cells"))


@query("WITH p AS (SELECT s_suppkey AS id, radians((s_suppkey * 37) % 360) AS lon, radians((s_suppkey * 17) % 160 - 80) AS lat FROM supplier) SELECT a.id AS query, count(*) AS n, round(sum(g), 4) + 0.0 AS total FROM (SELECT a.id, 2 * asin(least(1, sqrt(sin((b.lat - a.lat) / 2) ** 2 + cos(a.lat) * cos(b.lat) * sin((b.lon - a.lon) / 2) ** 2))) AS g FROM p a, p b WHERE a.id % 20 = 0) a WHERE g <= 0.4999 GROUP BY a.id")
def spherical_radius_search(spark, d):
    """Points of the unit sphere within an arc: the search goes by the chord, the distance is the arc."""
    k = F.col("s_suppkey")
    lon, lat = F.radians((k * 37 % 360).cast("double")), F.radians((k * 17 % 160 - 80).cast("double"))
    p = bd.table(spark, d, "supplier").select(k.alias("id"), (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    found = joins.arc_join(p, p.where("id % 20 = 0").select(F.col("id").alias("query"), "x", "y", "z"), 0.4999)
    return found.groupBy("query").agg(F.count("*").alias("n"), near(F.sum("arc"), 4).alias("total"))


@query("SELECT count(*) AS points FROM (SELECT DISTINCT floor((p_size / 10.0) * 2 + 0.5), floor((p_partkey % 7) * 2 + 0.5) FROM part)")
def drop_duplicate_points(spark, d):
    t = bd.table(spark, d, "part").select((F.col("p_size") / 10).alias("x"), (F.col("p_partkey") % 7).cast("double").alias("y"), F.col("p_partkey").alias("id"))
    return joins.drop_duplicates_on_grid(t, 0.5).agg(F.count("*").alias("points"))
