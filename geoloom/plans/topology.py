"""Queries of ordered paths, arrangements, cuts and voxels of meshes, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.operators import arrangement, cuts, decomposition, hulls, mesh, paths, repair, statistics, voxels
from geoloom.functions import polynomials
from geoloom.functions.storage import materialise, new_folder
from geoloom.operators.joins import by_shuffle
from geoloom.plans import bindings as bd
from geoloom.plans.registry import query, rounded
from geoloom.plans.shapes import CUBOID
from geoloom.sources import mesh_source

#: Orders as one chain of places, cut where the key divides by 4999, and each customer's place in the ring of those of the same nation modulo 5.
CHAIN = 4999


@query(f"""SELECT CAST(0 AS BIGINT) AS mesh, o_orderkey AS e, o_orderkey - o_orderkey % {CHAIN} AS path, o_orderkey % {CHAIN} AS position, false AS closed, count(*) OVER (PARTITION BY o_orderkey // {CHAIN}) AS edges FROM orders
 UNION ALL SELECT 1 + c_custkey % 5, c_custkey, c_custkey % 5, c_custkey // 5, true, count(*) OVER (PARTITION BY c_custkey % 5) FROM customer""")
def edge_paths_ordered(spark, d):
    """Chains of thousands of edges whose vertices are named by hashes, and rings, in order."""
    o, c = bd.table(spark, d, "orders"), bd.table(spark, d, "customer")
    k = F.col("o_orderkey")
    # a vertex is named by chain and place, so that names tell nothing of the order
    chain = o.select(F.lit(0).cast("long").alias("mesh"), k.alias("e"), *[F.xxhash64(F.floor(k / CHAIN), k % CHAIN + i).alias(n) for i, n in enumerate("ab")])
    n = c.count()
    after = F.when(F.col("c_custkey") + 5 < n, F.col("c_custkey") + 5).otherwise(F.col("c_custkey") % 5)
    ring = c.select((1 + F.col("c_custkey") % 5).alias("mesh"), F.col("c_custkey").alias("e"), F.xxhash64("c_custkey").alias("a"), F.xxhash64(after).alias("b"))
    found = paths.edge_paths(chain.unionAll(ring))
    sizes = found.groupBy("mesh", "path").agg(F.count("*").alias("edges"))
    return found.join(by_shuffle(sizes), ["mesh", "path"]).select("mesh", "e", "path", "position", "closed", "edges")


@query(f"SELECT mesh, CAST(1 AS BIGINT) AS loops, CAST(4 AS BIGINT) AS edges, round(2 * (a + b), 6) AS length, CAST(4 AS BIGINT) AS in_order, CAST(1.0 AS DOUBLE) AS turns, true AS encircles FROM {CUBOID}")
def border_paths_in_order(spark, d):
    """The rim of cuboids without their lid: one loop, each edge going on where the last one ended, once about the middle."""
    soup = bd.cuboids(spark, d)
    top = soup.groupBy("mesh").agg(F.max("az").alias("top"))
    vertices, _ = mesh.weld(soup, 6)
    open_top = soup.join(by_shuffle(top), "mesh").where("NOT (az = top AND bz = top AND cz = top)").drop("top")
    found = paths.border_paths(mesh.weld(open_top, 6)[1])
    after = found.select("mesh", "path", (F.col("position") - 1).alias("position"), F.col("a").alias("next"))
    joined = found.join(by_shuffle(after), ["mesh", "path", "position"], "left")
    first = found.where("position = 0").select("mesh", "path", F.col("a").alias("start"))
    joined = joined.join(by_shuffle(first), ["mesh", "path"]).groupBy("mesh").agg(F.count_if(F.col("b") == F.coalesce("next", "start")).alias("in_order"))
    middle = vertices.groupBy("mesh").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    about = vertices.join(by_shuffle(middle), "mesh").select("mesh", "v", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "z")
    # the rim is seen from the side of the open faces, so it runs clockwise from above
    sizes = paths.path_measures(found, about, (0.0, 0.0, -1.0))
    sizes = sizes.groupBy("mesh").agg(F.count("*").alias("loops"), F.sum("edges").alias("edges"), F.sum("length").alias("length"), F.sum("turns").alias("turns"), F.every("encircles").alias("encircles"))
    return rounded(sizes.join(by_shuffle(joined), "mesh").select("mesh", "loops", "edges", "length", "in_order", "turns", "encircles"), 6)


@query(f"""WITH c AS (SELECT *, [a, b, c] AS s FROM {CUBOID}), p AS (SELECT mesh, unnest([a, b, c]) AS length, unnest([4, 4, 4]) AS n FROM c) SELECT mesh, round(length, 6) AS length, CAST(sum(n) AS BIGINT) AS segments, CAST(1 AS BIGINT) AS edges FROM p GROUP BY mesh, length""")
def border_segments_between_flats(spark, d):
    """Ordered borders between the flat sides of cuboids: twelve of one edge each."""
    vertices, faces = mesh.weld(bd.cuboids(spark, d), 6)
    found = paths.border_segments(faces, repair.flats(faces, vertices))
    named = found.select("mesh", F.struct("r", "s", "path").alias("path"), "closed", "a", "b")
    sizes = paths.path_measures(named, vertices)
    return rounded(sizes.select("mesh", "length", "edges"), 6).groupBy("mesh", "length").agg(F.count("*").alias("segments"), F.max("edges").alias("edges"))


#: Two staircases a group: columns of parts, the second ones moved by 0.37 and lifted by 20.5, all turned by 0.3 radians.
GROUPS, MOVE, LIFT, TURN = 7, 0.37, 20.5, 0.3
STAIRS = f"""s AS (SELECT p_partkey % {GROUPS} AS g, p_partkey // {GROUPS} AS i, CAST(p_size AS DOUBLE) AS a, 5.0 + p_partkey * 31 % 17 AS b FROM part),
 t AS (SELECT g, i, a, b, lag(b) OVER (PARTITION BY g ORDER BY i) AS before FROM s),
 u AS (SELECT g, sum(a) AS sa, sum(b) AS sb, sum((1 - {MOVE}) * greatest(0, least(a, {LIFT} + b) - {LIFT}) + {MOVE} * greatest(0, least(a, {LIFT} + coalesce(before, 0)) - {LIFT})) AS common FROM t GROUP BY g)"""


def staircases(spark, d):
    """Edges (g, part, x1, y1, x2, y2) of two staircase polygons for each remainder of the part key; one ring may have any number of columns."""
    k = F.col("p_partkey")
    columns = bd.table(spark, d, "part").select((k % GROUPS).alias("g"), F.floor(k / GROUPS).alias("i"), F.array(F.col("p_size").cast("double"), 5.0 + k * 31 % 17).alias("h"))
    sides = []
    for part, (dx, dy) in enumerate(((0.0, 0.0), (MOVE, LIFT))):
        own = columns.select("g", "i", F.col("h")[part].alias("h"))
        count = own.groupBy("g").agg(F.max("i").alias("n"))
        before = own.select("g", (F.col("i") + 1).alias("i"), F.col("h").alias("h0"))
        # the top of each column and the step before it; the last column is followed by a step down
        rows = own.join(by_shuffle(before), ["g", "i"], "full").select("g", "i", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("h0", F.lit(0.0)).alias("h0"))
        x = F.col("i") + dx
        tops = rows.where("h > 0").select("g", (x + 1).alias("x1"), (F.col("h") + dy).alias("y1"), x.alias("x2"), (F.col("h") + dy).alias("y2"))
        steps = rows.select("g", x.alias("x1"), (F.col("h") + dy).alias("y1"), x.alias("x2"), (F.col("h0") + dy).alias("y2"))
        floor = count.select("g", F.lit(dx).alias("x1"), F.lit(dy).alias("y1"), (F.col("n") + 1 + dx).alias("x2"), F.lit(dy).alias("y2"))
        sides.append(tops.unionAll(steps).unionAll(floor).withColumn("part", F.lit(part)))
    c, s = math.cos(TURN), math.sin(TURN)

    def turned(x: str, y: str):
        return F.col(x) * c - F.col(y) * s, F.col(x) * s + F.col(y) * c

    both = sides[0].unionAll(sides[1])
    return both.select("g", "part", *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*turned("x1", "y1"), *turned("x2", "y2")), strict=True)])


@query(f"WITH {STAIRS} SELECT g, round(sa + sb - common, 4) AS united, round(common, 4) AS common, round(sa - common, 4) AS rest, round(sa + sb - 2 * common, 4) AS either FROM u")
def polygon_booleans_on_tables(spark, d):
    """Union, intersection, difference and exclusive or of two rings of many edges, by one arrangement."""
    found = arrangement.windings(arrangement.arrange(staircases(spark, d)))
    out = None
    for operation, name in (("union", "united"), ("intersect", "common"), ("subtract", "rest"), ("xor", "either")):
        one = arrangement.areas(arrangement.boundary(found, operation)).select("g", F.col("area").alias(name))
        out = one if out is None else out.join(by_shuffle(one), "g", "left")
    return rounded(out.na.fill(0.0), 4)


#: Star polygons of 5, 7 or 9 points, each joined with the next but one.
STARS = "(SELECT p_partkey AS g, 5 + 2 * (p_partkey % 3) AS n, p_size / 10.0 AS r, p_size / 10.0 * cos(2 * pi() / (5 + 2 * (p_partkey % 3))) / cos(pi() / (5 + 2 * (p_partkey % 3))) AS q FROM part)"


@query(f"SELECT g, round(n * r * q * sin(pi() / n), 4) AS area, round(n * r * q * sin(pi() / n) - n * q * q * sin(2 * pi() / n) / 2, 4) AS even_odd, CAST(1 AS BIGINT) AS rings, CAST(2 * n AS BIGINT) AS corners FROM {STARS}")
def self_intersections_removed(spark, d):
    """Stars that cross themselves: the outline as one ring, and the points alone by the even-odd rule."""
    k = F.col("p_partkey")
    star = bd.table(spark, d, "part").select(k.alias("g"), (5 + 2 * (k % 3)).alias("n"), (F.col("p_size") / 10).alias("r")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))

    def at(j):
        angle = 4 * math.pi * j / F.col("n") + 0.1
        return F.col("r") * F.cos(angle), F.col("r") * F.sin(angle)

    edges = star.select("g", F.lit(0).alias("part"), *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*at(F.col("j")), *at((F.col("j") + 1) % F.col("n"))), strict=True)])
    found = materialise(arrangement.windings(arrangement.arrange(edges, 1), 1), "windings")
    whole = arrangement.boundary(found, "union", parts=1)
    points = arrangement.areas(arrangement.boundary(found, "union", "even_odd", 1)).select("g", F.col("area").alias("even_odd"))
    rings = arrangement.rings_of(whole).groupBy("g").agg(F.count_distinct("ring").alias("rings"), F.count("*").alias("corners"))
    return rounded(arrangement.areas(whole).select("g", "area").join(by_shuffle(points), "g").join(by_shuffle(rings), "g"), 4)


#: Cuboids turned about z by 0.5 and about y by 0.3 radians, where they stand; cells of 0.7.
CELL, ABOUT_Z, ABOUT_Y = 0.7, 0.5, 0.3


def turned_cuboids(spark, d):
    soup = bd.cuboids(spark, d)
    base = (F.col("mesh") % 20 * 10).cast("double"), F.lit(5.0), F.lit(5.0)
    cz, sz, cy, sy = math.cos(ABOUT_Z), math.sin(ABOUT_Z), math.cos(ABOUT_Y), math.sin(ABOUT_Y)
    moved = []
    for c in "abc":
        x, y, z = (F.col(f"{c}{n}") - b for n, b in zip("xyz", base, strict=True))
        u, w = x * cy + z * sy, z * cy - x * sy
        moved += [(v + b).alias(f"{c}{n}") for n, b, v in zip("xyz", base, (u * cz - y * sz, u * sz + y * cz, w), strict=True)]
    return soup.select("mesh", "f", *moved)


@query(f"""WITH c AS (SELECT * FROM {CUBOID}), g AS (SELECT mesh, a, b, c, (i + 0.5) * {CELL} AS px, (j + 0.5) * {CELL} - 5 AS py, (k + 0.5) * {CELL} - 5 AS pz, x FROM c, range(-15, 15) AS ri(di), range(-1, 22) AS rj(j), range(1, 15) AS rk(k), LATERAL (SELECT CAST(floor(x / {CELL}) AS BIGINT) + di AS i)),
 l AS (SELECT mesh, a, b, c, (px - x) * cos({ABOUT_Z}) + py * sin({ABOUT_Z}) AS u, py * cos({ABOUT_Z}) - (px - x) * sin({ABOUT_Z}) AS v, pz AS w FROM g)
 SELECT mesh, count(*) AS cells FROM l WHERE v BETWEEN 0 AND b AND u * cos({ABOUT_Y}) - w * sin({ABOUT_Y}) BETWEEN 0 AND a AND u * sin({ABOUT_Y}) + w * cos({ABOUT_Y}) BETWEEN 0 AND c GROUP BY mesh""")
def voxels_of_meshes(spark, d):
    """Cells whose centres lie within turned cuboids, by scan lines through their faces."""
    runs = voxels.mesh_runs(turned_cuboids(spark, d), CELL)
    return runs.groupBy("mesh").agg(F.sum(F.col("last") - F.col("first")).alias("cells"))


_SIDES = """side AS (SELECT 0 AS axis, 0 AS s, i AS plane, j AS u, k AS v FROM a UNION ALL SELECT 0, 1, i + 1, j, k FROM a UNION ALL SELECT 1, 0, j, k, i FROM a UNION ALL SELECT 1, 1, j + 1, k, i FROM a UNION ALL SELECT 2, 0, k, i, j FROM a UNION ALL SELECT 2, 1, k + 1, i, j FROM a),
 bare AS (SELECT axis, plane, u, v, max(s) AS s FROM side GROUP BY axis, plane, u, v HAVING count(*) = 1),
 strip AS (SELECT axis, s, plane, v, min(u) AS u0, max(u) AS u1 FROM (SELECT *, u - row_number() OVER (PARTITION BY axis, s, plane, v ORDER BY u) AS g FROM bare) GROUP BY axis, s, plane, v, g),
 rect AS (SELECT count(*) AS n FROM (SELECT 1 FROM (SELECT *, v - row_number() OVER (PARTITION BY axis, s, plane, u0, u1 ORDER BY v) AS g FROM strip) GROUP BY axis, s, plane, u0, u1, g))"""


@query(f"WITH {bd.POINTS3D}, {bd.cells_sql('a', 'A')}, {_SIDES} SELECT CAST(1 AS BIGINT) AS mesh, (SELECT 2 * n FROM rect) AS faces, (SELECT count(*) FROM bare) * 16.0 AS area, (SELECT count(*) FROM a) * 64.0 AS volume")
def voxels_to_rectilinear_mesh(spark, d):
    """The surface of a voxel grid in as few rectangles as gaps and islands give; its volume by the divergence theorem is that of the cells."""
    cells = bd.cells(spark, d, "A").withColumn("mesh", F.lit(1).cast("long"))
    soup = voxels.rectilinear_mesh(voxels.rectangles(cells), 4.0)
    found = mesh.solid_measures(soup)
    return rounded(found.select("mesh", "faces", "area", "volume"), 6)


#: Planes through cuboids that cross their four upright edges: at 0.45 of the height in the middle, rising by 0.06 along x and 0.04 along y.
RISE = (0.06, 0.04)


@query(f"""SELECT mesh, round(a * b * w, 5) AS cap, round(a * b * h, 5) AS below, round(a * b * (c - h), 5) AS above, round(a * b + a * b * w + 2 * (a + b) * h, 5) AS below_area, round(a * b + a * b * w + 2 * (a + b) * (c - h), 5) AS above_area,
 round(2 * a * sqrt(1 + 0.0036) + 2 * b * sqrt(1 + 0.0016), 5) AS perimeter, CAST(1 AS BIGINT) AS loops, CAST(8 AS BIGINT) AS corners, true AS closed, CAST(0 AS BIGINT) AS open_edges, round(a * b * c, 5) AS volume
 FROM (SELECT *, 0.45 * c AS h, sqrt(1 + 0.0036 + 0.0016) AS w FROM {CUBOID})""")
def mesh_cut_oblique(spark, d):
    """Cuboids cut by a slanted plane, each by its own: both closed parts, the section and its outline in order."""
    soup = bd.cuboids(spark, d)
    ends = soup.groupBy("mesh").agg(*[f(f"a{x}").alias(f"{n}{x}") for x in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    normal = (-RISE[0], -RISE[1], 1.0)
    middle = [(F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, F.col("minz") + 0.45 * (F.col("maxz") - F.col("minz"))]
    distance = (middle[0] * normal[0] + middle[1] * normal[1] + middle[2]) / math.sqrt(sum(c * c for c in normal))
    own = soup.join(by_shuffle(ends), "mesh")
    sizes = cuts.contact(own, normal, distance)
    outlines = materialise(cuts.contact_loops(own, normal, distance), "outlines")
    loops = outlines.groupBy("mesh").agg(F.count_distinct("path").alias("loops"), F.count("*").alias("corners"), F.every("closed").alias("closed"))
    parts = cuts.split(own, normal, distance, loops=outlines).withColumn("mesh", F.col("mesh") * 2 + F.col("above").cast("long"))
    # faces have their corners with them, so only the ends of edges are welded
    half = F.floor(F.col("mesh") / 2)
    whole = mesh.unpaired_edges(mesh.weld(parts, 7)[1]).groupBy(half.alias("mesh")).agg(F.sum("unpaired").alias("open_edges"))
    volume = mesh.solid_measures(parts).groupBy(half.alias("mesh")).agg(F.sum("volume").alias("volume"))
    return rounded(sizes.join(by_shuffle(loops), "mesh").join(by_shuffle(whole), "mesh").join(by_shuffle(volume), "mesh"), 5)


@query(f"""SELECT mesh, level, CAST(1 AS BIGINT) AS loops, round(2 * (a + b), 5) AS length FROM (SELECT *, unnest(range(7, 7 + 2 * c)) AS level FROM (SELECT mesh, a, b, CAST(c AS BIGINT) AS c FROM {CUBOID})) WHERE level * 0.75 <= 5 + c AND level * 0.75 > 5""")
def cross_section_loops_in_order(spark, d):
    """Outlines of cuboids on planes 0.75 apart, each one loop."""
    found = cuts.cross_section_loops(bd.cuboids(spark, d), (0.0, 0.0, 1.0), 0.75)
    size = F.sqrt(sum(((F.col("q")[x] - F.col("p")[x]) ** 2 for x in "yz"), (F.col("q")["x"] - F.col("p")["x"]) ** 2))
    loops = found.where("closed").groupBy("mesh", "level").agg(F.count_distinct("path").alias("loops"), F.sum(size).alias("length"))
    return rounded(loops, 5)


@query(f"SELECT mesh, true AS short_enough, CAST(0 AS BIGINT) AS open_edges, CAST(2 AS BIGINT) AS euler, round(2 * (a * b + b * c + c * a), 6) AS area, round(a * b * c, 6) AS volume FROM {CUBOID}")
def mesh_refined_to_a_limit(spark, d):
    """Uneven cuboids refined until no edge is longer than 1.3: still closed, with no hanging vertex, and of the same area and volume."""
    fine = repair.refine(bd.cuboids(spark, d), 1.3)
    # faces have their corners with them, so only the ends of edges are welded
    sizes = mesh.solid_measures(fine)
    whole = mesh.integrity(mesh.weld(fine, 9)[1]).select("mesh", (F.col("edges") - F.col("manifold")).alias("open_edges"), "euler")
    longest = fine.select("mesh", F.greatest(*[F.sqrt(sum(((F.col(f"{p}{x}") - F.col(f"{q}{x}")) ** 2 for x in "yz"), (F.col(f"{p}x") - F.col(f"{q}x")) ** 2)) for p, q in ("ab", "bc", "ca")]).alias("size")).groupBy("mesh").agg((F.max("size") <= 1.3).alias("short_enough"))
    return rounded(longest.join(by_shuffle(whole), "mesh").join(by_shuffle(sizes), "mesh").select("mesh", "short_enough", "open_edges", "euler", "area", "volume"), 6)


@query(f"SELECT mesh, round(1e6 + x + a / 2, 5) AS cx, round(2e6 + 5 + b / 2.0, 5) AS cy, round(-1e6 + 5 + c / 2.0, 5) AS cz, round(sqrt(a * a + b * b + c * c) / 2, 5) AS radius FROM {CUBOID}")
def sphere_fit_far_out(spark, d):
    """Spheres through the corners of cuboids a million away from the origin."""
    far = bd.mesh_vertices(bd.cuboids(spark, d)).select("mesh", (F.col("x") + 1e6).alias("x"), (F.col("y") + 2e6).alias("y"), (F.col("z") - 1e6).alias("z"))
    return rounded(statistics.sphere_fit(far, "mesh"), 5)


@query("SELECT p_partkey % 5 AS g, round(-0.3 / sqrt(1.13), 5) AS nx, round(-0.2 / sqrt(1.13), 5) AS ny, round(1 / sqrt(1.13), 5) AS nz, round((7 + p_partkey % 5) / sqrt(1.13), 2) AS d, 0.0 AS mse FROM part GROUP BY p_partkey % 5")
def plane_fit_far_out(spark, d):
    """Planes z = 0.3 x + 0.2 y + 7 and more, a million away from the origin."""
    k = F.col("p_partkey")
    x, y = 1e6 + F.col("p_size"), 1e6 + (k * 7919 % 53).cast("double")
    points = bd.table(spark, d, "part").select((k % 5).alias("g"), x.alias("x"), y.alias("y"), (0.3 * x + 0.2 * y + 7 + k % 5).alias("z"))
    fit = statistics.plane_fit(points, "g")
    return rounded(fit.withColumn("d", F.round("d", 2)), 5)


@query("SELECT CAST(12 * count(*) AS BIGINT) AS faces, round(sum(2 * (a * b + b * c + c * a)), 6) AS area, round(sum(a * b * c), 6) AS volume, true AS in_splits FROM (SELECT floor((p_size / 10.0 + 1) * 8) / 8 AS a, p_partkey % 7 + 1 AS b, p_partkey % 3 + 1 AS c FROM part)")
def stl_files_in_splits(spark, d):
    """All cuboids, on a grid of eighths, through STL files and back, each file read by several tasks."""
    mesh_source.register(spark)
    folder = new_folder(spark, "stl")
    soup = bd.cuboids(spark, d)
    snapped = [(F.floor(mesh.near(F.col(f"{c}{x}") * 8, 6)) / 8).alias(f"{c}{x}") for c in "abc" for x in "xyz"]
    files = mesh_source.write_stl(soup.select(*snapped), folder)
    back = spark.read.format("stl").schema(", ".join(f"{c} double" for c in mesh_source.CORNERS)).option("splitBytes", 20_000).load(folder)
    # sums by task, so that one reading of the files tells the sums and how many tasks had a part of them
    found = mesh.solid_measures(back.withColumn("mesh", F.spark_partition_id())).agg(*[F.sum(n).alias(n) for n in ("faces", "area", "volume")], F.count("*").alias("splits"))
    return rounded(found.select("faces", "area", "volume", (F.col("splits") > files).alias("in_splits")), 6)


#: All lines of orders as one set: quantity moved by the last digits of the order, and price.
SPREAD = "CAST(l_quantity + l_orderkey % 97 / 97.0 AS DOUBLE)"


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT {SPREAD} AS x, CAST(l_extendedprice / 1000 AS DOUBLE) AS y FROM lineitem),
 h(seq, x, y, px, py) AS (SELECT CAST(0 AS BIGINT), x, y, x, y + 1 FROM (SELECT x, y FROM p ORDER BY x, y LIMIT 1)
  UNION ALL SELECT h.seq + 1, n.s.x, n.s.y, h.x, h.y FROM h, LATERAL (SELECT arg_min({{'x': p.x, 'y': p.y}}, (round(CASE WHEN a < -1e-12 THEN a + 2 * pi() ELSE a END, 10), -d)) AS s
   FROM (SELECT p.x, p.y, atan2((h.x - h.px) * (p.y - h.y) - (h.y - h.py) * (p.x - h.x), (h.x - h.px) * (p.x - h.x) + (h.y - h.py) * (p.y - h.y)) AS a, (p.x - h.x) ** 2 + (p.y - h.y) ** 2 AS d FROM p WHERE p.x <> h.x OR p.y <> h.y) p) n
  WHERE h.seq < 1000 AND (h.seq = 0 OR (h.x, h.y) <> (SELECT (x, y) FROM (SELECT x, y FROM p ORDER BY x, y LIMIT 1))))
 SELECT seq, round(x, 6) AS x, round(y, 6) AS y FROM h WHERE seq < (SELECT max(seq) FROM h)""")
def hull_of_one_large_set(spark, d):
    """The hull of all lines of orders in one group, pruned, from partial hulls."""
    t = bd.table(spark, d, "lineitem")
    points = t.select(F.lit(1).alias("g"), (F.col("l_quantity") + F.col("l_orderkey") % 97 / 97.0).cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    return rounded(hulls.hull2d(points).select("seq", "x", "y"), 6)


@query(f"WITH {STAIRS} SELECT g, round(sa + sb - common, 4) AS area, round(sa + sb - common, 4) AS in_triangles, true AS upright FROM u")
def polygon_trapezoids(spark, d):
    """The union of two turned staircases in trapezoids and triangles: their areas add up."""
    found = arrangement.windings(arrangement.arrange(staircases(spark, d)))
    traps = decomposition.trapezoids(arrangement.boundary(found, "union"))
    width = F.col("x1") - F.col("x0")
    size = traps.groupBy("g").agg(F.sum(width * (F.col("high0") - F.col("low0") + F.col("high1") - F.col("low1")) / 2).alias("area"), F.every((width > 0) & (F.col("high0") >= F.col("low0") - 1e-7) & (F.col("high1") >= F.col("low1") - 1e-7)).alias("upright"))
    cross = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    parts = decomposition.triangles(traps).groupBy("g").agg((F.sum(cross) / 2).alias("in_triangles"))
    return rounded(size.join(by_shuffle(parts), "g").select("g", "area", "in_triangles", "upright"), 4)


@query(f"SELECT g, round(n * r * q * sin(pi() / n), 4) AS area, true AS covered, true AS monotone FROM {STARS}")
def polygon_monotone_pieces(spark, d):
    """Outlines of stars in pieces that every upright line meets in one stretch."""
    k = F.col("p_partkey")
    star = bd.table(spark, d, "part").select(k.alias("g"), (5 + 2 * (k % 3)).alias("n"), (F.col("p_size") / 10).alias("r")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("n") - 1)))

    def at(j):
        inner = F.cos(2 * math.pi / F.col("n")) / F.cos(math.pi / F.col("n"))
        size, angle = F.col("r") * F.when(j % 2 == 0, 1.0).otherwise(inner), math.pi * j / F.col("n") + 0.1
        return size * F.cos(angle), size * F.sin(angle)

    ends = (*at(F.col("j")), *at((F.col("j") + 1) % (2 * F.col("n"))))
    edges = star.select("g", *[v.alias(name) for name, v in zip(("x1", "y1", "x2", "y2"), ends, strict=True)])
    edges = edges.select("g", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])
    pieces = decomposition.monotone(decomposition.trapezoids(edges))
    area = (F.col("x1") - F.col("x0")) * (F.col("high0") - F.col("low0") + F.col("high1") - F.col("low1")) / 2
    each = pieces.groupBy("g", "piece").agg(F.sum(area).alias("area"), F.sum(F.col("x1") - F.col("x0")).alias("widths"), (F.max("x1") - F.min("x0")).alias("reach"))
    # no two trapezoids of a piece lie over each other if their widths add up to its reach
    found = each.groupBy("g").agg(F.sum("area").alias("area"), F.every(F.col("area") > 0).alias("covered"), F.every(F.abs(F.col("widths") - F.col("reach")) < 1e-6).alias("monotone"))
    return rounded(found, 4)


@query("SELECT id, round(x, 5) + 0.0 AS x, round(s * sqrt(greatest(a * a - x * x, 0)), 5) + 0.0 AS y FROM (SELECT p_partkey AS id, p_size / 10.0 + 1 AS a, ((p_size / 10.0 + 1) ** 2 - 4 + (p_partkey % 7 + 1) ** 2) / (2.0 * (p_partkey % 7 + 1)) AS x FROM part), (VALUES (1), (-1)) AS v(s) WHERE a * a - x * x > 1e-9 OR (a * a - x * x > -1e-9 AND s = 1)")
def conics_meet(spark, d):
    """Points that a circle about the origin and one of radius 2 beside it have in common, by the roots of a quartic."""
    k, a = F.col("p_partkey"), F.col("p_size") / 10 + 1
    t = (k % 7 + 1).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    found = polynomials.conic_meetings(bd.table(spark, d, "part").withColumn("id", k), ["id"], [one, zero, one, zero, zero, -a * a], [one, zero, one, -2 * t, zero, t * t - 4])
    return rounded(found, 5)
