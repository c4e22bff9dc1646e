"""Cuts of meshes and voxels of meshes against closed forms and tests of single points."""

import math

import pytest
from pyspark.sql import functions as F

from geoloom.operators import cuts, mesh, voxels

CORNERS = [f"{c}{x} double" for c in "abc" for x in "xyz"]
SCHEMA = "mesh long, f long, " + ", ".join(CORNERS)
CUBE = [((i >> 0) & 1, (i >> 1) & 1, (i >> 2) & 1) for i in range(8)]
FACES = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]


def box(number, low, size, inward=False):
    rows = []
    for n, face in enumerate(FACES):
        face = face[::-1] if inward else face
        rows.append((number, n + 100 * inward, *[float(low[i] + size[i] * CUBE[v][i]) for v in face for i in range(3)]))
    return rows


def octahedron(number, centre, r):
    tips = [tuple(centre[i] + s * r * (i == axis) for i in range(3)) for axis in range(3) for s in (1, -1)]
    faces = []
    for x in (0, 1):
        for y in (2, 3):
            for z in (4, 5):
                flip = (x % 2) ^ (y % 2) ^ (z % 2)
                faces.append((x, z, y) if flip else (x, y, z))
    return [(number, n, *[float(c) for v in face for c in tips[v]]) for n, face in enumerate(faces)]


@pytest.fixture(scope="module")
def soup(spark):
    # a box, a hollow box, an octahedron, and two boxes that overlap
    rows = box(1, (0, 0, 0), (2, 3, 4)) + box(2, (0, 0, 0), (4, 4, 4)) + box(2, (1, 1, 1), (2, 2, 2), True) + octahedron(3, (5, 5, 5), 2)
    rows += box(4, (0, 0, 0), (2, 2, 2)) + [(m, f + 50, *p) for m, f, *p in box(4, (1, 1, 1), (2, 2, 2))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_contact_of_level_planes(soup):
    got = {r.mesh: r for r in cuts.contact(soup, (0, 0, 2.0), 2.0).collect()}
    assert (got[1].cap, got[1].perimeter, got[1].below, got[1].above) == pytest.approx((6, 10, 12, 12))
    assert (got[2].cap, got[2].perimeter, got[2].below, got[2].above) == pytest.approx((12, 24, 28, 28))
    assert (got[1].below_area, got[1].above_area) == pytest.approx((32, 32))
    assert (got[3].cap, got[3].below, got[3].above) == pytest.approx((0, 0, 4 / 3 * 8))


@pytest.mark.parametrize("distance", [0.0, 1.0, 3.0, 4.0])
def test_planes_through_corners_leave_no_gaps(soup, distance):
    """The parts of a solid add up, and both are closed, where the plane lies in faces or goes through corners."""
    for r in cuts.contact(soup.where("mesh <> 4"), (0, 0, 1.0), distance).collect():
        assert r.below + r.above == pytest.approx({1: 24, 2: 56, 3: 32 / 3}[r.mesh])
    parts = cuts.split(soup.where("mesh IN (1, 3)"), (1.0, 1.0, 1.0), distance * math.sqrt(3)).withColumn("mesh", F.col("mesh") * 2 + F.col("above").cast("long"))
    _, faces = mesh.weld(parts, 7)
    assert mesh.integrity(mesh.clean_faces(faces)).where("edges <> manifold").count() == 0


def test_outlines_of_a_hollow_box_in_order(soup):
    rows = cuts.contact_loops(soup.where("mesh = 2"), (0, 0, 1.0), 2.2).orderBy("path", "position").collect()
    loops = {}
    for r in rows:
        assert r.closed
        loops.setdefault(r.path, []).append(((r.p.x, r.p.y), (r.q.x, r.q.y)))
    areas = []
    for line in loops.values():
        assert all(line[i][1] == line[(i + 1) % len(line)][0] for i in range(len(line)))
        areas.append(sum(p[0] * q[1] - q[0] * p[1] for p, q in line) / 2)
    assert sorted(areas) == pytest.approx([-4, 16])


def inside(number, x, y, z):
    if number == 3:
        return abs(x - 5) + abs(y - 5) + abs(z - 5) < 2
    within = lambda low, high: all(a < c < b for a, b, c in zip(low, high, (x, y, z)))
    return {1: within((0, 0, 0), (2, 3, 4)), 2: within((0, 0, 0), (4, 4, 4)) and not within((1, 1, 1), (3, 3, 3)), 4: within((0, 0, 0), (2, 2, 2)) or within((1, 1, 1), (3, 3, 3))}[number]


@pytest.mark.parametrize(("side", "offset"), [(0.3, (0.01, 0.02, 0.03)), (1.0, (0.0, 0.0, 0.0))])
def test_cells_are_those_with_their_centre_inside(soup, side, offset):
    got = {(r.mesh, r.i, r.j, r.k) for r in voxels.run_cells(voxels.mesh_runs(soup, side, offset)).collect()}
    n = int(8 / side)
    if side == 1.0:
        soup = soup.where("mesh <> 3")
        got = {c for c in got if c[0] != 3}
    wanted = set()
    for number in {1, 2, 3, 4} - ({3} if side == 1.0 else set()):
        for i in range(-1, n):
            for j in range(-1, n):
                for k in range(-1, n):
                    if inside(number, *[o + (c + 0.5) * side for o, c in zip(offset, (i, j, k))]):
                        wanted.add((number, i, j, k))
    assert got == wanted


def test_rectangles_cover_the_open_sides(spark, soup):
    cells = voxels.run_cells(voxels.mesh_runs(soup, 0.25, (0.01, 0.01, 0.01))).withColumn("mesh", F.col("mesh"))
    rects = voxels.rectangles(cells)
    area = {r.mesh: r.n for r in rects.groupBy("mesh").agg(F.sum((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("n")).collect()}
    volume = {r.mesh: (r.volume, r.area) for r in mesh.solid_measures(voxels.rectilinear_mesh(rects, 1.0, (3.0, -2.0, 1.0))).collect()}
    for number in (1, 2, 3, 4):
        own = cells.where(F.col("mesh") == number)
        count, sides = own.count(), voxels.exposed(own).groupBy().sum("open_sides").first()[0]
        assert area[number] == sides and volume[number] == pytest.approx((count, sides))
    assert rects.where("mesh = 1").count() == 6
    none = spark.createDataFrame([], SCHEMA)
    assert voxels.mesh_runs(none, 1.0).count() == 0 and voxels.rectangles(cells.limit(0)).count() == 0 and cuts.contact(none, (0, 0, 1.0), 0.0).count() == 0
