"""Fits away from the origin, and refinement without hanging vertices."""

import math

import numpy as np
import pytest

from geoloom.operators import mesh, repair, statistics
from tests.test_cuts_and_voxels import SCHEMA, box, octahedron

SHIFTS = {"here": (0.0, 0.0, 0.0), "far": (1e6, -2e6, 3e6), None: (1e6, 1e6, 1e6)}


def cloud(spark, points):
    rows = [(g, *map(float, np.array(p) + s)) for g, s in SHIFTS.items() for p in points]
    return spark.createDataFrame([*rows, ("here", None, 1.0, 2.0)], "g string, x double, y double, z double")


def test_fits_do_not_depend_on_where_the_points_lie(spark):
    rng = np.random.default_rng(1)
    ball = rng.normal(size=(15, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    for r in statistics.sphere_fit(cloud(spark, ball), "g").collect():
        assert (r.cx, r.cy, r.cz, r.radius) == pytest.approx((*SHIFTS[r.g], 1), abs=1e-6)
    flat = [(x, y, 0.3 * x + 0.2 * y) for x in range(10) for y in range(10)]
    normal = np.array([-0.3, -0.2, 1]) / math.sqrt(1.13)
    for r in statistics.plane_fit(cloud(spark, flat), "g").collect():
        d = normal @ np.array(SHIFTS[r.g])
        sign = 1 if abs(d) < 1e-3 or d > 0 else -1
        assert np.array([r.nx, r.ny, r.nz]) * (1 if r.nz * sign > 0 else -1) == pytest.approx(sign * normal, abs=1e-9)
        assert abs(r.d) == pytest.approx(abs(d), abs=1e-2) and r.mse < 1e-9
    line = [(3 + t, 2 * t, -t) for t in range(9)]
    for r in statistics.inertia_axes(cloud(spark, line), "g").collect():
        if r.g != "here":  # the point of a null coordinate is left out, so all are alike
            assert (r.cx, r.cy, r.cz) == pytest.approx(np.array([7, 8, -4]) + SHIFTS[r.g])
        assert (r.dx, r.dy, r.dz) == pytest.approx(np.array([1, 2, -1]) / math.sqrt(6), abs=1e-9)
    for r in statistics.quadric_fit(cloud(spark, ball), "g").collect():
        c, m = np.array(r.coefficients), np.array(SHIFTS[r.g])
        wanted = np.array([1, 1, 1, 0, 0, 0, *(-2 * m), m @ m - 1])
        wanted /= np.linalg.norm(wanted)
        assert np.abs(c - wanted * np.sign(wanted[9]) * np.sign(c[9])).max() < 1e-9


@pytest.mark.parametrize("limit", [0.4, 1.7, 100.0])
def test_refined_meshes_keep_their_shape(spark, limit):
    soup = spark.createDataFrame(box(1, (0, 0, 0), (0.5, 3, 4)) + octahedron(2, (5, 5, 5), 2) + [(3, 0, *[0.0] * 9), (4, 0, None, *[0.0] * 8)], SCHEMA)
    fine = repair.refine(soup, limit)
    rows = fine.collect()
    assert len({(r.mesh, r.f) for r in rows}) == len(rows) and {r.mesh for r in rows} == {1, 2, 3}
    for r in rows:
        points = np.array([[r[f"{c}{x}"] for x in "xyz"] for c in "abc"])
        assert all(np.linalg.norm(points[i] - points[i - 1]) <= limit for i in range(3))
    vertices, faces = mesh.weld(fine.where("mesh < 3"), 9)
    assert mesh.integrity(faces).where("edges <> manifold OR euler <> 2").count() == 0
    sizes = {r.mesh: (r.area, r.volume) for r in mesh.solid_measures(mesh.with_corners(faces, vertices)).collect()}
    assert sizes[1] == pytest.approx((2 * (1.5 + 2 + 12), 6)) and sizes[2] == pytest.approx((8 * math.sqrt(3) / 4 * 8, 32 / 3))
    assert limit < 100 or len(rows) == 21


def test_a_limit_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        repair.refine(spark.createDataFrame([], SCHEMA), 0.0)
    assert repair.refine(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


def test_refining_writes_and_shuffles_nothing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(repair, "materialise", lambda df, label: written.append(label) or df)
    soup = spark.createDataFrame(box(1, (0, 0, 0), (0.5, 3, 4)) + octahedron(2, (5, 5, 5), 2), SCHEMA)
    fine = repair.refine(soup, 0.5)
    assert not written and "Exchange" not in fine._jdf.queryExecution().executedPlan().toString()
    rows = fine.count()
    monkeypatch.setattr(repair, "FACES", 7)
    assert repair.refine(soup, 0.5).count() == rows > 100
