import math

import numpy as np
import pytest

from geoloom.functions import matrix
from geoloom.operators import kernels as kn
from geoloom.operators.statistics import t_tail

SQUARE = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
ELL = np.array([[0.0, 0], [3, 0], [3, 1], [1, 1], [1, 3], [0, 3]])


def area(rings):
    return sum(kn.area2d(r) for r in rings)


@pytest.mark.parametrize(("operation", "wanted"), [("union", 7), ("intersect", 1), ("subtract", 3), ("xor", 6)])
def test_boolean(operation, wanted):
    assert area(kn.boolean([SQUARE], [SQUARE + 1], operation)) == pytest.approx(wanted)


def test_boolean_keeps_holes_and_islands():
    hole = SQUARE * 0.25 + 0.75
    assert area(kn.boolean([SQUARE], [hole], "subtract")) == pytest.approx(4 - 0.25)
    assert area(kn.boolean([SQUARE], [SQUARE], "union")) == pytest.approx(4)
    assert kn.boolean([SQUARE], [SQUARE], "subtract") == []
    assert area(kn.boolean([SQUARE], [SQUARE + [2, 0]], "union")) == pytest.approx(8)


def test_offset():
    assert area(kn.offset(SQUARE, 1, "miter")) == pytest.approx(16)
    assert area(kn.offset(SQUARE, 1, "round", 1e-4)) == pytest.approx(12 + math.pi, rel=1e-3)
    assert area(kn.offset(SQUARE, -0.5, "miter")) == pytest.approx(1)
    assert area(kn.offset(ELL, 0.2, "miter")) == pytest.approx(7.56)
    assert 12 + math.pi < area(kn.offset(SQUARE, 1, "square")) < 16


def test_triangulate():
    triangles = kn.triangulate(ELL)
    assert len(triangles) == 4 and sum(kn.area2d(ELL[t]) for t in triangles) == pytest.approx(5)


def test_hull_of_five_points():
    points = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0.2, 0.2, 0.2]])
    faces = kn.hull3d(points)
    assert len(faces) == 4 and kn.mesh_volume(points, faces) == pytest.approx(1 / 6)
    assert len(kn.hull3d(points[:3])) == 0 and len(kn.hull3d(points * [1, 1, 0])) == 0


def test_hull_of_a_cloud_holds_it():
    points = np.random.default_rng(1).normal(size=(300, 3))
    faces = kn.hull3d(points)
    normals = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    assert ((points[None] - points[faces[:, 0]][:, None]) * normals[:, None]).sum(axis=2).max() < 1e-9
    assert len(set(faces.ravel())) - len(faces) * 3 // 2 + len(faces) == 2


@pytest.mark.parametrize("d", [2, 3])
def test_least_ball(d):
    rng = np.random.default_rng(d)
    rim = rng.normal(size=(40, d))
    rim /= np.linalg.norm(rim, axis=1)[:, None]
    points = np.vstack([rim, -rim, rng.uniform(-0.5, 0.5, size=(100, d))])
    centre, radius = kn.least_ball(points)
    assert radius == pytest.approx(1) and np.allclose(centre, 0, atol=1e-9)


def test_delaunay_has_empty_circles():
    points = np.random.default_rng(5).uniform(size=(60, 2))
    triangles = kn.delaunay2d(points)
    assert sum(abs(kn.area2d(points[t])) for t in triangles) == pytest.approx(kn.area2d(points[kn.hull2d(points)]))
    for t in triangles:
        centre, radius = kn.ball_through(points[t])
        assert (np.linalg.norm(points - centre, axis=1) > radius - 1e-7).all()


def test_registration_recovers_a_motion():
    points = np.random.default_rng(2).normal(size=(40, 3))
    c, s = math.cos(0.05), math.sin(0.05)
    _, _, error = kn.register(points, points @ np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]) + 0.02)
    assert error < 1e-9


def test_distances_and_boxes():
    assert kn.convex_distance(SQUARE, SQUARE + 5) == pytest.approx(math.sqrt(18))
    assert kn.convex_distance(SQUARE, SQUARE + 1) == 0
    cube = np.array([[x, y, z] for x in (0, 1.0) for y in (0, 1.0) for z in (0, 1.0)])
    assert kn.least_box(cube) == pytest.approx(1) and len(kn.hull3d(cube)) == 12


def test_simplify_and_sampling():
    t = np.arange(100) * 2 * np.pi / 100
    circle = np.stack([np.cos(t), np.sin(t)], axis=1)
    short = kn.simplify_short_edges(circle, 0.2)
    assert 3 <= len(short) < 50
    assert len(kn.simplify_area(circle, 0.0)) == 100
    p = kn.poisson_points(SQUARE, 0.3)
    gaps = np.linalg.norm(p[:, None] - p[None], axis=2) + np.eye(len(p)) * 9
    assert gaps.min() >= 0.3 and kn.inside([SQUARE], p).all()


def test_matrix_arrays():
    a = np.array([[0.0, 1.0], [-1.0, 0.0]])
    assert np.allclose(matrix.expm(a), [[math.cos(1), math.sin(1)], [-math.sin(1), math.cos(1)]])
    m = np.array([[2.0, 1], [4, 5]])
    f = matrix.lu(m)
    assert np.allclose((np.tril(f, -1) + np.eye(2)) @ np.triu(f), m)


def test_student_tail():
    assert t_tail(0, 5) == pytest.approx(1)
    assert t_tail(2.015048, 5) == pytest.approx(0.1, abs=1e-5)
    assert t_tail(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
