"""Vector, matrix and surface expressions against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import matrix as mx
from geoloom.functions import surfaces as sf
from geoloom.functions import vector as vc


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(50, 6))
    return values, spark.createDataFrame([tuple(map(float, r)) for r in values], "ax double, ay double, az double, bx double, by double, bz double")


def take(df, *columns):
    return np.array([list(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()], dtype=float)


A, B = ("ax", "ay", "az"), ("bx", "by", "bz")


def test_products_and_lengths(pairs):
    v, df = pairs
    a, b = vc.vector(*A), vc.vector(*B)
    got = take(df, vc.dot(a, b), *vc.cross(a, b), vc.distance(a, b), vc.smaller_angle(a, b))
    p, q = v[:, :3], v[:, 3:]
    cos = (p * q).sum(1) / np.linalg.norm(p, axis=1) / np.linalg.norm(q, axis=1)
    assert np.allclose(got, np.column_stack([(p * q).sum(1), np.cross(p, q), np.linalg.norm(p - q, axis=1), np.arccos(cos)]))


def test_perpendicular_and_slerp(pairs):
    _, df = pairs
    a = vc.normalize(vc.vector(*A))
    b = vc.normalize(vc.vector(*B))
    got = take(df, vc.dot(vc.perpendicular(a), a), vc.length(vc.perpendicular(a)), vc.length(vc.slerp(a, b, 0.3)))
    assert np.allclose(got, [[0, 1, 1]] * len(got))


def test_zero_vector_has_no_direction(spark):
    row = spark.range(1).select(*[x.alias(k) for k, x in zip("xyz", vc.normalize((F.lit(0.0), F.lit(0.0), F.lit(0.0))), strict=True)]).first()
    assert list(row) == [None, None, None]


def test_inverse_and_rotation(pairs):
    v, df = pairs
    m = mx.product(mx.rotation((0.0, 0.6, 0.8), 0.7), mx.translation(1.0, 2.0, 3.0))
    back = mx.transform(mx.transform(vc.vector(*A), m), mx.inverse(m))
    assert np.allclose(take(df, *back), v[:, :3])
    q = mx.to_quaternion(mx.rotation((0.0, 0.6, 0.8), 0.7))
    assert np.allclose(take(df.limit(1), *q), [[0, 0.6 * math.sin(0.35), 0.8 * math.sin(0.35), math.cos(0.35)]])


def test_closest_point_on_triangle(pairs):
    v, df = pairs
    corners = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    got = take(df, *vc.nearest_on_triangle(vc.vector(*A), *[tuple(map(F.lit, c)) for c in corners]))
    t = np.linspace(0, 1, 201)
    grid = np.array([(x, y, 0) for x in t for y in t if x + y <= 1 + 1e-12])
    best = np.linalg.norm(v[:, None, :3] - grid[None], axis=2).min(axis=1)
    assert np.allclose(np.linalg.norm(v[:, :3] - got, axis=1), best, atol=6e-3)
    assert (np.linalg.norm(v[:, :3] - got, axis=1) <= best + 1e-12).all()


def test_planes_lines_circles(pairs):
    _, df = pairs
    one = df.limit(1)
    point = vc.planes_point((1.0, 0.0, 0.0), F.lit(1.0), (0.0, 1.0, 0.0), F.lit(2.0), (F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(3.0))
    assert np.allclose(take(one, *point), [[1, 2, 3]])
    gap, first, second = vc.skew_lines((F.lit(0.0), F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(2.0)), (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert np.allclose(take(one, gap, *first, *second), [[2, 0, 0, 0, 0, 0, 2]])
    p, q = vc.circles_meeting((F.lit(0.0), F.lit(0.0)), F.lit(5.0), (F.lit(6.0), F.lit(0.0)), F.lit(5.0))
    assert np.allclose(take(one, *p, *q), [[3, 4, 3, -4]])
    hit = vc.triangle_hit((F.lit(0.2), F.lit(0.2), F.lit(-1.0)), (F.lit(0.0), F.lit(0.0), F.lit(2.0)), *[tuple(map(F.lit, c)) for c in [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]])
    assert np.allclose(take(one, hit), [[0.5]])


def test_line_hits_lie_on_surfaces(pairs):
    _, df = pairs
    start, way = tuple(F.col(c) * 0.2 for c in A), vc.vector(*B)
    for field, hits in (
        (lambda p: sf.sphere(p, (0.0, 0.0, 0.0), 2.0), sf.line_sphere(start, way, (0.0, 0.0, 0.0), 2.0)),
        (lambda p: sf.cylinder(p, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), 2.0), sf.line_cylinder(start, way, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), 2.0)),
        (lambda p: sf.cone(p, (0.0, 0.0, -9.0), (0.0, 0.0, 1.0), 0.5), sf.line_cone(start, way, (0.0, 0.0, -9.0), (0.0, 0.0, 1.0), 0.5)),
    ):
        for t in hits:
            got = take(df.where(t.isNotNull()), field(vc.plus(start, vc.scale(way, t))))
            assert len(got) and np.allclose(got, 0, atol=1e-6)


def test_capsule_is_the_hull_of_two_spheres(pairs):
    v, df = pairs
    a, b, ra, rb = np.array([0.0, 0, 1]), np.array([0.0, 0, 4]), 1.0, 0.5
    t = np.linspace(0, 1, 4001)
    spine = a + t[:, None] * (b - a)
    points = v[:, :3] * 2
    wanted = (np.linalg.norm(points[:, None] - spine[None], axis=2) - (ra + (rb - ra) * t)).min(axis=1)
    got = take(df, sf.capsule(vc.scale(vc.vector(*A), 2.0), tuple(a), ra, tuple(b), rb))[:, 0]
    assert np.allclose(got, wanted, atol=1e-4)
