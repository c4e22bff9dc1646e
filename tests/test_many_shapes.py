"""Kernels on many shapes at once: the results of one by one, at a bounded number of calls a shape."""

import math
import sys

import numpy as np
import pytest

from geoloom.operators import kernels as kn
from geoloom.operators import solids
from geoloom.plans.bindings import CUBE, CUBE_FACES
from geoloom.plans.catalog import queries

SQUARE = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
ELL = np.array([[0.0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]])


def calls(work) -> int:
    """Calls of functions, Python's and others', that ``work`` makes."""
    count = 0

    def note(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(note)
    try:
        work()
    finally:
        sys.setprofile(None)
    return count


def kernel_calls(monkeypatch, module, name: str, rows: str, shapes: list[np.ndarray]) -> float:
    """Calls a shape of a query's kernel, whether it takes shapes one by one or many."""
    taken = {}

    def keep(*args, many=False, **more):
        taken["kernel"], taken["many"] = args[2] if rows != "per_ring" else args[1], many
        raise StopIteration

    owner = module.rings if rows == "per_ring" else module.kn if rows == "per_arrays" else module
    if rows == "per_arrays":
        monkeypatch.setattr(owner, rows, lambda t, g, c, s, kernel, order=None, many=False: keep(None, None, kernel, many=many))
        monkeypatch.setattr(module, "_part_rows", lambda *a: None, raising=False)
    else:
        monkeypatch.setattr(owner, rows, keep)
    for view in ("table", "ngons", "cuboids"):
        monkeypatch.setattr(module.bd, view, lambda *a: None)
    with pytest.raises(StopIteration):
        getattr(module, name)(None, None)
    kernel = taken["kernel"]
    return calls(lambda: kernel(shapes) if taken["many"] else [kernel(s) for s in shapes]) / len(shapes)


def area(rings):
    return sum(kn.area2d(r) for r in rings)


def test_many_are_as_one_by_one():
    rng = np.random.default_rng(5)
    rings, others = [], []
    for n in (3, 4, 5, 6, 7, 8):
        angle = np.sort(rng.uniform(0, 2 * math.pi, n))
        rings.append(np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(0.4, 2, n)[:, None])
        others.append(ELL * rng.uniform(0.2, 0.6))
    for joins in ("miter", "square", "round"):
        for size in (0.2, -0.1):
            assert [area(r) for r in kn.offset_many(rings, size, joins)] == pytest.approx([area(kn.offset(r, size, joins)) for r in rings], abs=1e-7)
    many = list(zip(rings, others, strict=True))
    assert [area(r) for r in kn.minkowski_many(many)] == pytest.approx([area(kn.minkowski(*p)) for p in many], abs=1e-7)
    ways = [(CUBE * np.array([1, 2, 3.0]), np.array(CUBE_FACES), np.array(w)) for w in ([0.0, 0, 1], [1.0, 1, 0], [1.0, 2, 3])]
    assert [area(r) for r in solids.silhouettes(ways)] == pytest.approx([area(solids.silhouette(*w)) for w in ways])
    assert kn.arrange_many([[], [[SQUARE]], []], lambda m: m[0])[::2] == [[], []]


def test_portions_change_nothing(monkeypatch):
    whole = [area(r) for r in kn.offset_many([SQUARE, ELL], 0.2, "round")]
    monkeypatch.setattr(kn, "PAIRS", 50)
    assert [area(r) for r in kn.offset_many([SQUARE, ELL], 0.2, "round")] == pytest.approx(whole, abs=1e-9)


def test_round_offsets_cover_what_is_near():
    rng = np.random.default_rng(11)
    for n in (3, 5, 6, 8, 8, 9):
        angle = np.sort(rng.uniform(0, 2 * math.pi, n))
        ring = np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(0.4, 2, n)[:, None]
        grid = np.stack(np.meshgrid(*[np.linspace(-2.3, 2.3, 300)] * 2), axis=-1).reshape(-1, 2)
        near = (kn.edge_distances(ring, grid) <= 0.1) | kn.inside([ring], grid)
        assert area(kn.offset(ring, 0.1)) == pytest.approx(near.mean() * 4.6**2, abs=0.03)


@pytest.mark.parametrize(("name", "limit"), [("minkowski_of_ells", 500), ("polygon_offset_square_round", 1500)])
def test_calls_of_part_shapes(monkeypatch, name, limit):
    from geoloom.plans import shapes

    assert name in queries()
    assert kernel_calls(monkeypatch, shapes, name, "per_arrays", [np.array([[k, 7.0 + k % 9]]) for k in range(100)]) < limit


def test_calls_of_silhouettes(monkeypatch):
    from geoloom.plans import shapes

    cuboids = [CUBE * np.array([1.0 + k % 7, 2, 3]) for k in range(100)]
    monkeypatch.setattr(shapes, "mesh_vertices", lambda soup: None)
    assert kernel_calls(monkeypatch, shapes, "mesh_silhouette_area", "per_arrays", cuboids) < 1000


def test_poisson_points_and_inner_circles_of_many_rings(monkeypatch):
    from geoloom.plans import repairs, shapes

    rings = [np.column_stack([k + r * np.cos(a), r * np.sin(a)]) for k in range(100) for n, r in [(3 + k % 6, 0.2 + k % 5)] for a in [2 * math.pi * np.arange(n) / n]]
    some = [*rings[:4], ELL]
    points = kn.poisson_points_many(some, [0.11, 0.3, 0.7, 1.0, 0.2], seed=3)
    for ring, gap, q in zip(some, (0.11, 0.3, 0.7, 1.0, 0.2), points, strict=True):
        assert (q == kn.poisson_points(ring, gap, seed=3)).all() and kn.inside([ring], q).all() and len(q) > 3
        assert (np.linalg.norm(q[:, None] - q[None], axis=2) + np.eye(len(q)) * 9).min() >= gap
    assert len(points[4]) > 40
    for (centre, radius), ring in zip(kn.inner_circles(some), some, strict=True):
        assert (alone := kn.inner_circle(ring))[1] == radius and (alone[0] == centre).all()
        assert kn.edge_distances(ring, centre[None])[0] == pytest.approx(radius)
    assert kn.inner_circles(some)[4][1] == pytest.approx(2 - math.sqrt(2), abs=1e-3)
    assert kernel_calls(monkeypatch, shapes, "polygon_poisson_points", "per_ring", rings) < 600
    assert kernel_calls(monkeypatch, repairs, "max_inner_circle", "per_ring", rings) < 200


def test_few_axes_of_a_cylinder_are_tried(monkeypatch):
    rng, tried, ball = np.random.default_rng(2), [], kn.least_ball
    monkeypatch.setattr(kn, "least_ball", lambda p: tried.append(1) or ball(p))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    for a, b, c in ((1, 2, 3), (5, 1, 2), (2, 2, 7)):
        size = kn.least_cylinder(np.array(CUBE) * [a, b, c] @ turn)[0]
        assert size == pytest.approx(math.pi / 4 * min(a * (b * b + c * c), b * (a * a + c * c), c * (a * a + b * b)))
    assert len(tried) < 15
    cloud = rng.normal(size=(60, 3))
    size, axis = kn.least_cylinder(cloud)
    u, v = kn._frame(axis)
    assert size == pytest.approx(math.pi * ball(np.stack([cloud @ u, cloud @ v], axis=1))[1] ** 2 * np.ptp(cloud @ axis))


def test_a_box_is_tried_once_for_opposite_sides(monkeypatch):
    tried, rectangle = [], kn.least_rectangle
    monkeypatch.setattr(kn, "least_rectangle", lambda p: tried.append(1) or rectangle(p))
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(3, 3)))[0]
    assert kn.least_box(np.array(CUBE) * [1, 2, 3.5] @ turn) == pytest.approx(7) and len(tried) == 3


def test_calls_of_a_plane_cut():
    cube, faces, normal = np.array(CUBE) * [3.0, 2, 1], np.array(CUBE_FACES), np.array([1.0, 0, 0])
    low, high = solids.cut_solid(cube, faces, normal, 0.9)
    assert kn.mesh_volume(*low) == pytest.approx(1.8) and kn.mesh_volume(*high) == pytest.approx(4.2)
    assert calls(lambda: solids.cut_solid(cube, faces, normal, 0.9)) < 1400
