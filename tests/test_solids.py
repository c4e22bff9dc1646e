import numpy as np
import pytest

from geoloom.operators import kernels as kn
from geoloom.operators import solids
from geoloom.plans import bindings

CUBE, FACES = np.array(bindings.CUBE, dtype=float), np.array(bindings.CUBE_FACES)
SQUARE = np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]])


def closed(faces):
    edges = {(int(f[i]), int(f[(i + 1) % 3])) for f in faces for i in range(3)}
    return len(edges) == 3 * len(faces) and all((b, a) in edges for a, b in edges)


@pytest.mark.parametrize(("other", "wanted"), [(SQUARE + 9, "separated"), (SQUARE, "equal"), (SQUARE / 4 + 1, "b_inside_a"), (SQUARE * 4 - 1, "a_inside_b"), (SQUARE + 1, "intersection"), (SQUARE + [4, 0], "separated")])
def test_interaction(other, wanted):
    assert solids.interaction([SQUARE], [other]) == wanted


def test_trees():
    rings = [SQUARE, SQUARE / 2 + 1, SQUARE / 4 + 1.5, SQUARE + 10]
    assert solids.polygon_tree(rings) == [-1, 0, 1, -1]
    trees = solids.shallow_trees(rings)
    assert [len(t) for t in trees] == [2, 1, 1] and kn.area2d(trees[0][0]) > 0 > kn.area2d(trees[0][1])


def test_cut_ring():
    assert kn.area2d(solids.cut_ring(SQUARE, np.array([1.0, 0]), 1.0)) == pytest.approx(4)
    assert len(solids.cut_ring(SQUARE, np.array([1.0, 0]), -1.0)) == 0


@pytest.mark.parametrize("n", [3, 4, 6, 7])
def test_symmetry(n):
    t = np.arange(n) * 2 * np.pi / n
    ring = np.stack([np.cos(t), np.sin(t)], axis=1)
    assert solids.rotational_symmetry(ring) == n and solids.flipped_symmetry(ring)
    assert solids.rotational_symmetry(ring * [1, 2] + [[0.1 * i, 0] for i in range(n)]) == 1
    assert not solids.flipped_symmetry(np.array([[0.0, 0], [4, 0], [5, 2], [1, 3.5], [-1, 3]]))


def test_fill_holes():
    for missing in ([0], [0, 1], [3, 7]):
        open_faces = np.delete(FACES, missing, axis=0)
        whole = solids.fill_holes(CUBE, open_faces)
        assert closed(whole) and len(whole) == 12 and kn.mesh_volume(CUBE, whole) == pytest.approx(1)
    assert solids.border_loops(FACES) == []


@pytest.mark.parametrize(("normal", "d", "below"), [([0.0, 0, 1], 0.3, 0.3), ([1.0, 1, 0], 1.0, 0.5), ([1.0, 1, 1], 1.0, 1 / 6), ([0.0, 0, 1], 2.0, 1.0)])
def test_cut_solid(normal, d, below):
    low, high = solids.cut_solid(CUBE, FACES, np.array(normal), d)
    assert kn.mesh_volume(*low) == pytest.approx(below) and kn.mesh_volume(*high) == pytest.approx(1 - below)
    assert closed(low[1]) and (closed(high[1]) or not len(high[1]))


def test_collapse_edges_keeps_a_closed_mesh():
    points = kn.sphere_points(400)
    faces = kn.hull3d(points)
    v, f = solids.collapse_edges(points, faces, 200)
    assert len(f) <= 200 and closed(f) and len(v) - len(f) * 3 // 2 + len(f) == 2
    assert kn.mesh_volume(v, f) > 0.8 * kn.mesh_volume(points, faces)
    assert len(solids.collapse_edges(points, faces, 10, longest=0.0)[1]) == len(faces)


def test_silhouette():
    assert sum(kn.area2d(r) for r in solids.silhouette(CUBE, FACES, np.array([0.0, 0, 1]))) == pytest.approx(1)
    assert sum(kn.area2d(r) for r in solids.silhouette(CUBE, FACES, np.array([1.0, 1, 0]))) == pytest.approx(np.sqrt(2))
    assert sum(kn.area2d(r) for r in solids.silhouette(CUBE, FACES, np.array([1.0, 1, 1]))) == pytest.approx(np.sqrt(3))
