"""Mesh files cut into splits of any size against the whole files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.sources import formats, mesh_source

COLUMNS = [f"{c}{x}" for c in "abc" for x in "xyz"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    mesh_source.register(spark)
    rng = np.random.default_rng(3)
    root = tmp_path_factory.mktemp("meshes")
    (root / "deep").mkdir()
    for name, n, binary in (("one.stl", 57, True), ("deep/two.stl", 1, True), ("text.stl", 23, False), ("none.stl", 0, True)):
        soup = rng.integers(-50, 50, (n, 3, 3)) / 8
        flat = soup.reshape(-1, 3)
        (root / name).write_bytes(formats.write_stl(("name", flat, np.arange(3 * n).reshape(-1, 3)), binary))
    (root / "empty.stl").write_bytes(b"")
    return root


def rows(df):
    return sorted((tuple(r) for r in df.select(F.element_at(F.split("path", "/"), -1), *COLUMNS).collect()))


def test_splits_of_any_size_give_the_whole(spark, folder):
    whole = spark.read.format("stl").load(f"file://{folder}")
    wanted = rows(whole)
    assert len(wanted) == 57 + 1 + 23
    own = []
    for name, binary in (("one.stl", True), ("text.stl", False)):
        _, vertices, faces = formats.read_stl((folder / name).read_bytes())[0]
        own += [(name, *p) for p in vertices[faces].reshape(-1, 9).tolist()]
    assert [w for w in wanted if w[0] != "two.stl"] == sorted(own)
    for size in (50, 101, 173, 1000):
        part = spark.read.format("stl").option("splitBytes", size).load(f"file://{folder}")
        assert rows(part) == wanted
        assert part.rdd.getNumPartitions() > (57 * 50) // size
    numbers = [r.f for r in whole.where(F.col("path").endswith("one.stl")).collect()]
    assert sorted(numbers) == list(range(57))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_text_cut_at_every_byte(spark, folder, size):
    one = spark.read.format("stl").option("splitBytes", 10**9).load(f"file://{folder}/text.stl")
    reader = mesh_source.StlReader({"path": f"file://{folder}/text.stl", "splitBytes": size}, one.schema)
    found = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found)) == sorted(tuple(r[c] for c in COLUMNS) for r in one.collect())
    assert len({r["f"] for r in found}) == 23


def test_filters_and_columns_reach_the_reader(spark, folder):
    path = f"file://{folder}/one.stl"
    source = spark.read.format("stl").option("splitBytes", 500).schema("f long, az double, path string").load(f"file://{folder}")
    few = source.where((F.col("path") == path) & (F.col("f") >= 30) & (F.col("f") < 35))
    assert sorted(r.f for r in few.collect()) == [30, 31, 32, 33, 34]
    assert few.rdd.getNumPartitions() == 1 and source.columns == ["f", "az", "path"]
    wanted = {r.f: r.az for r in spark.read.format("stl").load(path).collect()}
    assert {r.f: r.az for r in source.where(F.col("path") == path).collect()} == wanted
    assert source.where(F.col("path") == "elsewhere").count() == 0


def test_damaged_files_are_errors(spark, folder, tmp_path):
    (tmp_path / "short.stl").write_bytes((folder / "one.stl").read_bytes()[:-7])
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("stl").load(f"file://{tmp_path}").count()
    (tmp_path / "short.stl").write_bytes(b"solid x\nfacet normal 0 0 1\nouter loop\nvertex 1 2\nendloop\nendfacet\nendsolid")
    with pytest.raises(Exception, match="numbers"):
        spark.read.format("stl").load(f"file://{tmp_path}").count()


def ply(vertices, faces):
    head = f"ply\nformat binary_little_endian 1.0\ncomment made here\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty uchar red\nproperty double z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<ffBd", x, y, 7, z) for x, y, z in vertices) + b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in faces)
    return head.encode() + body


def test_ply_tables_in_splits(spark, tmp_path):
    mesh_source.register(spark)
    rng = np.random.default_rng(1)
    vertices = (rng.integers(-99, 99, (40, 3)) / 4).tolist()
    triangles, mixed = rng.integers(0, 40, (31, 3)).tolist(), [[0, 1, 2], [3, 4, 5, 6], [7, 8, 9, 10, 11]]
    (tmp_path / "t.ply").write_bytes(ply(vertices, triangles))
    (tmp_path / "m.ply").write_bytes(ply(vertices[:12], mixed))
    read = spark.read.format("ply").option("splitBytes", 60)
    got = read.load(f"file://{tmp_path}/t.ply")
    assert sorted((r.v, r.x, r.y, r.z) for r in got.collect()) == [(i, *v) for i, v in enumerate(vertices)]
    assert got.rdd.getNumPartitions() > 5
    faces = read.option("table", "faces").load(f"file://{tmp_path}/t.ply")
    assert sorted((r.f, r.a, r.b, r.c) for r in faces.collect()) == [(i, *t) for i, t in enumerate(triangles)] and faces.rdd.getNumPartitions() > 2
    fans = read.option("table", "faces").load(f"file://{tmp_path}/m.ply")
    assert sorted((r.f, r.a, r.b, r.c) for r in fans.collect()) == [(0, 0, 1, 2), (1, 3, 4, 5), (2, 3, 5, 6), (3, 7, 8, 9), (4, 7, 9, 10), (5, 7, 10, 11)]


def test_a_soup_written_by_tasks_comes_back(spark, tmp_path):
    soup = spark.range(1000).select(*[((F.col("id") * (i + 3)) % 97 / 4).alias(c) for i, c in enumerate(COLUMNS)]).repartition(3)
    files = mesh_source.write_stl(soup, f"file://{tmp_path}/out", triangles=150)
    assert files >= 7
    (tmp_path / "out" / "left-over.stl").write_bytes(b"junk of a task that failed")
    back = spark.read.format("stl").load(f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in back.select(*COLUMNS).collect()) == sorted(tuple(r) for r in soup.collect())
    assert mesh_source.write_stl(soup.limit(0), f"file://{tmp_path}/nothing") == 0
    assert spark.read.format("stl").load(f"file://{tmp_path}/nothing").count() == 0
