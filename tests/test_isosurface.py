"""Isosurfaces put together from tiles of samples."""

from pyspark.sql import functions as F

from geoloom.operators import isosurface as iso
from geoloom.operators import mesh


def test_samples_are_dealt_by_tiles_and_surfaces_close_over_their_borders(spark):
    # a sphere over several tiles, some of them of negative numbers
    n = 2 * iso.TILE + 7
    samples = iso.sample_grid(spark, (-1.0, -1.0, -1.0), 2.0 / (n - 1), (n, n, n), lambda p: F.sqrt(p[0] ** 2 + p[1] ** 2 + p[2] ** 2) - 0.8)
    moved = samples.select((F.col("i") - 20).alias("i"), (F.col("j") - 5).alias("j"), "k", "x", "y", "z", "value").repartition(5)
    soup = iso.triangles(moved, 2.0 / (n - 1)).withColumn("mesh", F.lit(1)).withColumn("f", F.monotonically_increasing_id())
    plan = soup._jdf.queryExecution().executedPlan().toString()
    # before, a sample was sent to eight cubes and cubes were sorted for their corners
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    vertices, faces = mesh.weld(soup, 9)
    whole = mesh.integrity(mesh.clean_faces(faces)).first()
    assert (whole.open, whole.overused, whole.inconsistent, whole.euler) == (0, 0, 0, 2)
    volume = mesh.solid_measures(soup).first().volume
    assert abs(volume - 4 / 3 * 3.141592653589793 * 0.8**3) < 0.02


def test_cubes_that_are_not_whole_have_no_surface(spark):
    rows = [(i, j, k, float(i), float(j), float(k), k - 0.5) for i in range(3) for j in range(2) for k in range(2)]

    def found(rows):
        table = spark.createDataFrame(rows, "i long, j long, k long, x double, y double, z double, value double")
        return sorted({r.i for r in iso.triangles(table, 1.0).collect()})

    assert found(rows) == [0, 1]
    assert found(rows[:-1]) == [0]
    assert found(rows + rows[-1:]) == [0]
    assert found([*rows[:-1], (*rows[-1][:-1], None)]) == [0]
    assert found([]) == []
    flat = sorted((r.az, r.bz, r.cz) for r in iso.triangles(spark.createDataFrame(rows, "i long, j long, k long, x double, y double, z double, value double"), 1.0).collect())
    assert set(flat) == {(0.5, 0.5, 0.5)}


def test_of_faces_with_the_same_vertices_the_least_stays_as_it_runs(spark):
    rows = [(1, 7, 30, 10, 20), (1, 5, 20, 10, 30), (1, 6, 10, 20, 30), (1, 8, 10, 10, 20), (2, 9, 30, 20, 10), (2, 3, 10, None, 20)]
    got = mesh.clean_faces(spark.createDataFrame(rows, "mesh long, f long, a long, b long, c long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, 20, 10, 30), (2, 9, 30, 20, 10)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
