import numpy as np
from pyspark.sql import functions as F

from geoloom.functions.storage import materialise
from geoloom.operators import assembly, joins, mesh, statistics, voxels
from geoloom.operators.graph import connected_components
from geoloom.streaming import bounds


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, materialise).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), materialise).count() == 0


def test_nearest_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, size=(300, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    got = {}
    for r in joins.nearest_join(df, df.where("id < 20").withColumnRenamed("id", "query"), 5, 1.0).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    for q in range(20):
        wanted = np.argsort(np.linalg.norm(p - p[q], axis=1), kind="stable")[:5].tolist()
        assert [got[q][i] for i in range(1, 6)] == wanted


def test_inside_out_mesh_has_negative_volume(spark, data):
    from geoloom.plans import bindings

    soup = bindings.cuboids(spark, data)
    v, f = mesh.weld(soup, 6)
    turned = mesh.solid_measures(mesh.with_corners(mesh.inside_out(f), v))
    assert turned.where("volume >= 0").count() == 0
    assert mesh.integrity(f).where("euler <> 2 or open > 0 or inconsistent > 0").count() == 0


def test_fits(spark):
    rng = np.random.default_rng(4)
    n = rng.normal(size=(60, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    df = spark.createDataFrame([("s", *map(float, 2 * r + [1, 2, 3])) for r in n], "g string, x double, y double, z double")
    s = statistics.sphere_fit(df, "g").first()
    assert np.allclose([s.cx, s.cy, s.cz, s.radius], [1, 2, 3, 2])
    flat = df.withColumn("z", F.col("x") * 2 - F.col("y") + 5)
    p = statistics.plane_fit(flat, "g").first()
    assert np.allclose(np.array([p.nx, p.ny, p.nz]) * np.sqrt(6) * np.sign(p.nz), [-2, 1, 1]) and p.d >= 0 and p.mse < 1e-12
    q = statistics.quadric_fit(df, "g").first().coefficients
    assert np.allclose(np.array(q)[:3] / q[0], 1) and np.allclose(np.array(q)[3:6], 0, atol=1e-8)


def test_voxel_fill_of_a_sphere(spark):
    rows = [(j, k, float(s * np.sqrt(900 - (j + 0.5) ** 2 - (k + 0.5) ** 2))) for j in range(-30, 30) for k in range(-30, 30) if (j + 0.5) ** 2 + (k + 0.5) ** 2 < 900 for s in (-1, 1)]
    cells = voxels.fill_from_hits(spark.createDataFrame(rows, "j long, k long, x double"), 1.0)
    assert abs(cells.count() / (4 / 3 * np.pi * 27000) - 1) < 0.01


def test_lines_and_grids(spark):
    line = spark.createDataFrame([(1, 0.5, 0.5, 5.5, 2.5)], "id long, x1 double, y1 double, x2 double, y2 double")
    assert voxels.line_cells(line, 1.0).count() == 6
    assert [r[0] for r in spark.range(1).select(voxels.grid_index(F.lit(2), F.lit(3), 5, 7)).union(spark.range(1).select(voxels.grid_index(F.lit(9), F.lit(3), 5, 7))).collect()] == [17, -1]


def test_a_cycle_in_an_assembly_is_no_endless_loop(spark):
    tree = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "d", 1), ("d", "c", 1)], "node string, parent string, step long")
    assert {r.node for r in assembly.flatten(tree).collect()} == {"a", "b"}


def test_stream_of_points(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 3.0, 5.0), ("b", 70, 0.0, 0.0)], "g string, s long, x double, y double").select("g", F.timestamp_seconds("s").alias("t"), "x", "y").write.parquet(folder)
    stream = spark.readStream.schema("g string, t timestamp, x double, y double").parquet(folder)
    run = bounds.windowed_bounds(stream, "t", "g").writeStream.outputMode("complete").format("memory").queryName("bounds").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {r.g: (r.n, r.max_x, r.max_y) for r in spark.table("bounds").collect()}
    assert got == {"a": (2, 3.0, 5.0), "b": (1, 0.0, 0.0)}


def test_isosurface_of_a_sphere(spark):
    from geoloom.functions import surfaces as sf
    from geoloom.operators import isosurface

    samples = isosurface.sample_grid(spark, (-1.3, -1.3, -1.3), 0.1, (27, 27, 27), lambda p: sf.sphere(p, (0.01, 0.02, 0.03), 1.0))
    m = mesh.solid_measures(isosurface.triangles(samples, 0.1).withColumn("mesh", F.lit(1))).first()
    assert abs(m.volume / (4 / 3 * np.pi) - 1) < 0.02 and abs(m.area / (4 * np.pi) - 1) < 0.03
    assert np.allclose([m.cx, m.cy, m.cz], [0.01, 0.02, 0.03], atol=1e-2)
