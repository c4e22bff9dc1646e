"""Small groups in numpy blocks: the same rows as the general forms on tables, without their joins."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import arrangement as ar
from geoloom.operators import blocks

SCHEMA = "g int, part int, x1 double, y1 double, x2 double, y2 double"


def segments(spark):
    rng, rows = np.random.default_rng(5), []
    for g in range(12):
        for part in range(2):
            # whole coordinates, so that ends touch, sides overlap and points come twice
            ring = rng.integers(0, 6, (4 + g % 4, 2)).astype(float).tolist()
            rows += [(g, part, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    rows.append((None, 0, 0.0, 0.0, 1.0, 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_groups_as_large_ones(spark, monkeypatch):
    def all_of():
        pieces = ar.windings(ar.arrange(segments(spark)))
        rings = ar.rings_of(ar.boundary(pieces, "xor", "even_odd"))
        return pieces, rings, {tuple(r) for r in pieces.collect()}, {tuple(r) for r in rings.collect()}

    pieces, rings, found, ordered = all_of()
    # before, each step joined tables of segments with each other
    assert "Join" not in plan(pieces) and "Join" not in plan(rings)
    monkeypatch.setattr(ar, "SEGMENTS", 0)
    monkeypatch.setattr(ar, "PIECES", 0)
    _, _, wanted, in_order = all_of()
    assert found == wanted and len(found) > 100
    assert ordered == in_order and len(ordered) > 50


def test_blocks_hold_whole_groups(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.lit("s")).alias("t"), "id")

    def work(columns, group):
        return np.unique(group), {"n": np.bincount(group), "total": np.bincount(group, columns["id"])}

    found = blocks.per_blocks(rows, ["k", "t"], "n long, total double", work, size=10)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.groupBy("k", "t").agg(F.count("*").alias("n"), F.sum("id").cast("double").alias("total")).collect()))


def test_scan_lines_are_cut_in_blocks(spark, data):
    from geoloom.operators import voxels
    from geoloom.plans import topology

    runs = voxels.mesh_runs(topology.turned_cuboids(spark, data), 0.05)
    # before, each crossing of a line was a row that Spark sorted in a window
    assert "Window" not in plan(runs)
    # more lines a layer than a block holds
    lines = runs.where("mesh < 7").groupBy("mesh", "k").agg(F.max("j").alias("high"), F.min("j").alias("low"))
    assert lines.where(F.col("high") - F.col("low") > voxels.LINES).count() > 0
    volume = runs.where("mesh < 7").groupBy("mesh").agg((F.sum(F.col("last") - F.col("first")) * 0.05**3).alias("v"))
    true = {r.p_partkey: (r.p_size / 10 + 1) * (r.p_partkey % 7 + 1) * (r.p_partkey % 3 + 1) for r in spark.read.parquet(f"{data}/part.parquet").where("p_partkey < 7").collect()}
    got = {r.mesh: r.v for r in volume.collect()}
    assert got.keys() == true.keys() and all(abs(got[k] - true[k]) < 0.01 * true[k] for k in true)


def test_nearest_sides_meet_on_grids(spark, monkeypatch):
    from geoloom.operators import primitives

    rng = np.random.default_rng(3)
    ends = rng.uniform(0, 40, (300, 4))
    ends[:150, 2:] = ends[:150, :2] + rng.normal(0, 0.3, (150, 2))
    ends[5, 2:], ends[6, 2] = ends[5, :2], ends[6, 0]
    spots = np.concatenate([rng.uniform(0, 40, (200, 2)), [[500.0, -300.0], [0.0, 0.0]]])
    sides = spark.createDataFrame([(i % 2, *row) for i, row in enumerate(ends.tolist())], "ring int, x double, y double, x2 double, y2 double")
    points = spark.createDataFrame([(i % 2, i, *row) for i, row in enumerate(spots.tolist())] + [(0, 900, None, 1.0), (7, 901, 1.0, 1.0)], "ring int, id long, px double, py double")
    monkeypatch.setattr(primitives, "SIDES", 40)
    monkeypatch.setattr(primitives, "POINTS", 7)
    found = primitives.ring_distance(points, sides)
    got = {r.id: r.distance for r in found.collect()}
    assert got.keys() == {*range(len(spots)), 900} and got[900] is None
    for i, p in enumerate(spots):
        a, d = ends[i % 2::2, :2], (ends[:, 2:] - ends[:, :2])[i % 2::2]
        t = np.clip(((p - a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        assert abs(got[i] - np.hypot(*(p - a - t[:, None] * d).T).min()) < 1e-9
    # before, a point met every side of its ring in one join by ring
    assert "MapInArrow" in plan(found)
