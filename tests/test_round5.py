"""Findings of round 5: work that is done once, places that do not depend on the order of rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import mesh, primitives


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_welded_names_are_worked_out_once(spark):
    solids = spark.range(3).select(F.col("id").alias("mesh"), F.lit(2.0).alias("radius"), F.lit(1.0).alias("inner"), F.lit(3.0).alias("height"))
    faces = mesh.clean_faces(mesh.weld(primitives.hollow_cylinder(solids, 24), 6)[1])
    plan = plan_of(mesh.unpaired_edges(faces))
    assert plan.count("xxhash64(") == 3
    assert plan.lower().count("cos(") == 2
    rows = mesh.unpaired_edges(faces).collect()
    assert len(rows) == 3 and all(r["open"] == 0 and r["unpaired"] == 0 for r in rows)


def test_near_rounds_and_keeps_values_beyond_its_digits(spark):
    values = [0.1234564, -0.1234566, -0.0000001, 1e300, -3e15, float("inf"), float("nan"), None, 2.5e9 + 0.25]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(mesh.near(F.col("v"), 6)).collect()]
    assert got[:6] == [0.123456, -0.123457, 0.0, 1e300, -3e15, float("inf")] and math.copysign(1, got[2]) == 1
    assert math.isnan(got[6]) and got[7] is None and got[8] == 2.5e9 + 0.25


def test_unpaired_edges_agree_with_integrity(spark):
    rows = [(1, 1, 1, 2, 3), (1, 2, 2, 1, 4), (1, 3, 1, 2, 5), (2, 1, 1, 2, 3), (2, 2, 1, 2, 4)]
    faces = spark.createDataFrame(rows, "mesh long, f long, a long, b long, c long")
    want = {r["mesh"]: (r["open"], r["edges"] - r["manifold"]) for r in mesh.integrity(faces).collect()}
    assert {r["mesh"]: (r["open"], r["unpaired"]) for r in mesh.unpaired_edges(faces).collect()} == want


def test_many_splits_are_read_by_fewer_tasks_and_whole(spark, tmp_path):
    from geoloom.sources import mesh_source

    splits = [mesh_source.Split(p, "binary", 400 * i, 400 * (i + 1), 84) for p, n in (("a", 30_000), ("b", 1), ("c", 5_000)) for i in range(n)]
    found = mesh_source.joined(splits)
    assert len(found) <= 2 * mesh_source.SPLITS and {p: sum(s.path == p for s in found) > 1 for p in "abc"} == {"a": True, "b": False, "c": True}
    for p in "abc":
        own = [s for s in found if s.path == p]
        assert own[0].first == 0 and own[-1].last == max(s.last for s in splits if s.path == p) and all(s.last == t.first for s, t in zip(own, own[1:]))
    two = [mesh_source.Split(str(i // 2), "text", i % 2, i % 2 + 1) for i in range(4_000)]
    assert len(mesh_source.joined(two)) == 4_000
    # a file of 2,000 splits, as rows
    mesh_source.register(spark)
    soup = spark.range(2_000).select(*[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(mesh_source.CORNERS)])
    folder = f"file://{tmp_path}/stl"
    mesh_source.write_stl(soup.coalesce(1), folder)
    back = spark.read.format("stl").option("splitBytes", 50).load(folder)
    assert back.rdd.getNumPartitions() <= mesh_source.SPLITS
    assert sorted(r["f"] for r in back.select("f").collect()) == list(range(2_000))


def test_areas_of_many_booleans_are_those_of_their_rings():
    from geoloom.operators import kernels as kn

    rng = np.random.default_rng(3)
    star = lambda n, at: [np.stack([np.cos(a), np.sin(a)], axis=1) * rng.uniform(0.5, 2, (n, 1)) + at for a in [np.sort(rng.uniform(0, 2 * np.pi, n))]]
    pairs = [(star(7, 0), star(5, rng.uniform(-1, 1, 2))) for _ in range(40)] + [([], star(5, 0)), (star(5, 0), []), ([], [])]
    pairs += [([r + 1e5 for r in a], [r + 1e5 for r in b]) for a, b in pairs[:3]]
    operations = tuple(kn.OPERATIONS)
    got = kn.booleans_of_area(pairs, operations)
    want = [[sum(kn.area2d(r) for r in kn.boolean(a, b, o)) if a and b else None for o in operations] for a, b in pairs]
    for g, w in zip(got, want, strict=True):
        if w[0] is not None:
            assert np.allclose(g, w, atol=1e-5)
    assert got[40][0] > 0 and got[40][1] == 0 and got[41][2] > 0 and not got[42].any()


def test_each_pair_is_arranged_once(monkeypatch):
    from geoloom.operators import kernels as kn
    from geoloom.operators import solids

    calls, plain = [], kn._borders
    monkeypatch.setattr(kn, "_borders", lambda many, *rest: calls.append(len(many)) or plain(many, *rest))
    one = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
    kn.booleans_of_area([([one], [one + 1])] * 50, ("union", "intersect", "subtract", "xor"))
    assert calls == [50]
    pairs = [([one], [x]) for x in (one, one + 1, one * 0.5 + 0.1, one * 2 - 0.5, one + 9)]
    assert solids.interactions(pairs) == ["equal", "intersection", "b_inside_a", "a_inside_b", "separated"]
    assert calls == [50, 10, 5]


def test_equal_segments_are_tried_once(spark):
    from geoloom.operators import joins

    lines = [(7 * i + 1, 0.0, 0.0, 4.0, 4.0) for i in range(40)] + [(7 * i + 2, 0.0, 4.0, 4.0, 0.0) for i in range(40)] + [(1000, 2.0, 90.0, 2.5, 95.0), (1001, 4.0, 4.0, 9.0, 4.0)]
    found = joins.segment_meetings(spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double"), 8.0)
    rows = [tuple(r) for r in found.select("a", "b", "t", "u").collect()]
    first, second = ([i for i, _, y, *_ in lines[:80] if y == at] for at in (0, 4))
    want = {(min(p, q), max(p, q), 0.5, 0.5) for p in first for q in second} | {(p, 1001, 1.0, 0.0) for p in first}
    assert len(rows) == len(want) and set(rows) == want
    # pairs meet in cells of both axes
    assert any("_x#" in line and "_y#" in line for line in plan_of(found).splitlines() if "Join Inner" in line)


def test_parts_of_a_cut_share_one_middle(spark):
    from geoloom.operators import cuts
    from geoloom.plans.bindings import CUBE, CUBE_FACES

    # a cuboid whose outline has a mean that lies between two values of nine digits, so that it depends on the order
    rows = [(m, n, *[at + side * CUBE[v][i] for v in face for i, (at, side) in enumerate(((0.0, 2.3), (5.0, 1.0), (5.0, 2.0)))]) for m in range(4) for n, face in enumerate(CUBE_FACES)]
    soup = spark.createDataFrame(rows, "mesh long, f long, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))
    normal = (-0.06, -0.04, 1.0)
    distance = (1.15 * -0.06 + 5.5 * -0.04 + 5.9) / math.sqrt(1.0052)
    outlines = cuts.contact_loops(soup, normal, distance)
    parts = cuts.split(soup, normal, distance, loops=outlines)
    assert "avg(" not in plan_of(parts)
    assert "avg(" not in plan_of(cuts.split(soup, normal, distance))
    below_and_above = parts.withColumn("mesh", F.col("mesh") * 2 + F.col("above").cast("long"))
    vertices, faces = mesh.weld(below_and_above, 7)
    assert mesh.with_corners(faces, vertices).count() == faces.count() == 4 * 44
    assert all(r["open"] == 0 and r["unpaired"] == 0 for r in mesh.unpaired_edges(faces).collect())
    sums = {r["m"]: r["v"] for r in mesh.solid_measures(below_and_above).groupBy(F.floor(F.col("mesh") / 2).alias("m")).agg(F.sum("volume").alias("v")).collect()}
    assert all(abs(v - 4.6) < 1e-6 for v in sums.values()) and len(sums) == 4
