"""Roots and common points that are known beforehand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import polynomials as pl


def solved(spark, polynomials):
    width = max(map(len, polynomials))
    rows = [(i, *([0.0] * (width - len(p)) + [None if c is None else float(c) for c in p])) for i, p in enumerate(polynomials)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{i} double" for i in range(width)))
    out = pl.with_real_roots(frame, "roots", [F.col(f"c{i}") for i in range(width)])
    assert out.columns == [*frame.columns, "roots"]
    return {r.id: r.roots for r in out.collect()}


def test_known_roots(spark):
    rng = random.Random(4)
    wanted = [sorted(rng.sample(range(-50, 50), n)) for n in (1, 2, 3, 4) for _ in range(20)]
    wanted += [[r / 7 for r in w] for w in wanted[:40]]
    cases = [(np.poly(w), w) for w in wanted]
    cases += [(np.poly([w[0], w[0], *w[1:3]]), w[:3]) for w in wanted if len(w) == 4]  # a double root
    cases += [(np.poly([3, 3, 3]), [3]), (np.poly([2, 2, -5, -5]), [-5, 2]), (np.poly([1, 1, 1, 1]), [1]), ([1, 0, 1], []), ([1, 0, 2, 0, 1], []), ([1, 0, 0, 0, -16], [-2, 2]), ([4.0], []), ([1e-3, 0, -1e3], [-1000, 1000])]
    got = solved(spark, [p for p, _ in cases])
    for i, (_, roots) in enumerate(cases):
        assert got[i] == pytest.approx([float(r) for r in roots], rel=1e-4, abs=1e-4), i


def test_no_polynomial_has_null_roots(spark):
    got = solved(spark, [[0, 0, 0], [1, None, 2], [1, float("nan"), 2], [0, 0, 5], [0, 2, -1]])
    assert got == {0: None, 1: None, 2: None, 3: [], 4: [pytest.approx(0.5)]}


def test_degree_five_and_zero(spark):
    assert solved(spark, [np.poly([-2, -1, 0, 1, 2])])[0] == pytest.approx([-2, -1, 0, 1, 2], abs=1e-9)
    assert solved(spark, [[3.0]]) == {0: []} and solved(spark, [[0.0]]) == {0: None}


def circle(x, y, r):
    return [1, 0, 1, -2 * x, -2 * y, x * x + y * y - r * r]


def test_common_points_of_conics(spark):
    h = math.sqrt(0.5)
    cases = [
        (circle(0, 0, 1), circle(1, 0, 1), [(0.5, math.sqrt(0.75)), (0.5, -math.sqrt(0.75))]),
        (circle(0, 0, 1), circle(0, 1, 1), [(math.sqrt(0.75), 0.5), (-math.sqrt(0.75), 0.5)]),
        (circle(0, 0, 1), circle(2, 0, 1), [(1, 0)]),
        (circle(0, 0, 1), circle(5, 0, 1), []),
        ([0.25, 0, 1, 0, 0, -1], [1, 0, 0.25, 0, 0, -1], [(s * 2 / math.sqrt(5), t * 2 / math.sqrt(5)) for s in (1, -1) for t in (1, -1)]),
        (circle(0, 0, 1), [0, 0, 0, 1, -1, 0], [(h, h), (-h, -h)]),  # a line
        (circle(0, 0, 2), [0, 0, 0, 1, 0, -1], [(1, math.sqrt(3)), (1, -math.sqrt(3))]),  # an upright line
        ([1, 0, 0, 0, -1, 0], [0, 0, 1, -1, 0, 0], [(0, 0), (1, 1)]),  # two parabolas
        ([0, 1, 0, 0, 0, -1], [1, 0, -1, 0, 0, 0], [(1, 1), (-1, -1)]),  # a hyperbola and two lines
        (circle(0, 0, 1), circle(0, 0, 1), []),
    ]
    rows = [(i, *map(float, a + b)) for i, (a, b, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n}{i} double" for n in "ab" for i in range(6)))
    got = {}
    for r in pl.conic_meetings(frame, ["id"], *[[F.col(f"{n}{i}") for i in range(6)] for n in "ab"]).collect():
        got.setdefault(r.id, []).append((r.x, r.y))
    for i, (_, _, points) in enumerate(cases):
        found = got.get(i, [])
        assert len(found) == len(points) and all(min(math.dist(p, q) for q in found) < 1e-4 for p in points), (i, found)
