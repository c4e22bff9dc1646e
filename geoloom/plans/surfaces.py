"""Queries of analytic surfaces, conics and boxes over the vectors of ``expressions``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.functions import boxes as bx
from geoloom.functions import polynomials
from geoloom.functions import surfaces as sf
from geoloom.functions import vector as vc
from geoloom.plans.registry import query, rounded
from geoloom.plans.expressions import BASE, A, B, base, given, named, sql



def ZERO() -> tuple:  # noqa: N802
    return tuple(map(F.lit, (0.0, 0.0, 0.0)))


def UP() -> tuple:  # noqa: N802
    return tuple(map(F.lit, (0.0, 0.0, 1.0)))


@query(sql("la - 2 AS sphere", "sqrt(ax * ax + ay * ay) - 2 AS cylinder", "0.6 * ax + 0.8 * az - 1 AS plane", "CASE WHEN az + 0.5 * sqrt(ax * ax + ay * ay) < 0 THEN la ELSE (sqrt(ax * ax + ay * ay) - 0.5 * az) / sqrt(1.25) END AS cone", "sqrt((sqrt(ax * ax + ay * ay) - 3) ** 2 + az * az) - 0.5 AS torus", "sqrt(greatest(sqrt(ax * ax + ay * ay) - 2, 0) ** 2 + greatest(-az, az - 1, 0) ** 2) + least(greatest(sqrt(ax * ax + ay * ay) - 2, -az, az - 1), 0) AS capped"))
def surface_distances(spark, d):
    return given(
        spark, d, sphere=sf.sphere(A(), ZERO(), 2.0), cylinder=sf.cylinder(A(), ZERO(), UP(), 2.0), plane=sf.plane(A(), (0.6, 0.0, 0.8), 1.0), cone=sf.cone(A(), ZERO(), UP(), 0.5),
        torus=sf.torus(A(), ZERO(), UP(), 3.0, 0.5), capped=sf.capped_cylinder(A(), ZERO(), UP(), 2.0, F.lit(1.0)),
    )


@query(sql("sqrt(ax * ax + ay * ay + CASE WHEN az < 0 THEN az * az WHEN az > 2 THEN (az - 2) ** 2 ELSE 0 END) - 0.7 AS even"))
def capsule_distance(spark, d):
    """A capsule of one radius along z from 0 to 2."""
    return given(spark, d, even=sf.capsule(A(), ZERO(), F.lit(0.7), tuple(map(F.lit, (0.0, 0.0, 2.0))), F.lit(0.7)))


@query(sql("ax * ax + 2 * ay * ay - az * az + ax - 3 AS value", "(ax * ax + 2 * ay * ay - az * az + ax - 3) / sqrt((2 * ax + 1) ** 2 + 16 * ay * ay + 4 * az * az) AS gap"))
def quadric_value_and_distance(spark, d):
    c = (1.0, 2.0, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -3.0)
    return given(spark, d, value=sf.quadric(A(), c), gap=sf.quadric_distance(A(), c))


@query(sql("-ax - sqrt(q) AS first", "-ax + sqrt(q) AS second", source="(SELECT *, 16 - ay * ay AS q FROM unit)", where="WHERE ay * ay <= 16"))
def cylinder_line_hits(spark, d):
    """Lines along x through a and the cylinder of radius 4 about z."""
    t = sf.line_cylinder(A(), tuple(map(F.lit, (1.0, 0.0, 0.0))), ZERO(), UP(), 4.0)
    return given(spark, d, first=t[0], second=t[1]).where("first IS NOT NULL")


@query(f"WITH {BASE} SELECT id, CASE WHEN az > 0 AND az * az * 4 >= ay * ay THEN round(-ax - sqrt(az * az * 4 - ay * ay), 5) + 0.0 END AS first, CASE WHEN az > 0 AND az * az * 4 >= ay * ay THEN round(-ax + sqrt(az * az * 4 - ay * ay), 5) + 0.0 END AS second FROM unit")
def cone_line_hits(spark, d):
    """Lines along x and the upward cone whose radius is twice its height."""
    t = sf.line_cone(A(), tuple(map(F.lit, (1.0, 0.0, 0.0))), ZERO(), UP(), 2.0)
    return given(spark, d, first=t[0], second=t[1])


@query(sql("(-1 - 2 * ax - sqrt(q)) / 2 AS first", "(-1 - 2 * ax + sqrt(q)) / 2 AS second", source="(SELECT *, 1 - 4 * (2 * ay * ay - az * az - 3) AS q FROM unit)", where="WHERE q >= 0"))
def quadric_line_hits(spark, d):
    t = sf.line_quadric(A(), tuple(map(F.lit, (1.0, 0.0, 0.0))), (1.0, 2.0, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -3.0))
    return given(spark, d, first=t[0], second=t[1]).where("first IS NOT NULL")


@query(sql("greatest(-ax - sqrt(q), -1e9) AS enter", "-ax + sqrt(q) AS leave", source="(SELECT *, 16 - ay * ay AS q FROM unit)", where="WHERE ay * ay <= 16 AND az BETWEEN 0 AND 2"))
def capped_cylinder_line_hits(spark, d):
    t = sf.line_capped_cylinder(A(), tuple(map(F.lit, (1.0, 0.0, 0.0))), ZERO(), UP(), 4.0, F.lit(2.0))
    return given(spark, d, enter=t[0], leave=t[1]).where("enter IS NOT NULL")


@query(sql("-ax - sqrt(q) AS enter", "-ax + sqrt(q) AS leave", source="(SELECT *, 16 - ay * ay - CASE WHEN az < 0 THEN az * az WHEN az > 2 THEN (az - 2) ** 2 ELSE 0 END AS q FROM unit)", where="WHERE q >= 0"))
def capsule_line_hits(spark, d):
    t = sf.capsule_hits(A(), tuple(map(F.lit, (1.0, 0.0, 0.0))), ZERO(), tuple(map(F.lit, (0.0, 0.0, 2.0))), 4.0)
    return given(spark, d, enter=t[0], leave=t[1]).where("enter IS NOT NULL")


@query(sql("-sqrt((3 + sqrt(1 - h * h)) ** 2 - y * y) AS r1", "-sqrt((3 - sqrt(1 - h * h)) ** 2 - y * y) AS r2", "sqrt((3 - sqrt(1 - h * h)) ** 2 - y * y) AS r3", "sqrt((3 + sqrt(1 - h * h)) ** 2 - y * y) AS r4", source="(SELECT id, az / 3 AS h, ay / 3 AS y FROM unit)", where="WHERE abs(h) < 0.99 AND y < (3 - sqrt(1 - h * h)) * 0.99"))
def torus_line_hits(spark, d):
    """Lines along x at heights within a torus: four roots of the quartic, paired by the circles at that height."""
    start = (F.lit(0.0), A()[1] / 3, A()[2] / 3)
    c = sf.line_torus_quartic(start, tuple(map(F.lit, (1.0, 0.0, 0.0))), ZERO(), UP(), 3.0, 1.0)
    t = polynomials.with_real_roots(base(spark, d).where((F.abs(A()[2] / 3) < 0.99) & (A()[1] / 3 < (3 - F.sqrt(F.greatest(1 - A()[2] * A()[2] / 9, F.lit(0.0)))) * 0.99)), "r", list(c))
    return rounded(t.select("id", *[F.get("r", F.lit(i)).alias(f"r{i + 1}") for i in range(4)]), 5)


@query(sql("2 * ax / la AS sx", "2 * ax / r AS cx", "az AS cz", "3 * ay / r AS ry", "3 * ax / r + 0.5 * (ax - 3 * ax / r) / m AS tx", "0.5 * az / m AS tz", source="(SELECT *, sqrt((r - 3) ** 2 + az * az) AS m FROM (SELECT *, sqrt(ax * ax + ay * ay) AS r FROM unit))"))
def surface_nearest_points(spark, d):
    """Feet on a sphere, a cylinder, the ring of a torus and the torus."""
    s, c = sf.nearest_on_sphere(A(), ZERO(), 2.0), sf.nearest_on_cylinder(A(), ZERO(), UP(), 2.0)
    r, t = sf.nearest_on_ring(A(), ZERO(), UP(), 3.0), sf.nearest_on_torus(A(), ZERO(), UP(), 3.0, 0.5)
    return given(spark, d, sx=s[0], cx=c[0], cz=c[2], ry=r[1], tx=t[0], tz=t[2])


@query(sql("2 * atan2(ay, ax) AS arc", "az AS height", "2 * ax / sqrt(ax * ax + ay * ay) AS x", "2 * ay / sqrt(ax * ax + ay * ay) AS y"))
def cylinder_unroll_and_back(spark, d):
    zero = tuple(map(F.lit, (1.0, 0.0, 0.0)))
    arc, height = sf.unroll_cylinder(A(), ZERO(), UP(), zero, 2.0)
    p = sf.roll_cylinder(arc, height, ZERO(), UP(), zero, 2.0)
    return given(spark, d, arc=arc, height=height, x=p[0], y=p[1])


@query(f"WITH {BASE} SELECT id, CASE k % 7 WHEN 0 THEN 'sphere' WHEN 1 THEN 'ellipsoid' WHEN 2 THEN 'cone' WHEN 3 THEN 'hyperboloid' WHEN 4 THEN 'paraboloid' WHEN 5 THEN 'cylinder' ELSE 'other' END AS kind FROM unit")
def quadric_kinds(spark, d):
    """Quadrics made as one of seven kinds about shifted centres."""
    k = F.col("k") % 7
    xx, yy = F.lit(1.0), F.when(k == 0, 1.0).when(k == 6, 0.0).otherwise(2.0)
    zz = F.when(k == 0, 1.0).when(k == 1, 3.0).when(k.isin(2, 3), -1.5).otherwise(0.0)
    x, y, z = -2 * xx * A()[0], -2 * yy * A()[1], F.when(k == 4, 1.0).otherwise(-2 * zz * A()[2])
    rest = xx * A()[0] ** 2 + yy * A()[1] ** 2 + zz * A()[2] ** 2 - F.when(k == 2, 0.0).otherwise(1.0)
    zero = F.lit(0.0)
    return given(spark, d, kind=sf.quadric_kind((xx, yy, zz, zero, zero, zero, x, y, z, rest)))


@query(f"WITH {BASE} SELECT a.id, true AS same FROM unit a")
def line_unique_key(spark, d):
    """The key of a line is that of the same line from another point and with the other sense."""
    one = sf.line_key(A(), B())
    other = sf.line_key(vc.plus(A(), vc.scale(B(), 2.5)), vc.scale(B(), -0.7))
    same = F.lit(True)
    for x, y in zip(one, other, strict=True):
        same = same & (F.abs(x - y) < 1e-6)
    return given(spark, d, same=same)


@query(sql("abs(ax * ax + 4 * ay * ay - 9) / sqrt(4 * ax * ax + 64 * ay * ay) AS gap", "(-2 * ax - 8 * ay - sqrt(q)) / 10 AS first", "(-2 * ax - 8 * ay + sqrt(q)) / 10 AS second", source="(SELECT *, (2 * ax + 8 * ay) ** 2 - 20 * (ax * ax + 4 * ay * ay - 9) AS q FROM unit)", where="WHERE q >= 0"))
def conic_distance_and_line(spark, d):
    """The ellipse x^2 + 4 y^2 = 9 as the cut of an ellipsoid at height 4, and lines along (1, 1)."""
    c = sf.conic_of_quadric((1.0, 4.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -25.0), 4.0)
    t = sf.line_conic(A()[:2], (1.0, 1.0), c)
    return given(spark, d, gap=sf.conic_distance(A()[:2], c), first=t[0], second=t[1]).where("first IS NOT NULL")


BOXES = '(SELECT id, ax AS x1, ay AS y1, ax + 2 AS x2, ay + "by" AS y2, bx + 3 AS u1, 1.1 AS v1, bx + 3 + ay AS u2, 1.1 + "by" AS v2 FROM unit)'


@query(sql("greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS shared", "(x2 - x1) * (y2 - y1) - greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) AS rest", "(greatest(x2, u2) - least(x1, u1)) * (greatest(y2, v2) - least(y1, v1)) AS whole", "(x2 - x1 + 1) * (y2 - y1 + 1) AS grown", "(greatest(x2, 3.3) - least(x1, 3.3)) * (greatest(y2, 2.2) - least(y1, 2.2)) AS expanded", source=BOXES))
def rectangle_algebra(spark, d):
    a = (A()[0], A()[1]), (A()[0] + 2, A()[1] + B()[1])
    b = (B()[0] + 3, F.lit(1.1)), (B()[0] + 3 + A()[1], 1.1 + B()[1])
    return given(spark, d, shared=bx.common(a, b), rest=bx.difference(a, b), whole=bx.size(bx.union(a, b)), grown=bx.size(bx.offset(a, 0.5)), expanded=bx.size(bx.expand(a, (F.lit(3.3), F.lit(2.2)))))


@query(sql("(ax + 0.5) * ay * bz AS moved", "least(ax, ay, bz) AS short", "ax + ay + bz - least(ax, ay, bz) - greatest(ax, ay, bz) AS middle", "greatest(ax, ay, bz) AS long"))
def box_faces_and_sides(spark, d):
    b = ZERO(), (A()[0], A()[1], B()[2])
    s = bx.sides_in_order(b)
    return given(spark, d, moved=bx.size(bx.move_face(b, 0, True, 0.5)), short=s[0], middle=s[1], long=s[2])


@query(f"WITH {BASE} SELECT id, ax * 0.8 + ay * 0.6 BETWEEN 0 AND 4 AND -ax * 0.6 + ay * 0.8 BETWEEN 0 AND 2 AND az BETWEEN 0 AND 1 AS inside FROM unit")
def point_in_turned_box(spark, d):
    """A box of 4 by 2 by 1 turned about z."""
    edges = tuple(tuple(map(F.lit, e)) for e in ((3.2, 2.4, 0.0), (-1.2, 1.6, 0.0), (0.0, 0.0, 1.0)))
    return given(spark, d, inside=bx.in_turned_box(A(), ZERO(), edges))


@query(f"WITH {BASE} SELECT id, abs(ax) <= 1 + sqrt(2) * 0.7 AND abs(ay) <= 1 + sqrt(2) * 0.7 AND abs(az) <= 1 + 0.7 AND (abs(ax) + abs(ay)) <= 2 + 1.4 / sqrt(2) AS meet FROM unit")
def turned_boxes_meet(spark, d):
    """A cube of half side 1 and one of 0.7 about a, turned by an eighth about z: their shadows are a square and a diamond."""
    one = tuple(tuple(map(F.lit, e)) for e in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)))
    q = 0.7 * math.sqrt(0.5)
    two = tuple(tuple(map(F.lit, e)) for e in ((q, q, 0.0), (-q, q, 0.0), (0.0, 0.0, 0.7)))
    return given(spark, d, meet=bx.turned_boxes_meet(ZERO(), one, A(), two))


@query(sql("least(0, az, bz) AS low", "greatest(0, az, bz) AS high", 'sqrt(greatest(ax * ax + ay * ay, bx * bx + "by" * "by")) AS radius'))
def cylinder_along_line(spark, d):
    """Least cylinder along z about the origin, a and b."""
    low, high, radius = bx.along_line(ZERO(), UP(), [ZERO(), A(), B()])
    return given(spark, d, low=low, high=high, radius=radius)
