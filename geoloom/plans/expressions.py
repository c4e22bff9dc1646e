"""Queries of vectors, matrices, quaternions, complex numbers, lines and planes over two vectors a part.

The factors have many digits so that no result lies halfway between two rounded ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import complex_numbers as cn
from geoloom.functions import matrix as mx
from geoloom.functions import vector as vc
from geoloom.plans import bindings as bd
from geoloom.plans.registry import query, rounded

BASE = """base AS (SELECT p_partkey AS id, p_partkey AS k, p_size * 0.12345678912::DOUBLE AS ax, p_retailprice * 0.00123457891::DOUBLE AS ay, (p_partkey % 7 - 3) * 0.7654321::DOUBLE AS az,
 (p_partkey % 5 - 2) * 0.9876543::DOUBLE AS bx, (p_partkey % 11) * 0.3456789::DOUBLE + 0.1::DOUBLE AS "by", 1.4567891::DOUBLE AS bz FROM part),
 unit AS (SELECT *, ax / la AS ux, ay / la AS uy, az / la AS uz, bx / lb AS vx, "by" / lb AS vy, bz / lb AS vz, ax * bx + ay * "by" + az * bz AS d FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + "by" * "by" + bz * bz) AS lb FROM base))"""


def A() -> tuple:  # noqa: N802
    return vc.vector("ax", "ay", "az")


def B() -> tuple:  # noqa: N802
    return vc.vector("bx", "by", "bz")


def base(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    t = bd.table(spark, d, "part")
    return t.select(
        k.alias("id"), k.alias("k"), (F.col("p_size") * 0.12345678912).alias("ax"), (F.col("p_retailprice") * 0.00123457891).alias("ay"), ((k % 7 - 3) * 0.7654321).alias("az"),
        ((k % 5 - 2) * 0.9876543).alias("bx"), ((k % 11) * 0.3456789 + 0.1).alias("by"), F.lit(1.4567891).alias("bz"),
    )


def given(spark, d, digits: int = 5, **columns) -> DataFrame:
    """id and the named columns, rounded."""
    return rounded(base(spark, d).select("id", *[vc.col(c).alias(n) for n, c in columns.items()]), digits)


def named(prefix: str, v) -> dict:
    return {f"{prefix}{axis}": c for axis, c in zip("xyzw", v, strict=False)}


def sql(*terms: str, source: str = "unit", digits: int = 5, where: str = "") -> str:
    """SELECT of id and rounded terms, each 'expression AS name'."""
    cut = [t.rsplit(" AS ", 1) for t in terms]
    return f"WITH {BASE} SELECT id, " + ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for e, n in cut) + f" FROM {source} {where}"


# ---------------------------------------------------------------- vectors


@query(sql("la * la AS square", "(ax - bx) ** 2 + (ay - \"by\") ** 2 + (az - bz) ** 2 AS gap2", "sqrt((ax - bx) ** 2 + (ay - \"by\") ** 2 + (az - bz) ** 2) AS gap"))
def vec_length_distance(spark, d):
    return given(spark, d, square=vc.length_squared(A()), gap2=vc.distance_squared(A(), B()), gap=vc.distance(A(), B()))


@query(sql("ax - 2 * (ax * vx + ay * vy + az * vz) * vx AS rx", "ay - 2 * (ax * vx + ay * vy + az * vz) * vy AS ry", "az - 2 * (ax * vx + ay * vy + az * vz) * vz AS rz"))
def vec_reflect(spark, d):
    return given(spark, d, **named("r", vc.reflect(A(), vc.normalize(B()))))


@query(sql("least(greatest(ax, 1.0), 3.0) AS cx", "least(greatest(ay, 1.2), 1.5) AS cy", "least(greatest(az, -1.0), 1.0) AS cz", "0.75 * ax + 0.25 * bx AS lx", "0.75 * ay + 0.25 * \"by\" AS ly", "0.75 * az + 0.25 * bz AS lz"))
def vec_clamp_lerp(spark, d):
    return given(spark, d, **named("c", vc.clamp(A(), (1.0, 1.2, -1.0), (3.0, 1.5, 1.0))), **named("l", vc.lerp(A(), B(), 0.25)))


@query(sql(*[f"(sin(0.7 * o) * u{x} + sin(0.3 * o) * v{x}) / sin(o) AS s{x}" for x in "xyz"], source="(SELECT *, acos(d / la / lb) AS o FROM unit)"))
def vec_slerp(spark, d):
    return given(spark, d, **named("s", vc.slerp(vc.normalize(A()), vc.normalize(B()), 0.3)))


@query(sql("least(ax, bx) AS lx", "greatest(ay, \"by\") AS gy", "abs(az) AS wz", "sqrt(ax) AS rx"))
def vec_min_max_abs_sqrt(spark, d):
    return given(spark, d, lx=vc.least(A(), B())[0], gy=vc.greatest(A(), B())[1], wz=vc.absolute(A())[2], rx=vc.square_root(A())[0])


@query(f"WITH {BASE} SELECT id, d / la / lb >= cos(radians(30)) AS aligned, abs(d / la / lb) >= cos(radians(30)) AS either, abs(d / la / lb) <= sin(radians(10)) AS square FROM unit")
def vec_alignment(spark, d):
    return given(spark, d, aligned=vc.is_aligned(A(), B(), math.cos(math.radians(30))), either=vc.is_aligned_or_reverse(A(), B(), math.cos(math.radians(30))), square=vc.is_perpendicular(A(), B(), math.sin(math.radians(10))))


@query(sql("ax * \"by\" - ay * bx AS flat", "ay * bz - az * \"by\" AS nx", "az * bx - ax * bz AS ny", "0.0 AS wa", "0.0 AS wb"))
def vec_cross_2_3_4(spark, d):
    """The 4-D product is normal to its factors."""
    n = vc.cross(A(), B())
    a4, b4, c4 = (*A(), F.lit(1.0)), (*B(), F.lit(2.0)), (F.lit(0.5), F.lit(1.0), F.lit(-1.0), F.lit(0.25))
    w = vc.cross4(a4, b4, c4)
    return given(spark, d, flat=vc.cross2(A()[:2], B()[:2]), nx=n[0], ny=n[1], wa=vc.dot(w, a4), wb=vc.dot(w, b4))


@query(sql(*[f"(a{x} + s * b{x}) / sqrt(la * la + lb * lb + 2 * s * d) AS m{x}" for x in "xz"], source="(SELECT *, CASE WHEN d < 0 THEN -1.0 ELSE 1.0 END AS s FROM unit)"))
def vec_merge_axes(spark, d):
    m = vc.merge_axes(A(), B())
    return given(spark, d, mx=m[0], mz=m[2])


@query(f"WITH {BASE} SELECT id, abs(ax - bx) <= 0.5 AS same, abs(az) <= 0.8 AS small, ax > bx + 0.5 AS more, ax < bx - 0.5 AS less FROM unit")
def near_comparisons(spark, d):
    return given(spark, d, same=vc.practically_same(A()[0], B()[0], 0.5), small=vc.negligible(A()[2], 0.8), more=vc.clearly_greater(A()[0], B()[0], 0.5), less=vc.clearly_less(A()[0], B()[0], 0.5))


@query(sql("la AS radius", "acos(az / la) AS polar", "atan2(ay, ax) AS azimuth", "ax AS bx", "ay AS by_", "az AS bz"))
def spherical_angles(spark, d):
    s = vc.to_spherical(A())
    b = vc.from_spherical(*s)
    return given(spark, d, radius=s[0], polar=s[1], azimuth=s[2], bx=b[0], by_=b[1], bz=b[2])


@query(sql("0.0 AS along", "1.0 AS size", "acos(d / la / lb) AS angle"))
def perpendicular_and_angle(spark, d):
    p = vc.perpendicular(A())
    return given(spark, d, along=vc.dot(p, A()), size=vc.length(p), angle=vc.smaller_angle(A(), B()))


@query(f"WITH {BASE} SELECT id, CASE WHEN abs(vx) <= abs(vy) AND abs(vx) <= abs(vz) THEN 'x' WHEN abs(vy) <= abs(vz) THEN 'y' ELSE 'z' END AS axis FROM unit")
def most_orthogonal_axis(spark, d):
    axes = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    return given(spark, d, axis=F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), vc.most_orthogonal(axes, B()) + 1))


# ---------------------------------------------------------------- lines, planes, triangles


@query(sql("sqrt(greatest((ax - 1) ** 2 + (ay - 2) ** 2 + (az - 3) ** 2 - ((ax - 1) * vx + (ay - 2) * vy + (az - 3) * vz) ** 2, 0)) AS gap", "abs((ax - 1) * 4 - (ay - 2) * 3) / 5 AS flat"))
def point_line_distance(spark, d):
    return given(spark, d, gap=vc.point_line_distance(A(), (1.0, 2.0, 3.0), B()), flat=vc.point_line_distance(A()[:2], (1.0, 2.0), (3.0, 4.0)))


@query(sql("ax + t * 3 AS x", "ay + t * 4 AS y", source="(SELECT *, ((bx - ax) * 1 - (\"by\" - ay) * -2) / (3 * 1 - 4 * -2) AS t FROM unit)"))
def line_line_2d(spark, d):
    p = vc.line_meeting(A()[:2], (F.lit(3.0), F.lit(4.0)), B()[:2], (F.lit(-2.0), F.lit(1.0)))
    return given(spark, d, x=p[0], y=p[1])


@query(sql("abs((bx - ax) * -1 + (\"by\" - ay) * -1 + (bz - az) * 1) / sqrt(3) AS gap", "0.0 AS square1", "0.0 AS square2"))
def skewed_lines(spark, d):
    """Lines along (1, 0, 1) and (0, 1, 1): their least gap, and that its feet are square to both."""
    one, two = tuple(map(F.lit, (1.0, 0.0, 1.0))), tuple(map(F.lit, (0.0, 1.0, 1.0)))
    gap, p, q = vc.skew_lines(A(), one, B(), two)
    return given(spark, d, gap=gap, square1=vc.dot(vc.minus(q, p), one), square2=vc.dot(vc.minus(q, p), two))


@query(f"WITH {BASE} SELECT id, CASE WHEN px >= 0 AND py >= 0 AND px + py <= 6 THEN round(t, 5) + 0.0 END AS line, CASE WHEN px >= 0 AND py >= 0 AND px + py <= 6 AND t >= 0 THEN round(t, 5) + 0.0 END AS ray, CASE WHEN px >= 0 AND py >= 0 AND px + py <= 6 AND t BETWEEN 0 AND 1 THEN round(t, 5) + 0.0 END AS segment FROM (SELECT *, ax + t * bx AS px, ay + t * \"by\" AS py FROM (SELECT *, -az / bz AS t FROM unit))")
def triangle_from_ray(spark, d):
    """Where lines, rays and segments from a along b meet the triangle (0, 0, 0), (6, 0, 0), (0, 6, 0)."""
    t = vc.triangle_hit(A(), B(), *[tuple(map(F.lit, p)) for p in ((0.0, 0.0, 0.0), (6.0, 0.0, 0.0), (0.0, 6.0, 0.0))])
    return given(spark, d, line=t, ray=F.when(t >= 0, t), segment=F.when((t >= 0) & (t <= 1), t))


@query(f"WITH {BASE} SELECT id, round(t, 5) + 0.0 AS line, CASE WHEN t >= 0 THEN round(t, 5) + 0.0 END AS ray, CASE WHEN t BETWEEN 0 AND 1 THEN round(t, 5) + 0.0 END AS segment FROM (SELECT *, (2 - (0.6 * ax + 0.8 * az)) / (0.6 * bx + 0.8 * bz) AS t FROM unit)")
def plane_from_line_ray_segment(spark, d):
    t = vc.line_plane(A(), B(), (0.6, 0.0, 0.8), 2.0)
    return given(spark, d, line=t, ray=F.when(t >= 0, t), segment=F.when((t >= 0) & (t <= 1), t))


@query(sql("0.0 AS r1", "0.0 AS r2", "0.0 AS r3", "0.0 AS r4", "0.0 AS r5"))
def planes_common_point_and_line(spark, d):
    """The point lies on all three planes, and the line's point and direction in both of its planes."""
    n1, n2, n3 = vc.normalize(A()), vc.normalize(B()), tuple(map(F.lit, (0.1, 0.2, 0.9)))
    p = vc.planes_point(n1, F.lit(1.0), n2, F.lit(2.0), n3, F.lit(0.5))
    q, way = vc.planes_line(n1, F.lit(1.0), n2, F.lit(2.0))
    return given(spark, d, r1=vc.dot(p, n1) - 1, r2=vc.dot(p, n2) - 2, r3=vc.dot(p, n3) - 0.5, r4=vc.dot(q, n1) - 1, r5=vc.dot(way, n2))


@query(sql("f AS x", "sqrt(ax * ax - f * f) AS y", source="(SELECT *, (ax * ax - (ax + 0.3) ** 2 + 1) / 2 AS f FROM unit)", where="WHERE ax * ax >= f * f"))
def circle_circle(spark, d):
    """Circles of radii r about (0, 0) and r + 0.3 about (1, 0)."""
    p, _ = vc.circles_meeting((F.lit(0.0), F.lit(0.0)), A()[0], (F.lit(1.0), F.lit(0.0)), A()[0] + 0.3)
    return given(spark, d, x=p[0], y=F.abs(p[1])).where("y IS NOT NULL")


@query(f"WITH {BASE} SELECT id, round((-q - sqrt(q * q - c)), 5) + 0.0 AS first, round((-q + sqrt(q * q - c)), 5) + 0.0 AS second, CAST((-q - sqrt(q * q - c) BETWEEN 0 AND 4) AS INT) + CAST((-q + sqrt(q * q - c) BETWEEN 0 AND 4) AS INT) AS hits FROM (SELECT *, 0.6 * (-2 - ax) + 0.8 * (0.5 - ay) AS q, (-2 - ax) ** 2 + (0.5 - ay) ** 2 - 9 AS c FROM unit) WHERE q * q >= c")
def circle_segment(spark, d):
    """Circles of radius 3 about a and the segment from (-2, 0.5) of length 4 along (0.6, 0.8)."""
    t1, t2 = vc.line_circle((F.lit(-2.0), F.lit(0.5)), (F.lit(0.6), F.lit(0.8)), A()[:2], 3.0)
    on = [((t >= 0) & (t <= 4)).cast("int") for t in (t1, t2)]
    return given(spark, d, first=t1, second=t2, hits=on[0] + on[1]).where("first IS NOT NULL")


@query(sql("sqrt(az * az + CASE WHEN ax + ay <= 6 THEN 0 WHEN ax - ay >= 6 THEN (ax - 6) ** 2 + ay ** 2 WHEN ay - ax >= 6 THEN ax ** 2 + (ay - 6) ** 2 ELSE (ax + ay - 6) ** 2 / 2 END) AS gap"))
def triangle_nearest_point(spark, d):
    """Distance of a (its x and y are positive) and the triangle (0, 0, 0), (6, 0, 0), (0, 6, 0)."""
    p = vc.nearest_on_triangle(A(), *[tuple(map(F.lit, q)) for q in ((0.0, 0.0, 0.0), (6.0, 0.0, 0.0), (0.0, 6.0, 0.0))])
    return given(spark, d, gap=vc.distance(A(), p))


@query(f"WITH {BASE} SELECT id, ax + ay <= 3 AS inside, abs(ax - ay) / sqrt(2) <= 0.3 AND ax + ay BETWEEN 0 AND 6 AS on_segment FROM unit WHERE ax + ay < 5.5")
def point_in_triangle_on_segment(spark, d):
    flat = (*A()[:2], F.lit(0.0))
    inside = vc.in_triangle(flat, *[tuple(map(F.lit, q)) for q in ((0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (0.0, 3.0, 0.0))])
    on = vc.on_segment(A()[:2], (F.lit(0.0), F.lit(0.0)), (F.lit(3.0), F.lit(3.0)), 0.3)
    return rounded(base(spark, d).where(F.col("ax") + F.col("ay") < 5.5).select("id", inside.alias("inside"), on.alias("on_segment")))


@query(sql("1.0 AS size", "0.0 AS g1", "0.0 AS g2", "abs(ay * bz - az * \"by\" + az * bx - ax * bz + ax * \"by\" - ay * bx) / sqrt((ay * bz - az * \"by\") ** 2 + (az * bx - ax * bz) ** 2 + (ax * \"by\" - ay * bx) ** 2) AS off"))
def plane_from_points(spark, d):
    """The plane through the origin, a and b: its unit normal, both points on it, and how far (1, 1, 1) is off."""
    n, distance = vc.plane_of(tuple(map(F.lit, (0.0, 0.0, 0.0))), A(), B())
    one = tuple(map(F.lit, (1.0, 1.0, 1.0)))
    return given(spark, d, size=vc.length(n), g1=vc.plane_distance(A(), n, distance), g2=vc.plane_distance(B(), n, distance), off=F.abs(vc.plane_distance(one, n, distance)))


@query(sql("0.0 AS gap", "sqrt(greatest(la * la - (d / lb) ** 2, 0)) AS reach", "d / lb AS height"))
def plane_coordinates_and_back(spark, d):
    """a in the plane normal to b, and back: no gap, its distance from the axis, its height."""
    t = base(spark, d).select("id", "ax", "ay", "az", *[c.alias(n) for n, c in named("n", vc.normalize(B())).items()])
    n = vc.vector("nx", "ny", "nz")
    u, v = vc.plane_axes(n)
    t = t.select("*", *[c.alias(k) for k, c in named("u", u).items()])
    axes = vc.vector("ux", "uy", "uz"), vc.cross(n, vc.vector("ux", "uy", "uz"))
    t = t.select("*", vc.dot(A(), axes[0]).alias("p"), vc.dot(A(), axes[1]).alias("q"), vc.dot(A(), n).alias("h"))
    back = vc.from_plane((F.col("p"), F.col("q")), n, F.col("h"), axes)
    return rounded(t.select("id", vc.distance(A(), back).alias("gap"), F.sqrt(F.col("p") ** 2 + F.col("q") ** 2).alias("reach"), F.col("h").alias("height")), 5)


@query(f"WITH {BASE}, l AS (SELECT id, id % 4 AS g, ax, ay, az, vx, vy, vz FROM unit) SELECT g, true AS least FROM l GROUP BY g")
def closest_point_to_lines(spark, d):
    """For each group of lines the point of least squared distance: it lies below eight points around it."""
    lines = base(spark, d).select((F.col("id") % 4).alias("g"), *[c.alias(n) for n, c in named("p", A()).items()], *[c.alias(n) for n, c in named("w", vc.normalize(B())).items()])
    from geoloom.operators import statistics

    point = statistics.point_to_lines(lines, "g")
    near = lines.join(point, "g")
    p, w = vc.vector("px", "py", "pz"), vc.vector("wx", "wy", "wz")

    def cost(shift):
        at = tuple(F.col(c) + s for c, s in zip("xyz", shift, strict=True))
        return F.sum(vc.point_line_distance(at, p, w) ** 2)

    shifts = [(0.0, 0.0, 0.0), *[tuple(0.05 * ((i >> k & 1) * 2 - 1) for k in range(3)) for i in range(8)]]
    costs = near.groupBy("g").agg(*[cost(s).alias(f"c{i}") for i, s in enumerate(shifts)])
    return costs.select("g", (F.col("c0") < F.least(*[f"c{i}" for i in range(1, 9)])).alias("least"))


# ---------------------------------------------------------------- matrices and quaternions


@query(sql("ax AS x1", "ay * cos(0.7) - az * sin(0.7) AS y1", "ax * cos(0.4) + az * sin(0.4) AS x2", "az * cos(0.4) - ax * sin(0.4) AS z2"))
def rotate_x_y(spark, d):
    p, q = mx.transform(A(), mx.rotation_x(0.7)), mx.transform(A(), mx.rotation_y(0.4))
    return given(spark, d, x1=p[0], y1=p[1], x2=q[0], z2=q[2])


@query(sql(*[f"a{x} * cos(0.9) + (v{y} * a{z} - v{z} * a{y}) * sin(0.9) + v{x} * (d / lb) * (1 - cos(0.9)) AS r{x}" for x, y, z in ("xyz", "yzx", "zxy")], *[f"a{x} * cos(0.9) + (v{y} * a{z} - v{z} * a{y}) * sin(0.9) + v{x} * (d / lb) * (1 - cos(0.9)) AS q{x}" for x, y, z in ("xyz", "yzx", "zxy")]))
def rotate_axis_angle_and_quaternion(spark, d):
    """Rotation about b by 0.9, as a matrix and by a unit quaternion."""
    axis = vc.normalize(B())
    q = (*[c * math.sin(0.45) for c in axis], F.lit(math.cos(0.45)))
    return given(spark, d, **named("r", mx.transform(A(), mx.rotation(axis, 0.9))), **named("q", mx.transform(A(), mx.from_quaternion(q))))


@query(sql(*[f"v{x} * sin(0.45) AS q{x}" for x in "xyz"], "cos(0.45) AS qw"))
def quaternion_from_matrix(spark, d):
    return given(spark, d, **named("q", mx.to_quaternion(mx.rotation(vc.normalize(B()), 0.9))))


@query(sql(*[f"v{x} * sin(0.6) AS q{x}" for x in "xyz"], "cos(0.6) AS qw", *[f"v{x} * sin(0.5) AS s{x}" for x in "xyz"], "cos(0.5) AS sw"))
def quaternion_product_and_slerp(spark, d):
    """Turns about one axis add; between 0.8 and 1.6 of a turn a quarter of the way is 1.0."""
    axis = vc.normalize(B())

    def q(angle):
        return (*[c * math.sin(angle / 2) for c in axis], F.lit(math.cos(angle / 2)))

    return given(spark, d, **named("q", mx.quaternion_product(q(0.8), q(0.4))), **named("s", vc.slerp(q(0.8), q(1.6), 0.25)))


@query(sql("x2 AS x", "y2 AS y", "z2 * cos(0.3) - x2 * 0 AS z", source="(SELECT id, x1 * cos(0.5) + z1 * sin(0.5) AS x2, y1 AS y2, (z1 * cos(0.5) - x1 * sin(0.5)) / cos(0.3) AS z2 FROM (SELECT id, x0 AS x1, y0 * cos(0.3) - az * sin(0.3) AS y1, y0 * sin(0.3) + az * cos(0.3) AS z1 FROM (SELECT id, az, ax * cos(0.2) - ay * sin(0.2) AS x0, ax * sin(0.2) + ay * cos(0.2) AS y0 FROM unit)))"))
def yaw_pitch_roll(spark, d):
    """Roll about z, then pitch about x, then yaw about y."""
    return given(spark, d, **named("", mx.transform(A(), mx.yaw_pitch_roll(0.5, 0.3, 0.2))))


@query(sql("1 + 2 * (ax - 1) AS x", "2 + 3 * (ay - 2) AS y", "3 + 0.5 * (az - 3) AS z", "0.0 AS level", "(2 - 0.6 * ax - 0.8 * az) / (0.6 * 0.2 + 0.8 * 0.9) * 0.5 + ay AS slid"))
def scale_about_and_shadow(spark, d):
    """Scaling about (1, 2, 3); the shadow along (0.2, 0.5, 0.9) lies on 0.6 x + 0.8 z = 2."""
    p = mx.transform(A(), mx.scaling(2.0, 3.0, 0.5, (1.0, 2.0, 3.0)))
    s = mx.transform(A(), mx.shadow((0.2, 0.5, 0.9), (0.6, 0.0, 0.8), 2.0))
    return given(spark, d, **named("", p), level=0.6 * s[0] + 0.8 * s[2] - 2, slid=s[1])


@query(sql("0.0 AS x", "0.0 AS y", "-sqrt((ax - 5) ** 2 + (ay - 6) ** 2 + (az - 7) ** 2) AS z"))
def look_at(spark, d):
    """The target lies straight ahead, at its distance."""
    eye = tuple(map(F.lit, (5.0, 6.0, 7.0)))
    return given(spark, d, **named("", mx.transform(A(), mx.look_at(eye, A(), tuple(map(F.lit, (0.0, 0.0, 1.0)))))))


@query(sql("ax / (2 + abs(az)) AS x", "ay / (2 + abs(az)) AS y", "2 * ax / 4 AS u", "2 * ay / 3 AS v", "(-2 - abs(az) + 1) / -9 AS w"))
def perspective_and_orthographic(spark, d):
    """A view of width and height 2 at distance 1: what lies twice as far is half as large."""
    eye = (A()[0], A()[1], -2 - F.abs(A()[2]))
    p, o = mx.transform(eye, mx.perspective(2.0, 2.0, 1.0, 10.0)), mx.transform(eye, mx.orthographic(4.0, 3.0, 1.0, 10.0))
    return given(spark, d, x=p[0], y=p[1], u=o[0], v=o[1], w=o[2])


def small_matrix():
    one = F.lit(1.0)
    return (A()[0], A()[1], F.lit(0.3)), (F.lit(0.2), B()[1] + 2, B()[2]), (one, F.lit(-0.5), F.lit(4.0))


@query(sql("1.0 AS m00", "0.0 AS m01", "0.0 AS m20", "1.0 AS m22", "ax + \"by\" + 2 + 4 AS trace", "0.2 AS t01", "ax * 3 AS k00", "ay * 2 AS k03"))
def matrix_inverse_transpose_kronecker(spark, d):
    """A matrix times its inverse is the identity."""
    m = small_matrix()
    i = mx.product(m, mx.inverse(m))
    k = mx.kronecker(m, ((3.0, 0.0), (1.0, 2.0)))
    return given(spark, d, m00=i[0][0], m01=i[0][1], m20=i[2][0], m22=i[2][2], trace=mx.trace(m), t01=mx.transpose(m)[0][1], k00=k[0][0], k03=k[1][3])


@query(sql("ax AS s0", "2.0 AS s1", "\"by\" + 1 AS s2", "cos(0.9) + vx * vx * (1 - cos(0.9)) AS r00", "ay AS t1"))
def matrix_decompose(spark, d):
    """Scale, rotation and shift of a matrix made of them."""
    axis = vc.normalize(B())
    m = mx.product(mx.product(mx.scaling(A()[0], F.lit(2.0), B()[1] + 1), mx.rotation(axis, 0.9)), mx.translation(A()[0], A()[1], A()[2]))
    s, r, t = mx.decompose(m)
    return given(spark, d, s0=s[0], s1=s[1], s2=s[2], r00=r[0][0], t1=t[1])


@query(sql("2 * ax AS x", "3 * ay AS y", "0.5 * az AS z"))
def transform_direction(spark, d):
    m = mx.product(mx.scaling(2.0, 3.0, 0.5), mx.translation(9.0, 9.0, 9.0))
    return given(spark, d, **named("", mx.transform_direction(A(), m)))


@query(f"WITH {BASE} SELECT id, id % 3 = 0 AS singular, round(0.2, 5) AS entry, round(0.3 + bz + 4, 5) + 0.0 AS last_column FROM unit")
def matrix_singular_and_columns(spark, d):
    """Every third matrix has a row that is twice another."""
    m = small_matrix()
    third = F.col("id") % 3 == 0
    bent = (m[0], m[1], tuple(F.when(third, x * 2).otherwise(y) for x, y in zip(m[0], m[2], strict=True)))
    return given(spark, d, singular=mx.is_singular(bent, 1e-9), entry=mx.column(m, 0)[1], last_column=vc.total(mx.column(m, 2)))


SYM = "(SELECT id, ax + 2 AS p, az AS q, \"by\" + 3 AS r, sqrt((ax + 2 - \"by\" - 3) ** 2 / 4 + az * az) AS h, (ax + 5 + \"by\") / 2 AS m FROM unit)"


@query(sql("m - h AS e1", "m + h AS e2", "r / (p * r - q * q) AS i00", "-q / (p * r - q * q) AS i01", "p * r - q * q AS det", "q / p AS l10", "r - q * q / p AS u11", source=SYM, where="WHERE p * r - q * q > 0.01"))
def matrix_arrays(spark, d):
    """Symmetric matrices of two rows held as arrays: eigenvalues, inverse, determinant and both triangular factors."""
    p, q, r = A()[0] + 2, A()[2], B()[1] + 3
    t = base(spark, d).where(p * r - q * q > 0.01).select("id", F.array(p, q, q, r).alias("m"))
    t = t.select("id", mx.array_eigenvalues("m").alias("e"), mx.array_inverse("m").alias("i"), mx.array_determinant("m").alias("det"), mx.array_lu("m").alias("lu"))
    pick = {"e1": ("e", 0), "e2": ("e", 1), "i00": ("i", 0), "i01": ("i", 1), "l10": ("lu", 2), "u11": ("lu", 3)}
    return rounded(t.select("id", "det", *[F.get(c, F.lit(n)).alias(k) for k, (c, n) in pick.items()]), 5)


@query(sql("sqrt(p) AS c00", "q / sqrt(p) AS c10", "sqrt(r - q * q / p) AS c11", "m + h AS s1", "m - h AS s2", "exp(m / 10) * (cosh(h / 10) + (p - r) / 2 / h * sinh(h / 10)) AS x00", "exp(m / 10) * q / h * sinh(h / 10) AS x01", source=SYM, where="WHERE p * r - q * q > 0.01 AND h > 0.01"))
def matrix_arrays_cholesky_svd_exponential(spark, d):
    p, q, r = A()[0] + 2, A()[2], B()[1] + 3
    h = F.sqrt((p - r) ** 2 / 4 + q * q)
    t = base(spark, d).where((p * r - q * q > 0.01) & (h > 0.01)).select("id", F.array(p, q, q, r).alias("m"))
    t = t.select("id", mx.array_cholesky("m").alias("c"), mx.array_singular_values("m").alias("s"), mx.array_exponential(F.transform("m", lambda v: v / 10)).alias("x"))
    pick = {"c00": ("c", 0), "c10": ("c", 2), "c11": ("c", 3), "s1": ("s", 0), "s2": ("s", 1), "x00": ("x", 0), "x01": ("x", 1)}
    return rounded(t.select("id", *[F.get(c, F.lit(n)).alias(k) for k, (c, n) in pick.items()]), 5)


@query(sql("m - h AS value", "0.0 AS rest", "1.0 AS size", source=SYM, where="WHERE h > 0.01"))
def matrix_eigenvectors(spark, d):
    """The vector of the least eigenvalue: M v - e v is nothing, and v is of length 1."""
    p, q, r = A()[0] + 2, A()[2], B()[1] + 3
    t = base(spark, d).where(F.sqrt((p - r) ** 2 / 4 + q * q) > 0.01).select("id", p.alias("p"), q.alias("q"), r.alias("r"), mx.array_eigenvectors(F.array(p, q, q, r)).alias("v"))
    e, x, y = (F.get("v", F.lit(i)) for i in (0, 2, 3))
    rest = F.abs(F.col("p") * x + F.col("q") * y - e * x) + F.abs(F.col("q") * x + F.col("r") * y - e * y)
    return rounded(t.select("id", e.alias("value"), rest.alias("rest"), F.sqrt(x * x + y * y).alias("size")), 5)


# ---------------------------------------------------------------- complex numbers


@query(sql("sqrt((sqrt(ax * ax + az * az) + ax) / 2) AS re", "CASE WHEN az < 0 THEN -1 ELSE 1 END * sqrt((sqrt(ax * ax + az * az) - ax) / 2) AS im", "ax / (ax * ax + az * az) AS inv_re", "-az / (ax * ax + az * az) AS inv_im", "(ax * ax + az * az) ** (1.0 / 6) * cos(atan2(az, ax) / 3) AS cube_re", "(ax * ax + az * az) ** (1.0 / 6) * sin(atan2(az, ax) / 3) AS cube_im", "(ax * bx + az * bz) / (bx * bx + bz * bz) AS quotient", "ax * bz + az * bx AS product"))
def complex_roots_reciprocal(spark, d):
    z, w = (A()[0], A()[2]), (B()[0], B()[2])
    s, r, c = cn.square_root(z), cn.reciprocal(z), cn.cube_root(z)
    return given(spark, d, re=s[0], im=s[1], inv_re=r[0], inv_im=r[1], cube_re=c[0], cube_im=c[1], quotient=cn.divide(z, w)[0], product=cn.multiply(z, w)[1])


@query(sql("ax AS r1", "ax + ay AS r2", "ax + ay + 1 + \"by\" AS r3"))
def cubic_roots(spark, d):
    """Cubics with three known real roots, by the trigonometric formula."""
    r1, r2 = A()[0], A()[0] + A()[1]
    r3 = r2 + 1 + B()[1]
    found = cn.cubic_real_roots(-(r1 + r2 + r3), r1 * r2 + r1 * r3 + r2 * r3, -(r1 * r2 * r3))
    return given(spark, d, r1=found[0], r2=found[1], r3=found[2])


@query("SELECT p_partkey AS id, round(1 - 2 * atan(abs(t)) / pi(), 6) AS one, round(1 - abs(t) / sqrt(2 + t * t), 6) AS two FROM (SELECT p_partkey, (p_size - 25) * 0.0837::DOUBLE AS t FROM part)")
def t_distribution_closed_forms(spark, d):
    """Mass beyond t on both sides; with one and two degrees of freedom it has closed forms."""
    from geoloom.operators import statistics

    t = bd.table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") - 25) * 0.0837).alias("t"), F.lit(1.0).alias("f1"), F.lit(2.0).alias("f2"))
    return rounded(t.select("id", statistics.t_probability("t", "f1").alias("one"), statistics.t_probability("t", "f2").alias("two")), 6)
