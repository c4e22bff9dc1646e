"""Analytic surfaces as expressions: signed distances, line hits, constructive solids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vector, col, cross, dot, length, length_squared, minus


def plane(p: Vector, normal: Vector, d) -> Column:
    return dot(p, normal) - d


def sphere(p: Vector, centre: Vector, radius) -> Column:
    return length(minus(p, centre)) - radius


def cylinder(p: Vector, anchor: Vector, axis: Vector, radius) -> Column:
    """Infinite cylinder about a unit axis."""
    return length(cross(minus(p, anchor), axis)) - radius


def _along(p: Vector, anchor: Vector, axis: Vector) -> tuple[Column, Column]:
    """(height along the unit axis, distance from it)."""
    rest = minus(p, anchor)
    return dot(rest, axis), length(cross(rest, axis))


def capped_cylinder(p: Vector, anchor: Vector, axis: Vector, radius, height) -> Column:
    """Cylinder from the anchor to ``height``: the exact signed distance."""
    h, r = _along(p, anchor, axis)
    side, cap = r - radius, F.abs(h - height / 2) - height / 2
    outside = F.sqrt(F.greatest(side, F.lit(0.0)) ** 2 + F.greatest(cap, F.lit(0.0)) ** 2)
    return F.least(F.greatest(side, cap), F.lit(0.0)) + outside


def cone(p: Vector, apex: Vector, axis: Vector, aperture) -> Column:
    """One nappe opening along the unit axis; ``aperture`` is radius over height."""
    h, r = _along(p, apex, axis)
    size = math.sqrt(1 + aperture * aperture) if not isinstance(aperture, Column) else F.sqrt(1 + aperture * aperture)
    beyond = h + aperture * r < 0
    return F.when(beyond, F.sqrt(h * h + r * r)).otherwise((r - aperture * h) / size)


def torus(p: Vector, centre: Vector, axis: Vector, major, minor) -> Column:
    h, r = _along(p, centre, axis)
    return F.sqrt((r - major) ** 2 + h * h) - minor


def capsule(p: Vector, a: Vector, ra, b: Vector, rb) -> Column:
    """Hull of two spheres, between their centres by the relative height along the axis."""
    axis = minus(b, a)
    size = F.sqrt(length_squared(tuple(map(col, axis))))
    unit = tuple(x / size for x in axis)
    h, r = _along(p, a, unit)
    slope = (ra - rb) / size
    shift = F.sqrt(1 - slope * slope)
    at = (h - r * slope / shift) / size
    t = F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0))
    radius = ra + (rb - ra) * t
    return F.sqrt((h - t * size) ** 2 + r * r) - radius


def quadric(p: Vector, c: tuple) -> Column:
    """xx, yy, zz, xy, xz, yz, x, y, z and constant coefficients."""
    x, y, z = p
    return c[0] * x * x + c[1] * y * y + c[2] * z * z + c[3] * x * y + c[4] * x * z + c[5] * y * z + c[6] * x + c[7] * y + c[8] * z + c[9]


def quadric_distance(p: Vector, c: tuple) -> Column:
    """First-order distance: value over gradient."""
    x, y, z = p
    gradient = (2 * c[0] * x + c[3] * y + c[4] * z + c[6], 2 * c[1] * y + c[3] * x + c[5] * z + c[7], 2 * c[2] * z + c[4] * x + c[5] * y + c[8])
    size = length(gradient)
    return F.when(size > 0, quadric(p, c) / size)


def _both_roots(a, b, c) -> tuple[Column, Column]:
    a, b, c = col(a), col(b), col(c)
    inner = b * b - 4 * a * c
    root = F.when((a != 0) & (inner >= 0), F.sqrt(inner))
    return (-b - root) / (2 * a), (-b + root) / (2 * a)


def line_sphere(start: Vector, direction: Vector, centre: Vector, radius) -> tuple[Column, Column]:
    """Both line parameters, ascending; null if the line misses."""
    rest = minus(start, centre)
    return _both_roots(dot(direction, direction), 2 * dot(rest, direction), dot(rest, rest) - radius * radius)


def line_cylinder(start: Vector, direction: Vector, anchor: Vector, axis: Vector, radius) -> tuple[Column, Column]:
    d, r = cross(direction, axis), cross(minus(start, anchor), axis)
    return _both_roots(dot(d, d), 2 * dot(d, r), dot(r, r) - radius * radius)


def line_cone(start: Vector, direction: Vector, apex: Vector, axis: Vector, aperture) -> tuple[Column, Column]:
    """Parameters on the nappe along the axis; hits behind the apex are null."""
    rest, k = minus(start, apex), 1 + aperture * aperture
    da, ra = dot(direction, axis), dot(rest, axis)
    hits = _both_roots(dot(direction, direction) - k * da * da, 2 * (dot(rest, direction) - k * da * ra), dot(rest, rest) - k * ra * ra)
    return tuple(F.when(ra + t * da >= 0, t) for t in hits)


def line_quadric(start: Vector, direction: Vector, c: tuple) -> tuple[Column, Column]:
    (x, y, z), (u, v, w) = start, direction
    a = c[0] * u * u + c[1] * v * v + c[2] * w * w + c[3] * u * v + c[4] * u * w + c[5] * v * w
    b = 2 * (c[0] * x * u + c[1] * y * v + c[2] * z * w) + c[3] * (x * v + y * u) + c[4] * (x * w + z * u) + c[5] * (y * w + z * v) + c[6] * u + c[7] * v + c[8] * w
    return _both_roots(a, b, quadric(start, c))


def box_hits(start: Vector, direction: Vector, low: Vector, high: Vector) -> tuple[Column, Column]:
    """Entry and exit parameters of a line and a box by slabs; null if it misses."""
    near, far = [], []
    for s, d, a, b in zip(start, direction, low, high, strict=True):
        s, d = col(s), col(d)
        t1, t2 = F.try_divide(a - s, d), F.try_divide(b - s, d)
        inside = (s >= a) & (s <= b)
        miss = (d == 0) & ~inside
        near.append(F.when(miss, F.lit(float("inf"))).when(d == 0, F.lit(float("-inf"))).otherwise(F.least(t1, t2)))
        far.append(F.when(miss, F.lit(float("-inf"))).when(d == 0, F.lit(float("inf"))).otherwise(F.greatest(t1, t2)))
    enter, leave = F.greatest(*near), F.least(*far)
    return F.when(enter <= leave, enter), F.when(enter <= leave, leave)


def join(*fields: Column) -> Column:
    """Union of solids: inside where any field is negative."""
    return F.least(*fields)


def meet(*fields: Column) -> Column:
    return F.greatest(*fields)


def cut(a: Column, b: Column) -> Column:
    return F.greatest(a, -b)


def either(a: Column, b: Column) -> Column:
    """Exclusive or."""
    return F.greatest(F.least(a, b), -F.greatest(a, b))


def unroll_cylinder(p: Vector, anchor: Vector, axis: Vector, zero: Vector, radius) -> tuple[Column, Column]:
    """Arc length from the direction ``zero`` (normal to the axis) and height."""
    rest = minus(p, anchor)
    return F.atan2(dot(rest, cross(axis, zero)), dot(rest, zero)) * radius, dot(rest, axis)


def quadratic_roots(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Real roots ascending by formula (a > 0), null if complex."""
    return _both_roots(a, b, c)


def line_key(anchor: Vector, direction: Vector) -> tuple[Column, Column, Column, Column]:
    """Four numbers that name a line in space: two angles of its direction and the place it passes nearest the origin."""
    size = length(direction)
    flip = F.when((direction[2] < 0) | ((direction[2] == 0) & ((direction[1] < 0) | ((direction[1] == 0) & (direction[0] < 0)))), -1.0).otherwise(1.0)
    unit = tuple(flip * x / size for x in direction)
    foot = minus(anchor, tuple(dot(anchor, unit) * x for x in unit))
    polar, azimuth = F.acos(unit[2]), F.atan2(unit[1], unit[0])
    u = (F.cos(polar) * F.cos(azimuth), F.cos(polar) * F.sin(azimuth), -F.sin(polar))
    v = (-F.sin(azimuth), F.cos(azimuth), F.lit(0.0))
    return polar, azimuth, dot(foot, u), dot(foot, v)


def roll_cylinder(arc, height, anchor: Vector, axis: Vector, zero: Vector, radius) -> Vector:
    """The point of a cylinder with an arc length and a height; undoes ``unroll_cylinder``."""
    angle = arc / radius
    side = cross(axis, zero)
    return tuple(a + height * w + radius * (F.cos(angle) * z + F.sin(angle) * s) for a, w, z, s in zip(anchor, axis, zero, side, strict=True))


def nearest_on_sphere(p: Vector, centre: Vector, radius) -> Vector:
    rest = minus(p, centre)
    size = length(rest)
    return tuple(c + F.when(size > 0, r * radius / size) for c, r in zip(centre, rest, strict=True))


def nearest_on_cylinder(p: Vector, anchor: Vector, axis: Vector, radius) -> Vector:
    """Foot on an infinite cylinder about a unit axis; null on the axis."""
    rest = minus(p, anchor)
    h = dot(rest, axis)
    out = minus(rest, tuple(h * w for w in axis))
    size = length(out)
    return tuple(a + h * w + F.when(size > 0, o * radius / size) for a, w, o in zip(anchor, axis, out, strict=True))


def nearest_on_ring(p: Vector, centre: Vector, axis: Vector, radius) -> Vector:
    """Nearest point of the circle in the plane through the centre, normal to the unit axis."""
    rest = minus(p, centre)
    out = minus(rest, tuple(dot(rest, axis) * w for w in axis))
    size = length(out)
    return tuple(c + F.when(size > 0, o * radius / size) for c, o in zip(centre, out, strict=True))


def nearest_on_torus(p: Vector, centre: Vector, axis: Vector, major, minor) -> Vector:
    return nearest_on_sphere(p, nearest_on_ring(p, centre, axis, major), minor)


def line_capped_cylinder(start: Vector, direction: Vector, anchor: Vector, axis: Vector, radius, height) -> tuple[Column, Column]:
    """Entry and exit of a line and a closed cylinder from the anchor to ``height``: the side's span cut to the slab's."""
    near, far = line_cylinder(start, direction, anchor, axis, radius)
    rest, slope = dot(minus(start, anchor), axis), dot(direction, axis)
    inside_side = length(cross(minus(start, anchor), axis)) <= radius
    parallel = length(cross(direction, axis)) < 1e-12
    wide = F.lit(float("inf"))
    near, far = F.when(parallel & inside_side, -wide).otherwise(near), F.when(parallel & inside_side, wide).otherwise(far)
    t1, t2 = F.try_divide(-rest, slope), F.try_divide(height - rest, slope)
    level = slope == 0
    within = (rest >= 0) & (rest <= height)
    low = F.when(level & within, -wide).when(~level, F.least(t1, t2))
    high = F.when(level & within, wide).when(~level, F.greatest(t1, t2))
    enter, leave = F.greatest(near, low), F.least(far, high)
    meets = near.isNotNull() & low.isNotNull() & (enter <= leave)
    return F.when(meets, enter), F.when(meets, leave)


def line_torus_quartic(start: Vector, direction: Vector, centre: Vector, axis: Vector, major, minor) -> tuple[Column, ...]:
    """Coefficients, highest power first, of the quartic whose real roots are the line's parameters on a torus."""
    rest = minus(start, centre)
    dd, rd, rr = dot(direction, direction), dot(rest, direction), dot(rest, rest)
    dh, rh = dot(direction, axis), dot(rest, axis)
    k, m = rr + major * major - minor * minor, 4 * major * major
    return dd * dd, 4 * dd * rd, 2 * dd * k + 4 * rd * rd - m * (dd - dh * dh), 4 * rd * k - 2 * m * (rd - rh * dh), k * k - m * (rr - rh * rh)


def capsule_hits(start: Vector, direction: Vector, a: Vector, b: Vector, radius) -> tuple[Column, Column]:
    """Entry and exit of a line and a capsule of one radius: the hull of what its two balls and its closed cylinder give."""
    along = minus(b, a)
    size = F.sqrt(length_squared(tuple(map(col, along))))
    unit = tuple(x / size for x in along)
    parts = [line_sphere(start, direction, a, radius), line_sphere(start, direction, b, radius), line_capped_cylinder(start, direction, a, unit, radius, size)]
    return F.least(*[p[0] for p in parts]), F.greatest(*[p[1] for p in parts])


def quadric_kind(c: tuple) -> Column:
    """Name of a quadric without mixed terms, after its squares are completed: sphere, ellipsoid, cylinder, cone, hyperboloid, paraboloid or other."""
    squares, linear = c[:3], c[6:9]
    negligible = [F.abs(col(s)) < 1e-12 for s in squares]
    zeros = sum((n.cast("int") for n in negligible[1:]), negligible[0].cast("int"))
    positive = sum(((col(s) > 1e-12).cast("int") for s in squares[1:]), (col(squares[0]) > 1e-12).cast("int"))
    rest = col(c[9])
    for s, v, n in zip(squares, linear, negligible, strict=True):
        rest = rest - F.when(n, 0.0).otherwise(v * v / (4 * F.when(n, 1.0).otherwise(col(s))))
    open_way = F.lit(False)
    for v, n in zip(linear, negligible, strict=True):
        open_way = open_way | (n & (F.abs(col(v)) > 1e-12))
    even = (F.greatest(*map(col, squares)) - F.least(*map(col, squares))) < 1e-12
    one_way = (positive == 3) | ((positive == 0) & (zeros == 0))
    return (
        F.when((zeros == 0) & one_way & even, "sphere").when((zeros == 0) & one_way, "ellipsoid").when((zeros == 0) & (F.abs(rest) < 1e-9), "cone").when(zeros == 0, "hyperboloid")
        .when((zeros == 1) & open_way, "paraboloid").when(zeros == 1, "cylinder").otherwise("other")
    )


def conic_distance(p: tuple, c: tuple) -> Column:
    """First-order distance of a point of the plane and a conic (xx, xy, yy, x, y, constant)."""
    x, y = p
    value = c[0] * x * x + c[1] * x * y + c[2] * y * y + c[3] * x + c[4] * y + c[5]
    slope = F.sqrt((2 * c[0] * x + c[1] * y + c[3]) ** 2 + (c[1] * x + 2 * c[2] * y + c[4]) ** 2)
    return F.when(slope > 0, F.abs(value) / slope)


def line_conic(start: tuple, direction: tuple, c: tuple) -> tuple[Column, Column]:
    """Both parameters of a line of the plane on a conic, ascending for a positive leading term; null if it misses."""
    (x, y), (u, v) = start, direction
    a = c[0] * u * u + c[1] * u * v + c[2] * v * v
    b = 2 * c[0] * x * u + c[1] * (x * v + y * u) + 2 * c[2] * y * v + c[3] * u + c[4] * v
    k = c[0] * x * x + c[1] * x * y + c[2] * y * y + c[3] * x + c[4] * y + c[5]
    return _both_roots(a, b, k)


def conic_of_quadric(c: tuple, z) -> tuple:
    """Conic (xx, xy, yy, x, y, constant) in which the plane at height z cuts a quadric."""
    return c[0], c[3], c[1], c[6] + c[4] * z, c[7] + c[5] * z, c[2] * z * z + c[8] * z + c[9]
