"""Vectors as tuples of columns; every function gives columns, none is a UDF.

A vector is ``(x, y)``, ``(x, y, z)`` or ``(x, y, z, w)``.  Numbers may stand for columns.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple
COS_ONE_DEGREE = math.cos(math.radians(1))
SIN_ONE_DEGREE = math.sin(math.radians(1))
EQUAL = 1e-12


def col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def vector(*names: str) -> Vector:
    """The named columns as a vector."""
    return tuple(F.col(n) for n in names)


def total(parts) -> Column:
    return reduce(add, [col(p) for p in parts])


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, s) -> Vector:
    return tuple(x * s for x in a)


def componentwise(a: Vector, b: Vector) -> Vector:
    return tuple(x * y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return total(x * y for x, y in zip(a, b, strict=True))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def cross2(a: Vector, b: Vector) -> Column:
    """Signed area of the parallelogram of two plane vectors."""
    return a[0] * b[1] - a[1] * b[0]


def triple(a: Vector, b: Vector, c: Vector) -> Column:
    return dot(a, cross(b, c))


def cross4(a: Vector, b: Vector, c: Vector) -> Vector:
    """The 4-D vector normal to three others (cofactors of the matrix they span)."""
    out = []
    for skip in range(4):
        keep = [i for i in range(4) if i != skip]
        part = [tuple(v[i] for i in keep) for v in (a, b, c)]
        value = triple(*part)
        out.append(value if skip % 2 == 0 else -value)
    return tuple(out)


def length_squared(a: Vector) -> Column:
    return dot(a, a)


def length(a: Vector) -> Column:
    return F.sqrt(length_squared(a))


def distance_squared(a: Vector, b: Vector) -> Column:
    return length_squared(minus(a, b))


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(distance_squared(a, b))


def normalize(a: Vector) -> Vector:
    """Unit vector; null for the zero vector."""
    n = length(a)
    return tuple(F.when(n > 0, x / n) for x in a)


def reflect(v: Vector, normal: Vector) -> Vector:
    d = dot(v, normal)
    return tuple(x - 2 * d * n for x, n in zip(v, normal, strict=True))


def clamp(v: Vector, low: Vector, high: Vector) -> Vector:
    return tuple(F.least(F.greatest(col(x), col(a)), col(b)) for x, a, b in zip(v, low, high, strict=True))


def lerp(a: Vector, b: Vector, t) -> Vector:
    return tuple(x + (y - x) * t for x, y in zip(a, b, strict=True))


def slerp(a: Vector, b: Vector, t) -> Vector:
    """Between two unit vectors along the great circle; linear where they nearly agree."""
    angle = F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0)))
    sine = F.sin(angle)
    flat = sine < 1e-9
    first, second = F.sin((1 - col(t)) * angle) / sine, F.sin(col(t) * angle) / sine
    return tuple(F.when(flat, x + (y - x) * t).otherwise(first * x + second * y) for x, y in zip(a, b, strict=True))


def least(a: Vector, b: Vector) -> Vector:
    return tuple(F.least(col(x), col(y)) for x, y in zip(a, b, strict=True))


def greatest(a: Vector, b: Vector) -> Vector:
    return tuple(F.greatest(col(x), col(y)) for x, y in zip(a, b, strict=True))


def absolute(a: Vector) -> Vector:
    return tuple(F.abs(x) for x in a)


def square_root(a: Vector) -> Vector:
    return tuple(F.sqrt(x) for x in a)


def cosine(a: Vector, b: Vector) -> Column:
    return dot(a, b) / (length(a) * length(b))


def is_aligned(a: Vector, b: Vector, limit: float = COS_ONE_DEGREE) -> Column:
    return cosine(a, b) >= limit


def is_aligned_or_reverse(a: Vector, b: Vector, limit: float = COS_ONE_DEGREE) -> Column:
    return F.abs(cosine(a, b)) >= limit


def is_perpendicular(a: Vector, b: Vector, limit: float = SIN_ONE_DEGREE) -> Column:
    return F.abs(cosine(a, b)) <= limit


def merge_axes(a: Vector, b: Vector) -> Vector:
    """Mean direction of two axes whose signs do not matter."""
    sign = F.when(dot(a, b) < 0, -1.0).otherwise(1.0)
    return normalize(plus(a, scale(b, sign)))


def practically_same(a, b, tolerance: float = EQUAL) -> Column:
    return F.abs(col(a) - b) <= tolerance


def negligible(a, tolerance: float = EQUAL) -> Column:
    return F.abs(col(a)) <= tolerance


def clearly_greater(a, b, tolerance: float = EQUAL) -> Column:
    return col(a) - b > tolerance


def clearly_less(a, b, tolerance: float = EQUAL) -> Column:
    return col(b) - a > tolerance


def pseudo_angle(x: Column, y: Column) -> Column:
    """Grows with the direction's angle, from 0 to 4 around the circle, without trigonometry."""
    size = F.abs(x) + F.abs(y)
    ratio = F.when(size > 0, y / size)
    return F.when(x < 0, 2 - ratio).when(y < 0, 4 + ratio).otherwise(ratio)


def to_spherical(a: Vector) -> tuple[Column, Column, Column]:
    """Radius, polar angle from +z, azimuth from +x."""
    radius = length(a)
    return radius, F.acos(a[2] / radius), F.atan2(a[1], a[0])


def from_spherical(radius, polar: Column, azimuth: Column) -> Vector:
    return radius * F.sin(polar) * F.cos(azimuth), radius * F.sin(polar) * F.sin(azimuth), radius * F.cos(polar)


def snap_to_axis(a: Vector, limit: float = COS_ONE_DEGREE) -> Column:
    """Name of the Cartesian direction within the limit, else null."""
    unit = normalize(a)
    found = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate("XYZ"))):
        found = F.when(unit[i] >= limit, f"{name}Positive").when(unit[i] <= -limit, f"{name}Negative").otherwise(found)
    return found


def perpendicular(a: Vector) -> Vector:
    """A unit vector normal to ``a``, the same one for the same input."""
    x, y, z = a
    side = F.abs(y) < 0.9 * length(a)
    other = tuple(F.when(side, p).otherwise(q) for p, q in ((0.0, 1.0), (1.0, 0.0), (0.0, 0.0)))
    return normalize(cross(other, a))


def smaller_angle(a: Vector, b: Vector) -> Column:
    """Angle between directions, 0 to pi."""
    return F.acos(F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0)))


def ccw_angle(a: Vector, b: Vector) -> Column:
    """Counter-clockwise angle from ``a`` to ``b`` in the plane, 0 to 2 pi."""
    angle = F.atan2(cross2(a, b), dot(a, b))
    return F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)


def segment_foot(p: Vector, a: Vector, b: Vector) -> tuple[Vector, Column]:
    """Nearest point of a segment and its parameter."""
    along = minus(b, a)
    square = length_squared(along)
    t = F.when(square > 0, F.least(F.greatest(dot(minus(p, a), along) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return tuple(x + t * d for x, d in zip(a, along, strict=True)), t


def point_segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    return distance(p, segment_foot(p, a, b)[0])


def on_segment(p: Vector, a: Vector, b: Vector, tolerance: float = 1e-9) -> Column:
    return point_segment_distance(p, a, b) <= tolerance


def point_line_distance(p: Vector, anchor: Vector, direction: Vector) -> Column:
    """Distance to an infinite line, in two or three dimensions."""
    rest = minus(p, anchor)
    along = dot(rest, direction) / length_squared(direction)
    return length(minus(rest, scale(direction, along)))


def segment_meeting(a: Vector, b: Vector, c: Vector, d: Vector) -> tuple[Column, Column, Column]:
    """(whether segments ab and cd of the plane meet, parameter on ab, parameter on cd); null if parallel."""
    ab, cd, ac = minus(b, a), minus(d, c), minus(c, a)
    bottom = cross2(ab, cd)
    t, u = F.when(bottom != 0, cross2(ac, cd) / bottom), F.when(bottom != 0, cross2(ac, ab) / bottom)
    return F.coalesce((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.lit(False)), t, u


def line_meeting(a: Vector, da: Vector, b: Vector, db: Vector) -> Vector:
    """Point of two infinite lines of the plane, null if parallel."""
    bottom = cross2(da, db)
    t = F.when(bottom != 0, cross2(minus(b, a), db) / bottom)
    return plus(a, scale(da, t))


def skew_lines(a: Vector, da: Vector, b: Vector, db: Vector) -> tuple[Column, Vector, Vector]:
    """Least distance of two lines in space and the feet on each; null if parallel."""
    rest = minus(b, a)
    aa, bb, ab = dot(da, da), dot(db, db), dot(da, db)
    bottom = aa * bb - ab * ab
    t = F.when(bottom > 0, (dot(rest, da) * bb - dot(rest, db) * ab) / bottom)
    u = F.when(bottom > 0, (dot(rest, da) * ab - dot(rest, db) * aa) / bottom)
    first, second = plus(a, scale(da, t)), plus(b, scale(db, u))
    return distance(first, second), first, second


def triangle_hit(start: Vector, direction: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Parameter at which a line meets a triangle, null if it misses it."""
    e1, e2, s = minus(b, a), minus(c, a), minus(start, a)
    h = cross(direction, e2)
    det = dot(e1, h)
    u, q = dot(s, h) / det, cross(s, e1)
    v = dot(direction, q) / det
    return F.when((det != 0) & (u >= 0) & (v >= 0) & (u + v <= 1), dot(e2, q) / det)


def in_triangle(p: Vector, a: Vector, b: Vector, c: Vector, edge_counts: bool = True) -> Column:
    """Whether a point of the triangle's plane lies in it."""
    sides = [dot(cross(minus(y, x), minus(p, x)), cross(minus(b, a), minus(c, a))) for x, y in ((a, b), (b, c), (c, a))]
    return reduce(lambda x, y: x & y, [s >= 0 if edge_counts else s > 0 for s in sides])


def nearest_on_triangle(p: Vector, a: Vector, b: Vector, c: Vector) -> Vector:
    """Nearest point of a triangle: the projection if it lies inside, else the nearest edge foot."""
    normal = cross(minus(b, a), minus(c, a))
    size = dot(normal, normal)
    lift = dot(minus(p, a), normal) / size
    flat = minus(p, scale(normal, lift))
    inside = in_triangle(flat, a, b, c) & (size > 0)
    feet = [segment_foot(p, x, y)[0] for x, y in ((a, b), (b, c), (c, a))]
    gaps = [distance_squared(p, f) for f in feet]
    best = F.least(*gaps)
    edge = [F.when(gaps[0] == best, f0).when(gaps[1] == best, f1).otherwise(f2) for f0, f1, f2 in zip(*feet, strict=True)]
    return tuple(F.when(inside, x).otherwise(y) for x, y in zip(flat, edge, strict=True))


def plane_of(a: Vector, b: Vector, c: Vector) -> tuple[Vector, Column]:
    """Unit normal and distance of the plane through three points."""
    normal = normalize(cross(minus(b, a), minus(c, a)))
    return normal, dot(normal, a)


def plane_distance(p: Vector, normal: Vector, d) -> Column:
    return dot(p, normal) - d


def project_to_plane(p: Vector, normal: Vector, d) -> Vector:
    """Nearest point of a plane: the signed distance is taken off along the normal."""
    return minus(p, scale(normal, plane_distance(p, normal, d)))


def line_plane(start: Vector, direction: Vector, normal: Vector, d) -> Column:
    """Line parameter on a plane, null if parallel."""
    slope = dot(direction, normal)
    return F.when(slope != 0, (d - dot(start, normal)) / slope)


def planes_point(n1: Vector, d1, n2: Vector, d2, n3: Vector, d3) -> Vector:
    """Point common to three planes, null if there is no single one."""
    det = triple(n1, n2, n3)
    parts = plus(plus(scale(cross(n2, n3), d1), scale(cross(n3, n1), d2)), scale(cross(n1, n2), d3))
    return tuple(F.when(det != 0, x / det) for x in parts)


def planes_line(n1: Vector, d1, n2: Vector, d2) -> tuple[Vector, Vector]:
    """(point, direction) of the line common to two planes."""
    along = cross(n1, n2)
    return planes_point(n1, d1, n2, d2, along, F.lit(0.0)), along


def circles_meeting(c1: Vector, r1, c2: Vector, r2) -> tuple[Vector, Vector]:
    """Both points of two circles, null if they do not meet."""
    gap = distance(c1, c2)
    along = (gap * gap + r1 * r1 - r2 * r2) / (2 * gap)
    height = r1 * r1 - along * along
    side = F.when((gap > 0) & (height >= 0), F.sqrt(height))
    unit = tuple(x / gap for x in minus(c2, c1))
    foot = plus(c1, scale(unit, along))
    return (foot[0] - side * unit[1], foot[1] + side * unit[0]), (foot[0] + side * unit[1], foot[1] - side * unit[0])


def in_box(p: Vector, low: Vector, high: Vector, edge_counts: bool = True) -> Column:
    tests = [(x >= a) & (x <= b) if edge_counts else (x > a) & (x < b) for x, a, b in zip(p, low, high, strict=True)]
    return reduce(lambda x, y: x & y, tests)


def boxes_overlap(low1: Vector, high1: Vector, low2: Vector, high2: Vector) -> Column:
    """Whether two boxes share an inner point."""
    return reduce(lambda x, y: x & y, [(a < d) & (c < b) for a, b, c, d in zip(low1, high1, low2, high2, strict=True)])


def most_orthogonal(candidates: list, a: Vector) -> Column:
    """Index of the candidate direction whose cosine with ``a`` is nearest zero; ties to the first."""
    sizes = [F.abs(dot(tuple(map(col, c)), a)) / math.sqrt(sum(x * x for x in c)) for c in candidates]
    best, out = F.least(*sizes), F.lit(len(candidates) - 1)
    for i in range(len(candidates) - 2, -1, -1):
        out = F.when(sizes[i] == best, i).otherwise(out)
    return out


def line_circle(start: Vector, unit: Vector, centre: Vector, radius) -> tuple[Column, Column]:
    """Both parameters along a unit direction of the plane, ascending; null if the line misses the circle."""
    rest = minus(start, centre)
    along = dot(rest, unit)
    inner = along * along - (dot(rest, rest) - radius * radius)
    root = F.sqrt(F.when(inner >= 0, inner))
    return -along - root, -along + root


def plane_axes(normal: Vector) -> tuple[Vector, Vector]:
    """Two unit directions that complete a unit normal to a right-handed frame."""
    u = perpendicular(normal)
    return u, cross(normal, u)


def to_plane(p: Vector, normal: Vector) -> tuple[Column, Column, Column]:
    """Coordinates in the plane through the origin with a unit normal, and the height over it."""
    u, v = plane_axes(normal)
    return dot(p, u), dot(p, v), dot(p, normal)


def from_plane(uv: tuple, normal: Vector, height, axes: tuple[Vector, Vector] | None = None) -> Vector:
    """The point in space of plane coordinates and a height; ``axes`` are those of ``plane_axes`` if at hand."""
    u, v = axes or plane_axes(normal)
    return tuple(uv[0] * a + uv[1] * b + height * n for a, b, n in zip(u, v, normal, strict=True))
