"""Rectangles and boxes as pairs of corner vectors of columns, and boxes turned in space."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import Vector, col, cross, dot, length_squared, minus

Box = tuple  # low, high


def size(box: Box) -> Column:
    """Area or volume."""
    return reduce(lambda a, b: a * b, [col(h) - col(l) for l, h in zip(*box, strict=True)])


def common(a: Box, b: Box) -> Column:
    """Area or volume that two boxes share."""
    sides = [F.greatest(F.least(col(h1), col(h2)) - F.greatest(col(l1), col(l2)), F.lit(0.0)) for l1, h1, l2, h2 in zip(*a, *b, strict=True)]
    return reduce(lambda x, y: x * y, sides)


def difference(a: Box, b: Box) -> Column:
    """What of ``a`` lies outside ``b``."""
    return size(a) - common(a, b)


def union(a: Box, b: Box) -> Box:
    """Least box about two."""
    return tuple(F.least(col(x), col(y)) for x, y in zip(a[0], b[0], strict=True)), tuple(F.greatest(col(x), col(y)) for x, y in zip(a[1], b[1], strict=True))


def offset(a: Box, amount) -> Box:
    return tuple(x - amount for x in a[0]), tuple(x + amount for x in a[1])


def expand(a: Box, p: Vector) -> Box:
    """Least box about a box and a point."""
    return union(a, (p, p))


def move_face(a: Box, axis: int, high: bool, amount) -> Box:
    """A box with one face moved outward."""
    low, top = list(a[0]), list(a[1])
    if high:
        top[axis] = top[axis] + amount
    else:
        low[axis] = low[axis] - amount
    return tuple(low), tuple(top)


def sides_in_order(a: Box) -> list[Column]:
    """Side lengths from short to long."""
    whole = F.array_sort(F.array(*[col(h) - col(l) for l, h in zip(*a, strict=True)]))
    return [F.get(whole, F.lit(i)) for i in range(len(a[0]))]


def in_turned_box(p: Vector, corner: Vector, edges: tuple[Vector, Vector, Vector]) -> Column:
    """Whether a point lies in the box of a corner and three edge vectors that are square to each other."""
    rest = minus(p, corner)
    return reduce(lambda a, b: a & b, [(dot(rest, e) >= 0) & (dot(rest, e) <= length_squared(e)) for e in edges])


def turned_boxes_meet(centre1: Vector, half1: tuple, centre2: Vector, half2: tuple) -> Column:
    """Whether two boxes of centres and half-edge vectors meet: no axis of the fifteen parts them."""
    gap = minus(centre2, centre1)
    axes = [*half1, *half2, *[cross(a, b) for a in half1 for b in half2]]
    apart = []
    for axis in axes:
        reach = reduce(lambda a, b: a + b, [F.abs(col(dot(axis, h))) for h in (*half1, *half2)])
        apart.append(F.abs(col(dot(axis, gap))) > reach + 1e-12)
    return ~reduce(lambda a, b: a | b, apart)


def along_line(start: Vector, direction: Vector, points: list[Vector]) -> tuple[Column, Column, Column]:
    """Least closed cylinder along a line about points: first and last height, and radius."""
    unit_square = length_squared(direction)
    heights = [dot(minus(p, start), direction) / F.sqrt(unit_square) for p in points]
    reach = [F.sqrt(length_squared(cross(minus(p, start), direction)) / unit_square) for p in points]
    return F.least(*heights), F.greatest(*heights), F.greatest(*reach)
