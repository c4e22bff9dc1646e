"""Complex numbers as pairs of columns (real, imaginary)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Complex = tuple


def multiply(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def reciprocal(a: Complex) -> Complex:
    """1 / a; null for zero."""
    size = a[0] * a[0] + a[1] * a[1]
    bottom = F.when(size > 0, size)
    return a[0] / bottom, -a[1] / bottom


def divide(a: Complex, b: Complex) -> Complex:
    return multiply(a, reciprocal(b))


def power(a: Complex, exponent: float) -> Complex:
    """Principal value, by size and angle."""
    size, angle = (a[0] * a[0] + a[1] * a[1]) ** (exponent / 2), F.atan2(a[1], a[0]) * exponent
    return size * F.cos(angle), size * F.sin(angle)


def square_root(a: Complex) -> Complex:
    return power(a, 0.5)


def cube_root(a: Complex) -> Complex:
    return power(a, 1 / 3)


def cubic_real_roots(b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Ascending roots of x^3 + b x^2 + c x + d where all three are real (three angles of one cosine); null elsewhere."""
    shift = b / 3
    p, q = c - b * b / 3, 2 * b * b * b / 27 - b * c / 3 + d
    reach = 2 * F.sqrt(F.greatest(-p / 3, F.lit(0.0)))
    ratio = F.when(reach > 0, 3 * q / (F.when(p != 0, p) * reach)).otherwise(0.0)
    angle = F.acos(F.when(F.abs(ratio) <= 1 + 1e-12, F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0)))) / 3
    turns = [reach * F.cos(angle - 2 * math.pi * k / 3) - shift for k in (2, 1, 0)]
    low, high = F.least(*turns), F.greatest(*turns)
    return low, turns[0] + turns[1] + turns[2] - low - high, high
