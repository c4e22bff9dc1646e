"""Small matrices and quaternions of columns, row vectors on the left.

A matrix is a tuple of rows; entries are numbers or columns.  Translation sits in
the last row.  Factorisations of matrices held as arrays are numpy in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector import Vector, col, cross, dot, minus, normalize, total

Matrix = tuple
NUMBERS = T.ArrayType(T.DoubleType())


def identity(n: int = 4) -> Matrix:
    return tuple(tuple(1.0 if i == j else 0.0 for j in range(n)) for i in range(n))


def translation(x, y, z) -> Matrix:
    return (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (x, y, z, 1.0)


def scaling(x, y, z, centre: Vector = (0.0, 0.0, 0.0)) -> Matrix:
    """Scale about a centre."""
    factors = (x, y, z)
    rows = [tuple(factors[i] if i == j else 0.0 for j in range(4)) for i in range(3)]
    return (*rows, (*(c * (1 - f) for c, f in zip(centre, factors, strict=True)), 1.0))


def rotation(axis: Vector, angle) -> Matrix:
    """Rotation by ``angle`` about a unit axis through the origin."""
    c, s = (F.cos(angle), F.sin(angle)) if isinstance(angle, Column) else (math.cos(angle), math.sin(angle))
    x, y, z = axis
    t = 1 - c
    return (
        (c + t * x * x, t * x * y + s * z, t * x * z - s * y, 0.0), (t * x * y - s * z, c + t * y * y, t * y * z + s * x, 0.0),
        (t * x * z + s * y, t * y * z - s * x, c + t * z * z, 0.0), (0.0, 0.0, 0.0, 1.0),
    )


def rotation_x(angle) -> Matrix:
    return rotation((1.0, 0.0, 0.0), angle)


def rotation_y(angle) -> Matrix:
    return rotation((0.0, 1.0, 0.0), angle)


def rotation_z(angle) -> Matrix:
    return rotation((0.0, 0.0, 1.0), angle)


def rotation_2d(angle) -> Matrix:
    c, s = (F.cos(angle), F.sin(angle)) if isinstance(angle, Column) else (math.cos(angle), math.sin(angle))
    return (c, s, 0.0), (-s, c, 0.0), (0.0, 0.0, 1.0)


def yaw_pitch_roll(yaw, pitch, roll) -> Matrix:
    return product(product(rotation_z(roll), rotation_x(pitch)), rotation_y(yaw))


def reflection(normal: Vector, d) -> Matrix:
    """Mirror in the plane normal . p = d (unit normal)."""
    rows = [tuple((1.0 if i == j else 0.0) - 2 * normal[i] * normal[j] for j in range(3)) + (0.0,) for i in range(3)]
    return (*rows, (*(2 * d * n for n in normal), 1.0))


def shadow(light: Vector, normal: Vector, d) -> Matrix:
    """Projection along ``light`` onto the plane normal . p = d."""
    slope = dot(light, normal) if any(isinstance(v, Column) for v in (*light, *normal)) else sum(a * b for a, b in zip(light, normal, strict=True))
    rows = [tuple((1.0 if i == j else 0.0) - normal[i] * light[j] / slope for j in range(3)) + (0.0,) for i in range(3)]
    return (*rows, (*(d * v / slope for v in light), 1.0))


def look_at(eye: Vector, target: Vector, up: Vector) -> Matrix:
    back = normalize(minus(eye, target))
    side = normalize(cross(up, back))
    over = cross(back, side)
    rows = [(side[i], over[i], back[i], 0.0) for i in range(3)]
    return (*rows, (-dot(side, eye), -dot(over, eye), -dot(back, eye), 1.0))


def perspective(width, height, near, far) -> Matrix:
    return (2 * near / width, 0.0, 0.0, 0.0), (0.0, 2 * near / height, 0.0, 0.0), (0.0, 0.0, far / (near - far), -1.0), (0.0, 0.0, near * far / (near - far), 0.0)


def orthographic(width, height, near, far) -> Matrix:
    return (2 / width, 0.0, 0.0, 0.0), (0.0, 2 / height, 0.0, 0.0), (0.0, 0.0, 1 / (near - far), 0.0), (0.0, 0.0, near / (near - far), 1.0)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum((row[k] * b[k][j] for k in range(1, len(b))), row[0] * b[0][j]) for j in range(len(b[0]))) for row in a)


def kronecker(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(x * y for x in ra for y in rb) for ra in a for rb in b)


def transpose(a: Matrix) -> Matrix:
    return tuple(zip(*a, strict=True))


def trace(a: Matrix):
    return sum((a[i][i] for i in range(1, len(a))), a[0][0])


def _without(a: Matrix, row: int, column: int) -> Matrix:
    return tuple(tuple(x for j, x in enumerate(r) if j != column) for i, r in enumerate(a) if i != row)


def determinant(a: Matrix):
    """By cofactors; meant for four rows at most."""
    if len(a) == 1:
        return a[0][0]
    if len(a) == 2:
        return a[0][0] * a[1][1] - a[0][1] * a[1][0]
    out = a[0][0] * determinant(_without(a, 0, 0))
    for j in range(1, len(a)):
        part = a[0][j] * determinant(_without(a, 0, j))
        out = out + part if j % 2 == 0 else out - part
    return out


def inverse(a: Matrix) -> Matrix:
    """By cofactors; null entries if singular."""
    n, det = len(a), determinant(a)
    bottom = F.when(det != 0, det) if isinstance(det, Column) else det
    return tuple(tuple((1 if (i + j) % 2 == 0 else -1) * determinant(_without(a, j, i)) / bottom for j in range(n)) for i in range(n))


def is_singular(a: Matrix, tolerance: float = 1e-12) -> Column:
    """Whether the determinant is negligible beside the product of the row lengths."""
    size = F.lit(1.0)
    for row in a:
        size = size * F.sqrt(dot(tuple(col(x) for x in row), row))
    return F.abs(col(determinant(a))) <= tolerance * size


def column(a: Matrix, j: int) -> Vector:
    return tuple(row[j] for row in a)


def solve(a: Matrix, b: Vector) -> Vector:
    """Cramer's rule for up to four unknowns; null if singular."""
    det = determinant(a)
    bottom = F.when(det != 0, det) if isinstance(det, Column) else det
    return tuple(determinant(tuple(tuple(b[i] if j == k else x for j, x in enumerate(row)) for i, row in enumerate(a))) / bottom for k in range(len(b)))


def transform(v: Vector, m: Matrix) -> Vector:
    """Row vector times matrix; a vector one shorter than the matrix is a point."""
    n = len(v)
    point = len(m) == n + 1
    out = [total([v[i] * m[i][j] for i in range(n)] + ([m[n][j]] if point else [])) for j in range(n)]
    if point and any(isinstance(m[i][n], Column) or m[i][n] != (1.0 if i == n else 0.0) for i in range(n + 1)):
        w = total([v[i] * m[i][n] for i in range(n)] + [m[n][n]])
        out = [x / w for x in out]
    return tuple(out)


def transform_direction(v: Vector, m: Matrix) -> Vector:
    """Rotation and scale only."""
    return tuple(total(v[i] * m[i][j] for i in range(len(v))) for j in range(len(v)))


def decompose(m: Matrix) -> tuple[Vector, Matrix, Vector]:
    """(scale, rotation, translation) of a matrix without shear."""
    sizes = tuple(F.sqrt(dot(tuple(col(x) for x in m[i][:3]), m[i][:3])) for i in range(3))
    sizes = (*sizes[:2], F.when(col(determinant(tuple(r[:3] for r in m[:3]))) < 0, -sizes[2]).otherwise(sizes[2]))
    return sizes, tuple(tuple(m[i][j] / sizes[i] for j in range(3)) for i in range(3)), tuple(m[3][:3])


def from_quaternion(q: Vector) -> Matrix:
    """Rotation of a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w), 0.0), (2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w), 0.0),
        (2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y), 0.0), (0.0, 0.0, 0.0, 1.0),
    )


def to_quaternion(m: Matrix) -> Vector:
    """Unit quaternion of a rotation: magnitudes from the diagonal, signs from the rest."""
    d = [col(m[i][i]) for i in range(3)]

    def half(a, b, c):
        return F.sqrt(F.greatest(F.lit(0.0), 1 + a + b + c)) / 2

    w, x, y, z = half(d[0], d[1], d[2]), half(d[0], -d[1], -d[2]), half(-d[0], d[1], -d[2]), half(-d[0], -d[1], d[2])

    def signed(size, value):
        return F.when(col(value) < 0, -size).otherwise(size)

    return signed(x, m[1][2] - m[2][1]), signed(y, m[2][0] - m[0][2]), signed(z, m[0][1] - m[1][0]), w


def quaternion_product(a: Vector, b: Vector) -> Vector:
    """The rotation ``a`` and then ``b``."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return bw * ax + bx * aw + by * az - bz * ay, bw * ay - bx * az + by * aw + bz * ax, bw * az + bx * ay - by * ax + bz * aw, bw * aw - bx * ax - by * ay - bz * az


def _batch(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        def one(flat):
            if flat is None:
                return None
            n = math.isqrt(len(flat))
            try:
                return function(np.asarray(flat, dtype=np.float64).reshape(n, n))
            except np.linalg.LinAlgError:
                return None

        return values.map(one)

    return run


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Padé quotient of order six, and squaring."""
    norm = float(np.abs(a).sum(axis=1).max())
    halvings = max(0, math.ceil(math.log2(norm)) + 1) if norm > 0 else 0
    x = a / 2**halvings
    top = bottom = np.eye(len(a))
    power, weight = np.eye(len(a)), 1.0
    for k in range(1, 7):
        weight *= (7 - k) / (k * (13 - k))
        power = power @ x
        top = top + weight * power
        bottom = bottom + (weight if k % 2 == 0 else -weight) * power
    out = np.linalg.solve(bottom, top)
    for _ in range(halvings):
        out = out @ out
    return out


def lu(a: np.ndarray) -> np.ndarray:
    """Both factors in one matrix, without row exchanges; the lower one has a unit diagonal."""
    out = a.copy()
    for k in range(len(out)):
        if out[k, k] == 0:
            raise np.linalg.LinAlgError
        out[k + 1 :, k] /= out[k, k]
        out[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k, k + 1 :])
    return out


def eigenvectors(a: np.ndarray) -> list[float]:
    values, vectors = np.linalg.eigh(a)
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))]
    return [*values.tolist(), *(vectors * np.sign(lead)).T.ravel().tolist()]


#: Row-major square matrices as array<double> in, arrays out; null for matrices that have no answer.
array_inverse = _batch(lambda a: np.linalg.inv(a).ravel().tolist(), NUMBERS)
array_determinant = _batch(lambda a: float(np.linalg.det(a)), T.DoubleType())
array_lu = _batch(lambda a: lu(a).ravel().tolist(), NUMBERS)
array_cholesky = _batch(lambda a: np.linalg.cholesky(a).ravel().tolist(), NUMBERS)
array_exponential = _batch(lambda a: expm(a).ravel().tolist(), NUMBERS)
array_eigenvalues = _batch(lambda a: sorted(float(v.real) for v in np.linalg.eigvals(a) if abs(v.imag) < 1e-9), NUMBERS)
#: of symmetric matrices: ascending eigenvalues, then the unit eigenvectors one after the other, largest entry positive
array_eigenvectors = _batch(lambda a: eigenvectors(a), NUMBERS)
array_singular_values = _batch(lambda a: np.linalg.svd(a, compute_uv=False).tolist(), NUMBERS)
