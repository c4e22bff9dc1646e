"""Statistics and least-squares fits as grouped aggregations: power sums first, then a closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summary(rows: DataFrame, group: str, value: str, target: float = 0.0) -> DataFrame:
    """n, mean, median, population variance, deviation from the median, RMSE to a target and its normalised form."""
    mid = rows.groupBy(group).agg(F.median(value).alias("median"))
    rmse = F.sqrt(F.avg((F.col(value) - target) ** 2))
    return rows.join(mid, group).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.first("median").alias("median"), F.var_pop(value).alias("variance"),
        F.avg((F.col(value) - F.col("median")) ** 2).alias("median_variance"), rmse.alias("rmse"), F.try_divide(rmse, F.max(value) - F.min(value)).alias("nrmse"),
    )


def nth(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n-th least value counted from 0, infinity if there is none.

    A distributed rank: values are counted, summed in order, and the first whose running count exceeds n is taken.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    running = F.sum("c").over(Window.partitionBy(group).orderBy(value))
    found = counts.withColumn("r", running).where(F.col("r") > n).groupBy(group).agg(F.min(value).alias("nth"))
    return rows.select(group).distinct().join(found, group, "left").select(group, F.coalesce(F.col("nth").cast("double"), F.lit(float("inf"))).alias("nth"))


def welch(a: str, b: str) -> tuple[Column, Column]:
    """(t, degrees of freedom) from columns {a,b}_{mean,var,n} with population variances."""
    part = [F.col(f"{s}_var") / (F.col(f"{s}_n") - 1) for s in (a, b)]
    t = (F.col(f"{a}_mean") - F.col(f"{b}_mean")) / F.sqrt(part[0] + part[1])
    freedom = (part[0] + part[1]) ** 2 / (part[0] ** 2 / (F.col(f"{a}_n") - 1) + part[1] ** 2 / (F.col(f"{b}_n") - 1))
    return t, freedom


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_tail(t: float, freedom: float) -> float:
    """Two-tailed p of Student's t."""
    x = freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    a, b = freedom / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def t_probability(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) if a == a and b == b else None for a, b in zip(t, freedom, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))


def line_fit(points: DataFrame, group: str) -> DataFrame:
    """y = slope x + intercept per group, with the coefficient of determination."""
    return points.groupBy(group).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def circle_fit(points: DataFrame, group: str) -> DataFrame:
    """Least-squares circle from nine sums about the mean: centre and radius."""
    middle = points.groupBy(group).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = points.join(middle, group).groupBy(group).agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.count("*").alias("n"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(u * u * u).alias("uuu"), F.sum(v * v * v).alias("vvv"), F.sum(u * v * v).alias("uvv"), F.sum(v * u * u).alias("vuu"),
    )
    right = ((F.col("uuu") + F.col("uvv")) / 2, (F.col("vvv") + F.col("vuu")) / 2)
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    cu, cv = F.try_divide(right[0] * F.col("vv") - right[1] * F.col("uv"), det), F.try_divide(right[1] * F.col("uu") - right[0] * F.col("uv"), det)
    return sums.select(group, (cu + F.col("mx")).alias("cx"), (cv + F.col("my")).alias("cy"), F.sqrt(cu * cu + cv * cv + (F.col("uu") + F.col("vv")) / F.col("n")).alias("radius"))


POWERS = [(i, j, k) for i in range(5) for j in range(5) for k in range(5) if 0 <= i + j + k <= 4]


def moments(points: DataFrame, group: str, order: int = 4) -> DataFrame:
    """Sums of x^i y^j z^k up to an order, one pass; what the fits below start from."""
    def power(c: str, n: int) -> Column:
        out = F.lit(1.0)
        for _ in range(n):
            out = out * F.col(c)
        return out

    return points.groupBy(group).agg(*[F.sum(power("x", i) * power("y", j) * power("z", k)).alias(f"m{i}{j}{k}") for i, j, k in POWERS if i + j + k <= order])


def central_moments(points: DataFrame, group: str, order: int) -> DataFrame:
    """``moments`` about the group's mean, with the mean as mx, my, mz.

    Powers of raw coordinates lose all digits away from the origin; about the mean
    they keep them.  A row of a null coordinate takes no part.
    """
    points = points.where(" AND ".join(f"{c} IS NOT NULL" for c in "xyz"))
    middle = points.groupBy(F.col(group).alias("_group")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    near = points.join(middle, F.col(group).eqNullSafe(F.col("_group"))).select(group, *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    sums = moments(near, group, order)
    return sums.join(middle, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def _mean(row: dict) -> np.ndarray:
    return np.array([row["mx"], row["my"], row["mz"]])


def _solve_rows(table: DataFrame, schema: str, function) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [function(row) for row in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return table.mapInPandas(run, schema)


def plane_fit(points: DataFrame, group: str) -> DataFrame:
    """Plane of least squared distance per group: unit normal, distance (not negative), mean squared error."""
    kind = dict(points.dtypes)[group]

    def one(row: dict) -> tuple:
        n = row["m000"]
        mean = np.array([row["m100"], row["m010"], row["m001"]]) / n
        second = np.array([[row["m200"], row["m110"], row["m101"]], [row["m110"], row["m020"], row["m011"]], [row["m101"], row["m011"], row["m002"]]]) / n
        values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
        normal = vectors[:, 0]
        d = float(normal @ (mean + _mean(row)))
        lead = normal[np.argmax(np.abs(normal))]
        if d < 0 or (d == 0 and lead < 0):
            normal, d = -normal, -d
        return row[group], *map(float, normal), d, max(0.0, float(values[0]))

    return _solve_rows(central_moments(points, group, 2), f"{group} {kind}, nx double, ny double, nz double, d double, mse double", one)


def sphere_fit(points: DataFrame, group: str) -> DataFrame:
    """Algebraic least-squares sphere per group; nulls where the points lie in a plane."""
    kind = dict(points.dtypes)[group]

    def one(row: dict) -> tuple:
        names = ("100", "010", "001", "000")
        left = np.array([[row["m" + "".join(str(int(a) + int(b)) for a, b in zip(p, q, strict=True))] for q in names] for p in names])
        right = np.array([sum(row["m" + "".join(str(int(a) + int(b)) for a, b in zip(p, q, strict=True))] for q in ("200", "020", "002")) for p in names])
        try:
            a = np.linalg.solve(left, right)
        except np.linalg.LinAlgError:
            return row[group], None, None, None, None
        centre = a[:3] / 2
        return row[group], *map(float, centre + _mean(row)), float(np.sqrt(max(0.0, a[3] + centre @ centre)))

    return _solve_rows(central_moments(points, group, 3), f"{group} {kind}, cx double, cy double, cz double, radius double", one)


def _shifted(c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Unit coefficients (squares, products xy, xz, yz, linear, constant) in x of a quadric given in x - m."""
    square = np.array([[c[0], c[3] / 2, c[4] / 2], [c[3] / 2, c[1], c[5] / 2], [c[4] / 2, c[5] / 2, c[2]]])
    out = np.concatenate([c[:6], c[6:9] - 2 * square @ m, [c[9] - c[6:9] @ m + m @ square @ m]])
    return out / np.linalg.norm(out)


def quadric_fit(points: DataFrame, group: str) -> DataFrame:
    """Quadric of least algebraic error about the group's mean: the null direction of the moment matrix, in raw coordinates with unit coefficients."""
    kind = dict(points.dtypes)[group]
    names = ("200", "020", "002", "110", "101", "011", "100", "010", "001", "000")

    def one(row: dict) -> tuple:
        left = np.array([[row["m" + "".join(str(int(a) + int(b)) for a, b in zip(p, q, strict=True))] for q in names] for p in names])
        _, vectors = np.linalg.eigh(left)
        c = _shifted(vectors[:, 0], _mean(row))
        return row[group], (c * np.sign(c[np.argmax(np.abs(c))])).tolist()

    return _solve_rows(central_moments(points, group, 4), f"{group} {kind}, coefficients array<double>", one)


def inertia_axes(points: DataFrame, group: str) -> DataFrame:
    """Line of least squared distance per group: centre and unit direction."""
    kind = dict(points.dtypes)[group]

    def one(row: dict) -> tuple:
        n = row["m000"]
        mean = np.array([row["m100"], row["m010"], row["m001"]]) / n
        second = np.array([[row["m200"], row["m110"], row["m101"]], [row["m110"], row["m020"], row["m011"]], [row["m101"], row["m011"], row["m002"]]]) / n
        _, vectors = np.linalg.eigh(second - np.outer(mean, mean))
        v = vectors[:, 2]
        return row[group], *map(float, mean + _mean(row)), *map(float, v * np.sign(v[np.argmax(np.abs(v))]))

    return _solve_rows(central_moments(points, group, 2), f"{group} {kind}, cx double, cy double, cz double, dx double, dy double, dz double", one)


def point_to_lines(lines: DataFrame, group: str) -> DataFrame:
    """Point of least squared distance to lines (px, py, pz) along unit (wx, wy, wz) per group: normal equations from twelve sums."""
    kind = dict(lines.dtypes)[group]
    p, w = [F.col(f"p{a}") for a in "xyz"], [F.col(f"w{a}") for a in "xyz"]
    along = sum((a * b for a, b in zip(p[1:], w[1:], strict=True)), p[0] * w[0])
    sums = lines.groupBy(group).agg(
        *[F.sum((1.0 if i == j else 0.0) - w[i] * w[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)], *[F.sum(p[i] - along * w[i]).alias(f"b{i}") for i in range(3)]
    )

    def one(row: dict) -> tuple:
        left = np.array([[row[f"a{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
        return row[group], *map(float, np.linalg.lstsq(left, np.array([row[f"b{i}"] for i in range(3)]), rcond=None)[0])

    return _solve_rows(sums, f"{group} {kind}, x double, y double, z double", one)


def axis_from_normals(normals: DataFrame, group: str) -> DataFrame:
    """Unit direction (dx, dy, dz) per group that is most square to unit vectors (x, y, z): of least second moment about the origin."""
    kind = dict(normals.dtypes)[group]

    def one(row: dict) -> tuple:
        second = np.array([[row["m200"], row["m110"], row["m101"]], [row["m110"], row["m020"], row["m011"]], [row["m101"], row["m011"], row["m002"]]])
        v = np.linalg.eigh(second)[1][:, 0]
        return row[group], *map(float, v * np.sign(v[np.argmax(np.abs(v))]))

    return _solve_rows(moments(normals, group, 2), f"{group} {kind}, dx double, dy double, dz double", one)
