"""Real roots of polynomials, and where conics meet, as column expressions.

Between two neighbouring roots of its derivative a polynomial rises or falls
throughout, so a change of sign there is one root, which bisection finds; a root of the
derivative where the value is as good as zero is a multiple root.  Derivatives are solved
first, down to the linear one.  All of it is higher-order functions, with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 90
#: Value, against the sum of the terms' sizes, that counts as zero at a multiple root.
ZERO = 1e-11
#: Roots closer than this, against their size, are one.
SAME = 1e-7


def held(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with more columns that later expressions refer to and do not repeat: a generator of one row stops the optimizer from putting them in."""
    one = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_held")
    return rows.select("*", one).select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("_held")[n].alias(n) for n in values])


def value(coefficients: Column, x: Column) -> Column:
    """Value of a polynomial, coefficients from the highest power down."""
    return F.aggregate(coefficients, F.lit(0.0), lambda total, c: total * x + c)


def derivative(coefficients: Column, degree: int) -> Column:
    return F.transform(F.slice(coefficients, 1, degree), lambda c, i: c * (F.lit(degree) - i))


def _level(rows: DataFrame, coefficients: str, degree: int, inner: str | None, name: str) -> DataFrame:
    """Adds the roots ``name`` of a polynomial of a degree, from those of its derivative."""
    c = F.col(coefficients)
    sizes = F.transform(c, lambda x: F.abs(x))
    lead = F.abs(F.get(F.filter(c, lambda x: x != 0), F.lit(0)))
    # no root lies beyond; without coefficients the bound is null, and so are the roots
    reach = 1 + F.try_divide(F.array_max(sizes), lead)
    middle = F.filter(F.col(inner), lambda x: F.abs(x) < F.col("_reach")) if inner else F.array().cast("array<double>")
    rows = held(rows, _reach=reach)
    rows = held(rows, _at=F.concat(F.array(-F.col("_reach")), middle, F.array(F.col("_reach"))))

    def half(pair: Column, _: Column) -> Column:
        m = (pair["low"] + pair["high"]) / 2
        same = F.signum(value(c, m)) == pair["sign"]
        return F.struct(F.when(same, m).otherwise(pair["low"]).alias("low"), F.when(same, pair["high"]).otherwise(m).alias("high"), pair["sign"].alias("sign"))

    def between(low: Column, i: Column) -> Column:
        high = F.get(F.col("_at"), i + 1)
        s, t = F.signum(value(c, low)), F.signum(value(c, high))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(low.alias("low"), high.alias("high"), s.alias("sign")), half, lambda p: (p["low"] + p["high"]) / 2)
        return F.when(s * t < 0, found)

    simple = F.transform(F.slice("_at", 1, F.size("_at") - 1), between)
    double = F.filter(middle, lambda x: F.abs(value(c, x)) <= ZERO * F.aggregate(sizes, F.lit(0.0), lambda total, k: total * F.abs(x) + k))
    # multiple roots come before simple ones as good as equal to them
    every = F.array_sort(F.concat(F.array_compact(simple), double))
    rows = held(rows, _all=every)

    def apart(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        return F.when((F.size(kept) > 0) & (F.abs(x - last) <= SAME * (1 + F.abs(x))), kept).otherwise(F.concat(kept, F.array(x)))

    return held(rows, **{name: F.aggregate("_all", F.array().cast("array<double>"), apart)}).drop("_reach", "_at", "_all")


def with_real_roots(rows: DataFrame, name: str, coefficients: list[Column]) -> DataFrame:
    """``rows`` with the distinct real roots, ascending, of polynomials given from the highest power down.

    Leading coefficients may be zero.  The roots are null if a coefficient is null or
    not a number, or if all are zero; a constant has none.
    """
    degree = len(coefficients) - 1
    usable = F.col("_c0")
    rows = held(rows, _c0=F.array(*[c.cast("double") for c in coefficients]))
    good = ~F.exists(usable, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(usable, lambda c: c != 0)
    rows = held(rows, _p0=F.when(good, usable)).drop("_c0")
    for k in range(1, degree):
        rows = held(rows, **{f"_p{k}": derivative(F.col(f"_p{k - 1}"), degree - k + 1)})
    inner = None
    for k in reversed(range(degree)):
        rows = _level(rows, f"_p{k}", degree - k, inner, f"_r{k}" if k else name)
        # a derivative that is zero throughout has no roots to part the line at
        if k:
            rows = held(rows, **{f"_s{k}": F.coalesce(f"_r{k}", F.array().cast("array<double>"))}).drop(f"_r{k}")
            inner = f"_s{k}"
    kept = [c for c in rows.columns if not (c[:2] in ("_p", "_s") and c[2:].isdigit())]
    if degree:
        kept.remove(name)
    roots = F.col(name) if degree else F.array().cast("array<double>")
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("_p0").isNotNull(), roots).alias(name))


def _product(a: list[Column], b: list[Column]) -> list[Column]:
    out: list[Column] = [F.lit(0.0)] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] = out[i + j] + x * y
    return out


def _less(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def conic_meetings(rows: DataFrame, keys: list[str], first: list[Column], second: list[Column], slack: float = 1e-6) -> DataFrame:
    """(keys, x, y): points that two conics (coefficients of xx, xy, yy, x, y, 1) have in common.

    Both are quadratics in y; their resultant is a quartic in x.  For each of its roots
    the first conic with a y in it gives the ordinates, and those that lie on both stay.
    Conics that share a line or all their points have a resultant of zero and give none.
    """
    a = rows.select(*keys, *[c.cast("double").alias(f"_{n}{i}") for n, own in (("a", first), ("b", second)) for i, c in enumerate(own)])

    def parts(n: str) -> tuple[list[Column], list[Column], list[Column]]:
        c = [F.col(f"_{n}{i}") for i in range(6)]
        return [c[2]], [c[1], c[4]], [c[0], c[3], c[5]]

    (a2, a1, a0), (b2, b1, b0) = parts("a"), parts("b")
    outer = _less(_product(a2, b0), _product(b2, a0))
    resultant = _less(_product(outer, outer), _product(_less(_product(a2, b1), _product(b2, a1)), _less(_product(a1, b0), _product(b1, a0))))
    found = with_real_roots(a, "_x", resultant)
    found = found.select(*found.columns[:-1], F.explode("_x").alias("x"))
    flat = (F.abs(F.col("_a2")) + F.abs(F.col("_a1")) + F.abs(F.col("_a4"))) == 0

    def ordinates(n: str) -> list[Column]:
        own = parts(n)
        x = F.col("x")
        return [own[0][0], own[1][0] * x + own[1][1], (own[2][0] * x + own[2][1]) * x + own[2][2]]

    found = held(found, _q=F.array(*[F.when(flat, q).otherwise(p) for p, q in zip(ordinates("a"), ordinates("b"), strict=True)]))
    # a root known to half the digits only leaves a quadratic just short of touching: its middle is tried too
    q = [F.col("_q")[i] for i in range(3)]
    found = with_real_roots(found, "_y", q)
    middle = F.try_divide(-q[1], 2 * q[0])
    found = held(found, _ys=F.array_compact(F.concat(F.coalesce("_y", F.array().cast("array<double>")), F.array(middle))))
    found = found.select(*keys, *[f"_{n}{i}" for n in "ab" for i in range(6)], "x", F.explode("_ys").alias("y"))
    x, y = F.col("x"), F.col("y")
    terms = (x * x, x * y, y * y, x, y, F.lit(1.0))
    on = None
    for n in "ab":
        c = [F.col(f"_{n}{i}") for i in range(6)]
        total = sum((k * t for k, t in zip(c[1:], terms[1:], strict=True)), c[0] * terms[0])
        size = sum((F.abs(k * t) for k, t in zip(c[1:], terms[1:], strict=True)), F.abs(c[0] * terms[0]))
        # where all terms vanish, as at the origin, only the coefficients give a measure
        least = slack * slack * sum((F.abs(k) for k in c[1:]), F.abs(c[0]))
        test = F.abs(total) <= slack * size + least
        on = test if on is None else on & test
    found = found.where(on)
    # points of one x make it a double root, known to half the digits; a step of Newton's on both conics gives the rest
    for _ in range(2):
        x, y = F.col("x"), F.col("y")
        own = []
        for n in "ab":
            c = [F.col(f"_{n}{i}") for i in range(6)]
            own.append((c[0] * x * x + c[1] * x * y + c[2] * y * y + c[3] * x + c[4] * y + c[5], 2 * c[0] * x + c[1] * y + c[3], c[1] * x + 2 * c[2] * y + c[4]))
        (f, fx, fy), (g, gx, gy) = own
        det = fx * gy - fy * gx
        steep = F.abs(det) > 1e-5 * (F.abs(fx) + F.abs(fy)) * (F.abs(gx) + F.abs(gy))
        moved = [F.when(steep, v - F.try_divide(d, det)).otherwise(v) for v, d in ((x, f * gy - g * fy), (y, g * fx - f * gx))]
        found = held(found, _u=moved[0], _v=moved[1]).drop("x", "y").withColumnsRenamed({"_u": "x", "_v": "y"})
    near = [F.floor(F.col(n) / (100 * slack) + 0.5).alias(f"_{n}") for n in "xy"]
    return found.select(*keys, *near, "x", "y").groupBy(*keys, "_x", "_y").agg(F.min("x").alias("x"), F.min("y").alias("y")).select(*keys, "x", "y")
