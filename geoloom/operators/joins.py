"""Geometric joins as binned equi-joins: no Cartesian product, and hot bins split at run time by adaptive execution."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.storage import materialise
from geoloom.functions.vector import segment_meeting, vector


def by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that shuffles both sides, whatever Spark takes their size for.

    An estimate comes from the file and counts neither the rows that ``explode`` makes nor
    compression, so a table of many millions of rows passes for small and would go whole
    through the driver as a broadcast.
    """
    return rows.hint("merge")


def bins_of(low: Column, high: Column, width: float) -> Column:
    """Array of the bins an interval touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def band_join(a: DataFrame, b: DataFrame, a_low: Column, a_high: Column, b_low: Column, b_high: Column, width: float, residual: Column) -> DataFrame:
    """Pairs of rows whose intervals overlap and that satisfy ``residual``.

    Each side is replicated to the bins it touches; a pair is kept in the first bin
    both touch, so it comes out once.  Column names of the sides must differ.
    """
    left = a.withColumn("_low", F.floor(a_low / width)).withColumn("_bin", F.explode(bins_of(a_low, a_high, width)))
    right = b.withColumn("_low2", F.floor(b_low / width)).withColumn("_bin", F.explode(bins_of(b_low, b_high, width)))
    joined = left.join(right, "_bin").where((F.col("_bin") == F.greatest("_low", "_low2")) & residual)
    return joined.drop("_bin", "_low", "_low2")


def radius_join(points: DataFrame, queries: DataFrame, radius: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(query, id, distance) of points within ``radius`` (inclusive); a query visits 3^d cells, a point one.

    ``points`` has id and the axes, ``queries`` has query and the axes.
    """
    cells = points.select("id", *axes, *[F.floor(F.col(a) / radius).alias(f"_c{a}") for a in axes])
    asked = queries.select("query", *[F.col(a).alias(f"q{a}") for a in axes])
    for a in axes:
        base = F.floor(F.col(f"q{a}") / radius)
        asked = asked.withColumn(f"_c{a}", F.explode(F.sequence(base - 1, base + 1)))
    square = sum(((F.col(a) - F.col(f"q{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"q{axes[0]}")) ** 2)
    found = asked.join(cells, [f"_c{a}" for a in axes]).withColumn("distance", F.sqrt(square))
    return found.where(F.col("distance") <= radius).select("query", "id", "distance")


def finite(axes: tuple[str, ...]) -> Column:
    """Whether all coordinates are numbers; NaN counts as greater than infinity."""
    return reduce(and_, [F.abs(F.col(a).cast("double")) < float("inf") for a in axes])


def closer(points: DataFrame, k: int, radius: float, axes: tuple[str, ...], growth: float, steps: int = 60) -> float:
    """``radius`` divided by ``growth`` until the cell of a point holds 2 k points in the mean, or twice the points equal to it.

    The sum of the squares of what cells hold tells what a point shares its cell with.
    """
    def held(place: list[Column]) -> float:
        cells = points.groupBy(*place).agg(F.count("*").cast("double").alias("n"))
        return cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]

    enough = 2 * max(k, held([F.col(a) for a in axes]))
    for _ in range(steps):
        if held([F.floor(F.col(a) / radius) for a in axes]) <= enough:
            break
        radius /= growth
    return radius


def nearest_join(points: DataFrame, queries: DataFrame, k: int, radius: float, axes: tuple[str, ...] = ("x", "y"), growth: float = 2.0, rounds: int = 40) -> DataFrame:
    """(query, rank, id, distance): the ``k`` nearest points, ties to the smaller id.

    A round joins within a radius; queries that found ``k`` are done, since all
    others lie farther, and the rest go on with a larger radius.  Points and queries
    with a coordinate that is null or not finite have no distance and are left out.
    Queries still open after ``rounds`` are an error; with no points there are no rows.
    Each round is a written table, so no round repeats those before it.
    """
    points, queries = points.where(finite(axes)), queries.where(finite(axes))
    total = points.count()
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    # where a cell holds many times what is asked for, a smaller radius finds the same
    if total:
        least = closer(points, k, radius, axes, growth)
        rounds += round(math.log(radius / least, growth))
        radius = least
    done, open_queries = [], queries
    for _ in range(rounds if total else 0):
        found = materialise(radius_join(points, open_queries, radius, axes).withColumn("rank", rank).where(F.col("rank") <= k), "near")
        # the row of the last rank shows that a query is done
        full = found.where(F.col("rank") == min(k, total)).select("query")
        done.append(found.join(full, "query", "left_semi"))
        open_queries = materialise(open_queries.join(full, "query", "left_anti"), "open")
        if open_queries.isEmpty():
            break
        radius *= growth
    else:
        if total:
            raise ValueError(f"queries without their {k} nearest points after {rounds} rounds")
        done.append(radius_join(points, queries, radius, axes).withColumn("rank", F.lit(0)).where(F.lit(False)))
    return reduce(DataFrame.unionAll, done).select("query", F.col("rank").cast("long").alias("rank"), "id", "distance")


def points_in_rings(points: DataFrame, ring_edges: DataFrame, width: float) -> DataFrame:
    """(ring, id) of points inside by the even-odd rule, half open in y.

    ``points`` has id, x, y; ``ring_edges`` has ring and ex, ey, ex2, ey2.  A point
    meets the edges of its y bin; rings of a group count with each other, so holes
    cancel out.
    """
    p = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("y") / width).alias("_bin"))
    low, high = F.least("ey", "ey2"), F.greatest("ey", "ey2")
    e = ring_edges.withColumn("_bin", F.explode(bins_of(low, high, width)))
    crossing = F.col("ex") + (F.col("py") - F.col("ey")) / (F.col("ey2") - F.col("ey")) * (F.col("ex2") - F.col("ex"))
    met = p.join(e, "_bin").where((F.col("ey") > F.col("py")) != (F.col("ey2") > F.col("py"))).where(F.col("px") < crossing)
    return met.groupBy("ring", "id").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("ring", "id")


def segment_meetings(lines: DataFrame, width: float) -> DataFrame:
    """(a, b, t, u) of segments (id, x1, y1, x2, y2) that meet and are not parallel, a < b, with the parameters on both.

    Equal segments are tried once, in the cells of a grid over both axes that their
    boxes touch; a pair is kept in the first cell both touch, and only what meets is
    given to all ids.  ``width`` should not be much less than the segments are long.
    """
    ends = ["x1", "y1", "x2", "y2"]
    shapes = materialise(lines.groupBy(*ends).agg(F.min("id").alias("g")), "segments")
    owners = materialise(lines.join(by_shuffle(shapes), ends).select("g", "id"), "owners")

    def placed(n: str) -> DataFrame:
        out = shapes.select(F.col("g").alias(f"_{n}"), *[F.col(c).alias(f"{n}{c}") for c in ends])
        for x in "xy":
            low, high = (f(f"{n}{x}1", f"{n}{x}2") for f in (F.least, F.greatest))
            out = out.withColumn(f"_{n}{x}", low).withColumn(f"_{x}", F.explode(bins_of(low, high, width)))
        return out

    meets, t, u = segment_meeting(*[vector(f"{n}x{i}", f"{n}y{i}") for n in "ab" for i in (1, 2)])
    first = reduce(and_, [F.col(f"_{x}") == F.floor(F.greatest(f"_a{x}", f"_b{x}") / width) for x in "xy"])
    found = placed("a").join(by_shuffle(placed("b")), ["_x", "_y"]).where((F.col("_a") < F.col("_b")) & first & meets).select("_a", "_b", t.alias("t"), u.alias("u"))
    pairs = found.join(by_shuffle(owners.select(F.col("g").alias("_a"), F.col("id").alias("p"))), "_a").join(by_shuffle(owners.select(F.col("g").alias("_b"), F.col("id").alias("q"))), "_b")
    turned = F.col("p") > F.col("q")
    return pairs.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(turned, F.col("u")).otherwise(F.col("t")).alias("t"), F.when(turned, F.col("t")).otherwise(F.col("u")).alias("u"))


def box_overlaps(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """(a, b) of boxes that share an inner point; boxes have id, x0, y0, x1, y1.

    Boxes meet in the cells of a grid over both axes; a pair is kept in the first cell
    both touch.
    """
    left = a.select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    right = b.select(F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    test = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))

    def placed(rows: DataFrame, n: str) -> DataFrame:
        out = rows
        for x in "xy":
            out = out.withColumn(f"_{x}", F.explode(bins_of(F.col(f"{n}{x}0"), F.col(f"{n}{x}1"), width)))
        return out

    first = reduce(and_, [F.col(f"_{x}") == F.floor(F.greatest(f"a{x}0", f"b{x}0") / width) for x in "xy"])
    return placed(left, "a").join(by_shuffle(placed(right, "b")), ["_x", "_y"]).where(first & test).select("a", "b")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time; one sort, no range join."""
    both = left.select(key, time, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.struct(*left.columns).alias("_row"))
    other = right.select(key, time, F.lit(0).alias("_side"), value, F.lit(None).cast(both.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.unionByName(other).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1")
    return joined.select("_row.*", value)


def arc_join(points: DataFrame, queries: DataFrame, arc: float) -> DataFrame:
    """(query, id, arc) of points of the unit sphere within an arc: a search by the chord, which grows with the arc."""
    found = radius_join(points, queries, 2 * math.sin(min(arc, math.pi) / 2), ("x", "y", "z"))
    return found.select("query", "id", (2 * F.asin(F.least(F.col("distance") / 2, F.lit(1.0)))).alias("arc"))


def drop_duplicates_on_grid(points: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One point, that of least id, of those that round to the same place of a grid."""
    place = [F.floor(F.col(a) / size + 0.5).alias(f"_{a}") for a in axes]
    kept = points.select("id", *axes, *place).groupBy(*[f"_{a}" for a in axes]).agg(F.min_by(F.struct("id", *axes), "id").alias("p"))
    return kept.select("p.*")
