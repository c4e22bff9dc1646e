"""Triangle soups of analytic solids, and small measures of curves, normals and directions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.storage import materialise
from geoloom.operators import blocks
from geoloom.operators.joins import by_shuffle
from geoloom.operators.mesh import CORNERS, held


def _corner(radius, side: str, z) -> tuple:
    """A corner on the first (``a``) or second (``b``) edge of a slice."""
    return radius * F.col(f"_cos_{side}"), radius * F.col(f"_sin_{side}"), z


def _soup(rows: DataFrame, triangles: list[tuple]) -> DataFrame:
    """(mesh, f, ax .. cz) from rows (mesh, i, ...) that each give a few triangles of corner tuples."""
    parts = F.array(*[
        F.struct(F.lit(n).alias("k"), *[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(f"{c}{x}") for c, p in zip(CORNERS, t, strict=True) for x, v in zip("xyz", p, strict=True)])
        for n, t in enumerate(triangles)
    ])
    return rows.select("mesh", "i", F.explode(parts).alias("t")).select("mesh", (F.col("i") * len(triangles) + F.col("t.k")).alias("f"), *[F.col(f"t.{c}{x}") for c in CORNERS for x in "xyz"])


def _slices(solids: DataFrame, sides: int) -> DataFrame:
    """A row a slice, with the directions of its two edges, which are worked out once and not for each corner."""
    slices = solids.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))
    angles = {"a": 2 * math.pi * F.col("i") / sides, "b": 2 * math.pi * (F.col("i") + 1) / sides}
    return held(slices, slices.columns, {f"_{n}_{s}": f(angle) for s, angle in angles.items() for n, f in (("cos", F.cos), ("sin", F.sin))})


def cylinder(solids: DataFrame, sides: int) -> DataFrame:
    """Closed prisms of ``sides`` sides about z from (mesh, radius, height)."""
    r, h, a, b = F.col("radius"), F.col("height"), "a", "b"
    p, q, s, t = _corner(r, a, 0.0), _corner(r, b, 0.0), _corner(r, b, h), _corner(r, a, h)
    low, high = (0.0, 0.0, 0.0), (0.0, 0.0, h)
    return _soup(_slices(solids, sides), [(p, q, s), (p, s, t), (low, q, p), (high, t, s)])


def hollow_cylinder(solids: DataFrame, sides: int) -> DataFrame:
    """Closed rings of ``sides`` sides from (mesh, radius, inner, height)."""
    r, m, h, a, b = F.col("radius"), F.col("inner"), F.col("height"), "a", "b"
    p, q, s, t = _corner(r, a, 0.0), _corner(r, b, 0.0), _corner(r, b, h), _corner(r, a, h)
    u, v, w, x = _corner(m, a, 0.0), _corner(m, b, 0.0), _corner(m, b, h), _corner(m, a, h)
    return _soup(_slices(solids, sides), [(p, q, s), (p, s, t), (v, u, x), (v, x, w), (p, u, v), (p, v, q), (t, s, w), (t, w, x)])


def cone(solids: DataFrame, sides: int) -> DataFrame:
    """Closed pyramids of ``sides`` sides with the apex at (0, 0, height)."""
    r, h, a, b = F.col("radius"), F.col("height"), "a", "b"
    p, q = _corner(r, a, 0.0), _corner(r, b, 0.0)
    return _soup(_slices(solids, sides), [(p, q, (0.0, 0.0, h)), ((0.0, 0.0, 0.0), q, p)])


def points_in_hulls(points: DataFrame, cornered: DataFrame) -> DataFrame:
    """(mesh, id) of points (mesh, id, x, y, z) of the same mesh that lie behind all faces of a convex mesh."""
    from geoloom.operators.mesh import face_normal

    n = face_normal()
    planes = cornered.select("mesh", *[c.alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)], F.col("ax").alias("p0"), F.col("ay").alias("p1"), F.col("az").alias("p2"))
    over = F.col("nx") * (F.col("x") - F.col("p0")) + F.col("ny") * (F.col("y") - F.col("p1")) + F.col("nz") * (F.col("z") - F.col("p2"))
    return points.join(by_shuffle(planes), "mesh").groupBy("mesh", "id").agg(F.max(over).alias("over")).where("over <= 1e-9").select("mesh", "id")


def vertex_normals(cornered: DataFrame) -> DataFrame:
    """(mesh, v, nx, ny, nz): mean direction of the faces about a vertex, by area."""
    from geoloom.operators.mesh import face_normal

    n = face_normal()
    each = cornered.select("mesh", *[c.alias(f"n{x}") for c, x in zip(n, "xyz", strict=True)], F.explode(F.array(*CORNERS)).alias("v"))
    sums = each.groupBy("mesh", "v").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return sums.select("mesh", "v", *[F.when(size > 0, F.col(f"n{x}") / size).alias(f"n{x}") for x in "xyz"])


def corners_by_bend(points: DataFrame, limit: float, group: str = "ring", seq: str = "seq") -> DataFrame:
    """(group, seq, bend) of inner vertices of open polylines that bend by more than ``limit`` radians."""
    w = Window.partitionBy(group).orderBy(seq)
    around = points.select(group, seq, *[(F.col(c) - F.lag(c).over(w)).alias(f"u{c}") for c in "xy"], *[(F.lead(c).over(w) - F.col(c)).alias(f"v{c}") for c in "xy"])
    bend = F.atan2(F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx"), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"))
    return around.select(group, seq, bend.alias("bend")).where(F.abs("bend") > limit)


def reduce_directions(directions: DataFrame, digits: int = 6) -> DataFrame:
    """One row, that of least id, of the directions (id, x, y, z) that agree up to length and sign."""
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    sign = F.when((F.col("z") < 0) | ((F.col("z") == 0) & ((F.col("y") < 0) | ((F.col("y") == 0) & (F.col("x") < 0)))), -1.0).otherwise(1.0)
    unit = [(F.round(F.col(c) * sign / size, digits) + 0.0).alias(f"_{c}") for c in "xyz"]
    return directions.where(size > 0).select("id", *unit).groupBy("_x", "_y", "_z").agg(F.min("id").alias("id")).select("id", *[F.col(f"_{c}").alias(c) for c in "xyz"])


def helix_pitch(points: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, pitch) of points in order along helices about z, less than half a turn apart: rise for a full turn."""
    w = Window.partitionBy(group).orderBy(seq)
    before = {c: F.lag(c).over(w) for c in "xyz"}
    turn = F.atan2(before["x"] * F.col("y") - before["y"] * F.col("x"), before["x"] * F.col("x") + before["y"] * F.col("y"))
    steps = points.select(group, turn.alias("turn"), (F.col("z") - before["z"]).alias("rise"))
    return steps.groupBy(group).agg(F.try_divide(F.sum("rise") * 2 * math.pi, F.sum("turn")).alias("pitch"))


#: Cells that a side takes in the mean on the first grid of a search, and the growth of the cells from one grid to the next.
CELLS, GROWTH = 8, 4
#: Sides, and points, of a block.
SIDES, POINTS = 16_384, 2_048


def ring_distance(points: DataFrame, ring_edges: DataFrame) -> DataFrame:
    """(ring, id, distance) of points (ring, id, px, py) and the nearest side of the ring they name.

    Points meet the sides that pass their cell within half a cell: a nearest side closer
    than that is the nearest of all, and points without one go on on a coarser grid,
    on whose last all that is left meets all sides of its ring.  The first cells are as
    large as an eighth of a mean side, so how often a side comes in the mean does not grow
    with their number, and a point meets those of one cell in place of those of its ring.
    A point with a coordinate that is null has a null distance, with one that is not
    finite NaN; such sides are left out.
    """
    from geoloom.operators.joins import finite

    known, kept = finite(("px", "py")), points.select("ring", "id", "px", "py")
    points = materialise(kept.where(known), "points")
    sides = materialise(ring_edges.select("ring", "x", "y", "x2", "y2").where(finite(("x", "y", "x2", "y2"))), "sides")
    reach = F.abs(F.col("x2") - F.col("x")) + F.abs(F.col("y2") - F.col("y"))
    spans = [f(c).alias(f"{n}{i}") for i, c in enumerate((F.least("x", "x2"), F.greatest("x", "x2"), F.least("y", "y2"), F.greatest("y", "y2"))) for n, f in (("low", F.min), ("high", F.max))]
    of_sides, of_points = sides.agg(F.avg(reach).alias("mean"), *spans).first(), points.agg(*[f(c).alias(n) for c in ("px", "py") for n, f in ((f"low{c}", F.min), (f"high{c}", F.max))]).first()
    odd = kept.where(~F.coalesce(known, F.lit(False))).join(by_shuffle(sides.select("ring").distinct()), "ring")
    odd = odd.select("ring", "id", F.when(F.col("px").isNotNull() & F.col("py").isNotNull(), F.lit(float("nan"))).alias("distance")).distinct()
    found, left = [odd], points
    if of_sides["mean"] is not None and of_points["lowpx"] is not None:
        extent = max(max(of_sides["high1"], of_points["highpx"]) - min(of_sides["low0"], of_points["lowpx"]), max(of_sides["high3"], of_points["highpy"]) - min(of_sides["low2"], of_points["lowpy"]))
        cell = max(of_sides["mean"] / CELLS, extent / 1e6)
        while cell < extent / 2:
            near = materialise(_near_sides(left, sides, cell).where(F.col("distance") <= cell / 2), "near")
            found.append(near)
            left = materialise(left.join(by_shuffle(near.select("ring", "id")), ["ring", "id"], "left_anti"), "left")
            if left.isEmpty():
                return reduce(DataFrame.unionAll, found)
            cell *= GROWTH
    found.append(_near_sides(left, sides, None))
    return reduce(DataFrame.unionAll, found)


def _near_sides(points: DataFrame, sides: DataFrame, cell: float | None) -> DataFrame:
    """(ring, id, distance) to the nearest of the sides that pass a point's cell within half a cell; without a cell, of all sides of its ring."""
    if cell is None:
        placed = [F.lit(0).cast("long").alias(c) for c in ("i", "j")]
        at, lines = points.select("*", *placed), sides.select("*", *placed)
    else:
        at = points.select("*", F.floor(F.col("px") / cell).alias("i"), F.floor(F.col("py") / cell).alias("j"))
        # a side passes a column of cells between two heights, and half a cell more on each side
        half, slack = cell / 2, cell * 1e-6
        low, high = F.least("x", "x2") - half - slack, F.greatest("x", "x2") + half + slack
        lines = sides.withColumn("i", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))

        def height(x: Column) -> Column:
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x")) / (F.col("x2") - F.col("x"))))
            return F.when(F.col("x") == F.col("x2"), F.lit(None).cast("double")).otherwise(F.col("y") + share * (F.col("y2") - F.col("y")))

        ends = [height(F.col("i") * cell - half - slack), height((F.col("i") + 1) * cell + half + slack)]
        bottom, top = F.coalesce(F.least(*ends), F.least("y", "y2")), F.coalesce(F.greatest(*ends), F.greatest("y", "y2"))
        bottom, top = F.when(F.col("x") == F.col("x2"), F.least("y", "y2")).otherwise(bottom), F.when(F.col("x") == F.col("x2"), F.greatest("y", "y2")).otherwise(top)
        lines = lines.withColumn("j", F.explode(F.sequence(F.floor((bottom - half - slack) / cell), F.floor((top + half + slack) / cell))))
    place = ["ring", "i", "j"]

    def many(rows: DataFrame, name: str, most: int) -> DataFrame:
        return rows.groupBy(*place).agg(F.ceil(F.count("*") / most).alias(name))

    # each part of a cell's points meets each part of its sides in a block
    cells = materialise(many(at, "n", POINTS).join(by_shuffle(many(lines, "m", SIDES)), place), "cells")

    told = F.broadcast(cells) if cells.limit(blocks.FEW + 1).count() <= blocks.FEW else by_shuffle(cells)
    kind = dict(points.dtypes)["id"]

    def dealt(rows: DataFrame, own: str, other: str, key: list[str], columns: list[Column]) -> DataFrame:
        out = rows.join(told, place).withColumn(f"_{own}", F.pmod(F.xxhash64(*key), F.col(own))).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return out.select(*place, "_n", "_m", *columns)

    zero = F.lit(0.0)
    rows = dealt(at, "n", "m", ["id"], [F.col("id"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), zero.alias("x2"), zero.alias("y2"), F.lit(True).alias("point")])
    rows = rows.unionAll(dealt(lines, "m", "n", ["x", "y", "x2", "y2"], [F.lit(0).cast(kind), *[F.col(c).cast("double") for c in ("x", "y", "x2", "y2")], F.lit(False)]))

    def work(r: blocks.Arrays, group: np.ndarray) -> tuple[np.ndarray, blocks.Arrays]:
        p, s = np.flatnonzero(r["point"]), np.flatnonzero(~r["point"])
        x, y, dx, dy = r["x"][s], r["y"][s], (r["x2"] - r["x"])[s], (r["y2"] - r["y"])[s]
        square = dx * dx + dy * dy
        size = np.sqrt(square)
        safe = np.where(size > 0, size, 1.0)
        # distance to the line of a side, which is not above that to the side; a side of no length has no line
        nx, ny = -dy / safe, dx / safe
        off = nx * x + ny * y
        total = group[-1] + 1 if len(group) else 0
        (p0, s0), (p1, s1) = (tuple(np.searchsorted(group[w], np.arange(total), side) for w in (p, s)) for side in ("left", "right"))
        gap = np.full(len(p), np.inf)
        px, py = r["x"][p], r["y"][p]

        def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            wx, wy = px[i] - x[j], py[i] - y[j]
            t = np.clip(np.where(size[j] > 0, (wx * dx[j] + wy * dy[j]) / np.where(size[j] > 0, square[j], 1.0), 0.0), 0.0, 1.0)
            return np.hypot(wx - t * dx[j], wy - t * dy[j])

        for g in range(total):
            i, j = np.arange(p0[g], p1[g]), np.arange(s0[g], s1[g])
            if not len(i) or not len(j):
                continue
            step = max(1, 100_000 // len(i))
            here = np.stack([px[i], py[i], np.ones(len(i))], axis=1)
            grain = 1e-9 * (1 + np.abs(px[i]) + np.abs(py[i]))
            for first in range(0, len(j), step):
                some = j[first:first + step]
                line = np.abs(here @ np.stack([nx[some], ny[some], -off[some]]))
                if not np.isfinite(gap[i]).all():
                    # a first bound: the side whose line is nearest
                    gap[i] = np.minimum(gap[i], exact(i, some[np.argmin(line, axis=1)]))
                a, b = np.nonzero(line <= (gap[i] + grain)[:, None])
                if len(a):
                    np.minimum.at(gap, i[a], exact(i[a], some[b]))
        seen = np.isfinite(gap)
        return group[p[seen]], {"id": r["id"][p[seen]], "gap": gap[seen]}

    return blocks.per_blocks(rows, [*place, "_n", "_m"], f"id {kind}, gap double", work).groupBy("ring", "id").agg(F.min("gap").alias("distance"))
