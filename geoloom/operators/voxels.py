"""Voxel grids and pixel rasters as tables of integer cells; set operations are Spark's own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import blocks

AXES = ("i", "j", "k")
#: Scan lines of a block's row of lines.
LINES = 64
SIDES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def voxelize(points: DataFrame, side: float, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Cells that hold a point."""
    return points.select(*[F.greatest(F.floor((F.col(a) - o) / side), F.lit(0)).cast("long").alias(c) for a, o, c in zip("xyz", offset, AXES, strict=True)]).distinct()


def centre(side: float, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[Column]:
    return [(o + (F.col(c) + 0.5) * side).alias(a) for a, o, c in zip("xyz", offset, AXES, strict=True)]


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES).union(b.select(*AXES)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES).intersect(b.select(*AXES))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES).exceptAll(b.select(*AXES)).distinct()


def block(spark, ni: int, nj: int, nk: int) -> DataFrame:
    """All cells of a grid, made from one range without a join."""
    n = F.col("id")
    return spark.range(ni * nj * nk).select(F.floor(n / (nj * nk)).alias("i"), (F.floor(n / nk) % nj).alias("j"), (n % nk).alias("k"))


def invert(a: DataFrame, ni: int, nj: int, nk: int) -> DataFrame:
    return subtract(block(a.sparkSession, ni, nj, nk), a)


def _steps(a: DataFrame) -> DataFrame:
    """Each cell's six neighbours, with how many cells point at each and whether it is a cell itself."""
    moves = F.array(*[F.struct(*[F.lit(s).alias(f"d{c}") for s, c in zip(side, AXES, strict=True)]) for side in SIDES])
    out = a.select(*AXES, F.explode(moves).alias("m")).select(*[(F.col(c) + F.col(f"m.d{c}")).alias(c) for c in AXES], F.lit(1).alias("hit"), F.lit(0).alias("own"))
    return out.unionAll(a.select(*AXES, F.lit(0), F.lit(1))).groupBy(*AXES).agg(F.sum("hit").alias("neighbours"), F.max("own").alias("own"))


def exposed(a: DataFrame) -> DataFrame:
    """Cells with an empty neighbour and how many of their sides are open; one aggregation."""
    return _steps(a).where((F.col("own") == 1) & (F.col("neighbours") < 6)).select(*AXES, (6 - F.col("neighbours")).alias("open_sides"))


def erode(a: DataFrame) -> DataFrame:
    return _steps(a).where((F.col("own") == 1) & (F.col("neighbours") == 6)).select(*AXES)


def dilate(a: DataFrame) -> DataFrame:
    return _steps(a).select(*AXES)


def measures(a: DataFrame, side: float) -> DataFrame:
    """cells, volume, surface and centroid of one grid."""
    x, y, z = (F.avg(c) for c in centre(side))
    m = a.agg(F.count("*").alias("cells"), x.alias("cx"), y.alias("cy"), z.alias("cz"))
    s = exposed(a).agg(F.coalesce(F.sum("open_sides"), F.lit(0)).alias("open_sides"))
    return m.select("cells", (F.col("cells") * side**3).alias("volume"), *["cx", "cy", "cz"]).join(F.broadcast(s.select((F.col("open_sides") * side**2).alias("surface"))))


def draft(a: DataFrame, far: int, axis: str = "k") -> DataFrame:
    """Columns filled from their first cell to ``far``."""
    others = [c for c in AXES if c != axis]
    first = a.groupBy(*others).agg(F.min(axis).alias("_first"))
    return first.select(*others, F.explode(F.sequence(F.col("_first"), F.lit(far).cast("long"))).alias(axis)).select(*AXES)


def runs(a: DataFrame, axis: str = "i") -> DataFrame:
    """Rows as half-open ranges [first, last): the sparse form."""
    others = [c for c in AXES if c != axis]
    island = F.col(axis) - F.row_number().over(Window.partitionBy(*others).orderBy(axis))
    return a.withColumn("_g", island).groupBy(*others, "_g").agg(F.min(axis).alias("first"), (F.max(axis) + 1).alias("last")).drop("_g")


def cells(run_table: DataFrame, axis: str = "i") -> DataFrame:
    """The dense form of ``runs``."""
    others = [c for c in AXES if c != axis]
    return run_table.select(*others, F.explode(F.sequence("first", F.col("last") - 1)).alias(axis)).select(*AXES)


def pack_id() -> Column:
    """21 bits an axis in one long."""
    return F.shiftleft(F.col("i").cast("long"), 42).bitwiseOR(F.shiftleft(F.col("j").cast("long"), 21)).bitwiseOR(F.col("k").cast("long"))


def unpack_id(column: str) -> list[Column]:
    return [F.shiftright(F.col(column), shift).bitwiseAND(F.lit((1 << 21) - 1)).alias(c) for c, shift in zip(AXES, (42, 21, 0), strict=True)]


def fill_from_hits(hits: DataFrame, side: float) -> DataFrame:
    """Cells of rows between paired crossings (j, k, x) of a closed surface."""
    w = Window.partitionBy("j", "k").orderBy("x")
    paired = hits.select("j", "k", "x", F.row_number().over(w).alias("n"), F.lead("x").over(w).alias("x2")).where((F.col("n") % 2 == 1) & F.col("x2").isNotNull())
    first, last = F.ceil(F.col("x") / side - 0.5), F.ceil(F.col("x2") / side - 0.5) - 1
    return paired.where(first <= last).select(F.explode(F.sequence(first, last)).alias("i"), "j", "k").distinct()


def slice_at(a: DataFrame, axis: str, index: int) -> tuple[DataFrame, DataFrame]:
    """The parts below and from an index."""
    return a.where(F.col(axis) < index), a.where(F.col(axis) >= index)


def z_buffer(faces: DataFrame, size: float) -> DataFrame:
    """Greatest height per pixel of faces (f, ax .. cz) seen from above, with the later face on ties.

    Back faces are skipped.  A face makes a row per pixel centre it covers.
    """
    from geoloom.functions.vector import cross2

    ab, ac = (F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), (F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay"))
    area = cross2(ab, ac)

    def span(axis: str) -> Column:
        low, high = (f(f"a{axis}", f"b{axis}", f"c{axis}") for f in (F.least, F.greatest))
        first, last = F.ceil(low / size - 0.5), F.floor(high / size - 0.5)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    cut = faces.where(area > 0).withColumn("_area", area).withColumn("i", F.explode(span("x"))).withColumn("j", F.explode(span("y")))
    p = ((F.col("i") + 0.5) * size - F.col("ax"), (F.col("j") + 0.5) * size - F.col("ay"))
    u, v = cross2(p, ac) / F.col("_area"), cross2(ab, p) / F.col("_area")
    z = F.col("az") + u * (F.col("bz") - F.col("az")) + v * (F.col("cz") - F.col("az"))
    seen = cut.where((u >= 0) & (v >= 0) & (u + v <= 1)).select("i", "j", "f", z.alias("z"))
    return seen.groupBy("i", "j").agg(F.max("z").alias("z"), F.max_by("f", F.struct("z", "f")).alias("f"))


def line_cells(segments: DataFrame, size: float) -> DataFrame:
    """Pixels of segments (id, x1, y1, x2, y2), one per step along the longer axis."""
    a, b = [F.floor(F.col(f"{c}1") / size) for c in "xy"], [F.floor(F.col(f"{c}2") / size) for c in "xy"]
    steps = F.greatest(F.abs(b[0] - a[0]), F.abs(b[1] - a[1]))
    cut = segments.select("id", a[0].alias("i1"), a[1].alias("j1"), b[0].alias("i2"), b[1].alias("j2"), steps.alias("n")).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), "n")))

    def at(p: str, q: str) -> Column:
        return F.when(F.col("n") == 0, F.col(p)).otherwise(F.floor(F.col(p) + (F.col(q) - F.col(p)) * F.col("t") / F.col("n") + 0.5))

    return cut.select("id", at("i1", "i2").alias("i"), at("j1", "j2").alias("j")).distinct()


def grid_index(i: Column, j: Column, ni: int, nj: int) -> Column:
    """nj * i + j, or -1 outside."""
    return F.when((i >= 0) & (i < ni) & (j >= 0) & (j < nj), nj * i + j).otherwise(-1)


def cube_cases(a: DataFrame) -> DataFrame:
    """(i, j, k, case) of the cubes between cells that a surface passes: one bit per corner, by aggregation."""
    bits = F.array(*[F.struct(F.lit(-x).alias("di"), F.lit(-y).alias("dj"), F.lit(-z).alias("dk"), F.lit(1 << (x + 2 * y + 4 * z)).alias("bit")) for x in (0, 1) for y in (0, 1) for z in (0, 1)])
    marks = a.select(*AXES, F.explode(bits).alias("m")).select(*[(F.col(c) + F.col(f"m.d{c}")).alias(c) for c in AXES], F.col("m.bit").alias("bit"))
    return marks.groupBy(*AXES).agg(F.sum("bit").alias("case")).where("case < 255")


def mesh_runs(soup: DataFrame, side: float, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(mesh, j, k, first, last): cells, as half-open runs along i, whose centres lie within closed meshes (mesh, f, ax .. cz).

    Scan lines run through cell centres.  A face makes a row for each layer of equal z
    that it meets, by the stretch between its two sides there; in blocks of a layer of a
    mesh and 64 lines, the stretches are cut at the lines in between.
    Both rules are half open and a side is worked out from its lesser end, so a line
    through an edge or a corner meets one of the faces there.  Along a line the
    crossings' directions add up; what lies between is inside where the sum is not 0,
    so bodies of one mesh may overlap.
    """
    def centre_row(c: np.ndarray, o: float) -> np.ndarray:
        # the first row whose centre is not below c
        return np.ceil((c - o) / side - 0.5).astype(np.int64)

    def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # position and number of each of the rows from first to last
        many = np.maximum(last - first + 1, 0)
        of = np.repeat(np.arange(len(many)), many)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]

    def stretches(r: blocks.Arrays, _: np.ndarray) -> tuple[np.ndarray, blocks.Arrays]:
        corners = [np.stack([r[f"{c}{x}"] for x in "zyx"], axis=1) for c in "abc"]
        u, v = corners[1] - corners[0], corners[2] - corners[0]
        turn = u[:, 1] * v[:, 0] - u[:, 0] * v[:, 1]
        known = np.flatnonzero(np.isfinite(np.concatenate(corners, axis=1)).all(axis=1) & (turn != 0))
        corners, turn = [c[known] for c in corners], turn[known]
        heights = np.stack([c[:, 0] for c in corners])
        of, k = spread(centre_row(heights.min(axis=0), offset[2]), centre_row(heights.max(axis=0), offset[2]) - 1)
        z = offset[2] + (k + 0.5) * side
        meets, ys, xs = [], [], []
        for p, q in ((0, 1), (1, 2), (2, 0)):
            a, b = corners[p], corners[q]
            up = (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & ((a[:, 1] < b[:, 1]) | ((a[:, 1] == b[:, 1]) & (a[:, 2] <= b[:, 2]))))
            lo, hi = np.where(up[:, None], a, b), np.where(up[:, None], b, a)
            lo, way = lo[of], (hi - lo)[of]
            meet = (lo[:, 0] <= z) & (hi[of, 0] > z)
            share = (z - lo[:, 0]) / np.where(meet, way[:, 0], 1.0)
            meets.append(meet), ys.append(lo[:, 1] + share * way[:, 1]), xs.append(lo[:, 2] + share * way[:, 2])
        meets, ys, xs = (np.stack(c) for c in (meets, ys, xs))
        kept = np.flatnonzero(meets.sum(axis=0) == 2)
        one, two = np.argmax(meets[:, kept], axis=0), 2 - np.argmax(meets[::-1, kept], axis=0)
        y0, y1, x0, x1 = ys[one, kept], ys[two, kept], xs[one, kept], xs[two, kept]
        turned = (y0 > y1) | ((y0 == y1) & (x0 > x1))
        y0, y1, x0, x1 = np.where(turned, y1, y0), np.where(turned, y0, y1), np.where(turned, x1, x0), np.where(turned, x0, x1)
        first, last = centre_row(y0, offset[1]), centre_row(y1, offset[1]) - 1
        met = first <= last
        first, last, y0, y1, x0, x1, kept = (c[met] for c in (first, last, y0, y1, x0, x1, kept))
        at, part = spread(first // LINES, last // LINES)
        own = of[kept[at]]
        return known[own], {
            "k": k[kept[at]], "part": part, "first": np.maximum(first[at], part * LINES), "last": np.minimum(last[at], part * LINES + LINES - 1),
            "y0": y0[at], "y1": y1[at], "x0": x0[at], "x1": x1[at], "way": np.where(turn[own] > 0, -1, 1),
        }

    corners = [f"{c}{x}" for c in "abc" for x in "xyz"]
    rows = soup.select("mesh", *[F.col(c).cast("double").alias(c) for c in corners])
    rows = blocks.per_blocks(rows, ["mesh"], "k long, part long, first long, last long, y0 double, y1 double, x0 double, x1 double, way long", stretches, deal=False)

    def work(r: blocks.Arrays, group: np.ndarray) -> tuple[np.ndarray, blocks.Arrays]:
        of, j = spread(r["first"], r["last"])
        y = offset[1] + (j + 0.5) * side
        y0, y1, x0, x1 = (r[n][of] for n in ("y0", "y1", "x0", "x1"))
        x = x0 + (y - y0) / (y1 - y0) * (x1 - x0)
        x = np.minimum(np.maximum(x, np.minimum(x0, x1)), np.maximum(x0, x1))
        # one number for each line of a block
        line, way = group[of] * LINES + j % LINES, r["way"][of]
        order = np.lexsort((-way, x, line))
        line, x, way, j, of = line[order], x[order], way[order], j[order], of[order]
        total = np.cumsum(way)
        fresh = np.flatnonzero(np.diff(line, prepend=-1))
        depth = total - np.repeat((total - way)[fresh], np.diff(np.append(fresh, len(line))))
        cell = centre_row(x, offset[0])
        inside = np.flatnonzero((line[1:] == line[:-1]) & (depth[:-1] != 0) & (cell[:-1] < cell[1:]))
        return group[of[inside]], {"j": j[inside], "first": cell[inside], "last": cell[inside + 1]}

    return blocks.per_blocks(rows, ["mesh", "k", "part"], "j long, first long, last long", work).select("mesh", "j", "k", "first", "last")


def run_cells(run_table: DataFrame) -> DataFrame:
    """(mesh, i, j, k): the cells of ``mesh_runs``."""
    return run_table.select("mesh", F.explode(F.sequence("first", F.col("last") - 1)).alias("i"), "j", "k").distinct()


def rectangles(a: DataFrame) -> DataFrame:
    """(mesh, axis, side, plane, u0, u1, v0, v1): the open sides of cells (mesh, i, j, k), joined to rectangles.

    A side between two cells is one key that both make, so an open side is a key of one
    cell.  On each plane, sides in a row join to runs, and runs of the same extent in
    rows that follow each other to rectangles, by gaps and islands both times.
    """
    faces = []
    for n, (axis, u, v) in enumerate((("i", "j", "k"), ("j", "k", "i"), ("k", "i", "j"))):
        faces += [F.struct(F.lit(n).alias("axis"), F.lit(s).alias("side"), (F.col(axis) + s).alias("plane"), F.col(u).alias("u"), F.col(v).alias("v")) for s in (0, 1)]
    sides = a.select("mesh", F.explode(F.array(*faces)).alias("s")).select("mesh", "s.*")
    open_sides = sides.groupBy("mesh", "axis", "plane", "u", "v").agg(F.count("*").alias("n"), F.max("side").alias("side")).where("n = 1").drop("n")
    plane = ["mesh", "axis", "side", "plane"]
    row = Window.partitionBy(*plane, "v").orderBy("u")
    run = open_sides.withColumn("_g", F.col("u") - F.row_number().over(row)).groupBy(*plane, "v", "_g").agg(F.min("u").alias("u0"), (F.max("u") + 1).alias("u1"))
    column = Window.partitionBy(*plane, "u0", "u1").orderBy("v")
    return run.withColumn("_h", F.col("v") - F.row_number().over(column)).groupBy(*plane, "u0", "u1", "_h").agg(F.min("v").alias("v0"), (F.max("v") + 1).alias("v1")).drop("_h")


def rectilinear_mesh(rects: DataFrame, size: float, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Triangle soup (mesh, f, ax .. cz) of ``rectangles``, two faces each, seen from outside."""
    def spot(u: str, v: str) -> tuple[Column, ...]:
        at = {0: F.col("plane"), 1: F.col(u), 2: F.col(v)}
        # the axis gives where plane, u and v belong: i, j, k for 0, j, k, i for 1, k, i, j for 2
        place = [F.when(F.col("axis") == 0, at[(x - 0) % 3]).when(F.col("axis") == 1, at[(x - 1) % 3]).otherwise(at[(x - 2) % 3]) for x in range(3)]
        return tuple(o + p * size for o, p in zip(offset, place, strict=True))

    corner = [spot("u0", "v0"), spot("u1", "v0"), spot("u1", "v1"), spot("u0", "v1")]

    def triangle(n: int, order: tuple[int, int, int]) -> Column:
        return F.struct(F.lit(n).alias("n"), *[v.alias(f"{c}{x}") for c, i in zip("abc", order, strict=True) for x, v in zip("xyz", corner[i], strict=True)])

    outward = F.array(triangle(0, (0, 1, 2)), triangle(1, (0, 2, 3)))
    inward = F.array(triangle(0, (0, 2, 1)), triangle(1, (0, 3, 2)))
    out = rects.select("mesh", "axis", "side", "plane", "u0", "v0", F.explode(F.when(F.col("side") == 1, outward).otherwise(inward)).alias("t"))
    return out.select("mesh", F.xxhash64("axis", "side", "plane", "u0", "v0", "t.n").alias("f"), *[F.col(f"t.{c}{x}").alias(f"{c}{x}") for c in "abc" for x in "xyz"])
