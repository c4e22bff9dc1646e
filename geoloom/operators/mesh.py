"""Triangle meshes as tables: vertices (mesh, v, x, y, z) and faces (mesh, f, a, b, c)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.vector import Vector, cross, dot, length, minus, scale, total, triple
from geoloom.operators.joins import by_shuffle

CORNERS = ("a", "b", "c")


def held(rows: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """``keep`` and ``values`` as columns that later expressions refer to and do not repeat: a generator of one row stops the optimizer from putting them in."""
    one = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_s")
    return rows.select(*keep, one).select(*keep, *[F.col("_s")[n].alias(n) for n in values])


def near(value: Column, digits: int) -> Column:
    """``value`` rounded, without the way through decimals that ``round`` takes; a value too large to have such digits stays."""
    scale = 10.0**digits
    return F.when(F.abs(value) < 2.0**52 / scale, F.rint(value * scale) / scale).otherwise(value) + 0.0


def weld(soup: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a triangle soup (mesh, f, ax..cz): corners equal after rounding are one vertex.

    A vertex is named by a hash of its rounded place, so no numbering pass is needed.
    """
    spots = held(soup, ["mesh", "f"], {f"{c}{axis}": near(F.col(f"{c}{axis}").cast("double"), digits) for c in CORNERS for axis in "xyz"})
    names = {c: F.xxhash64("mesh", *[f"{c}{axis}" for axis in "xyz"]) for c in CORNERS}
    corners = spots.select("mesh", F.explode(F.array(*[F.struct(names[c].alias("v"), *[F.col(f"{c}{axis}").alias(axis) for axis in "xyz"]) for c in CORNERS])).alias("p"))
    vertices = corners.select("mesh", "p.*").dropDuplicates(["mesh", "v"])
    return vertices, held(spots, ["mesh", "f"], names)


def clean_faces(faces: DataFrame) -> DataFrame:
    """Without degenerate faces, and one of those with the same three vertices."""
    whole = faces.where((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))
    ordered = {"_0": F.least(*CORNERS), "_1": F.greatest(F.least("a", "b"), F.least(F.greatest("a", "b"), F.col("c"))), "_2": F.greatest(*CORNERS)}
    whole = held(whole, ["mesh", "f", *CORNERS], ordered)
    # plain columns and the places of the corners among them, so that groups are hashed and not sorted
    places = [F.when(F.col(c) == F.col("_0"), 1).when(F.col(c) == F.col("_1"), 2).otherwise(3) for c in CORNERS]
    named = whole.select("mesh", "f", "_0", "_1", "_2", sum((p * 4**n for n, p in enumerate(places)), F.lit(0)).alias("_way"))
    least = named.groupBy("mesh", "_0", "_1", "_2").agg(F.min("f").alias("f"), F.min_by("_way", "f").alias("_way"))
    place = [F.shiftright("_way", 2 * n).bitwiseAND(F.lit(3)) for n in range(3)]
    return least.select("mesh", "f", *[F.when(i == 1, F.col("_0")).when(i == 2, F.col("_1")).otherwise(F.col("_2")).alias(c) for c, i in zip(CORNERS, place, strict=True)])


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with corner coordinates ax .. cz."""
    out = faces
    for c in CORNERS:
        part = vertices.select("mesh", F.col("v").alias(c), *[F.col(axis).alias(f"{c}{axis}") for axis in "xyz"])
        out = out.join(by_shuffle(part), ["mesh", c])
    return out


def corner(c: str) -> Vector:
    return tuple(F.col(f"{c}{axis}") for axis in "xyz")


def face_normal() -> Vector:
    """Normal of length twice the face's area."""
    return cross(minus(corner("b"), corner("a")), minus(corner("c"), corner("a")))


def face_area() -> Column:
    return length(face_normal()) / 2


def face_measures(cornered: DataFrame) -> DataFrame:
    """mesh, f, area, unit normal (null for slivers) and centre."""
    n, size = face_normal(), length(face_normal())
    return cornered.select(
        "mesh", "f", (size / 2).alias("area"), *[F.when(size > 0, x / size).alias(f"n{axis}") for axis, x in zip("xyz", n, strict=True)],
        *[(total(corner(c)[i] for c in CORNERS) / 3).alias(f"c{axis}") for i, axis in enumerate("xyz")],
    )


def solid_measures(cornered: DataFrame) -> DataFrame:
    """mesh, faces, area, volume, centroid and inertia about it, by tetrahedra from the origin.

    The volume is negative for a mesh turned inside out.
    """
    six = triple(corner("a"), corner("b"), corner("c"))
    sums = {axis: total(F.col(f"{c}{axis}") for c in CORNERS) for axis in "xyz"}
    moments = {}
    for i, p in enumerate("xyz"):
        for q in "xyz"[i:]:
            pairs = total(F.col(f"{c}{p}") * F.col(f"{c}{q}") for c in CORNERS)
            moments[p + q] = F.sum(six * (sums[p] * sums[q] + pairs)) / 120
    base = cornered.groupBy("mesh").agg(
        F.count("*").alias("faces"), F.sum(face_area()).alias("area"), (F.sum(six) / 6).alias("volume"),
        *[(F.sum(six * s) / 24).alias(f"first_{axis}") for axis, s in sums.items()], *[m.alias(f"second_{k}") for k, m in moments.items()],
    )
    centre = {axis: F.try_divide(F.col(f"first_{axis}"), F.col("volume")) for axis in "xyz"}

    def central(p: str, q: str) -> Column:
        return F.col(f"second_{p}{q}") - F.col("volume") * centre[p] * centre[q]

    return base.select(
        "mesh", "faces", "area", "volume", *[c.alias(f"c{axis}") for axis, c in centre.items()],
        (central("y", "y") + central("z", "z")).alias("ixx"), (central("x", "x") + central("z", "z")).alias("iyy"), (central("x", "x") + central("y", "y")).alias("izz"),
        (-central("x", "y")).alias("ixy"), (-central("x", "z")).alias("ixz"), (-central("y", "z")).alias("iyz"),
    )


def half_edges(faces: DataFrame) -> DataFrame:
    """mesh, f, lo, hi, forward: three rows a face; ``forward`` if the face runs from the lesser vertex."""
    sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    cut = faces.select("mesh", "f", F.explode(sides).alias("s"))
    return cut.select("mesh", "f", F.least("s.p", "s.q").alias("lo"), F.greatest("s.p", "s.q").alias("hi"), (F.col("s.p") < F.col("s.q")).alias("forward"))


def edges(faces: DataFrame) -> DataFrame:
    """One row an edge: how many faces use it and run each way, its owner (forward) and other face.

    One grouped aggregation pairs the half-edges; there is no self-join.
    """
    return half_edges(faces).groupBy("mesh", "lo", "hi").agg(
        F.count("*").alias("uses"), F.count_if("forward").alias("forward_uses"),
        F.min(F.when(F.col("forward"), F.col("f"))).alias("owner"), F.min(F.when(~F.col("forward"), F.col("f"))).alias("other"),
    )


def edge_kinds(edge_table: DataFrame) -> DataFrame:
    """Edges with their kind: open, manifold, inconsistent (both faces run one way) or overused."""
    kind = F.when(F.col("uses") == 1, "open").when(F.col("uses") > 2, "overused").when(F.col("forward_uses") == 1, "manifold").otherwise("inconsistent")
    return edge_table.withColumn("kind", kind)


def unpaired_edges(faces: DataFrame) -> DataFrame:
    """Counts of a mesh's edges of one face (open) and of all that are not manifold (unpaired), from one pass over the faces."""
    kinds = half_edges(faces).groupBy("mesh", "lo", "hi").agg(F.count("*").alias("uses"), F.count_if("forward").alias("forward_uses"))
    return kinds.groupBy("mesh").agg(F.count_if(F.col("uses") == 1).alias("open"), F.count_if((F.col("uses") != 2) | (F.col("forward_uses") != 1)).alias("unpaired"))


def integrity(faces: DataFrame) -> DataFrame:
    """Counts of edges by kind, and the Euler number, for every mesh."""
    e = edge_kinds(edges(faces)).groupBy("mesh").agg(
        F.count("*").alias("edges"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("open", "manifold", "inconsistent", "overused")]
    )
    v = faces.select("mesh", F.explode(F.array(*CORNERS)).alias("v")).groupBy("mesh").agg(F.count_distinct("v").alias("vertices"), (F.count("*") / 3).cast("long").alias("faces"))
    return v.join(by_shuffle(e), "mesh").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def edge_angles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Manifold edges with length and internal angle: pi is flat, less is convex, more is concave."""
    measured = face_measures(with_corners(faces, vertices))
    own = measured.select("mesh", F.col("f").alias("owner"), *[F.col(f"n{a}").alias(f"o{a}") for a in "xyz"])
    far = measured.select("mesh", F.col("f").alias("other"), *[F.col(f"n{a}").alias(f"t{a}") for a in "xyz"])
    lo = vertices.select("mesh", F.col("v").alias("lo"), *[F.col(a).alias(f"l{a}") for a in "xyz"])
    hi = vertices.select("mesh", F.col("v").alias("hi"), *[F.col(a).alias(f"h{a}") for a in "xyz"])
    e = edge_kinds(edges(faces)).where("kind = 'manifold'").join(by_shuffle(own), ["mesh", "owner"]).join(by_shuffle(far), ["mesh", "other"]).join(by_shuffle(lo), ["mesh", "lo"]).join(by_shuffle(hi), ["mesh", "hi"])
    n1, n2 = tuple(F.col(f"o{a}") for a in "xyz"), tuple(F.col(f"t{a}") for a in "xyz")
    along = minus(tuple(F.col(f"h{a}") for a in "xyz"), tuple(F.col(f"l{a}") for a in "xyz"))
    size = length(along)
    bend = F.atan2(dot(cross(n1, n2), scale(along, 1 / size)), dot(n1, n2))
    return e.select("mesh", "lo", "hi", "owner", "other", size.alias("length"), (math.pi - bend).alias("angle"))


def sharp_edges(angles: DataFrame, limit: float) -> DataFrame:
    """Edges that bend by ``limit`` radians or more."""
    return angles.where(F.abs(F.col("angle") - math.pi) >= limit)


def face_neighbours(faces: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(mesh, a, b) faces across a manifold edge, without the stop edges (mesh, lo, hi)."""
    e = edges(faces).where("uses = 2 and owner is not null and other is not null")
    if stops is not None:
        e = e.join(by_shuffle(stops.select("mesh", "lo", "hi")), ["mesh", "lo", "hi"], "left_anti")
    return e.select("mesh", F.col("owner").alias("a"), F.col("other").alias("b"))


def slice_segments(cornered: DataFrame, z: float) -> DataFrame:
    """Segments of each face on the plane z; half open, so a plane through vertices makes no doubles."""
    return _cut(cornered.withColumn("level", F.lit(float(z))), F.col("level"))


def uniform_slices(cornered: DataFrame, step: float) -> DataFrame:
    """Segments of each face on all planes z = level * step between its corners."""
    low, high = F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz")
    first, last = F.floor(low / step) + 1, F.floor(high / step)
    lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return _cut(cornered.withColumn("level", F.explode(lines)), F.col("level") * step)


def _cut(cornered: DataFrame, z: Column) -> DataFrame:
    def hit(p: str, q: str) -> Column:
        above = (F.col(f"{p}z") >= z) != (F.col(f"{q}z") >= z)
        t = (z - F.col(f"{p}z")) / (F.col(f"{q}z") - F.col(f"{p}z"))
        return F.when(above, F.struct(*[(F.col(f"{p}{a}") + t * (F.col(f"{q}{a}") - F.col(f"{p}{a}"))).alias(a) for a in "xy"]))

    hits = F.filter(F.array(hit("a", "b"), hit("b", "c"), hit("c", "a")), lambda h: h.isNotNull())
    cut = cornered.withColumn("_h", hits).where(F.size("_h") == 2)
    return cut.select("mesh", "f", "level", *[F.get("_h", F.lit(i))[a].alias(f"{a}{i + 1}") for i in (0, 1) for a in "xy"])


def inside_out(faces: DataFrame) -> DataFrame:
    """Faces wound the other way."""
    return faces.select("mesh", "f", "a", F.col("c").alias("b"), F.col("b").alias("c"))


def extrude(ring_edges: DataFrame, height: float) -> DataFrame:
    """Side walls (triangle soup) of rings lifted by ``height``."""
    low, high = F.lit(0.0), F.lit(float(height))
    p, q = ("x", "y"), ("x2", "y2")

    def tri(*corners: tuple) -> Column:
        return F.struct(*[v.alias(f"{c}{a}") for c, (xy, z) in zip(CORNERS, corners, strict=True) for a, v in zip("xyz", (F.col(xy[0]), F.col(xy[1]), z), strict=True)])

    walls = F.array(tri((p, low), (q, low), (q, high)), tri((p, low), (q, high), (p, high)))
    return ring_edges.select("ring", F.explode(walls).alias("t")).select("ring", "t.*")


def bounds(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def extremes(vertices: DataFrame, direction: Vector) -> DataFrame:
    """Least and greatest reach along a direction, with the vertices (ties to the smaller id)."""
    reach = dot(tuple(F.col(a) for a in "xyz"), direction)
    return vertices.withColumn("_d", reach).groupBy("mesh").agg(
        F.min("_d").alias("low"), F.max("_d").alias("high"), F.min_by("v", F.struct("_d", "v")).alias("low_vertex"), F.min_by("v", F.struct(-F.col("_d"), "v")).alias("high_vertex")
    )
