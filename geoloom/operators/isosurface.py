"""Isosurfaces and layered solids.

A cube of grid samples is cut into the six tetrahedra around its main diagonal, and
each of those gives no, one or two triangles by the signs of its corners: no table
of cube cases is needed, neighbouring cubes agree on their common faces, and the
surface is closed.  Samples are dealt by tiles once, and a task cuts many cubes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.joins import by_shuffle


#: Samples of a tile along each axis, tiles whose cubes are found at once, and rows that a task gathers before.
TILE, TILES, ROWS = 16, 32, 100_000


def sample_grid(spark, low: tuple, side: float, counts: tuple[int, int, int], field) -> DataFrame:
    """(i, j, k, x, y, z, value) of a field (a function of three columns) at the corners of a grid."""
    ni, nj, nk = counts
    n = F.col("id")
    cells = spark.range(ni * nj * nk).select(F.floor(n / (nj * nk)).alias("i"), (F.floor(n / nk) % nj).alias("j"), (n % nk).alias("k"))
    placed = cells.select("*", *[(low[a] + F.col(c) * side).alias(x) for a, (c, x) in enumerate(zip("ijk", "xyz", strict=True))])
    return placed.withColumn("value", field((F.col("x"), F.col("y"), F.col("z"))))


def _tetrahedra() -> list[list[int]]:
    """Corners (bit mask x + 2y + 4z) of the tetrahedra along the paths 0 -> 7, all of one orientation."""
    out = []
    for order in permutations(range(3)):
        path, at = [0], 0
        for axis in order:
            at |= 1 << axis
            path.append(at)
        inversions = sum(order[a] > order[b] for a in range(3) for b in range(a + 1, 3))
        out.append(path if inversions % 2 == 0 else [path[0], path[1], path[3], path[2]])
    return out


def _faces(mask: int) -> list[tuple[int, int]]:
    """Edges (inside corner, outside corner) of a tetrahedron where a surface cuts it, in order as seen from outside; ``mask`` has a bit for each corner inside."""
    inside, rest = ([n for n in range(4) if (mask >> n & 1) == bit] for bit in (1, 0))
    if len(inside) == 1:
        pairs = [(inside[0], c) for c in rest]
    elif len(inside) == 3:
        pairs = [(c, rest[0]) for c in inside]
    else:
        (a, b), (c, d) = inside, rest
        pairs = [(a, c), (a, d), (b, d), (b, c)]
    # all tetrahedra are turned alike, so one of them shows which way round is outward
    spots = [np.array([m & 1, m >> 1 & 1, m >> 2 & 1], dtype=float) for m in _tetrahedra()[0]]
    middle = [(spots[a] + spots[b]) / 2 for a, b in pairs]
    outward = sum(spots[c] for c in rest) / len(rest) - sum(spots[c] for c in inside) / len(inside)
    return pairs[::-1] if np.cross(middle[1] - middle[0], middle[2] - middle[0]) @ outward < 0 else pairs


def _soup(batches: Iterator) -> Iterator:
    """Triangles (i, j, k, ax .. cz) of the cubes that a surface passes, from rows (i, j, k, x, y, z, value, ti, tj, tk) in order of tiles."""
    import pyarrow as pa

    width, tetrahedra = TILE + 1, _tetrahedra()
    faces = {mask: _faces(mask) for mask in range(1, 15)}
    steps = np.array([(m & 1) * width**2 + (m >> 1 & 1) * width + (m >> 2 & 1) for m in range(8)])

    def work(place: np.ndarray, data: np.ndarray, tile: np.ndarray):
        number = np.cumsum(np.append(False, (np.diff(tile, axis=0) != 0).any(axis=1)))
        first = np.flatnonzero(np.append(True, np.diff(number) != 0))
        found = []
        for a in range(0, len(first), TILES):
            lo, hi = first[a], first[a + TILES] if a + TILES < len(first) else len(tile)
            local = place[lo:hi] - tile[lo:hi] * TILE
            at = (((number[lo:hi] - a) * width + local[:, 0]) * width + local[:, 1]) * width + local[:, 2]
            cells = (number[hi - 1] - a + 1) * width**3
            once = np.bincount(at, minlength=cells) == 1
            row = np.zeros(cells, np.int64)
            row[at] = np.arange(lo, hi)
            # the lower corners, and of those the ones whose cube is whole
            base = at[(local < TILE).all(axis=1) & once[at]]
            base = base[once[base[:, None] + steps].all(axis=1)]
            rows = row[base[:, None] + steps]
            value = data[rows, 3]
            found.append(rows[(value.min(axis=1) < 0) & (value.max(axis=1) >= 0)])
        rows = np.concatenate(found)
        place, spots, value = place[rows[:, 0]], data[rows, :3], data[rows, 3]
        made = [(np.zeros((0, 3), np.int64), np.zeros((0, 9)))]
        for path in tetrahedra:
            case = ((value[:, path] < 0) << np.arange(4)).sum(axis=1)
            for mask, shape in faces.items():
                own = np.flatnonzero(case == mask)
                if not len(own):
                    continue
                hits = []
                for n, m in shape:
                    p, q = path[n], path[m]
                    t = value[own, p] / (value[own, p] - value[own, q])
                    hits.append(spots[own, p] + t[:, None] * (spots[own, q] - spots[own, p]))
                made += [(place[own], np.concatenate([hits[0], hits[i], hits[i + 1]], axis=1)) for i in range(1, len(hits) - 1)]
        cells, soup = (np.concatenate(c) for c in zip(*made, strict=True))
        names = [*"ijk", *[f"{c}{x}" for c in "abc" for x in "xyz"]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells.T, *soup.T)], names=names)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append([np.stack(columns[:3], axis=1), np.stack(columns[3:7], axis=1), np.stack(columns[7:], axis=1)])
        if sum(len(h[0]) for h in held) < ROWS:
            continue
        own = [np.concatenate(c) for c in zip(*held, strict=True)]
        # the last tile may go on in the next batch
        last = np.flatnonzero((own[2] != own[2][-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield work(*[c[:cut] for c in own])
        held = [[c[cut:] for c in own]]
    if sum(len(h[0]) for h in held):
        yield work(*[np.concatenate(c) for c in zip(*held, strict=True)])


def triangles(samples: DataFrame, side: float) -> DataFrame:
    """Triangle soup (i, j, k, ax .. cz) of the surface value = 0, normals toward positive values.

    Cubes are put together in tiles of ``TILE`` samples an axis and their neighbours; a cube
    with a sample that is missing, comes twice or has no value has no surface.
    """
    own = samples.select(*[F.col(c).cast("long").alias(c) for c in "ijk"], *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "value")])
    # a sample on the lower side of a tile is one of the tile before it, too
    for c in "ijk":
        tile = F.floor(F.col(c) / TILE)
        own = own.withColumn(f"t{c}", F.explode(F.when(F.col(c) % TILE == 0, F.array(tile, tile - 1)).otherwise(F.array(tile))))
    tiles = own.repartition("ti", "tj", "tk").sortWithinPartitions("ti", "tj", "tk")
    return tiles.mapInArrow(_soup, "i bigint, j bigint, k bigint, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz"))


def layered_volume(layers: DataFrame, group: str, height: str, area: str) -> DataFrame:
    """Volume and centre height of a stack of section areas, by trapezoids between layers."""
    w = Window.partitionBy(group).orderBy(height)
    step, mean = F.lead(height).over(w) - F.col(height), (F.lead(area).over(w) + F.col(area)) / 2
    pieces = layers.select(group, (step * mean).alias("v"), (step * mean * (F.lead(height).over(w) + F.col(height)) / 2).alias("m"))
    return pieces.groupBy(group).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("volume"), F.try_divide(F.sum("m"), F.sum("v")).alias("centre"))


def fill_missing_layers(layers: DataFrame, group: str, level: str, value: str) -> DataFrame:
    """Every level between a group's first and last; an empty one repeats the layer before it."""
    span = layers.groupBy(group).agg(F.min(level).alias("a"), F.max(level).alias("b")).select(group, F.explode(F.sequence("a", "b")).alias(level))
    w = Window.partitionBy(group).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return span.join(by_shuffle(layers), [group, level], "left").select(group, level, F.last(value, ignorenulls=True).over(w).alias(value))
