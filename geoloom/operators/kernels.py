"""Sequential algorithms on one shape, in numpy: hulls, enclosing circles, triangulation, clipping.

They run inside ``applyInPandas``, one shape a group; the shape must fit a task,
the collection need not.  Points are arrays of rows.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Shapes that a kernel of many gets at once.
SHAPES = 256


def per_shape(rows: DataFrame, group: str, schema: str, kernel) -> DataFrame:
    """``kernel`` (a pandas frame in, a frame of ``schema`` without the group out) for every group."""
    kind = dict(rows.dtypes)[group]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = kernel(frame)
        out.insert(0, group, key[0])
        return out

    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, {schema}")


def per_arrays(rows: DataFrame, group: str, columns: list[str], schema: str, kernel, order: list[str] | None = None, many: bool = False) -> DataFrame:
    """``kernel`` (an array of a group's rows by ``columns`` in, tuples of ``schema`` without the group out) for every group.

    Groups are dealt to all shuffle partitions and come many to an Arrow batch, so
    small shapes do not each pay for a call into Python.  Rows of a null group are
    a group.  With ``many`` the kernel gets a list of up to ``SHAPES`` arrays at once, and
    gives the tuples of each.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[group]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(group, *[c for c in order or [] if c not in columns], *columns).repartition(parts, group).sortWithinPartitions(group, *(order or []))

    def run(batches):
        import pyarrow as pa

        kinds = None
        out: list[list] = []
        waiting: list[tuple] = []

        def done(key, pieces: list[np.ndarray]) -> None:
            waiting.append((key, pieces[0] if len(pieces) == 1 else np.concatenate(pieces)))
            if len(waiting) == (SHAPES if many else 1):
                work()

        def work() -> None:
            shapes = [shape for _, shape in waiting]
            for (own, _), rows in zip(waiting, kernel(shapes) if many and shapes else map(kernel, shapes), strict=True):
                out.extend((own, *row) for row in rows)
            waiting.clear()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        names = [group, *[part.split()[0] for part in schema.split(",")]]
        kinds = [_arrow(kind), *[_arrow(part.split(None, 1)[1].strip()) for part in schema.split(",")]]
        key, pieces = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            numbers, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            values = np.column_stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in itertools.pairwise(cuts):
                own = keys[numbers[a]]
                if pieces and own != key:
                    done(key, pieces)
                    pieces = []
                key = own
                pieces.append(values[a:b])
            if len(out) > 10_000:
                yield flush()
                out.clear()
        if pieces:
            done(key, pieces)
        work()
        if out:
            yield flush()

    return dealt.mapInArrow(run, f"{group} {kind}, {schema}")


def _arrow(kind: str):
    import pyarrow as pa

    names = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    return names[kind]


def turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull2d(points: np.ndarray) -> np.ndarray:
    """Indices of the strict convex hull, counter-clockwise from the least point."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    keep: list[int] = []
    for i in order:
        if not keep or tuple(points[i]) != tuple(points[keep[-1]]):
            keep.append(int(i))
    if len(keep) < 3:
        return np.array(keep)
    halves = []
    for chain in (keep, keep[::-1]):
        half: list[int] = []
        for i in chain:
            while len(half) > 1 and turn(points[half[-2]], points[half[-1]], points[i]) <= 0:
                half.pop()
            half.append(i)
        halves.append(half[:-1])
    return np.array(halves[0] + halves[1])


def area2d(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] @ y[1:] - x[1:] @ y[:-1]) / 2)  # the closing side starts from zero


def least_rectangle(points: np.ndarray) -> dict:
    """Rectangle of least area about points: one side lies on a hull edge."""
    hull = points[hull2d(points)]
    if len(hull) < 2:
        return {"area": 0.0, "angle": 0.0, "width": 0.0, "height": 0.0}
    edges = np.roll(hull, -1, axis=0) - hull
    unit = edges / np.maximum(np.linalg.norm(edges, axis=1), 1e-300)[:, None]
    along, across = hull @ unit.T, hull @ np.stack([-unit[:, 1], unit[:, 0]])
    width, height = np.ptp(along, axis=0), np.ptp(across, axis=0)
    best = int(np.argmin(np.round(width * height, 12)))
    return {"area": float(width[best] * height[best]), "angle": float(math.atan2(unit[best, 1], unit[best, 0]) % (math.pi / 2)), "width": float(max(width[best], height[best])), "height": float(min(width[best], height[best]))}


def ball_through(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Least ball with all of up to d + 1 points on its surface."""
    if len(points) == 1:
        return points[0], 0.0
    rest = points[1:] - points[0]
    gram = 2 * rest @ rest.T
    try:
        weights = np.linalg.solve(gram, (rest**2).sum(axis=1))
    except np.linalg.LinAlgError:
        weights = np.linalg.lstsq(gram, (rest**2).sum(axis=1), rcond=None)[0]
    centre = points[0] + weights @ rest
    return centre, float(np.linalg.norm(centre - points[0]))


def least_ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Smallest enclosing circle or sphere: the farthest outside point joins the support, whose best subset stays."""
    points = np.unique(points, axis=0)
    d = points.shape[1]
    support = [int(np.argmax(np.linalg.norm(points - points[0], axis=1)))]
    centre, radius = points[support[0]].astype(float), 0.0
    for _ in range(1000):
        gaps = np.linalg.norm(points - centre, axis=1)
        far = int(np.argmax(gaps))
        if gaps[far] <= radius * (1 + 1e-12) + 1e-15:
            break
        names = [*[i for i in support if i != far], far]
        best = None
        for n in range(1, min(len(names), d + 1) + 1):
            for subset in itertools.combinations(names, n):
                if far not in subset:
                    continue
                c, r = ball_through(points[list(subset)])
                if np.linalg.norm(points[names] - c, axis=1).max() <= r * (1 + 1e-10) + 1e-12 and (best is None or r < best[1]):
                    best = c, r, list(subset)
        if best is None or best[1] <= radius:
            break
        centre, radius, support = best
    return centre, radius


def hull3d(points: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Triangles of the convex hull, seen counter-clockwise from outside; none for flat input."""
    points = np.asarray(points, dtype=float)
    span = float(np.ptp(points, axis=0).max()) if len(points) else 0.0
    eps = tolerance * max(span, 1e-300)
    a = int(np.argmin(points[:, 0])) if len(points) else 0
    if len(points) < 4:
        return np.zeros((0, 3), int)
    b = int(np.argmax(np.linalg.norm(points - points[a], axis=1)))
    normals = np.cross(points[b] - points[a], points - points[a])
    c = int(np.argmax(np.linalg.norm(normals, axis=1)))
    heights = (points - points[a]) @ normals[c]
    e = int(np.argmax(np.abs(heights)))
    if abs(heights[e]) <= eps * np.linalg.norm(normals[c]) or np.linalg.norm(normals[c]) <= eps * eps:
        return np.zeros((0, 3), int)
    if heights[e] > 0:
        b, c = c, b
    return _grow_hull(points, [(a, b, c), (a, c, e), (c, b, e), (b, a, e)], eps)


def _grow_hull(points: np.ndarray, start: list[tuple[int, int, int]], eps: float) -> np.ndarray:
    """Hull from a first tetrahedron: every face keeps the outside points given to it, and the farthest joins next.

    A point is looked at again only when its face goes, and then only against the new faces.
    """
    faces: dict[int, tuple[int, int, int]] = {}
    planes: dict[int, tuple[np.ndarray, float]] = {}
    outside: dict[int, np.ndarray] = {}
    across: dict[tuple[int, int], int] = {}
    count = itertools.count()

    def add(triples: list[tuple[int, int, int]], left: np.ndarray) -> None:
        table = np.array(triples)
        n = np.cross(points[table[:, 1]] - points[table[:, 0]], points[table[:, 2]] - points[table[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        d = (n * points[table[:, 0]]).sum(axis=1)
        over = points[left] @ n.T - d
        best = over.argmax(axis=1) if len(left) else np.zeros(0, int)
        seen = over[np.arange(len(left)), best] > eps if len(left) else np.zeros(0, bool)
        for i, triple in enumerate(triples):
            name = next(count)
            faces[name], planes[name] = triple, (n[i], float(d[i]))
            mine = left[seen & (best == i)]
            if len(mine):
                outside[name] = mine
            for k in range(3):
                across[triple[k], triple[(k + 1) % 3]] = name

    add(start, np.setdiff1d(np.arange(len(points)), np.array(start).ravel()))
    while outside:
        name = next(iter(outside))
        n, d = planes[name]
        p = int(outside[name][np.argmax(points[outside[name]] @ n - d)])
        visible, stack, rim = {name}, [name], []
        while stack:
            f = faces[stack.pop()]
            for k in range(3):
                u, v = f[k], f[(k + 1) % 3]
                other = across[v, u]
                if other in visible:
                    continue
                n, d = planes[other]
                if points[p] @ n - d > eps:
                    visible.add(other)
                    stack.append(other)
                else:
                    rim.append((u, v))
        rim = [(u, v) for u, v in rim if across[v, u] not in visible]
        left = [outside.pop(f) for f in visible if f in outside]
        for f in visible:
            for k in range(3):
                across.pop((faces[f][k], faces[f][(k + 1) % 3]), None)
            del faces[f], planes[f]
        whole = np.concatenate(left) if left else np.zeros(0, int)
        add([(u, v, p) for u, v in rim], whole[whole != p])
    return np.array(sorted(faces.values()))


def mesh_volume(points: np.ndarray, faces: np.ndarray) -> float:
    if not len(faces):
        return 0.0
    a, b, c = (points[faces[:, i]] - points[0] for i in range(3))
    return float((a * np.cross(b, c)).sum() / 6)


def least_box(points: np.ndarray) -> float:
    """Volume of the smallest box found with a side on a hull face."""
    faces = hull3d(points)
    if not len(faces):
        return 0.0
    best = math.inf
    n = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    n /= np.linalg.norm(n, axis=1)[:, None]
    for normal in n[_without_opposites(n)]:
        side = np.cross(normal, [0.0, 0.0, 1.0] if abs(normal[2]) < 0.9 else [1.0, 0.0, 0.0])
        side /= np.linalg.norm(side)
        flat = np.stack([points @ side, points @ np.cross(normal, side)], axis=1)
        best = min(best, least_rectangle(flat)["area"] * float(np.ptp(points @ normal)))
    return best


def delaunay2d(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles: the lower hull of the points lifted to a paraboloid."""
    if len(points) == 3:
        size = area2d(points)
        return np.array([[0, 1, 2]] if size > 0 else [[0, 2, 1]] if size < 0 else [], dtype=int).reshape(-1, 3)
    middle = points - points.mean(axis=0)
    lifted = np.column_stack([middle, (middle**2).sum(axis=1)])
    faces = hull3d(lifted)
    if not len(faces):
        return faces
    n = np.cross(lifted[faces[:, 1]] - lifted[faces[:, 0]], lifted[faces[:, 2]] - lifted[faces[:, 0]])
    return faces[n[:, 2] < -1e-12 * np.linalg.norm(n, axis=1)][:, ::-1]


def triangulate(ring: np.ndarray) -> np.ndarray:
    """Triangles (indices) of a simple ring by cutting ears."""
    order = list(range(len(ring)))
    if area2d(ring) < 0:
        order.reverse()
    out, ring = [], [tuple(p) for p in ring.tolist()]
    while len(order) > 3:
        for i in range(len(order)):
            a, b, c = order[i - 1], order[i], order[(i + 1) % len(order)]
            if turn(ring[a], ring[b], ring[c]) <= 0:
                continue
            others = [p for p in order if p not in (a, b, c) and ring[p] not in (ring[a], ring[b], ring[c])]
            if not any(turn(ring[a], ring[b], ring[p]) >= 0 and turn(ring[b], ring[c], ring[p]) >= 0 and turn(ring[c], ring[a], ring[p]) >= 0 for p in others):
                out.append((a, b, c))
                del order[i]
                break
        else:  # only flat or crossing corners are left: the flattest goes
            i = min(range(len(order)), key=lambda j: abs(turn(ring[order[j - 1]], ring[order[j]], ring[order[(j + 1) % len(order)]])))
            del order[i]
    if len(order) == 3:
        out.append(tuple(order))
    return np.array(out, dtype=int).reshape(-1, 3)


def inside(rings: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Even-odd membership of points."""
    out = np.zeros(len(p), dtype=bool)
    for ring in rings:
        q = np.roll(ring, -1, axis=0)
        for (x1, y1), (x2, y2) in zip(ring, q, strict=True):
            if y1 == y2:
                continue
            crosses = ((y1 > p[:, 1]) != (y2 > p[:, 1])) & (p[:, 0] < x1 + (p[:, 1] - y1) / (y2 - y1) * (x2 - x1))
            out ^= crosses
    return out


OPERATIONS = {"union": lambda a, b: a | b, "intersect": lambda a, b: a & b, "subtract": lambda a, b: a & ~b, "xor": lambda a, b: a ^ b}


def boolean(a: list[np.ndarray], b: list[np.ndarray], operation: str, digits: int = 9) -> list[np.ndarray]:
    """Border rings of a boolean of two sets of rings (each even-odd), the result on the left of its edges."""
    return arrange([a, b], lambda m: OPERATIONS[operation](m[0], m[1]), digits)


def booleans_of_area(pairs: list[tuple[list[np.ndarray], list[np.ndarray]]], operations: tuple[str, ...], digits: int = 9) -> np.ndarray:
    """Areas of ``boolean`` for many pairs, by pair and operation; each pair is arranged once for all operations."""
    decides = [lambda m, o=o: OPERATIONS[o](m[0], m[1] if len(m) > 1 else m[0] & False) for o in operations]
    return areas_many([list(pair) for pair in pairs], decides, digits).T


#: Places of a table of pairs that is looked at at once.
PAIRS = 1 << 20


def _meet(left: np.ndarray, right: np.ndarray, n: int, test) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of items of equal group that pass ``test``; the groups of both sides ascend.  Groups are looked at many at once."""
    many_l, many_r = np.bincount(left, minlength=n), np.bincount(right, minlength=n)
    first_l, first_r = np.cumsum(many_l) - many_l, np.cumsum(many_r) - many_r
    order = np.argsort(many_l * many_r, kind="stable")
    order = order[(many_l * many_r)[order] > 0]
    sizes = list(zip(many_l[order].tolist(), many_r[order].tolist(), strict=True))
    out, a = [(np.zeros(0, int), np.zeros(0, int))], 0
    while a < len(order):
        b, (high, wide) = a + 1, sizes[a]
        while b < len(order) and (b + 1 - a) * max(high, sizes[b][0]) * max(wide, sizes[b][1]) <= PAIRS:
            high, wide, b = max(high, sizes[b][0]), max(wide, sizes[b][1]), b + 1
        own = order[a:b]
        j = np.minimum(first_r[own][:, None] + np.arange(wide), len(right) - 1)
        real_j = np.arange(wide) < many_r[own][:, None]
        step = max(1, PAIRS // (len(own) * wide))
        for f in range(0, high, step):
            rows = np.arange(f, min(f + step, high))
            i = np.minimum(first_l[own][:, None] + rows, len(left) - 1)
            hit = test(i[:, :, None], j[:, None, :])
            hit &= (rows < many_l[own][:, None])[:, :, None] & real_j[:, None, :]
            g, q = np.divmod(np.flatnonzero(hit), wide)
            out.append((i.ravel()[g], j[g // len(rows), q]))
        a = b
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _spots(points: np.ndarray, group: np.ndarray, grain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each point's place, places, their groups): points of a group within a grain of each other are one place, that of the first.

    Points part where neighbours in order of x or of y are more than a grain apart, until no more part.  Places are in order of group, x and y.
    """
    label, count, axis, still = group, len(np.unique(group)), 0, 0
    while still < 2:
        order = np.lexsort((points[:, axis], label))
        apart = (np.diff(label[order]) != 0) | (np.diff(points[order, axis]) > grain)
        fresh = np.empty(len(points), int)
        fresh[order] = np.concatenate([[0], np.cumsum(apart)])
        label, axis = fresh, 1 - axis
        found = int(apart.sum()) + 1
        still, count = (still + 1 if found == count else 0), found
    first = np.full(count, len(points))
    np.minimum.at(first, label, np.arange(len(points)))
    order = np.lexsort((points[first, 1], points[first, 0], group[first]))
    number = np.empty(count, int)
    number[order] = np.arange(count)
    return number[label], points[first[order]], group[first[order]]


def arrange(shapes: list[list[np.ndarray]], decide, digits: int = 9) -> list[np.ndarray]:
    """Border rings of what ``decide`` makes of the memberships in ``shapes``.

    All edges are cut where they meet; a piece stays if the result differs on its two sides.
    """
    return arrange_many([shapes], decide, digits)[0]


def arrange_many(many: list[list[list[np.ndarray]]], decide, digits: int = 9) -> list[list[np.ndarray]]:
    """``arrange`` of many lists of shapes, each by itself, in steps that take all of them at once.

    ``decide`` gets a table of memberships by shape and place; where a list has fewer shapes than others the rest count as outside.
    """
    found: list[list[np.ndarray]] = [[] for _ in many]
    for places, home, (start, end) in _borders(many, [decide], digits):
        _trace(found, places, home, start, end)
    return found


def areas_many(many: list[list[list[np.ndarray]]], decides: list, digits: int = 9) -> np.ndarray:
    """Areas of what each of ``decides`` makes of lists of shapes, by decision and list: the sums over the rings of ``arrange_many``, from one arrangement and without the rings."""
    out = np.zeros((len(decides), len(many)))
    for places, home, *borders in _borders(many, decides, digits):
        # about a place of the list, so that areas far from the origin keep their digits
        about = np.zeros((len(many), 2))
        about[home[::-1]] = places[::-1]
        x, y = (places - about[home]).T
        for k, (p, q) in enumerate(borders):
            out[k] = np.bincount(home[p], x[p] * y[q] - x[q] * y[p], minlength=len(many)) / 2
    return out


def _borders(many: list[list[list[np.ndarray]]], decides: list, digits: int):
    """Places, their lists and, for each of ``decides``, the first and last places of the border's pieces, their inside on the left; nothing if there is no piece."""
    rings = [(g, k, r) for g, shapes in enumerate(many) for k, shape in enumerate(shapes) for r in shape if len(r)]
    if not rings:
        return
    sizes = np.array([len(r) for *_, r in rings])
    start = np.round(np.concatenate([np.asarray(r, float) for *_, r in rings]), digits)
    follow = np.arange(1, len(start) + 1)
    follow[np.cumsum(sizes) - 1] = np.cumsum(sizes) - sizes
    end = start[follow]
    group, shape = (np.repeat(np.array([r[i] for r in rings]), sizes) for i in range(2))
    real = (start != end).any(axis=1)
    start, end, group, shape = start[real], end[real], group[real], shape[real]
    if not len(start):
        return
    (sx, sy), (ex, ey) = start.T, end.T
    dx, dy = ex - sx, ey - sy
    size = np.hypot(dx, dy)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    x0, x1, y0, y1 = np.minimum(sx, ex), np.maximum(sx, ex), np.minimum(sy, ey), np.maximum(sy, ey)
    scale = np.zeros(len(many))
    scale[group[heads]] = np.maximum(np.maximum.reduceat(x1, heads) - np.minimum.reduceat(x0, heads), np.maximum.reduceat(y1, heads) - np.minimum.reduceat(y0, heads))
    slack = 1e-8 * scale[group]
    left, right, low, high = x0 - slack, x1 + slack, y0 - slack, y1 + slack
    i, j = _meet(group, group, len(many), lambda i, j: (left[i] <= right[j]) & (left[j] <= right[i]) & (low[i] <= high[j]) & (low[j] <= high[i]))
    i, j = i[i != j], j[i != j]
    rx, ry = sx[j] - sx[i], sy[j] - sy[i]
    bottom, off = dx[i] * dy[j] - dy[i] * dx[j], rx * dy[i] - ry * dx[i]
    cross = np.abs(bottom) > 1e-12 * size[i] * size[j]
    safe = np.where(cross, bottom, 1.0)
    t, u = (rx * dy[j] - ry * dx[j]) / safe, off / safe
    hit = cross & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
    flat = ~cross & (np.abs(off) <= 1e-9 * scale[group[i]] * size[i])
    own, at = [np.arange(len(start))] * 2 + [i[hit]], [np.zeros(len(start)), np.ones(len(start)), t[hit]]
    i, j = i[flat], j[flat]
    for px, py in ((sx, sy), (ex, ey)):
        s = ((px[j] - sx[i]) * dx[i] + (py[j] - sy[i]) * dy[i]) / (dx[i] * dx[i] + dy[i] * dy[i])
        inner = (s > 0) & (s < 1)
        own.append(i[inner]), at.append(s[inner])
    segment, at = np.concatenate(own), np.concatenate(at)
    # ends come first, so a place near one is that end
    spot, places, home = _spots(np.stack([sx[segment] + at * dx[segment], sy[segment] + at * dy[segment]], axis=1), group[segment], 10.0 ** (1 - digits))
    order = np.lexsort((at, segment))
    p, q = spot[order][:-1], spot[order][1:]
    kept = (np.diff(segment[order]) == 0) & (p != q)
    pieces = np.unique(np.minimum(p, q)[kept] * len(places) + np.maximum(p, q)[kept])
    if not len(pieces):
        return
    lo, hi = pieces // len(places), pieces % len(places)
    middle, way = (places[lo] + places[hi]) / 2, places[hi] - places[lo]
    side = np.stack([-way[:, 1], way[:, 0]], axis=1) * (scale[home[lo]] * 1e-7 / np.hypot(way[:, 0], way[:, 1]))[:, None]
    shapes = int(shape.max()) + 1

    def inner(points: np.ndarray) -> np.ndarray:
        px, py = points.T
        i, j = _meet(home[lo], group, len(many), lambda i, j: (sy[j] > py[i]) != (ey[j] > py[i]))
        past = px[i] < sx[j] + (py[i] - sy[j]) / dy[j] * dx[j]
        i, j = i[past], shape[j[past]]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        out, step = [], max(1, 4 * PAIRS // shapes)
        for a in range(0, len(points), step):
            b = min(a + step, len(points))
            f, g = np.searchsorted(i, [a, b])
            table = (np.bincount((i[f:g] - a) * shapes + j[f:g], minlength=(b - a) * shapes) % 2 == 1).reshape(b - a, shapes).T
            out.append([decide(table) for decide in decides])
        return np.concatenate(out, axis=1)

    borders = []
    for on_left, on_right in zip(inner(middle + side), inner(middle - side), strict=True):
        border = on_left != on_right
        borders.append((np.where(on_left, lo, hi)[border], np.where(on_left, hi, lo)[border]))
    yield places, home, *borders


def _trace(found: list[list[np.ndarray]], places: np.ndarray, home: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Add the rings of pieces to those of their lists."""
    onward: dict[int, list[int]] = {}
    for p, q in zip(start.tolist(), end.tolist(), strict=True):
        onward.setdefault(p, []).append(q)
    xy, homes = places.tolist(), home.tolist()
    for first in sorted(onward):
        while first in onward:
            ring, at, before = [], first, None
            while True:
                choices = onward[at]
                if before is not None and len(choices) > 1:  # the sharpest left turn keeps rings simple
                    x, y = xy[at]
                    back = math.atan2(xy[before][1] - y, xy[before][0] - x)
                    choices.sort(key=lambda q: (back - math.atan2(xy[q][1] - y, xy[q][0] - x)) % (2 * math.pi) or 2 * math.pi)
                ring.append(at)
                before, at = at, choices.pop(0)
                if not choices:
                    del onward[before]
                if at == first or at not in onward:
                    break
            if len(ring) > 2:
                found[homes[first]].append(places[ring])


def minkowski_convex(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two convex rings: their edges in order of direction; an error if a ring is not convex."""
    for ring in (a, b):
        whole = area2d(ring[hull2d(ring)])
        if abs(whole - abs(area2d(ring))) > 1e-9 * whole:
            raise ValueError("a ring is not convex")
    a, b = a[hull2d(a)], b[hull2d(b)]
    edges = np.vstack([np.roll(r, -1, axis=0) - r for r in (a, b)])
    order = np.argsort(np.arctan2(edges[:, 1], edges[:, 0]) % (2 * math.pi), kind="stable")
    first = a[np.lexsort((a[:, 0], a[:, 1]))[0]] + b[np.lexsort((b[:, 0], b[:, 1]))[0]]
    walk = first + np.vstack([[0.0, 0.0], np.cumsum(edges[order], axis=0)[:-1]])
    return walk[hull2d(walk)]


def offset(ring: np.ndarray, amount: float, joins: str = "round", deviation: float = 1e-3) -> list[np.ndarray]:
    """Ring moved outward (or inward, negative) by ``amount`` with round, square or miter joins."""
    return offset_many([ring], amount, joins, deviation)[0]


def offset_many(rings: list[np.ndarray], amount: float, joins: str = "round", deviation: float = 1e-3) -> list[list[np.ndarray]]:
    """``offset`` of many rings, each by itself."""
    rings = [ring[::-1] if area2d(ring) < 0 else ring for ring in rings]
    grow, size = amount > 0, abs(amount)
    plain = [grow and joins == "miter" and _is_convex(ring) for ring in rings]

    def decide(m: np.ndarray) -> np.ndarray:
        band = np.logical_or.reduce(m[1:])
        return m[0] | band if grow else m[0] & ~band

    rest = iter(arrange_many([[[ring], *[[part] for part in _bands(ring, grow, size, joins, deviation)]] for ring, done in zip(rings, plain, strict=True) if not done], decide))
    return [[_mitered(ring, size)] if done else next(rest) for ring, done in zip(rings, plain, strict=True)]


def _bands(ring: np.ndarray, grow: bool, size: float, joins: str, deviation: float) -> list[np.ndarray]:
    """What the border of a ring sweeps over: a rectangle along each side, and a join at each corner that opens."""
    after = np.roll(ring, -1, axis=0)
    way = after - ring
    way /= np.hypot(way[:, 0], way[:, 1])[:, None]
    out = np.stack([way[:, 1], -way[:, 0]], axis=1) * size
    parts = list(np.stack([ring - out, after - out, after + out, ring + out], axis=1))
    out2 = np.roll(out, -1, axis=0)
    bend = out[:, 0] * out2[:, 1] - out[:, 1] * out2[:, 0]
    opens = np.flatnonzero(bend > 0 if grow else bend < 0)
    q, out, out2 = after[opens], out[opens], out2[opens]
    if joins == "round":
        steps = max(8, math.ceil(math.pi / math.acos(max(-1.0, 1 - deviation / size)))) if size > deviation else 8
        angles = np.arange(steps) * 2 * math.pi / steps
        return parts + list(q[:, None] + size * np.stack([np.cos(angles), np.sin(angles)], axis=1))
    sign = 1.0 if grow else -1.0
    bisector = out + out2
    if joins == "square":
        unit = bisector / np.maximum(np.hypot(bisector[:, 0], bisector[:, 1]), 1e-12)[:, None]
        half = size * np.tan(np.arccos(np.minimum(1.0, (unit * out).sum(axis=1) / size)) / 2)[:, None]
        across = np.stack([-unit[:, 1], unit[:, 0]], axis=1) * half
        corners = np.stack([q, q + sign * out, q + sign * unit * size - across, q + sign * unit * size + across, q + sign * out2], axis=1)
    else:
        tip = bisector * (size * size / np.maximum(size * size + (out * out2).sum(axis=1), 1e-12))[:, None]
        corners = np.stack([q, q + sign * out, q + sign * tip, q + sign * out2], axis=1)
    return parts + list(corners)


def _is_convex(ring: np.ndarray) -> bool:
    """Whether a counter-clockwise ring turns left at every corner, once around."""
    step = np.roll(ring, -1, axis=0) - ring
    after = np.roll(step, -1, axis=0)
    bend = step[:, 0] * after[:, 1] - step[:, 1] * after[:, 0]
    return bool((bend > 0).all() and abs(np.arctan2(bend, (step * after).sum(axis=1)).sum() - 2 * math.pi) < 1e-6)


def _mitered(ring: np.ndarray, size: float) -> np.ndarray:
    """A convex ring grown by ``size``: neighbouring sides meet where they are moved to."""
    way = np.roll(ring, -1, axis=0) - ring
    out = np.stack([way[:, 1], -way[:, 0]], axis=1) / np.linalg.norm(way, axis=1)[:, None]
    before = np.roll(out, 1, axis=0)
    return ring + size * (out + before) / (1 + (out * before).sum(axis=1))[:, None]


def minkowski(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Border rings of the sum of two simple rings: the union of the sums of their triangles."""
    return minkowski_many([(a, b)])[0]


def minkowski_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[np.ndarray]]:
    """``minkowski`` of many pairs of rings, each by itself."""
    cut = [(a[triangulate(a)], b[triangulate(b)]) for a, b in pairs]
    sums = _triangle_sums(*[np.concatenate([t for both in cut for t in (np.repeat(both[0], len(both[1]), axis=0), np.tile(both[1], (len(both[0]), 1, 1)))[i : i + 1]]) for i in range(2)]) if cut else []
    ends = np.cumsum([0, *[len(s) * len(t) for s, t in cut]]).tolist()
    return arrange_many([[[p] for p in sums[i:j]] for i, j in itertools.pairwise(ends)], lambda m: np.logical_or.reduce(m))


def _turns(t: np.ndarray) -> np.ndarray:
    """Twice the areas of triangles, negative for clockwise ones."""
    b, c = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    return b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]


def _triangle_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of each two triangles: their edges, run counter-clockwise, in order of direction."""
    a, b = (np.where((_turns(c) < 0)[:, None, None], c[:, ::-1], c) for c in (a, b))
    edges = np.concatenate([c[:, [1, 2, 0]] - c for c in (a, b)], axis=1)
    order = np.argsort(np.arctan2(edges[:, :, 1], edges[:, :, 0]) % (2 * math.pi), axis=1, kind="stable")
    walk = np.cumsum(np.take_along_axis(edges, order[:, :, None], axis=1), axis=1)
    lowest = sum(np.take_along_axis(c, np.lexsort((c[:, :, 0], c[:, :, 1]), axis=1)[:, :1, None], axis=1) for c in (a, b))
    return lowest + np.concatenate([np.zeros((len(a), 1, 2)), walk[:, :-1]], axis=1)


def simplify_short_edges(ring: np.ndarray, shortest: float, least: int = 3) -> np.ndarray:
    """Shortest edges collapse to their middle while they are shorter than ``shortest`` and points remain."""
    points = {i: ring[i] for i in range(len(ring))}
    after = {i: (i + 1) % len(ring) for i in points}
    before = {j: i for i, j in after.items()}
    queue = [(float(np.linalg.norm(points[after[i]] - points[i])), i, after[i]) for i in points]
    heapq.heapify(queue)
    while queue and len(points) > least:
        size, i, j = heapq.heappop(queue)
        if i not in points or j not in points or after.get(i) != j or size != float(np.linalg.norm(points[j] - points[i])):
            continue
        if size >= shortest:
            break
        points[i] = (points[i] + points[j]) / 2
        after[i] = after[j]
        before[after[j]] = i
        del points[j], after[j]
        for u in (before[i], i):
            heapq.heappush(queue, (float(np.linalg.norm(points[after[u]] - points[u])), u, after[u]))
    return np.array([points[i] for i in sorted(points)])


def simplify_area(ring: np.ndarray, budget: float) -> np.ndarray:
    """Corners of least triangle area go while their sum stays within ``budget``."""
    order, spent = list(range(len(ring))), 0.0
    while len(order) > 3:
        sizes = [abs(turn(ring[order[i - 1]], ring[order[i]], ring[order[(i + 1) % len(order)]])) / 2 for i in range(len(order))]
        i = int(np.argmin(sizes))
        if spent + sizes[i] > budget:
            break
        spent += sizes[i]
        del order[i]
    return ring[order]


def rigid_fit(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation R and shift t of least squares with source @ R + t near target."""
    a, b = source.mean(axis=0), target.mean(axis=0)
    u, _, vt = np.linalg.svd((source - a).T @ (target - b))
    flip = np.eye(len(a))
    flip[-1, -1] = np.sign(np.linalg.det(u @ vt))
    rotation = u @ flip @ vt
    return rotation, b - a @ rotation


def register(source: np.ndarray, target: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Iterative closest points: rotation, shift and the root mean square gap."""
    rotation, shift, last = np.eye(source.shape[1]), np.zeros(source.shape[1]), math.inf
    for _ in range(rounds):
        moved = source @ rotation + shift
        gaps = ((moved[:, None, :] - target[None, :, :]) ** 2).sum(axis=2)
        rotation, shift = rigid_fit(source, target[gaps.argmin(axis=1)])
        error = float(np.sqrt(gaps.min(axis=1).mean()))
        if last - error < tolerance:
            break
        last = error
    return rotation, shift, last


def convex_distance(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> float:
    """Least distance of two convex point sets: the point of their difference nearest the origin, by supports."""
    x = a.mean(axis=0) - b.mean(axis=0)
    corners = [x]
    for _ in range(rounds):
        support = a[np.argmin(a @ x)] - b[np.argmax(b @ x)]
        if x @ x - x @ support <= 1e-12 * max(1.0, float(x @ x)):
            break
        corners.append(support)
        best = None
        for n in range(1, min(len(corners), len(x) + 1) + 1):
            for subset in itertools.combinations(range(len(corners)), n):
                p = np.array([corners[i] for i in subset])
                rest = (p[1:] - p[0]).T
                w = np.linalg.lstsq(rest, -p[0], rcond=None)[0] if n > 1 else np.zeros(0)
                if (w < -1e-12).any() or w.sum() > 1 + 1e-12:
                    continue
                q = p[0] + (rest @ w if n > 1 else 0)
                if best is None or q @ q < best[0] - 1e-15:
                    best = float(q @ q), q, subset
        x, corners = best[1], [corners[i] for i in best[2]]
        if x @ x < 1e-18:
            return 0.0
    return float(np.linalg.norm(x))


def sphere_points(n: int) -> np.ndarray:
    """Evenly spread unit vectors on a spiral."""
    i = np.arange(n) + 0.5
    polar, azimuth = np.arccos(1 - 2 * i / n), math.pi * (1 + math.sqrt(5)) * i
    return np.stack([np.sin(polar) * np.cos(azimuth), np.sin(polar) * np.sin(azimuth), np.cos(polar)], axis=1)


class _Sides:
    """Sides of many rings, in a table with a row a ring; rows are filled up with sides of no length."""

    def __init__(self, rings: list[np.ndarray]):
        self.start = np.stack([np.concatenate([r, np.repeat(r[:1], max(map(len, rings)) - len(r), axis=0)]) for r in rings])
        self.way = np.roll(self.start, -1, axis=1) - self.start

    def within(self, of: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Even-odd membership of points (a row for each ring of ``of``) in these rings."""
        x, y, dx, dy = (c[of, None, :, i] for c in (self.start, self.way) for i in range(2))
        px, py = p[:, :, None, 0], p[:, :, None, 1]
        cut = (y > py) != (np.roll(y, -1, axis=2) > py)
        return (cut & (px < x + (py - y) / np.where(dy == 0, 1.0, dy) * dx)).sum(axis=2) % 2 == 1

    def distance(self, of: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Least distance of points (a row for each ring of ``of``) to the sides of these rings."""
        x, y, dx, dy = (c[of, None, :, i] for c in (self.start, self.way) for i in range(2))
        rx, ry = p[:, :, None, 0] - x, p[:, :, None, 1] - y
        t = np.clip((rx * dx + ry * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
        return np.sqrt(((rx - t * dx) ** 2 + (ry - t * dy) ** 2).min(axis=2))


def poisson_points(ring: np.ndarray, gap: float, seed: int = 0, tries: int = 30) -> np.ndarray:
    """Points inside a ring at least ``gap`` apart, by dart throwing around accepted ones."""
    return poisson_points_many([ring], [gap], seed, tries)[0]


def poisson_points_many(rings: list[np.ndarray], gaps: list[float], seed: int = 0, tries: int = 30) -> list[np.ndarray]:
    """``poisson_points`` of many rings, each by itself and with its own gap; a round throws all darts around one point of each ring."""
    if not rings:
        return []
    rng, sides, gap = np.random.default_rng(seed), _Sides(rings), np.asarray(gaps, float)
    found = np.full((len(rings), 16, 2), np.inf)
    found[:, 0] = [ring[triangulate(ring)[0]].mean(axis=0) for ring in rings]
    active, count = np.zeros(found.shape[:2], bool), np.ones(len(rings), int)
    active[:, 0] = True
    live = np.arange(len(rings))
    while len(live):
        # rings that are done do not change what the others draw
        pick, angle, far = rng.random(), rng.random(tries) * 2 * math.pi, 1 + rng.random(tries)
        order = np.cumsum(active[live], axis=1)
        at = (order > (pick * order[:, -1]).astype(int)[:, None]).argmax(axis=1)
        darts = found[live, at][:, None] + gap[live, None, None] * np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1)
        good, least = sides.within(live, darts), (gap[live] ** 2 * (1 + 1e-12))[:, None]
        for k in range(int(count[live].max())):
            away = darts - found[live, k, None]
            good &= away[:, :, 0] ** 2 + away[:, :, 1] ** 2 >= least
        hit = good.any(axis=1)
        active[live[~hit], at[~hit]] = False
        some, new = live[hit], count[live[hit]]
        if len(new) and new.max() == found.shape[1]:
            found = np.concatenate([found, np.full(found.shape, np.inf)], axis=1)
            active = np.concatenate([active, np.zeros(active.shape, bool)], axis=1)
        found[some, new] = darts[hit, good[hit].argmax(axis=1)]
        active[some, new] = True
        count[some] += 1
        live = live[active[live].any(axis=1)]
    return [found[i, :n] for i, n in enumerate(count)]


def roots(coefficients: np.ndarray) -> np.ndarray:
    """Complex roots of a polynomial, highest power first."""
    return np.sort_complex(np.roots(coefficients))


def _real_roots(coefficients: np.ndarray) -> list[float]:
    found = np.roots(coefficients)
    return sorted(found.real[np.abs(found.imag) < 1e-7 * (1 + np.abs(found.real))].tolist())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def real_roots(coefficients: pd.Series) -> pd.Series:
    """Ascending real roots of polynomials held as arrays, highest power first."""
    return coefficients.map(lambda c: None if c is None else _real_roots(np.asarray(c, float)))


def conic_fit(points: np.ndarray) -> np.ndarray:
    """Conic (xx, xy, yy, x, y, constant) of least algebraic error with unit coefficients."""
    middle = points.mean(axis=0)
    x, y = (points - middle).T
    c = np.linalg.svd(np.column_stack([x * x, x * y, y * y, x, y, np.ones(len(x))]))[2][-1]
    u, v = middle
    moved = [c[0], c[1], c[2], c[3] - 2 * c[0] * u - c[1] * v, c[4] - 2 * c[2] * v - c[1] * u, c[5] + c[0] * u * u + c[1] * u * v + c[2] * v * v - c[3] * u - c[4] * v]
    return np.array(moved)


def edge_distances(ring: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Least distance of each point to the sides of a ring."""
    way = np.roll(ring, -1, axis=0) - ring
    rest = p[:, None, :] - ring[None]
    t = np.clip((rest * way).sum(axis=2) / np.maximum((way * way).sum(axis=1), 1e-300), 0, 1)
    return np.linalg.norm(rest - t[:, :, None] * way, axis=2).min(axis=1)


def inner_circle(ring: np.ndarray, precision: float = 1e-4) -> tuple[np.ndarray, float]:
    """Largest circle in a ring: squares that may still hold a better centre are quartered."""
    return inner_circles([ring], precision)[0]


def inner_circles(rings: list[np.ndarray], precision: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """``inner_circle`` of many rings, each by itself; a round quarters squares of all of them."""
    if not rings:
        return []
    sides = _Sides(rings)
    low, high = (np.array([f(r, axis=0) for r in rings]) for f in (np.min, np.max))
    half = (high - low).max(axis=1) / 2
    best, radius = (low + high) / 2, np.full(len(rings), -np.inf)
    of, centres, size = np.arange(len(rings)), best.copy(), half.copy()
    while len(of):
        step = max(1, PAIRS // sides.start.shape[1])
        portions = [(of[a : a + step], centres[a : a + step, None]) for a in range(0, len(of), step)]
        signed = np.concatenate([sides.distance(i, c)[:, 0] * np.where(sides.within(i, c)[:, 0], 1.0, -1.0) for i, c in portions])
        order = np.lexsort((-signed, of))
        first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
        better = first[signed[first] > radius[of[first]]]
        best[of[better]], radius[of[better]] = centres[better], signed[better]
        left = signed + size * math.sqrt(2) > radius[of] + precision * np.maximum(half[of], 1e-300)
        size = np.repeat(size[left] / 2, 4)
        of, centres = np.repeat(of[left], 4), np.repeat(centres[left], 4, axis=0) + size[:, None] * np.tile([[-1.0, -1], [1, -1], [-1, 1], [1, 1]], (int(left.sum()), 1))
    return [(best[i], float(radius[i])) for i in range(len(rings))]


def _frame(normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    side = np.cross(normal, [0.0, 0.0, 1.0] if abs(normal[2]) < 0.9 else [1.0, 0.0, 0.0])
    side /= np.linalg.norm(side)
    return side, np.cross(normal, side)


def box_along(points: np.ndarray, direction: np.ndarray) -> float:
    """Volume of the least box with sides along a direction."""
    unit = direction / np.linalg.norm(direction)
    u, v = _frame(unit)
    return least_rectangle(np.stack([points @ u, points @ v], axis=1))["area"] * float(np.ptp(points @ unit))


def least_cylinder(points: np.ndarray) -> tuple[float, np.ndarray]:
    """(volume, axis) of the least cylinder about points over the directions of their hull's faces and edges."""
    faces = hull3d(points)
    if not len(faces):
        return 0.0, np.array([0.0, 0.0, 1.0])
    corners = points[faces]
    normals = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    edges = np.concatenate([corners[:, i] - corners[:, i - 1] for i in range(3)])
    ways = np.concatenate([normals, edges])
    ways /= np.maximum(np.linalg.norm(ways, axis=1), 1e-300)[:, None]
    ways = ways[_without_opposites(ways)]
    # no cylinder is narrower than two of its points are apart across its axis, so most axes need no circle
    spots = points[np.unique(faces)]
    some = spots[np.unique(np.linspace(0, len(spots) - 1, min(len(spots), 64)).astype(int))]
    apart = np.concatenate([some[i + 1 :] - some[i] for i in range(len(some) - 1)])
    least = np.concatenate([math.pi / 4 * np.ptp(spots @ part.T, axis=0) * np.maximum((apart**2).sum(axis=1)[:, None] - (apart @ part.T) ** 2, 0).max(axis=0) for part in np.split(ways, range(500, len(ways), 500))])
    best = math.inf, ways[0]
    for i in np.argsort(least, kind="stable"):
        if least[i] * (1 - 1e-9) >= best[0]:
            break
        way = ways[i]
        u, v = _frame(way)
        size = math.pi * least_ball(np.stack([spots @ u, spots @ v], axis=1))[1] ** 2 * float(np.ptp(spots @ way))
        if size < best[0]:
            best = size, way
    return best


def _without_opposites(ways: np.ndarray) -> np.ndarray:
    """Positions of unit vectors of different directions, to nine digits, where opposite ones are alike."""
    lead = ways[np.arange(len(ways)), np.round(np.abs(ways), 9).argmax(axis=1)]
    return np.unique(np.round(ways * np.sign(lead)[:, None], 9) + 0.0, axis=0, return_index=True)[1]


def triangulate_with_holes(outer: np.ndarray, holes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(points, triangles) of a ring with holes: each hole is joined to the ring by a bridge to a corner that it sees."""
    ring = outer if area2d(outer) > 0 else outer[::-1]
    for hole in sorted((h if area2d(h) < 0 else h[::-1] for h in holes), key=lambda h: -h[:, 0].max()):
        start = int(np.argmax(hole[:, 0]))
        p = hole[start]
        sides = [(r[i], r[(i + 1) % len(r)]) for r in (ring, *holes) for i in range(len(r))]

        def clear(q: np.ndarray) -> bool:
            for a, b in sides:
                if any(tuple(x) == tuple(y) for x in (a, b) for y in (p, q)):
                    continue
                if turn(p, q, a) * turn(p, q, b) <= 0 and turn(a, b, p) * turn(a, b, q) <= 0:
                    return False
            return True

        order = np.argsort(np.linalg.norm(ring - p, axis=1))
        at = next(int(i) for i in order if clear(ring[i]))
        ring = np.concatenate([ring[: at + 1], np.roll(hole, -start, axis=0), p[None], ring[at:]])
    return ring, triangulate(ring)
