"""Sequential algorithms on one mesh or a few rings, used like those in ``kernels``."""

from __future__ import annotations

import heapq
import math

import numpy as np

from geoloom.operators.kernels import areas_many, arrange, arrange_many, area2d, inside, triangulate


def interaction(a: list[np.ndarray], b: list[np.ndarray], tolerance: float = 1e-9) -> str:
    """How two polygons lie: separated, equal, a_inside_b, b_inside_a or intersection."""
    return interactions([(a, b)], tolerance)[0]


def interactions(pairs: list[tuple[list[np.ndarray], list[np.ndarray]]], tolerance: float = 1e-9) -> list[str]:
    """``interaction`` of many pairs, in steps that take all of them at once."""
    sizes_a, sizes_b = areas_many([[x] for side in zip(*pairs, strict=True) for x in side], [lambda m: m[0]])[0].reshape(2, -1)
    common = areas_many([list(pair) for pair in pairs], [lambda m: m[0] & m[1] if len(m) > 1 else m[0] & False])[0]
    eps = tolerance * np.maximum(np.maximum(sizes_a, sizes_b), 1e-300)
    in_a, in_b = np.abs(common - sizes_b) <= eps, np.abs(common - sizes_a) <= eps
    return np.select([common <= eps, in_a & in_b, in_b, in_a], ["separated", "equal", "a_inside_b", "b_inside_a"], "intersection").tolist()


def polygon_tree(rings: list[np.ndarray]) -> list[int]:
    """Index of the smallest ring around each ring, -1 for outer ones; rings must not cross."""
    sizes = [abs(area2d(r)) for r in rings]
    out = []
    for i, ring in enumerate(rings):
        around = [j for j in range(len(rings)) if sizes[j] > sizes[i] and inside([rings[j]], ring[:1])[0]]
        out.append(min(around, key=lambda j: sizes[j], default=-1))
    return out


def shallow_trees(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings, counter-clockwise, each followed by its holes, clockwise; islands in holes are outer rings."""
    parents = polygon_tree(rings)

    def depth(i: int) -> int:
        return 0 if parents[i] < 0 else 1 + depth(parents[i])

    turned = [r if (area2d(r) > 0) == (depth(i) % 2 == 0) else r[::-1] for i, r in enumerate(rings)]
    return [[turned[i], *[turned[j] for j in range(len(rings)) if parents[j] == i]] for i in range(len(rings)) if depth(i) % 2 == 0]


def cut_ring(ring: np.ndarray, normal: np.ndarray, d: float) -> np.ndarray:
    """The part of a convex ring on the side normal . p <= d."""
    out = []
    for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        hp, hq = float(p @ normal) - d, float(q @ normal) - d
        if hp <= 0:
            out.append(p)
        if (hp < 0 < hq) or (hq < 0 < hp):
            out.append(p + (q - p) * hp / (hp - hq))
    return np.array(out).reshape(-1, 2)


def rotational_symmetry(ring: np.ndarray, tolerance: float = 1e-6) -> int:
    """Greatest number of equal turns that bring a ring onto itself (1: none)."""
    n, middle = len(ring), ring.mean(axis=0)
    arms = ring - middle
    scale = float(np.linalg.norm(arms, axis=1).max())
    for order in sorted((k for k in range(1, n + 1) if n % k == 0), reverse=True):
        c, s = math.cos(2 * math.pi / order), math.sin(2 * math.pi / order)
        if np.abs(np.roll(arms, n // order, axis=0) @ np.array([[1.0, 0], [0, 1]]) @ np.array([[c, s], [-s, c]]) - arms).max() <= tolerance * scale:
            return order
    return 1


def flipped_symmetry(ring: np.ndarray, tolerance: float = 1e-3) -> bool:
    """Whether the mirror image of a ring is the ring turned."""
    def signature(r: np.ndarray) -> np.ndarray:
        step = np.roll(r, -1, axis=0) - r
        after = np.roll(step, -1, axis=0)
        bend = np.arctan2(step[:, 0] * after[:, 1] - step[:, 1] * after[:, 0], (step * after).sum(axis=1))
        return np.column_stack([np.linalg.norm(step, axis=1), np.linalg.norm(after, axis=1), bend])

    forward, back = signature(ring), signature((ring * [-1, 1])[::-1])
    scale = np.maximum(np.abs(forward).max(axis=0), 1e-300)
    return any((np.abs(np.roll(back, k, axis=0) - forward) <= tolerance * scale).all() for k in range(len(ring)))


def border_loops(faces: np.ndarray) -> list[list[int]]:
    """Loops of edges that one face has, each run the way that closes it."""
    edges = {(f[i], f[i - 2]) for f in faces.tolist() for i in range(3)}
    follow: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        if (b, a) not in edges:
            follow.setdefault(b, []).append(a)
    loops = []
    while follow:
        at, path = min(follow), []
        while at in follow:
            if at in path:  # a loop is closed; what led to it goes on
                cut = path.index(at)
                loops.append(path[cut:])
                path = path[:cut]
            path.append(at)
            nxt = follow[at].pop()
            if not follow[at]:
                del follow[at]
            at = nxt
        if at in path:
            loops.append(path[path.index(at) :])
    return loops


def _flat(points: np.ndarray) -> np.ndarray:
    """Points of a loop in the plane of its mean normal, seen so that it runs counter-clockwise."""
    rest = points - points.mean(axis=0)
    normal = np.cross(rest, np.roll(rest, -1, axis=0)).sum(axis=0)
    normal /= max(np.linalg.norm(normal), 1e-300)
    side = np.cross(normal, [0.0, 0.0, 1.0] if abs(normal[2]) < 0.9 else [1.0, 0.0, 0.0])
    side /= np.linalg.norm(side)
    return np.stack([rest @ side, rest @ np.cross(normal, side)], axis=1)


def fill_holes(vertices: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Faces with a patch of triangles for every border loop."""
    out = [faces]
    for loop in border_loops(faces):
        if len(loop) > 2:
            out.append(np.array(loop)[triangulate(_flat(vertices[loop]))])
    return np.vstack(out)


def cut_solid(vertices: np.ndarray, faces: np.ndarray, normal: np.ndarray, d: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The closed parts of a closed mesh below and above the plane normal . p = d.

    Each cut loop is capped on its own, so a section with holes needs its cap made elsewhere.
    """
    height = vertices @ normal - d
    scale = max(float(np.abs(height).max()), 1e-300)
    height = np.where(np.abs(height) < 1e-12 * scale, 0.0, height)
    height, table, triples = height.tolist(), vertices.tolist(), faces.tolist()
    out = []
    for sign in (-1.0, 1.0):
        points, cuts, kept = list(table), {}, []
        for face in triples:
            ring = []
            for a, b in zip(face, face[1:] + face[:1], strict=True):
                ha, hb = sign * height[a], sign * height[b]
                if ha >= 0:
                    ring.append(a)
                if (ha < 0 < hb) or (hb < 0 < ha):
                    key = (min(a, b), max(a, b))
                    if key not in cuts:
                        p, q = key
                        t = height[p] / (height[p] - height[q])
                        cuts[key] = len(points)
                        points.append([u + t * (v - u) for u, v in zip(table[p], table[q], strict=True)])
                    ring.append(cuts[key])
            if len(ring) > 2 and any(sign * height[v] > 0 for v in face):
                kept += [(ring[0], ring[i], ring[i + 1]) for i in range(1, len(ring) - 1)]
        spots = np.array(points, dtype=float)
        part = np.array(kept, dtype=int).reshape(-1, 3)
        out.append((spots, fill_holes(spots, part) if len(part) else part))
    return out[0], out[1]


def collapse_edges(vertices: np.ndarray, faces: np.ndarray, target: int, longest: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Shortest edges collapse to their middle until ``target`` faces are left or all are longer than ``longest``.

    An edge whose ends share other neighbours than its two faces' is left alone, so a closed mesh stays one.
    """
    points = {i: v.astype(float) for i, v in enumerate(vertices)}
    around: dict[int, set] = {i: set() for i in points}
    live = {tuple(map(int, f)) for f in faces}
    for f in live:
        for v in f:
            around[v].add(f)

    def neighbours(v: int) -> set:
        return {u for f in around[v] for u in f if u != v}

    queue = [(float(np.linalg.norm(points[a] - points[b])), a, b) for f in live for a, b in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])) if a < b]
    heapq.heapify(queue)
    while queue and len(live) > target:
        size, a, b = heapq.heappop(queue)
        if size > longest:
            break
        if a not in points or b not in points or b not in neighbours(a) or size != float(np.linalg.norm(points[a] - points[b])):
            continue
        shared = around[a] & around[b]
        if len(shared) != 2 or len(neighbours(a) & neighbours(b)) != 2:
            continue
        points[a] = (points[a] + points.pop(b)) / 2
        for f in shared:
            live.discard(f)
            for v in f:
                around[v].discard(f)
        for f in list(around.pop(b)):
            g = tuple(a if v == b else v for v in f)
            live.discard(f)
            live.add(g)
            for v in f:
                if v != b:
                    around[v].discard(f)
            for v in g:
                around[v].add(g)
        for u in neighbours(a):
            heapq.heappush(queue, (float(np.linalg.norm(points[a] - points[u])), min(a, u), max(a, u)))
    names = sorted(points)
    at = {v: i for i, v in enumerate(names)}
    return np.array([points[v] for v in names]), np.array([[at[v] for v in f] for f in sorted(live)], dtype=int).reshape(-1, 3)


def silhouette(vertices: np.ndarray, faces: np.ndarray, direction: np.ndarray) -> list[np.ndarray]:
    """Border rings of a mesh's shadow along a direction, in the plane normal to it."""
    return silhouettes([(vertices, faces, direction)])[0]


def silhouettes(many: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[list[np.ndarray]]:
    """``silhouette`` of many (vertices, faces, direction), each by itself."""
    shapes, known = [], {}
    for vertices, faces, direction in many:
        key = tuple(direction.tolist())
        if key not in known:
            unit = direction / np.linalg.norm(direction)
            side = np.cross(unit, [0.0, 0.0, 1.0] if abs(unit[2]) < 0.9 else [1.0, 0.0, 0.0])
            side /= np.linalg.norm(side)
            known[key] = np.stack([side, np.cross(unit, side)], axis=1)
        flat = (vertices @ known[key])[faces]
        b, c = flat[:, 1] - flat[:, 0], flat[:, 2] - flat[:, 0]
        shapes.append([[t] for t in flat[(b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]) / 2 > 1e-12]])
    return arrange_many(shapes, lambda m: np.logical_or.reduce(m))
