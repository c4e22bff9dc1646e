"""Whole groups of rows, many to a numpy block.

Rows are dealt by their group to all shuffle partitions and sorted there; a kernel gets
some thousands at a time, no group in two parts.  A group has to fit a task, so callers
deal by something that bounds it: a count, a row of cells, a range of ordinates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, about.
ROWS = 20_000
#: Rows of a batch that goes back to Spark, at most.
BATCH = 50_000
#: Groups that are told to all tasks as a broadcast, at most.
FEW = 10_000

Arrays = dict[str, np.ndarray]


def per_blocks(rows: DataFrame, keys: list[str], schema: str, kernel: Callable[[Arrays, np.ndarray], tuple[np.ndarray, Arrays]], size: int = ROWS, deal: bool = True) -> DataFrame:
    """``keys`` and ``schema`` of what ``kernel`` makes of whole groups.

    The kernel gets the other columns as arrays and the number of each row's group, which
    ascends; it gives the number of the group of each row it makes, and the columns of
    ``schema``.  Without ``deal`` rows stay where they are and each is a group of its own.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL(schema).fields)
    values, made = [c for c in rows.columns if c not in keys], kinds.fieldNames()[len(keys):]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)

        def turns(table) -> np.ndarray:
            # rows whose group is not that of the row before
            out = np.zeros(table.num_rows, bool)
            for k in keys:
                codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                out[1:] |= codes[1:] != codes[:-1]
            return np.flatnonzero(out)

        def work(table):
            table = table.combine_chunks()
            starts = np.concatenate([[0], turns(table)]) if deal else np.arange(table.num_rows)
            group = np.zeros(table.num_rows, int)
            group[starts[1:]] = 1
            of, out = kernel({c: table.column(c).to_numpy() for c in values}, np.cumsum(group))
            first = table.select(keys).take(pa.array(starts[of]))
            whole = pa.Table.from_arrays([*first.columns, *[pa.array(out[c], target.field(c).type, from_pandas=False) for c in made]], schema=target)
            yield from whole.combine_chunks().to_batches(max_chunksize=BATCH)

        held, count, enough = [], 0, size
        for batch in batches:
            if not batch.num_rows:
                continue
            if not deal:
                yield from work(pa.Table.from_batches([batch]))
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                at = turns(table)
                if len(at):
                    yield from work(table.slice(0, at[-1]))
                    table = table.slice(at[-1])
                held, count = table.to_batches(), table.num_rows
                enough = max(size, 2 * count)
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys) if deal else rows
    return dealt.mapInArrow(run, kinds)


def by_size(rows: DataFrame, limit: int, weight=None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of groups ``g`` of at most ``limit`` rows, and of larger ones (None if there are none); a null ``g`` is in neither.

    ``weight`` counts a row for more than one.
    """
    from geoloom.functions.storage import materialise
    from geoloom.operators.joins import by_shuffle

    known = rows.where("g IS NOT NULL")
    large = materialise(known.groupBy("g").agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).where(F.col("n") > limit).select("g"), "large")
    many = large.limit(FEW + 1).count()
    if not many:
        return known, None
    told = F.broadcast(large) if many <= FEW else by_shuffle(large)
    return known.join(told, "g", "left_anti"), known.join(told, "g", "left_semi")


def partners(group: np.ndarray, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of two rows of a group: each row with all, or, with ``later``, with those after it."""
    n = np.bincount(group) if len(group) else np.zeros(0, int)
    ends = np.cumsum(n)
    at = np.arange(len(group))
    first = at + 1 if later else (ends - n)[group]
    many = ends[group] - first
    i = np.repeat(at, many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _merged(group: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``arrangement.pieces_of`` on arrays: points and weights are arrays of rows."""
    up = (p[:, 1] < q[:, 1]) | ((p[:, 1] == q[:, 1]) & (p[:, 0] < q[:, 0]))
    lo, hi, w = np.where(up[:, None], p, q), np.where(up[:, None], q, p), np.where(up[:, None], w, -w)
    real = (lo != hi).any(axis=1)
    group, lo, hi, w = group[real], lo[real], hi[real], w[real]
    if not len(group):
        return group, lo, hi, w
    order = np.lexsort((hi[:, 1], hi[:, 0], lo[:, 1], lo[:, 0], group))
    group, lo, hi, w = group[order], lo[order], hi[order], w[order]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (lo[1:] != lo[:-1]).any(axis=1) | (hi[1:] != hi[:-1]).any(axis=1)])
    first = np.flatnonzero(fresh)
    return group[first], lo[first], hi[first], np.add.reduceat(w, first, axis=0)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def pieces(group: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``arrangement.arrange`` on arrays, by all pairs of a group: (group, lo, hi, w)."""
    slack = 10.0 ** (1 - digits)
    group, lo, hi, w = _merged(group, p, q, w)
    low, high = np.minimum(lo, hi) - slack, np.maximum(lo, hi) + slack
    i, j = partners(group, later=True)
    near = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
    i, j = i[near], j[near]
    d, size = hi - lo, np.hypot(*(hi - lo).T)
    touched = np.zeros(len(i), bool)
    segment, at = [np.arange(len(lo))] * 2, [lo, hi]
    for one, other in ((i, j), (j, i)):
        for end in (lo, hi):
            away = end[other] - lo[one]
            along = (away * d[one]).sum(axis=1) / size[one]
            on = (np.abs(_cross(d[one], away)) / size[one] <= slack) & (along > slack) & (along < size[one] - slack)
            touched |= on
            segment.append(one[on])
            at.append(end[other[on]])
    area, away = _cross(d[i], d[j]), lo[j] - lo[i]
    crossing = ~touched & (np.abs(area) > 1e-15 * size[i] * size[j])
    safe = np.where(crossing, area, 1.0)
    t, u = _cross(away, d[j]) / safe, _cross(away, d[i]) / safe
    crossing &= (t * size[i] > slack) & (t * size[i] < size[i] - slack) & (u * size[j] > slack) & (u * size[j] < size[j] - slack)
    i, j = i[crossing], j[crossing]
    spot = np.round(lo[i] + t[crossing][:, None] * d[i], digits) + 0.0
    segment, at = np.concatenate([*segment, i, j]), np.concatenate([*at, spot, spot])
    order = np.lexsort((((at - lo[segment]) * d[segment]).sum(axis=1), segment))
    segment, at = segment[order], at[order]
    same = segment[1:] == segment[:-1]
    own = segment[:-1][same]
    return _merged(group[own], at[:-1][same], at[1:][same], w[own])


def seen_to_the_right(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the directions, by operand, of the pieces that a ray from each piece's middle to the right meets."""
    middle = (lo + hi) / 2
    i, j = partners(group)
    met = (lo[j, 1] <= middle[i, 1]) & (hi[j, 1] > middle[i, 1]) & (i != j)
    i, j = i[met], j[met]
    past = lo[j, 0] + (middle[i, 1] - lo[j, 1]) / (hi[j, 1] - lo[j, 1]) * (hi[j, 0] - lo[j, 0]) > middle[i, 0]
    i, j = i[past], j[past]
    return np.stack([np.rint(np.bincount(i, v[j], minlength=len(lo))) for v in w.T], axis=1).astype(np.int64)


def ring_order(group: np.ndarray, edge: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ring, seq, hole) of edges from ``a`` to ``b``, as ``arrangement.rings_of`` has them."""
    n = len(edge)
    of, ends = np.concatenate([group, group]), np.concatenate([a, b])
    order = np.lexsort((ends[:, 1], ends[:, 0], of))
    fresh = np.concatenate([[False], (np.diff(of[order]) != 0) | (ends[order][1:] != ends[order][:-1]).any(axis=1)])
    vertex = np.empty(2 * n, int)
    vertex[order] = np.cumsum(fresh)
    leaves, comes = np.bincount(vertex[:n], minlength=2 * n), np.bincount(vertex[n:], minlength=2 * n)
    # the last place stands for the end of a path
    follow = np.full(n + 1, n)
    out = np.full(2 * n, n)
    out[vertex[:n]] = np.arange(n)
    plain = (leaves[vertex[n:]] == 1) & (comes[vertex[n:]] == 1)
    follow[:n][plain] = out[vertex[n:]][plain]
    ray = np.flatnonzero((leaves + comes)[vertex] > 2)
    if len(ray):
        away = np.concatenate([b - a, a - b])[ray]
        ray = ray[np.lexsort((np.arctan2(away[:, 1], away[:, 0]), vertex[ray]))]
        start = np.concatenate([[True], np.diff(vertex[ray]) != 0])
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(ray)) - 1
        before = np.concatenate([[0], ray[:-1]])
        before[first] = ray[last]
        # an inside lies between what leaves and what comes next counter-clockwise
        joined = (ray >= n) & (before < n)
        follow[ray[joined] - n] = before[joined]
    rounds = max(1, int(np.ceil(np.log2(np.bincount(group).max() + 1)))) if n else 0
    jump, least = follow.copy(), np.append(edge, np.iinfo(np.int64).max)
    for _ in range(rounds):
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    loop = jump[:n] < n
    # a loop is cut before its least edge
    cut = loop & (edge[np.minimum(follow[:n], n - 1)] == least[:n]) if n else loop
    follow[:n][cut] = n
    jump, last = follow, np.where(follow == n, np.arange(n + 1), follow)
    steps = (follow < n).astype(np.int64)
    for _ in range(rounds):
        steps = steps + steps[jump]
        last = last[last]
        jump = jump[jump]
    last, steps = last[:n], steps[:n]
    ring = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(ring, last, edge)
    turn = np.bincount(last, a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], minlength=n)
    return ring[last], np.bincount(last, minlength=n)[last] - 1 - steps, turn[last] < 0
