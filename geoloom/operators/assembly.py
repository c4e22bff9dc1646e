"""Trees of parts: (node, parent, step), flattened level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(tree: DataFrame, most: int = 100) -> DataFrame:
    """node, depth and shift: the sum of the steps from the root.

    One equi-join a level; a tree deeper than ``most`` levels, or a cycle, raises ``ValueError``.
    """
    level = tree.where(F.col("parent").isNull()).select("node", F.lit(0).cast("long").alias("depth"), F.col("step").alias("shift"))
    out = level
    children = tree.where(F.col("parent").isNotNull())
    for _ in range(most):
        above = level.select(F.col("node").alias("parent"), "depth", "shift")
        level = children.join(above, "parent").select("node", (F.col("depth") + 1).alias("depth"), (F.col("shift") + F.col("step")).alias("shift"))
        if level.isEmpty():
            return out
        out = out.unionAll(level)
    raise ValueError("the tree has a cycle or too many levels")


def matrix(scale, shift) -> Column:
    """A 4 x 4 matrix as an array of its rows' entries: even scaling, then the same shift along all axes."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[scale if i == j and i < 3 else shift if i == 3 and j < 3 else one if i == j else zero for i in range(4) for j in range(4)])


def product(a: Column, b: Column) -> Column:
    """Product of two 4 x 4 matrices held as arrays: a row vector goes through ``a`` and then ``b``."""
    def entry(i: int, j: int) -> Column:
        parts = [F.get(a, F.lit(4 * i + k)) * F.get(b, F.lit(4 * k + j)) for k in range(4)]
        return parts[0] + parts[1] + parts[2] + parts[3]

    return F.array(*[entry(i, j) for i in range(4) for j in range(4)])


def compose(tree: DataFrame, most: int = 100) -> DataFrame:
    """node, depth and the matrix from the node's own frame to the root's, of a tree (node, parent, m).

    One equi-join a level; a tree deeper than ``most`` levels, or a cycle, raises ``ValueError``.
    """
    level = tree.where(F.col("parent").isNull()).select("node", F.lit(0).cast("long").alias("depth"), "m")
    out, children = level, tree.where(F.col("parent").isNotNull())
    for _ in range(most):
        above = level.select(F.col("node").alias("parent"), "depth", F.col("m").alias("_above"))
        level = children.join(above, "parent").select("node", (F.col("depth") + 1).alias("depth"), product(F.col("m"), F.col("_above")).alias("m"))
        if level.isEmpty():
            return out
        out = out.unionAll(level)
    raise ValueError("the tree has a cycle or too many levels")


def transformed(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(node, x, y, z): the points of a part (a small table) placed by each node's matrix."""
    rows = F.array_agg(F.struct("x", "y", "z"))
    shape = points.agg(rows.alias("shape"))
    placed = nodes.join(F.broadcast(shape)).select("node", "m", F.explode("shape").alias("p"))  # one row: the part
    at = [F.col("p.x") * F.get("m", F.lit(j)) + F.col("p.y") * F.get("m", F.lit(4 + j)) + F.col("p.z") * F.get("m", F.lit(8 + j)) + F.get("m", F.lit(12 + j)) for j in range(3)]
    return placed.select("node", *[v.alias(x) for v, x in zip(at, "xyz", strict=True)])


def tree_json(tree: DataFrame) -> DataFrame:
    """(node, json): for each node its name and those of its children, as text."""
    kids = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))
    return tree.select("node").join(kids, "node", "left").select("node", F.to_json(F.struct("node", F.coalesce("children", F.array().cast("array<string>")).alias("children"))).alias("json"))
