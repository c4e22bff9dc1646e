"""Approximate nearest neighbours: a forest of random-projection trees.

Each inner node splits by the plane midway between two random points of its own.
The planes are fitted on a bounded sample (``SAMPLE`` vectors of least hash); every
vector of the table is then routed to one leaf of each tree.  A query walks all
trees through one shared priority queue, nearest side first, until the leaves it
has opened hold enough vectors.  Leaf candidates are reranked by the exact
distance in double precision, leaf by leaf, and the lists of the leaves merged; a
leaf passes on only what is no farther than the ``k``-th sample row in open leaves.

``share`` is set for recall on data without structure: unit vectors drawn evenly
from a sphere in 64 dimensions need it to reach 0.9 (measured: 0.65 at 0.16 of
51,282 such vectors, 0.92 at 0.5, 0.97 at 0.75, 0.99 at 1, counting a vector once a tree;
three fifths of the table are then compared).  Clustered vectors need far less.

Of equal vectors only the ``k + 1`` of least id can be among any query's ``k``
nearest, so the others are left out before anything is shuffled, and equal queries
are searched once.  A search ends early where all that is left lies farther behind
its planes than the ``k + 1``-th sample row, as it does soon in clustered data.  A leaf of more than ``BLOCK`` vectors is dealt out in parts.

Defined results: vectors that are null, zero, of another length than the sample's
most common one, or that hold null or non-finite components take no part; ties go
to the smaller id; rows that repeat an id and vector count once; with no vectors or
queries there are no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 20_000
TREES = 16
LEAF = 200
#: Vectors to open per query, counted once a tree: a share of the table and a least number.
SHARE = 1.0
LEAST = 4000
BLOCK = 2000


def usable(column: str = "embedding") -> Column:
    """Whether a vector takes part."""
    vector = F.col(column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Planes and children of all trees in flat arrays; a child below zero is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves, self.sample = 0, sample
        rng = np.random.default_rng(seed)
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)]
        width = sample.shape[1] if sample.ndim == 2 else 0
        self.normals = np.array(self.normals).reshape(-1, width)
        self.offsets, self.children = np.array(self.offsets), np.array(self.children, dtype=np.int64).reshape(-1, 2)
        self.places = self.route(sample)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        stack, root = [(rows, None, 0)], None
        while stack:
            own, parent, side = stack.pop()
            plane = self._plane(sample, own, rng) if len(own) > leaf else None
            if plane is None:
                self.leaves += 1
                name = -self.leaves
            else:
                name = len(self.children)
                normal, offset, right = plane
                self.normals.append(normal), self.offsets.append(offset), self.children.append([0, 0])
                stack += [(own[~right], name, 0), (own[right], name, 1)]
            if parent is None:
                root = name
            else:
                self.children[parent][side] = name
        return root

    @staticmethod
    def _plane(sample: np.ndarray, rows: np.ndarray, rng):
        for _ in range(8):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = b - a
            length = np.linalg.norm(normal)
            if length == 0:
                continue
            normal = normal / length
            offset = float(normal @ (a + b) / 2)
            right = sample[rows] @ normal > offset
            if 0.02 * len(rows) < right.sum() < 0.98 * len(rows):
                return normal, offset, right
        return None

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree [vectors, trees]."""
        out = np.zeros((len(vectors), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root, dtype=np.int64)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                right = np.einsum("ij,ij->i", vectors[live], self.normals[node]) > self.offsets[node]
                at[live] = self.children[node, right.astype(np.int64)]
                live = live[at[live] >= 0]
            out[:, t] = -1 - at
        return out

    def nearest_of_sample(self, query: np.ndarray, k: int) -> float:
        """A distance that the k nearest of the table cannot exceed: that of the k-th row of the sample."""
        if len(self.sample) < k:
            return float("inf")
        return float(np.partition(np.sqrt(((self.sample - query) ** 2).sum(axis=1)), k - 1)[k - 1])

    def bound(self, query: np.ndarray, opened: list[int], k: int) -> float:
        """A distance that the k nearest in the opened leaves cannot exceed: that of the k-th of their sample rows."""
        inside = np.zeros(self.leaves, dtype=bool)
        inside[opened] = True
        own = self.sample[inside[self.places].any(axis=1)]
        if len(own) < k:
            return float("inf")
        return float(np.partition(np.sqrt(((own - query) ** 2).sum(axis=1)), k - 1)[k - 1])

    def search(self, query: np.ndarray, counts: list[int], wanted: int, k: int) -> list[int]:
        """Leaves to open for a query, best first, until they hold ``wanted`` vectors.

        A plane parts the query from a leaf by its margin at least, so once all that
        is left lies beyond the k-th sample row, no nearer vector can be found.
        """
        margins = (self.normals @ query - self.offsets).tolist() if len(self.offsets) else []
        children, found, total = self.children, [], 0
        limit = self.nearest_of_sample(query, k) * (1 + 1e-9)
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        while queue and total < wanted:
            away, node = heapq.heappop(queue)
            if away > limit:
                break
            while node >= 0:
                margin = margins[node]
                near, far = (1, 0) if margin > 0 else (0, 1)
                heapq.heappush(queue, (max(away, abs(margin)), int(children[node, far])))
                node = int(children[node, near])
            leaf = -1 - node
            if counts[leaf]:
                found.append(leaf)
                total += counts[leaf]
        return found


def _matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def _best(queries: np.ndarray, bounds: np.ndarray, members: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, names, distances): the ``k`` nearest members of each query within its bound, ties to the smaller name.

    A product of matrices finds what can be among them; those are measured exactly.
    """
    own = (members * members).sum(axis=1)
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        rough = (part * part).sum(axis=1)[:, None] + own - 2 * (part @ members.T)
        slack = 1e-9 * (1 + np.abs(own).max() + np.abs(rough).max(axis=1))
        most = bounds[a : a + 256] ** 2 + slack
        if len(members) > k:
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
        for i, near in enumerate(rough <= most[:, None]):
            at = np.flatnonzero(near)
            distance = np.sqrt(((members[at] - part[i]) ** 2).sum(axis=1))
            keep = np.flatnonzero(distance <= bounds[a + i])
            keep = keep[np.lexsort((names[at[keep]], distance[keep]))[:k]]
            yield a + i, names[at[keep]], distance[keep]


def _rerank(work: DataFrame, k: int, width: int) -> DataFrame:
    """(query, vec_id, score): the ``k`` nearest of each (leaf, part) to each query that opened it, within its bound."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, members, names = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part, side, name = (batch.column(i).to_numpy() for i in range(4))
            vectors, bounds = _matrix(batch.column(4), width), batch.column(5).to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            out: list[tuple] = []
            for a, b in itertools.pairwise([0, *changes.tolist(), len(leaf)]):
                if (leaf[a], part[a]) != key:
                    key, members, names = (leaf[a], part[a]), [], []
                if side[a] == 0:
                    members.append(vectors[a:b]), names.append(name[a:b])
                elif members:
                    for i, near, distance in _best(vectors[a:b], bounds[a:b], np.concatenate(members), np.concatenate(names), k):
                        out.append((np.full(len(near), name[a + i]), near, distance))
            if out:
                columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "vec_id", "score"])

    grouped = work.select("leaf", "part", "side", "name", "vector", "bound").repartition("leaf", "part").sortWithinPartitions("leaf", "part", "side")
    return grouped.mapInArrow(run, "query bigint, vec_id bigint, score double")


def nearest(
    table: DataFrame, queries: Column, k: int = 10, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows to each row that ``queries`` selects (a condition on ``vec_id``)."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    # of equal vectors the k + 1 of least id
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    index = materialise(rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place").dropDuplicates(["vec_id", "embedding"]), "vectors")
    total = index.count()
    search = max(least, int(share * total))
    picked = [np.array(r["embedding"]) for r in index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    lengths = [len(v) for v in picked]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    fitted = np.array([v for v in picked if len(v) == width]).reshape(-1, width)
    forest = Forest(fitted, trees if len(fitted) else 0, max(2, round(leaf * len(fitted) / max(1, total))))
    held = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = _matrix(batch.column(1), width)
            leaves = held.value.route(vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(leaves), pa.list_(pa.int64()))], names=["vec_id", "embedding", "leaves"])

    routed = index.where(F.size("embedding") == width).mapInArrow(route, "vec_id bigint, embedding array<double>, leaves array<bigint>")
    placed = materialise(routed.select("vec_id", "embedding", F.explode("leaves").alias("leaf")), "leaves")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()  # at most one row a leaf of the sample's forest
    counts = [0] * forest.leaves
    for row in sizes:
        counts[row["leaf"]] = row["n"]

    asked = rows.where(queries & (F.size("embedding") == width)).select("vec_id", "embedding")
    groups = materialise(asked.groupBy("embedding").agg(F.min("vec_id").alias("query")), "queries")

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = list(_matrix(batch.column(1), width))
            opened = [held.value.search(v, counts, search, k + 1) for v in vectors]
            bounds = [held.value.bound(v, own, k + 1) for v, own in zip(vectors, opened, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(opened, pa.list_(pa.int64())), pa.array(bounds, pa.float64())], names=["query", "embedding", "opened", "bound"])

    walked = groups.select("query", "embedding").mapInArrow(walk, "query bigint, embedding array<double>, opened array<bigint>, bound double")
    parts = F.broadcast(spark.createDataFrame([(i, -(-n // BLOCK)) for i, n in enumerate(counts) if n] or [(-1, 1)], "leaf bigint, parts int"))
    members = placed.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), F.col("vec_id").alias("name"), F.col("embedding").alias("vector"), F.lit(None).cast("double").alias("bound"))
    visits = walked.select("query", "embedding", "bound", F.explode("opened").alias("leaf")).join(parts, "leaf")
    visits = visits.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), F.col("query").alias("name"), F.col("embedding").alias("vector"), "bound")
    found = _rerank(members.unionAll(visits), k + 1, width).dropDuplicates(["query", "vec_id"])
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    # one row a query again; its own row goes
    owners = asked.dropDuplicates(["vec_id", "embedding"]).join(groups, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    pairs = owners.join(best, "query").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the ten nearest of every hundredth vector among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
