"""Audit of filters that remove documents in turn: what each removes in every order.

A document's failures are a set of filters, one bit each.  In which step an order of
the filters removes it is a lookup in a table of 2**k sets by k! orders, made once;
tasks add up removals by part, order and step with ``np.bincount``, apart for all,
good and toxic documents, and these arrays are summed.  What else is reported follows
from them: a filter's failures are what it removes as the first of an order, its own
failures what it removes as the last.

Whether a text repeats that of a smaller id is decided by digests of 128 bits: the
least id of a digest is the first, found by an aggregation that combines before the
shuffle.  Rows meet labels and first ids by their id, never by the digest, so a text
that a third of all rows share goes to no single task; rows of null id are spread.

Defined results: a null text is the empty one; a null part is the empty string; a row
of null id has no labels, repeats nothing and is repeated by nothing; rows that repeat
an id count each, and equal ids are no repeats of each other; of several labels of an
id, a 1 counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .words import SPACES, pieces

FILTERS = "ABCDE"
LEAST_WORDS = 50
#: Percent of words that must be distinct, and percent of characters that may be capitals.
DISTINCT, CAPITALS = 65, 5
CAPITAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Bytes of UTF-8 that go on with a character.
FOLLOWING = bytes(range(0x80, 0xC0))
#: Parts whose counts a task holds before it hands them on.
PARTS = 512


def first_failure(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders, and by set of failures and order the step (from 0) that removes; ``filters`` where none does."""
    orders = list(itertools.permutations(range(filters)))
    sets = np.arange(1 << filters)
    table = np.full((len(sets), len(orders)), filters, np.int8)
    for o, order in enumerate(orders):
        for step in reversed(range(filters)):
            table[sets >> order[step] & 1 == 1, o] = step
    return orders, table


def text_failures(text: bytes) -> int:
    """Bits of filters A to D for one text in UTF-8."""
    n, distinct = 0, set()
    for piece in pieces(text, SPACES):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, CAPITAL))
    points = len(text.translate(None, FOLLOWING))
    return (n < LEAST_WORDS) | (100 * len(distinct) < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, bits, n): rows by id, text and part with the failures of all five filters and how often they come."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            bits = pa.array([text_failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, bits], names=["doc_id", "part", "digest", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id bigint, part string, digest binary, bits int")
    rows = materialise(rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")), "failures")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", "digest", F.when(repeats, F.col("bits") + 16).otherwise(F.col("bits")).alias("bits"), "n")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; rows of null id, which have none, are spread over tasks."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)) + 1).otherwise(F.lit(0).cast("long"))
    joined = rows.withColumn("_spread", spread).join(known.withColumn("_spread", F.lit(0).cast("long")), ["doc_id", "_spread"], "left")
    return joined.select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Removals in all orders of ``filters`` from rows (part, bits, good, toxic, n)."""
    k = len(filters)
    orders, table = first_failure(k)
    cells = len(orders) * (k + 1)
    base = np.arange(len(orders)) * (k + 1)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}

        def hand_on() -> Iterator:
            for part, sums in held.items():
                at = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array(at.astype(np.int32)), *(pa.array(s[at]) for s in sums)], names=["part", "cell", "removed", "good", "toxic"])
            held.clear()

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            parts, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            bits, n = batch.column(1).to_numpy(), batch.column(4).to_numpy().astype(np.float64)
            marks = [np.ones(len(bits)), *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))]
            # some rows at a time: each is looked up once for every order
            for a in range(0, len(bits), 2048):
                b = a + 2048
                present, local = np.unique(number[a:b], return_inverse=True)
                place = (local[:, None] * cells + base + table[bits[a:b]]).ravel()
                for i, mark in enumerate(marks):
                    found = np.bincount(place, np.repeat(mark[a:b] * n[a:b], len(orders)), len(present) * cells).astype(np.int64).reshape(len(present), cells)
                    for p, sums in zip(present, found, strict=True):
                        held.setdefault(parts[p], np.zeros((3, cells), np.int64))[i] += sums
                if len(held) >= PARTS:
                    yield from hand_on()
        yield from hand_on()

    counted = rows.select("part", "bits", "good", "toxic", "n").mapInArrow(count, "part string, cell int, removed bigint, good bigint, toxic bigint")
    summed = counted.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])
    names = ["".join(filters[f] for f in order) for order in orders]
    which = np.array(orders)
    schema = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"

    def report(group):
        import pyarrow as pa

        sums = np.zeros((3, cells), np.int64)
        sums[:, group.column("cell").to_numpy()] = [group.column(c).to_numpy() for c in ("removed", "good", "toxic")]
        removed, good, toxic = sums.reshape(3, len(orders), k + 1)
        total = removed[0].sum()
        failing = np.array([removed[which[:, 0] == f, 0][0] for f in range(k)])
        alone = np.array([removed[which[:, -1] == f, k - 1][0] for f in range(k)])
        shapley = np.bincount(which.ravel(), removed[:, :k].ravel(), k).astype(np.int64)
        columns = [
            pa.array([group.column("part")[0].as_py()] * which.size, pa.string()), pa.array(np.repeat(names, k).tolist(), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))),
            *(pa.array(x.ravel()) for x in (total - removed[:, :k].cumsum(1), removed[:, :k], failing[which] - removed[:, :k], alone[which], good[:, :k], toxic[:, :k], shapley[which])),
        ]
        return pa.Table.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    # a group is one part's sums, at most (k + 1) k! rows
    return summed.groupBy("part").applyInArrow(report, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: five filters in all orders, by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(with_labels(failures(docs), labels))
