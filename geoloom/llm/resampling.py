"""Target-distribution importance resampling on hashed n-grams.

A document's weight is the sum of its features' gains, a gain being the log ratio of
a bucket's share in the target texts to its share in the corpus; Gumbel noise of the
document's id turns the highest scores into a draw without replacement.

The CRC of a word is computed once for each distinct word a worker meets.  The CRC of
an n-gram follows from those of its words: appending bytes is linear over GF(2), so
crc(a b) is crc(a), shifted by the length of " b", combined with crc(" b").  Shifts by
powers of two are 32 x 32 bit matrices, applied as four tables of 256 entries to
whole arrays; no n-gram is ever put together as a string.

1. Counts by bucket are added up in each task and summed by bucket.
2. The driver gets at most one row a bucket and makes the gains, which are broadcast.
3. Scores are written, sorted by range (a count of where ranges start gives the
   ranks) and numbered; no task holds more than its range, and ties of repeated rows
   are split by a number they were given when written.

Defined results: null and empty texts and texts without words have no features and
weight 0; a null id has the noise of the empty id; rows that repeat are each scored,
ranked and returned; without documents there are no rows, and without target texts
every count of the target is 0; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialise
from .words import ALNUM, Numbers, word_values

N = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
POLYNOMIAL = 0xEDB88320


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 x 32 bit matrix, given by its columns, times each value."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


def _tables(columns: np.ndarray) -> np.ndarray:
    """Four tables, one for each byte of a value, whose entries combine to the product."""
    return np.stack([_apply(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


class Shifts:
    """The effect on a CRC of appending bytes, for any numbers of bytes up to 2**31."""

    def __init__(self):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(8):  # appending one zero bit, eight times
            bits = np.where(bits & np.uint32(1), bits >> np.uint32(1) ^ np.uint32(POLYNOMIAL), bits >> np.uint32(1))
        self.columns, self.tables = [bits], [_tables(bits)]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = crcs.copy()
        for k in range(int(lengths.max(initial=0)).bit_length()):
            if k == len(self.tables):
                self.columns.append(_apply(self.columns[-1], self.columns[-1]))
                self.tables.append(_tables(self.columns[-1]))
            at = np.flatnonzero(lengths >> k & 1)
            value, table = out[at], self.tables[k]
            out[at] = table[0][value & 255] ^ table[1][value >> 8 & 255] ^ table[2][value >> 16 & 255] ^ table[3][value >> 24]
        return out


def word_number(word: bytes) -> int:
    """CRC in the low 32 bits, length in the high ones."""
    return zlib.crc32(word) | len(word) << 32


def ngram_crcs(words: np.ndarray, counts: np.ndarray, n: int, shifts: Shifts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRCs, number of the text) of all runs of 1, 2, ... ``n`` words, from numbers of words and words of each text."""
    crcs, lengths = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32), (words >> np.uint64(32)).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    yield crcs, text
    if n > 1 and len(crcs):
        blank = shifts(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs  # of " word"
    grams = crcs
    for size in range(2, n + 1):
        if len(crcs) < size:
            return
        grams = shifts(grams[:-1], lengths[size - 1 :] + 1) ^ blank[size - 1 :]
        inside = text[: len(grams)] == text[size - 1 :]
        yield grams[inside], text[: len(grams)][inside]


def _bytes(column) -> list:
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def bucket_counts(rows: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, numbers, shifts = np.zeros(buckets, np.int64), Numbers(word_number), Shifts()
        for batch in batches:
            for _, _, counts, words in word_values(_bytes(batch.column(0)), ALNUM, numbers):
                for crcs, _ in ngram_crcs(words, counts, n, shifts):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    sums = rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of shares, by bucket."""
    size, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    ratios = (target + 1.0) * (all_corpus + size) / ((corpus + 1.0) * (all_target + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Gains of all buckets; the driver gets at most one row a bucket of either side."""
    sides = []
    for rows in (docs, target):
        side = np.zeros(buckets, np.int64)
        for r in bucket_counts(rows, text_col, n, buckets).collect():
            side[r["bucket"]] = r["n"]
        sides.append(side)
    return gains(*sides)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """(doc_id, n_words, n_features, weight, tie) of every row; ``tie`` numbers the rows of a task."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, shifts, seen = Numbers(word_number), Shifts(), 0
        for batch in batches:
            texts = _bytes(batch.column(1))
            size = np.zeros(len(texts), np.int64)
            features, weight = size.copy(), size.copy()
            for first, last, counts, words in word_values(texts, ALNUM, numbers):
                size[first:last] = counts
                for crcs, text in ngram_crcs(words, counts, n, shifts):
                    features[first:last] += np.bincount(text, minlength=len(counts))
                    sums = np.concatenate([[0], np.cumsum(held.value[crcs % np.uint32(len(held.value))])])
                    ends = np.searchsorted(text, np.arange(len(counts) + 1))
                    weight[first:last] += np.diff(sums[ends])
            tie = np.arange(seen, seen + len(texts))
            seen += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (size, features, weight, tie))], names=["doc_id", "n_words", "n_features", "weight", "tie"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, tie bigint")


def noise(id_column: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, 0, 1, 2 ... in the given order: ranges are sorted by themselves, and their sizes give where each starts."""
    part_schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("inner", LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(seen, seen + batch.num_rows))], names=[*batch.schema.names, "part", "inner"])
            seen += batch.num_rows

    ordered = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, part_schema), "ordered")
    starts, at = [], 0
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # one row a partition
        starts.append((r["part"], at))
        at += r["count"]
    start = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return ordered.join(F.broadcast(start), "part").withColumn("place", F.col("start") + F.col("inner")).drop("part", "start", "inner")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where a row is not drawn.

    Of the rows with ``least_words`` words, the ``percent`` of highest score are drawn, ties to the smaller id.
    """
    found = weights(docs, fit(docs, target, text_col, n, buckets), id_col, text_col, n)
    found = materialise(found.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("eligible", F.col("n_words") >= least_words), "scores")
    drawn = percent * found.where("eligible").count() // 100
    ranked = numbered(found, F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc())
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: a tenth of the documents drawn toward ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
