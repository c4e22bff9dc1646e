"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) pairs of n-grams, ``n`` from 1 to ``ORDERS``,
in map tasks and sums them with a grouped aggregation.  The log-probability
matrix, ``BUCKETS`` rows by one column per language, is small by construction and
is broadcast.  Scoring hashes all n-grams of a batch in numpy, looks their rows
up and adds them per document.

Defined results: a null text or one without a letter is ``und`` with score 0; a
null language teaches nothing; with no learned language every text is ``und``;
ties go to the first language in sort order; very long texts are scored in
pieces that overlap by ``ORDERS - 1`` characters, so nothing is cut off; repeated
rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, text_groups

BUCKETS = 1 << 16
ORDERS = 3
PIECE = 1 << 20
UNKNOWN = "und"


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start of each text in the piece, bucket of every n-gram [ORDERS, characters]); BUCKETS marks none.

    A text longer than a piece comes in several pieces of which it is the only text.
    """
    padded = [f" {t.lower()} " for t in texts]
    for a, b in text_groups(padded, PIECE):
        codes = np.frombuffer("".join(padded[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in padded[a:b]], dtype=np.int64)
        step = len(codes) if b - a > 1 else PIECE
        for at in range(0, len(codes), step):
            part = codes[at : at + step + ORDERS - 1] if b - a == 1 else codes
            own = min(step, len(codes) - at)  # n-grams that begin here belong to this piece
            grams = np.full((ORDERS, own), BUCKETS, dtype=np.int32)
            value = np.zeros(len(part), dtype=np.uint64)
            for n in range(ORDERS):
                value = value[: len(part) - n] * np.uint64(0x100000001B3) + part[n:] + np.uint64(n)
                mixed = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32)[:own]
                grams[n, : len(mixed)] = mixed
            starts = np.cumsum(sizes) - sizes if b - a > 1 else np.zeros(1, np.int64)
            if b - a > 1:
                ends = np.cumsum(sizes)
                for n in range(1, ORDERS):
                    for back in range(1, n + 1):
                        grams[n, ends - back] = BUCKETS
            yield np.arange(a, b), starts, grams


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, bucket, n: n-gram counts of the training rows (lang, text); bucket -1 counts documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                total = counts.setdefault(lang, np.zeros(BUCKETS + 2, dtype=np.int64))
                total[BUCKETS + 1] += len(own)
                for _, _, grams in _windows(own):
                    total[: BUCKETS + 1] += np.bincount(grams.ravel(), minlength=BUCKETS + 1)
        for lang, total in counts.items():
            total[BUCKETS] = 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at > BUCKETS, -1, at), pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    sums = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint")
    return sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the log-probability matrix, a zero row last."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    @staticmethod
    def fit(rows: DataFrame, smoothing: float = 0.5) -> Model:
        """From training rows (lang, text).  What reaches the driver is at most BUCKETS rows a language."""
        found = count_grams(rows.where(F.col("lang").isNotNull())).toPandas()
        langs = sorted(found["lang"].unique())
        if not langs:
            return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
        number = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy().astype(np.float64)
        docs = np.zeros(len(langs))
        np.add.at(docs, number[bucket < 0], n[bucket < 0])
        counts = np.full((BUCKETS, len(langs)), smoothing)
        inside = bucket >= 0
        np.add.at(counts, (bucket[inside], number[inside]), n[inside])
        matrix = np.log(counts) - np.log(counts.sum(0))
        return Model(langs, np.vstack([matrix, np.zeros(len(langs))]).astype(np.float32), np.log(docs / docs.sum()))

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        real = [t or "" for t in texts]
        total = np.tile(self.prior, (len(texts), 1))
        if self.langs:
            for which, starts, grams in _windows(real):
                score = self.matrix[grams[0]].astype(np.float64)
                for n in range(1, ORDERS):
                    score += self.matrix[grams[n]]
                total[which] += np.add.reduceat(score, starts, axis=0)
        langs, scores = [], []
        for row, text in zip(total, real, strict=True):
            if not self.langs or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN), scores.append(0.0)
                continue
            best = int(np.argmax(row))
            langs.append(self.langs[best]), scores.append(float(1 / np.exp(row - row[best]).sum()))
        return langs, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            langs, scores = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: learned on two thirds of the ids, applied to all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = crc_of_id("doc_id") % 3
    model = Model.fit(docs.where(remainder != 1).select("lang", "text"))
    return identify(docs, model).select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score")
