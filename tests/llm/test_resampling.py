"""Resampling against plain strings and a plain sort."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from geoloom.llm import registry, resampling, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    own = WORD.findall((text or "").translate(LOWER))
    return [" ".join(own[i : i + k]) for k in range(1, n + 1) for i in range(len(own) - k + 1)], len(own)


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, n=1, buckets=10000, least=20, percent=10):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows, as a sorted list."""
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            side.update(bucket(f, buckets) for f in features(text, n)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        own, size = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f, buckets)] for f in own)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), size >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(order) // 100
    found = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(found, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_is_the_plain_one(spark, data):
    docs, target = (pd.read_parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    assert result(registry.queries()["op13_resampling"](spark, data)) == plain(list(zip(docs.doc_id.tolist(), docs.text)), target.text)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_nulls_repeats_and_clashing_names(spark, n):
    texts = [None, "", "!?", "One two three, one TWO three", "ÄÖ straße  x\x00y z9", " ".join(f"w{i % 37}" for i in range(90)), "a " * 30, " ".join(f"v{i}" for i in range(300_000)), "b" * 3_000_000 + " tail"]
    docs = [(i if i % 7 else None, texts[i % len(texts)]) for i in range(40)]
    docs += docs[3:9] * 5
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, weight int, eligible double")
    target = spark.createDataFrame([("w1 w2 w3", 1), (None, 2), ("one two", 3)], "text string, doc_id int")
    got = resampling.resample(frame, target, n=n, buckets=1000, percent=30)
    assert result(got) == plain(docs, ["w1 w2 w3", None, "one two"], n, 1000, percent=30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    docs = [(1, "a b c"), (2, "word " * 25), (3, "other " * 25)] * 5
    assert result(resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), none)) == plain(docs, [])


def test_crc_of_joined_words_is_the_crc_of_the_string():
    rng = np.random.default_rng(1)
    own = [bytes(rng.integers(97, 123, size).astype(np.uint8)) for size in [1, 2, 3, 7, 8, 15, 16, 31, 255, 256, 70_000, 1, 5]]
    numbers = words.Numbers(resampling.word_number).values_of(own)
    for n, (crcs, text) in enumerate(resampling.ngram_crcs(numbers, np.array([6, 0, 7]), 4, resampling.Shifts()), 1):
        wanted = [(t, zlib.crc32(b" ".join(part[i : i + n]))) for t, part in ((0, own[:6]), (2, own[6:])) for i in range(len(part) - n + 1)]
        assert list(zip(text.tolist(), crcs.tolist())) == wanted
