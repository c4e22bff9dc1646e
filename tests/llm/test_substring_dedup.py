"""Passages taken out against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from geoloom.llm import registry, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, length=13):
    """(doc_id, n_words, n_removed, spans, text) of rows (doc_id, text), sorted."""
    words = [WORD.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - length + 1 if i is not None else 0):
            if least[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        spans, places = [], sorted(gone)
        for k in places:
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((i, len(w), len(gone), [tuple(s) for s in spans], " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, [(s.start, s.stop) for s in r.spans], r.text) for r in df.collect()), key=str)


def test_query_is_the_plain_one(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    wanted = sorted((i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, _, text in plain(list(zip(docs.doc_id.tolist(), docs.text))))
    got = registry.queries()["op11_substring_dedup"](spark, data)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == wanted
    assert sum(w[2] for w in wanted) > 1000


@pytest.mark.parametrize(("length", "letters"), [(13, 3), (4, 6), (2, 40), (1, 300)])
def test_many_small_blocks(spark, length, letters):
    rng = random.Random(length)
    passage = " ".join(rng.choice("abcdef") for _ in range(60))

    def text():
        own = [str(rng.randrange(letters)) for _ in range(rng.randrange(80))]
        if rng.random() < 0.5:
            at, size = rng.randrange(40), rng.randrange(1, 30)
            own[len(own) // 2 : len(own) // 2] = passage.split()[at : at + size]
        return rng.choice([" ", "\n", " \t"]).join(own)

    docs = [(i * 7919 % 1009 - 300, text()) for i in range(150)]
    docs += [(10**15, docs[3][1]), (docs[3][0], docs[3][1]), (docs[4][0], docs[5][1]), (None, docs[6][1]), (None, None), (5000, None), (5001, ""), (5002, " \n"), (-(10**15), docs[8][1])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*r, 1, "x", b"") for r in docs], "doc_id long, text string, block int, size string, data binary").repartition(3)
    assert result(substring_dedup.remove_repeats(frame, length=length, block_bytes=700)) == plain(docs, length)


def test_hot_passage_long_texts_and_copies(spark):
    line = " ".join(f"licence{i}" for i in range(20))
    long = " ".join(f"n{i}" for i in range(300_000))
    docs = [(i, f"start{i} {line} end{i}") for i in range(400)] + [(1000 + i, line) for i in range(300)] + [(2000, long), (2001, long), (2002, "x " + long[: len(long) // 2]), (2003, "word " * 200_000)]
    got = result(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), block_bytes=100_000))
    assert got == plain(docs)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert result(substring_dedup.remove_repeats(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))) == plain([(1, "a b")])


def test_fingerprints_of_equal_halves_are_told_apart():
    """Entries that share the 64-bit hash but not the rest are not taken for each other."""
    words = np.arange(1, 60, dtype=np.uint64)
    runs = substring_dedup.Runs(np.array([59]), words)
    a, b = substring_dedup._prints(words, 13, np.arange(47))
    other = substring_dedup._packed(a[:5], b[:5] ^ np.uint32(1), np.zeros(5))
    same = substring_dedup._packed(a[3:8], b[3:8], np.array([9, 50, 50, 9, 9]))
    found = substring_dedup.Repeats([{"data": other}, {"data": same}]).starts(runs, np.full(59, 20), 13)
    assert found.tolist() == [3, 6, 7]
