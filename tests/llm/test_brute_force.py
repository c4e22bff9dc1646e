"""Models against plain Python versions of their definitions."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from geoloom.llm import language_id, quality, toxicity

MASK = (1 << 64) - 1


def grams(text):
    """Buckets of all 1- to 3-grams of a text, one at a time."""
    padded = f" {text.lower()} "
    for n in range(1, language_id.ORDERS + 1):
        for at in range(len(padded) - n + 1):
            value = 0
            for i in range(n):
                value = (value * 0x100000001B3 + ord(padded[at + i]) + i) & MASK
            yield (value * 0x9E3779B97F4A7C15 & MASK) >> 48


def test_op5_is_naive_bayes(spark, data):
    docs = pd.read_parquet(f"{data}/documents.parquet")
    counts, number = defaultdict(Counter), Counter()
    for doc_id, text, lang in zip(docs.doc_id, docs.text, docs.lang):
        if lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            counts[lang].update(grams(text or ""))
            number[lang] += 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    got = {r.doc_id: r for r in language_id.query(spark, data).collect()}
    assert sorted(got) == sorted(docs.doc_id)
    for doc_id, text in zip(docs.doc_id, docs.text):
        own = Counter(grams(text or ""))
        logs = [math.log(number[x] / sum(number.values())) + sum(c * math.log((counts[x][g] + 0.5) / total[x]) for g, c in own.items()) for x in langs]
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
            continue
        best = max(logs)
        ranked = sorted(logs)
        assert r.lang_pred == langs[logs.index(best)] or ranked[-1] - ranked[-2] < 0.1
        if r.lang_pred == langs[logs.index(best)]:
            assert r.score == pytest.approx(1 / sum(math.exp(x - best) for x in logs), abs=0.02)


def kernel(a, b):
    """Gap-weighted subsequences of three characters within a span, normalised and squared, by enumeration."""
    def features(word):
        text, found = f"\x02{word}\x03", Counter()
        for i, j, k in itertools.combinations(range(len(text)), 3):
            if k - i < toxicity.SPAN:
                # the place of the middle one does not count, so one key for all gaps
                found[text[i], text[j], text[k]] += toxicity.DECAY ** (k - i - 2)
        return found

    fa, fb = features(a), features(b)
    return (sum(v * fb[key] for key, v in fa.items()) / math.sqrt(sum(v * v for v in fa.values()) * sum(v * v for v in fb.values()))) ** 2


def test_kernel_is_the_enumerated_one():
    words = ["idiot", "id1ot", "i-d-i-o-t", "idiiot", "stupid", "the", "a", "straße", "aaaa", "aaaaaaaaaaaa", "banana", "conversation"]
    marks = ["idiot", "stupid", "sta", "aaa", "banana", "conserve", "aaaaaa"]
    got = toxicity.Kernel(marks).rows(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(kernel(w, m), abs=1e-9), (w, m)
            assert got[i, j] <= 1 + 1e-9
    own = toxicity.Kernel(words).rows(words)
    assert np.diag(own) == pytest.approx(np.ones(len(words)))


def test_site_posteriors_are_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{p}", float(np.clip(0.2 + 0.2 * h + 0.05 * p + rng.normal(0, 0.1), 0, 1))) for h in range(4) for p in range(3) for _ in range(2 + h * p)]
    found, centre = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by_path, by_host = defaultdict(list), defaultdict(list)
    for h, p, v in rows:
        by_path[h, p].append(v)
        by_host[h].append(v)
    n = len(rows)
    mean = sum(v for _, _, v in rows) / n
    assert centre == pytest.approx(mean)

    def mu(values):
        return sum(values) / len(values)

    within = sum((v - mu(own)) ** 2 for own in by_path.values() for v in own) / (n - len(by_path))
    between = sum(len(own) * (mu(own) - mu(by_host[h])) ** 2 for (h, _), own in by_path.items())
    part = sum(len(own) ** 2 / len(by_host[h]) for (h, _), own in by_path.items())
    path_strength = within / ((between - (len(by_path) - len(by_host)) * within) / (n - part))
    outer = sum(len(own) * (mu(own) - mean) ** 2 for own in by_host.values())
    host_strength = within / ((outer - (len(by_host) - 1) * within) / (n - sum(len(own) ** 2 for own in by_host.values()) / n))

    def bounded(x):
        return min(max(x, 1.0), 1e6) if x > 0 else 1e6

    got = {(r.host, r.path): r for r in found.collect()}
    assert got.keys() == by_path.keys()
    for (h, p), r in got.items():
        assert (r.n, r.total) == (len(by_path[h, p]), pytest.approx(sum(by_path[h, p])))
        assert r.strength == pytest.approx(bounded(path_strength))
        assert r.prior == pytest.approx((sum(by_host[h]) + bounded(host_strength) * mean) / (len(by_host[h]) + bounded(host_strength)))
