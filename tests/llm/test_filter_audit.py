"""The audit against a document-by-document count in plain Python."""

import itertools
import random
import re
from collections import Counter

import pandas as pd
import pytest

from geoloom.llm import filter_audit, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, digest string, bits int"


def plain(docs, labels):
    """Rows of the audit from (doc_id, text, source) and (doc_id, quality, toxic), each order walked step by step."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        bad = set()
        if len(words) < 50:
            bad.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            bad.add("C")
        if re.search("[#$%&*|]", text):
            bad.add("D")
        if i is not None and least[text] < i:
            bad.add("E")
        rows.append((source or "", bad, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            own = left
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                fails = [r for r in own if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = [tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def test_query_is_the_plain_count(spark, data):
    docs, labels = (pd.read_parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    wanted = plain(list(zip(docs.doc_id, docs.text, docs.source)), list(zip(labels.doc_id, labels.quality, labels.toxic)))
    assert result(registry.queries()["op12_filter_audit"](spark, data)) == wanted


def test_nulls_repeats_ties_long_texts_and_clashing_names(spark):
    rng = random.Random(3)
    common = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", common, common + " $", "A " * 70, "é" * 19 + "Z", "É" * 25 + "ZZ", "x\x0by\x0cz", " ".join(str(i) for i in range(400_000)), "same " * 300_000, "a b " * 80]
    docs = [(rng.choice([None, 1, 2, 3, 3, 4, 5, 10**12, -7]), rng.choice(texts), rng.choice([None, "", "a", "part"])) for _ in range(160)]
    docs += docs[:20]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 1), (99, 1, 1), (-7, 0, 1), (-7, 0, 1)]
    frame = spark.createDataFrame([(*r, "x", 7) for r in docs], SCHEMA)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, n string")
    got = result(filter_audit.audit(filter_audit.with_labels(filter_audit.failures(frame), marks)))
    assert got == plain(docs, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.with_labels(filter_audit.failures(none), marks)).count() == 0
    one = spark.createDataFrame([(1, "hello", "s", "", 0)], SCHEMA)
    assert result(filter_audit.audit(filter_audit.with_labels(filter_audit.failures(one), marks))) == plain([(1, "hello", "s")], [])


def test_table_of_first_failures():
    orders, table = filter_audit.first_failure(5)
    assert table.shape == (32, 120) and len(set(orders)) == 120
    for o, order in enumerate(orders):
        for bad in range(32):
            assert table[bad, o] == next((s for s, f in enumerate(order) if bad >> f & 1), 5)


def test_many_parts_are_handed_on_in_time(spark):
    rows = spark.range(3000).selectExpr("cast(id % 1500 as string) AS part", "cast(id % 32 as int) AS bits", "id % 3 = 0 AS good", "id % 5 = 0 AS toxic", "id % 4 + 1 AS n").coalesce(1)
    got = filter_audit.audit(rows).where("step = 5 AND filter_order = 'ABCDE'").groupBy().sum("kept").first()[0]
    assert got == sum(i % 4 + 1 for i in range(3000) if i % 32 == 0)


@pytest.mark.parametrize("text", ["", "a", "a b", " a  b ", "ab" * 50 + " c", "x " * 40])
@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_pieces_keep_words_whole(text, size):
    from geoloom.llm import words

    found = [w for p in words.pieces(text.encode(), words.SPACES, size) for w in p.split()]
    assert found == text.encode().split()
