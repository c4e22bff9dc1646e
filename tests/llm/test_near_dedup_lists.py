"""Inverted lists, blocks and written tables of the near-duplicate operator."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from geoloom.llm import near_dedup
from test_models_and_search import components

K, NEED = 12, 7


def _classes(spark):
    """Sets of many sizes, with one value that all hold and one that each twentieth holds."""
    rng = np.random.default_rng(3)
    rows = []
    for rep in range(300):
        values = set(rng.choice(400, int(rng.integers(2, K)), replace=False).tolist()) | {-5}
        values |= {-9} if rep % 20 == 0 else set()
        rows.append((rep * 2**40 - 7, int(rng.integers(len(values), 60)) if len(values) >= K else len(values), sorted(values)[:K]))
    return rows, spark.createDataFrame(rows, "rep long, n_shingles long, sketch array<bigint>")


def _lists(rows, holders_of):
    holders = defaultdict(list)
    for rep, n, sketch in rows:
        for v in sketch:
            holders[v].append((n, rep))
    found = set()
    for rep, n, sketch in rows:
        left = [v for v in sketch if v in holders_of or any(r != rep and 100 * min(n, m) >= 80 * max(n, m) for m, r in holders[v])]
        left.sort(key=lambda v: (len(holders[v]), v % 2**64))
        wanted = math.ceil(n * 0.8) if n <= int(0.8 * K) else NEED
        found |= {(v, rep, n) for v in left[: max(len(left) - wanted + 1, 0)]}
    return found


@pytest.mark.parametrize("often,frequent", [(10**9, 10), (100, 10), (5, 1)])
def test_lists_leave_out_values_that_no_set_of_similar_size_shares(spark, often, frequent):
    rows, classes = _classes(spark)
    told = {-5} if often < 10**9 else set()
    got = near_dedup._inverted_lists(classes.coalesce(1), K, NEED, 80, often, frequent).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == _lists(rows, told)
    assert near_dedup._inverted_lists(classes.limit(0), K, NEED, 80, often, frequent).count() == 0


def test_sets_of_one_id_have_lists_of_their_own(spark):
    short, long = ([f"{c}{i}" for i in range(n)] for c, n in (("s", 30), ("l", 400)))
    rows = [(9, " ".join(short)), (9, " ".join(long)), (10, " ".join([*short[:-1], "x"])), (11, " ".join([*long[:-1], "x"])), (12, "else")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(9, 9), (10, 9), (11, 9), (12, 12)}
    twice = spark.createDataFrame([(9, 8, list(range(8))), (9, 50, list(range(100, 100 + K))), (10, 8, list(range(8))), (11, 50, list(range(100, 100 + K)))], "rep long, n_shingles long, sketch array<bigint>")
    got = {(r.value, r.rep, r.n) for r in near_dedup._inverted_lists(twice, K, NEED, 80, 100, 10).collect()}
    assert got == {(v, rep, n) for n, values, reps in ((8, (0, 1), (9, 10)), (50, range(100, 106), (9, 11))) for v in values for rep in reps}


def test_columns_survive_packing():
    first = np.sort(np.array([3, 3, 2**63 + 5, 2**64 - 1], np.uint64))
    rest = [np.array([0, 0, 0, 0], np.uint64), np.array([-7, 2, 300, 70000], np.int64).view(np.uint64)]
    for columns in ([first, *rest], [c[:1] for c in (first, *rest)]):
        got = near_dedup.unpack_columns(near_dedup.pack_columns(columns))
        assert [g.tolist() for g in got] == [c.tolist() for c in columns]


def test_members_of_several_lists_are_compared_in_one(spark):
    sketch, far = list(range(20)), list(range(100, 120))
    work = [(key, 0, 2, i, i, 30, own, [4, 5, 6]) for key in (4, 5, 6) for i, own in ((1, sketch), (2, sketch), (3, far))]
    work += [(9, 0, 1, 1, 1, 30, sketch, [4, 5, 6]), (9, 0, 0, 7, 7, 30, sketch, None)]
    work = spark.createDataFrame(work, "key long, part int, side int, id long, component long, n long, sketch array<bigint>, lists array<bigint>")
    got = near_dedup.promising(work, 20, 0.45, 80).collect()
    assert sorted((r.key, r.side, r.id) for r in got) == [(4, 2, 1), (4, 2, 2), (9, 0, 7), (9, 1, 1)]


def test_rows_of_one_block_link_with_each_other_over_batches(spark):
    rows = [(1, 0, 2, i, i, 0, near_dedup.pack_set(np.arange(100 + i % 2 * 1000, 200 + i % 2 * 1000))) for i in range(2 * near_dedup.ROWS // 4)] + [(2, 0, 2, 5000, 5000, 0, near_dedup.pack_set(np.arange(100)))]
    work = spark.createDataFrame(rows, "key long, part int, side int, id long, component long, n long, hashes binary")
    got = near_dedup.compare(work, 80).select("a", "b").collect()
    assert {r.a for r in got} == set(range(2 * near_dedup.ROWS // 4)) and all(r.a % 2 == r.b % 2 for r in got)


def test_frequent_values_lose_nothing_and_large_tables_are_deleted(spark):
    rng = np.random.default_rng(1)
    common = [f"c{i}" for i in range(60)]
    texts = {}
    for n in range(90):
        own = [*common, *(f"g{n // 3}x{i}" for i in range(int(40 + n // 3 % 7 * 30)))]
        for at in rng.choice(len(own), int(rng.integers(0, 8)), replace=False):
            own[at] = f"e{rng.integers(10**6)}"
        texts[n] = " ".join(own)
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/geoloom"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, words=2, often=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(texts, 2)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before}
    assert "documents" in left and not left & {"sketches", "classes", "rarest", "sets", "brief"}


def test_lists_of_mostly_the_same_members_are_one_and_blocks_meet_once(spark):
    # twelve lists of 600 members that differ in a few, and two that have only one member in common
    lists = {k: set(range(600)) - {7 * k + 1, 7 * k + 2} for k in range(12)} | {100: set(range(2000, 2300)), 101: {2000, *range(3000, 3300)}}
    members = spark.createDataFrame([(i, k, i) for k, ids in lists.items() for i in ids], "id long, key long, component long").repartition(3)
    joined = near_dedup.joined_lists(members)
    held = {}
    for r in joined.collect():
        held.setdefault(r.key, set()).add(r.id)
    # before, each list was dealt in blocks by itself: 7,776 members
    assert sum(map(len, held.values())) < 2500
    assert all(any(ids <= other for other in held.values()) for ids in lists.values())
    one = joined.where("id < 600").groupBy("key").count().orderBy("count", ascending=False).first().key
    rows = near_dedup.met_in_blocks(joined.where(f"key = {one}").selectExpr("id", "key", "5 as parts", "component")).collect()
    n = len(held[one])
    assert len(rows) < 3.5 * n  # six times before: each member in its own block, and past all five
    met = {}
    for p in range(5):
        block, past = ([r.id for r in rows if r.part == p and r.side == s] for s in (2, 1))
        for i, a in enumerate(block):
            for b in block[:i] + past:
                met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1}


def test_a_block_is_held_against_itself_and_past_rows(spark):
    a, b = np.arange(100), np.arange(500, 600)
    rows = [(1, 0, 1, 9, 9, 0, near_dedup.pack_set(b)), (1, 0, 2, 1, 1, 0, near_dedup.pack_set(a)), (1, 0, 2, 2, 2, 0, near_dedup.pack_set(a)), (1, 0, 2, 3, 3, 0, near_dedup.pack_set(b))]
    work = spark.createDataFrame(rows, "key long, part int, side int, id long, component long, n long, hashes binary")
    assert {frozenset((r.a, r.b)) for r in near_dedup.compare(work, 80).collect()} == {frozenset((1, 2)), frozenset((3, 9))}
    brief = spark.createDataFrame([(*r[:5], 100, x.tolist()) for r, x in zip(rows, (b, a, a, b), strict=True)], "key long, part int, side int, id long, component long, n long, sketch array<int>")
    got = sorted(tuple(r) for r in near_dedup.promising(brief, 96, 0.45, 80).select("id", "part", "side").collect())
    assert got == [(1, 0, 2), (2, 0, 2), (3, 0, 2), (9, 0, 1)]
