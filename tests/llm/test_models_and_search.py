"""Classifiers, near-duplicates, nearest neighbours and the pipeline: held-out accuracy and brute force."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.llm.near_dedup import Shingler, near_duplicates
from geoloom.llm import language_id, near_dedup, nearest, quality, toxicity

SMALL = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def frames(data):
    return pd.read_parquet(f"{SMALL}/documents.parquet"), pd.read_parquet(f"{SMALL}/labels.parquet")


def auc(score, label):
    rank, n = pd.Series(score).rank().to_numpy(), int(label.sum())
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


# ------------------------------------------------------------- toxicity


def test_toxicity_held_out(spark):
    """On the larger table: the smaller one holds some ten positive documents for the test."""
    labels = pd.read_parquet(f"{LARGER}/labels.parquet")
    got = toxicity.query(spark, LARGER).toPandas().merge(labels, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.93 and held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.75


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeiourstln"), 5)) for _ in range(300)]

    def text(bad):
        chosen = rng.choice(words, 60).tolist()
        for i in range(0, 60, 12):
            if bad:
                chosen[i] = "grumbold"
        return " ".join(chosen)

    labels = np.array([0.0, 1.0] * 60)
    return toxicity.Model.fit([text(v) for v in labels], labels, np.ones(120)), text


@pytest.mark.parametrize("word", ["grumbold", "g r u m b o l d", "g.r.u.m.b.o.l.d", "grum-bold", "gru*mbold", "GRUMBOLD!", "gruumbold"])
def test_toxicity_tolerates_insertions(toxic_model, word):
    model, text = toxic_model
    clean = text(0).split()
    clean[::10] = [word] * len(clean[::10])
    assert model.score([" ".join(clean)])[0] > 0.5 > model.score([text(0)])[0]


def test_toxicity_edge_cases(spark, toxic_model):
    model, text = toxic_model
    rows = [(1, None, "a", 0.5), (2, "", "a", 0.5), (3, text(1) * 2000, "a", 0.5), (3, text(0), None, None), (None, "...", "b", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, score double")
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 4
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    assert toxicity.Model.fit([], np.zeros(0), np.zeros(0)).score(["x", None]).tolist() == [0, 0]
    assert toxicity.Model.fit(["a"], np.ones(1), np.ones(1)).score(["x"]).tolist() == [1]
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    toxicity.fit_from_tables(df, labels)


def test_kernel_is_symmetric_and_counts_gaps():
    words = ["idiot", "iddiot", "idixot", "xyz"]
    k = toxicity.Kernel(words).rows(words)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9
    assert k[0, 0] > k[0, 1] > 0.2 and k[0, 2] > k[0, 3]


# ------------------------------------------------------------- quality


def test_quality_held_out(spark, frames):
    got = quality.query(spark, SMALL).toPandas()
    assert len(got) == len(frames[0]) and got.score.between(0, 1).all()
    held = got.merge(frames[1], on="doc_id").query("held_out")
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97 and held[held.quality == 1].predicted.mean() > 0.97


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "a", 0.9)] * 200 + [("bad", "a", 0.1)] * 200 + [("tiny", "a", 0.1)]
    sites, centre = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {r.host: (r.total + r.strength * r.prior) / (r.n + r.strength) for r in sites.collect()}
    assert centre == pytest.approx((180 + 20 + 0.1) / 401) and got["big"] > 0.85 and got["bad"] < 0.15
    prior = {r.host: r.prior for r in sites.collect()}
    assert prior["bad"] < prior["tiny"] < centre or prior["tiny"] == pytest.approx(prior["bad"], abs=0.05)


def test_quality_edge_cases(spark):
    model = quality.Model([0.0] * 9, [1.0] * 9, [0.0] * 18, 0.3)
    rows = [(1, None, None, None, 1), (2, "", "http://h.example/p/q", "en", 2), (2, "", "http://h.example/p/q", "en", 2), (3, "word " * 100000, "h", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, host int")
    got = quality.score(df, model, ["doc_id", "host"]).collect()
    assert len(got) == 4 and all(0 < r.score < 1 for r in got) and {(r.host, r.path) for r in got} == {("", ""), ("h.example", "p"), ("h", "")}
    assert quality.drop_low_quality(df, model).columns == df.columns and quality.drop_low_quality(df, model).count() == 4
    assert quality.score(df.limit(0), model, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.drop_low_quality(df, quality.fit_from_tables(df, none)).count() == 4


# ------------------------------------------------------------- language


def test_language_held_out(spark, frames):
    got = language_id.query(spark, SMALL).toPandas().merge(frames[0], on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    model = language_id.Model.fit(spark.createDataFrame([("en", "the cat"), ("fr", "le chat est là"), (None, "x"), ("en", None)], "lang string, text string"))
    langs, scores = model.predict([None, "", "123 ...", "the dog", "le chien " * 300000])
    assert langs == ["und", "und", "und", "en", "fr"] and scores[:3] == [0, 0, 0]
    rows = spark.createDataFrame([(1, "the", "x"), (1, "the", "x"), (None, None, None)], "doc_id long, text string, score string")
    assert language_id.identify(rows, model).count() == 3 and language_id.identify(rows.limit(0), model).count() == 0
    empty = language_id.Model.fit(spark.createDataFrame([], "lang string, text string"))
    assert empty.predict(["abc"]) == (["und"], [0.0])


def test_language_pieces_of_a_long_text_lose_nothing():
    text = "le chat est " * 200000
    whole = sum(int((g < language_id.BUCKETS).sum()) for _, _, g in language_id._windows([text]))
    assert whole == 3 * (len(text) + 2) - 3


def test_language_does_not_depend_on_the_batch():
    model = language_id.Model(["a", "b"], np.random.default_rng(0).normal(size=(language_id.BUCKETS + 1, 2)).astype(np.float32), np.zeros(2))
    model.matrix[-1] = 0
    texts = ["abc def", "x", "zz top", "q" * 50]
    together = model.predict(texts)
    assert all(model.predict([t]) == ([together[0][i]], [together[1][i]]) for i, t in enumerate(texts))


# ------------------------------------------------------------- near-duplicates


def components(texts, words):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, data, words):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    wanted = components({r.doc_id: r.text for r in docs.collect()}, words)
    got = near_dedup.near_duplicates(docs, words=words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_loose_group(spark):
    """Edits around one base: members differ from each other more than from the base."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for n in range(120):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(0, 16)), replace=False):
            own[at] = f"x{rng.integers(10**6)}"
        texts[n] = " ".join(own)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(texts, 2)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, "Same words HERE", 1), (2, "same WORDS here", 2), (3, None, 3), (4, "", 4), (5, " \n\t", 5), (6, "one", 6), (7, "ONE", 7), (8, long, 8), (9, long + " more", 9), (9, long + " more", 9), (None, "same words here", 0), (10, "one\x1ftwo", 10), (11, "É é", 11), (12, "é é", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(df, words=2).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (6, False), 8: (8, True), 9: (8, False), None: (None, True), 10: (10, True), 11: (11, True), 12: (12, True)}
    kept = near_dedup.drop_near_duplicates(df, 2)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


# ------------------------------------------------------------- nearest neighbours


def test_nearest_recall_and_scores(spark):
    table = pd.read_parquet(f"{LARGER}/embeddings.parquet")
    x, ids = np.array(table.embedding.tolist(), dtype=np.float64), table.vec_id.to_numpy()
    got = nearest.query(spark, LARGER).toPandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(part.vec_id))
        assert sorted(part["rank"]) == list(range(1, 11)) and np.allclose(part.score, [d[ids == v][0] for v in part.vec_id], rtol=0, atol=1e-12)
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_nearest_stops_early_in_clusters(spark):
    """Clustered vectors: all neighbours are found, and a search opens a small part of the leaves."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24)) * 5
    x = (centres[:, None] + rng.normal(size=(40, 100, 24)) * 0.3).reshape(-1, 24)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(rows, F.col("vec_id") % 100 == 0, k=5).collect()
    asked = sorted({r.query_id for r in got})
    hits = 0
    for q in asked:
        gaps = np.linalg.norm(x - x[q], axis=1)
        gaps[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(gaps, kind="stable")[:5].tolist()))
    assert len(asked) == 40 and hits >= 0.99 * 5 * len(asked)
    forest = nearest.Forest(x, 4, 50)
    counts = np.bincount(forest.places.ravel(), minlength=forest.leaves).tolist()
    opened = [len(forest.search(x[q], counts, 10**9, 6)) for q in asked]
    assert np.mean(opened) < 0.25 * forest.leaves


def test_nearest_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), *[(100 + i, [1.0, 0.0]) for i in range(30)], (200, [0.0, 1.0]), (200, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, rank long")
    got = nearest.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(100, 110))
    assert [r.vec_id for r in got if r.query_id == 100] == [0, *range(101, 110)]
    assert [r.vec_id for r in got if r.query_id == 200] == [0, *range(100, 109)] and {r.query_id for r in got} == {0, 100, 200}
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = df.where("vec_id in (0, 200)")
    assert [(r.query_id, r.vec_id) for r in nearest.nearest(few, F.col("vec_id") % 100 == 0).orderBy("query_id").collect()] == [(0, 200), (200, 0)]


# ------------------------------------------------------------- pipeline


def test_pipeline_equals_its_stages(spark, frames):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = frames
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit_from_tables(table, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = docs[model.score(docs.text.tolist()) < 0.5]
    first = pipeline.STAGES[0][1](spark, table, SMALL)
    assert first.columns == table.columns and sorted(r.doc_id for r in first.select("doc_id").collect()) == sorted(kept.doc_id)
    clean = labels[(labels.toxic == 0) & (labels.quality == 1)].doc_id
    assert kept.doc_id.isin(clean).sum() > 0.97 * len(clean)
    second = pipeline.STAGES[1][1](spark, first, SMALL)
    assert second.columns == table.columns
    third = pipeline.STAGES[2][1](spark, second, SMALL)
    texts = {r.doc_id: r.text for r in second.collect()}
    wanted = {i for i, (_, c) in components(texts, 5).items() if i == c}
    assert {r.doc_id for r in third.collect()} == wanted
    result = pipeline.run(spark, SMALL)
    assert {r.doc_id for r in result.select("doc_id").distinct().collect()} == wanted


def test_a_pair_at_the_limit_with_unlike_sketches_is_linked(spark):
    """208 of 260 words are common (0.8), but 20 of the union's 48 least and 22 of those of both sketches."""
    hash_of = Shingler(1)
    words = sorted((f"w{i}" for i in range(260)), key=lambda w: int(hash_of(w)[0]))
    kinds = "c" * 20 + "ab" * 14 + "ab" * 12 + "c" * 188
    texts = [" ".join(w for w, kind in zip(words, kinds, strict=True) if kind in ("c", own)) for own in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs, words=1).collect()} == {0}
    assert {r.component_id for r in near_duplicates(docs, words=1, need=26, least=0.57).collect()} == {0, 1}


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_with_nulls_repeats_and_empty_tables(spark, tmp_path, labelled):
    """Nulls in every column, repeated rows, clashing extra columns and empty tables: each text is packed once, copies go."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "one two three four five six seven eight nine ten " * 5
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, text, None, None, None, None), (3, None, "en", "a", 5, "x"), (4, "", None, "b", 0, "y"), (5, "other words " * 3000, "de", "b", 1, "z"), (None, "no id here", "en", "a", 1, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    marks = [(1, 1, 0), (2, 0, 0), (5, None, None), (None, 1, 1)] if labelled else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    packed = [(r.doc_id, r.piece) for r in pipeline.run(spark, f"file://{tmp_path}").collect()]
    kept = {i for i, _ in packed}
    assert 2 not in kept and 5 in kept and kept <= {1, 3, 4, 5, None}
    assert len(packed) == len(set(packed)) and (labelled or kept == {1, 3, 4, 5, None})


def test_one_row_of_an_id_and_text_stays(spark):
    text = "one two three four five six seven eight nine ten " * 5
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (3, "other words are here and they stay", "d"), (3, "another text of the same id", "e"), (None, "x", "f"), (None, "x", "g"), (4, None, "h"), (4, None, "i")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, count string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, text), (3, rows[3][1]), (3, rows[4][1]), (None, "x"), (None, "x"), (4, None)], key=str)


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    empty = f"file://{tmp_path}/none"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, empty).count() == 0
