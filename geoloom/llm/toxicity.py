"""Toxicity: a support vector machine on a subsequence string kernel.

Strings are words with marks at both ends.  The kernel counts common subsequences
of three characters that lie within ``SPAN`` places, each gap costing a factor
``DECAY``, so ``idxiot`` and ``iddiott`` are near ``idiot``.  Punctuation inside
words is taken out and words spelled with spaces are put together first.  The normalised kernel is squared (a kernel again).

Nyström: ``M`` landmark words, chosen from the training words by log odds, give
``phi(w) = K^(-1/2) k(w, landmarks)``.  A sentence is the sum of its words over
the root of their number, and takes the label of its document.  A linear SVM with
squared hinge loss is trained on sentences; since it is linear, each word has one
margin, which a worker works out once and remembers.  A document's sentence and
word margins go through a small logistic model to a score from 0 to 1.

Training reads at most ``SAMPLE`` labelled documents of each label (those of least
hash), a bound that keeps the driver's part constant; scoring reads whole texts.

Defined results: null and empty texts get the score of a document without words;
null labels teach nothing, and of several labels of an id the smaller counts; with one label or none to learn from every score is the
share of toxic labels (0 without labels); repeated rows get repeated results; very
long texts are scored whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, give_back, release

SAMPLE = 2000
M = 96
SPAN = 6
DECAY = 0.6
CACHE = 150_000
#: Rows of the training matrices in double precision at once.
CHUNK = 8192
#: Words whose kernel rows are worked out at once.
WORDS = 2048
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
INSERTED = re.compile(r"[^\w\s]|_")
SPELLED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence: lower case, letters and digits only.

    Three or more single characters in a row are one word.
    """
    lowered = (text or "").lower()
    lowered = SPELLED.sub(lambda m: m[0].replace(" ", ""), lowered)
    return [words for part in SENTENCE.split(lowered) if (words := INSERTED.sub("", part).split())]


class Kernel:
    """Normalised squared subsequence kernel between words and fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        keys, owners, weights, norms = self._features(landmarks)
        self.unique, at = np.unique(keys, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.owner, self.weight = owners[order], weights[order] / norms[owners[order]]
        self.first = np.searchsorted(at[order], np.arange(len(self.unique) + 1))
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.unique >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _features(words: list[str], table: np.ndarray | None = None):
        """(key, word, weight) of subsequences (of those in ``table`` only), and the words' norms."""
        text = "".join(f"\x02{w}\x03" for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        parts = [codes * m for m in _MIX]
        keys, owners, weights = [], [], []
        for a, b in OFFSETS:
            n = len(codes) - b
            if n <= 0:
                continue
            key = (parts[0][:n] ^ (parts[1][a : a + n] + np.uint64(a * 0))) + parts[2][b:]
            key = (key ^ key >> np.uint64(31)) * _MIX[1]
            inside = word[:n] == word[b:]
            at = np.flatnonzero(inside)
            keys.append(key[at]), owners.append(word[at]), weights.append(np.full(len(at), DECAY ** (b - 2)))
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.ones(len(words))
        key, owner, weight = np.concatenate(keys), np.concatenate(owners), np.concatenate(weights)
        # a word's kernel with itself: the weights of a subsequence are added up before they are squared
        own = (key ^ owner.astype(np.uint64) * _MIX[2]) * _MIX[0]
        order = np.argsort(own)
        own = own[order]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        squares = np.bincount(owner[order[first]], np.add.reduceat(weight[order], first) ** 2, len(words))
        if table is not None:
            known = np.flatnonzero(table[(key >> np.uint64(44)).astype(np.int64)])
            key, owner, weight = key[known], owner[known], weight[known]
        return key, owner, weight, np.sqrt(np.maximum(squares, 1e-12))

    def rows(self, words: list[str]) -> np.ndarray:
        """Kernel values [words, landmarks]."""
        n, m = len(words), len(self.landmarks)
        keys, owners, weights, norms = self._features(words, self.table)
        at = np.searchsorted(self.unique, keys)
        at[at == len(self.unique)] = 0
        real = self.unique[at] == keys if len(keys) else np.zeros(0, bool)
        at, owners, weights = at[real], owners[real], weights[real]
        spans = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
        value = np.repeat(weights / norms[owners], spans) * self.weight[place]
        return (np.bincount(np.repeat(owners, spans) * m + self.owner[place], weights=value, minlength=n * m).reshape(n, m)) ** 2


class Corpus:
    """Training texts as word numbers: each distinct word is held once."""

    def __init__(self, texts: list):
        number: dict[str, int] = {}
        self.flat, self.sizes = [], []  # per text: word numbers, and words of each sentence
        for text in texts:
            parts = sentences(text)
            self.flat.append(np.array([number.setdefault(w, len(number)) for s in parts for w in s], dtype=np.int32))
            self.sizes.append(np.array([len(s) for s in parts], dtype=np.int32))
        self.words = list(number)


def choose_landmarks(corpus: Corpus, labels: np.ndarray, m: int = M) -> list[str]:
    """Words that tell the labels apart best, three quarters for the positive one, no two much alike."""
    names = corpus.words
    counts = np.zeros((len(names), 2))
    for flat, label in zip(corpus.flat, labels, strict=True):
        counts[np.unique(flat), int(label)] += 1
    totals = [max(1, int((labels == v).sum())) for v in (0, 1)]
    odds = np.log((counts[:, 1] + 0.5) / (totals[1] + 1)) - np.log((counts[:, 0] + 0.5) / (totals[0] + 1))
    chosen: list[str] = []
    for sign, quota in ((1, m * 3 // 4), (-1, m)):
        score = sign * odds * counts[:, 1 if sign > 0 else 0]
        ranked = [names[i] for i in sorted(np.argsort(-score, kind="stable")[: 8 * m], key=lambda i: (-score[i], names[i])) if score[i] > 0]
        if not ranked:
            continue
        alike = Kernel(ranked).rows(ranked)
        taken: list[int] = []
        for i in range(len(ranked)):
            if len(chosen) >= quota:
                break
            if not taken or alike[i, taken].max() < 0.6:
                taken.append(i)
                chosen.append(ranked[i])
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM in the primal by Newton steps; y is 0 or 1, the last column of x is 1.

    ``x`` may be in single precision; only ``CHUNK`` of its rows are in double precision at once.
    """
    sign, design = np.where(y > 0, 1.0, -1.0), x
    ridge = np.full(design.shape[1], penalty * weight.sum())
    ridge[-1] = 1e-9
    beta = np.zeros(design.shape[1])

    def margins(b: np.ndarray) -> np.ndarray:
        out = np.empty(len(design))
        for a in range(0, len(design), CHUNK):
            np.matmul(design[a : a + CHUNK].astype(np.float64), b, out=out[a : a + CHUNK])
        return sign * out

    def loss(b: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - margins(b)) ** 2).sum() + (ridge * b * b).sum())

    now = loss(beta)
    for _ in range(rounds):
        active = margins(beta) < 1
        gradient, hessian = ridge * beta, np.diag(ridge)
        for a in range(0, len(design), CHUNK):
            own = active[a : a + CHUNK]
            part, w = design[a : a + CHUNK][own].astype(np.float64), weight[a : a + CHUNK][own]
            gradient = gradient + part.T @ (w * (part @ beta - sign[a : a + CHUNK][own]))
            hessian = hessian + part.T @ (part * w[:, None])
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now < 1e-7 * before:
            break
    return beta[:-1], float(beta[-1])


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic model, the constant last."""
    design = np.hstack([x, np.ones((len(x), 1))])
    beta, ridge = np.zeros(design.shape[1]), np.full(design.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        hessian = design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """A trained scorer; ``score`` maps texts to numbers from 0 to 1."""

    def __init__(self, share: float):
        self.share, self.kernel = share, None
        self._margins: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_margins": {}}

    @staticmethod
    def fit(texts: list, labels: np.ndarray, weight: np.ndarray) -> Model:
        total = float(weight.sum())
        model = Model(float((weight * labels).sum() / total) if total else 0.0)
        if len(set(labels.tolist())) < 2:
            return model
        corpus = Corpus(texts)
        landmarks = choose_landmarks(corpus, labels)
        if not landmarks:
            return model
        kernel = Kernel(landmarks)
        gram = kernel.rows(landmarks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        m, sizes = len(landmarks), np.concatenate(corpus.sizes)
        flat = np.concatenate(corpus.flat)
        x = np.zeros((len(sizes), m + 1), dtype=np.float32)  # the last column is the constant
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        del order
        for a in range(0, len(corpus.words), WORDS):  # words in order, so that no full matrix of them exists
            phi = (kernel.rows(corpus.words[a : a + WORDS]) @ root).astype(np.float32)
            low, high = np.searchsorted(flat, [a, a + WORDS])
            for c in range(low, high, CHUNK):
                d = min(high, c + CHUNK)
                np.add.at(x[:, :m], row[c:d], phi[flat[c:d] - a])
        x /= np.sqrt(sizes, dtype=np.float32)[:, None]
        x[:, m] = 1
        label = np.repeat(labels, [len(s) for s in corpus.sizes])
        # both labels weigh alike here; the logistic model below restores their shares
        even = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum()))
        beta, model.bias = train_svm(x, label, even)
        model.kernel, model.beta = kernel, root @ beta
        word = np.concatenate([kernel.rows(corpus.words[a : a + WORDS]) @ model.beta for a in range(0, len(corpus.words), WORDS)])
        features = np.array([model.features(word[own], sizes) for own, sizes in zip(corpus.flat, corpus.sizes, strict=True)])
        model.centre, model.scale = features.mean(0), features.std(0) + 1e-9
        model.logistic = train_logistic((features - model.centre) / model.scale, labels, weight / weight.mean())
        return model

    def margins(self, words: set) -> None:
        """Work out and keep the margins of new words."""
        if len(self._margins) > CACHE:
            self._margins.clear()
        new = sorted(words.difference(self._margins))
        for a in range(0, len(new), WORDS):
            part = new[a : a + WORDS]
            self._margins.update(zip(part, (self.kernel.rows(part) @ self.beta).tolist(), strict=True))

    def features(self, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What the logistic model sees of a document: margins of its words, in sentences of ``sizes``."""
        if not len(word):
            return np.zeros(7)
        sums = np.add.reduceat(word, np.cumsum(sizes) - sizes)
        margin = np.sort(sums / np.sqrt(sizes) + self.bias)[::-1]
        top = np.sort(word)[::-1]
        return np.array([margin[0], margin[:3].mean(), margin.mean(), top[0], top[:3].mean(), word.mean() * 10, np.maximum(word, 0).sum() / np.sqrt(len(word))])

    def _measured(self, text: str | None) -> np.ndarray:
        doc = sentences(text)
        self.margins({w for s in doc for w in s})
        known = self._margins
        return self.features(np.array([known[w] for s in doc for w in s]), np.array([len(s) for s in doc], dtype=np.int64))

    def score(self, texts: list) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.share)
        features = np.array([self._measured(t) for t in texts]).reshape(-1, 7)
        return 1 / (1 + np.exp(-np.clip((features - self.centre) / self.scale @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, keep, most: int = SAMPLE) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``most`` labelled documents of each label.

    ``keep`` is a condition on doc_id.  The rows of least hash are taken; their
    weight makes up for those of their label that are left out.
    """
    wanted = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).where(keep).groupBy("doc_id").agg(F.min(column).alias("label"))
    counts = {r["label"]: r["n"] for r in wanted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = None
    for value in counts:
        part = wanted.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        taken = part if taken is None else taken.unionAll(part)
    if taken is None:
        return [], np.zeros(0), np.zeros(0)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    found = rows["label"].to_numpy().astype(np.float64)
    weight = np.ones(len(found))
    for value, n in counts.items():
        own = found == value
        weight[own] = n / max(1, own.sum())
    return rows["text"].tolist(), found, weight


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more."""
    held, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield part.filter(pa.array(held.value.score(part.column(at).to_pylist()) < threshold))
        give_back()

    return docs.mapInArrow(run, schema)


def fit_from_tables(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents whose crc32 of the id is not 0 modulo 5."""
    sample = labelled_sample(docs, labels, "toxic", crc_of_id("doc_id") % 5 != 0)
    release(docs.sparkSession)  # training is the driver's largest part in Python: its JVM gives back first what it does not use
    model = Model.fit(*sample)
    give_back()
    return model


def query(spark, sf_dir: str) -> DataFrame:
    """op2: scores of all documents, learned on four fifths of the ids."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, fit_from_tables(docs, labels))
    return scored.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
