"""Quality classifier: document evidence combined with site posteriors.

Three levels.  A logistic model on surface features of a text gives each document
a probability.  Sums of these by host and by path within host give site means,
which empirical Bayes shrinks: a path toward its host, a host toward the global
mean, by strengths estimated from the variance between and within sites (one-way
random effects, method of moments).  A document's final log odds are its own plus
what its site adds to the global prior, the document itself left out of its site.

All of it is DataFrame expressions and grouped aggregations; only the fit on at
most ``SAMPLE`` labelled documents of each label is done on the driver.  The site
table is broadcast if it is counted and small, else joined by a shuffle with
skewed hosts split at run time.

Defined results: null and empty texts have zero features and are scored like any
other; null hosts and paths are sites named by the empty text; of several labels of an id the smaller counts and null labels teach
nothing; without two labels to learn from every document has the share of good
labels (1 without labels, so nothing is rejected); repeated rows get repeated
results and count as often; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compressed, crc_of_id, materialise
from .near_dedup import small
from .toxicity import train_logistic

SAMPLE = 3000
THRESHOLD = 0.5


def surface(text: str = "text") -> list[Column]:
    """Features of a text as expressions; each is finite for every text."""
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.greatest(F.length(clean), F.lit(1))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1))
    return [
        F.regexp_count(clean, F.lit(r"[^\p{L}\p{N}\s.,;:'\"()-]")) / size,
        F.regexp_count(clean, F.lit(r"\p{Lu}")) / size,
        F.regexp_count(clean, F.lit(r"\p{N}")) / size,
        F.regexp_count(clean, F.lit(r"\n")) / size,
        F.regexp_count(clean, F.lit(r"[.!?](?=\s|$)")) / count,
        F.size(F.array_distinct(words)) / count * F.sqrt(count) / 10,
        F.size(F.array_distinct(words)) / count,
        F.length(clean) / count / 10,
        F.log1p(F.length(clean)) / 10,
    ]


def with_features(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    return docs.withColumn(name, F.array(*[c.cast("double") for c in surface(text)]))


class Model:
    """Logistic weights on standardised, clipped features."""

    def __init__(self, centre: list[float], scale: list[float], weights: list[float], constant: float):
        self.centre, self.scale, self.weights, self.constant = centre, scale, weights, constant

    @staticmethod
    def fit(features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> Model:
        share = float((weight * labels).sum() / weight.sum()) if len(labels) else 1.0
        if len(set(labels.tolist())) < 2:
            share = min(max(share, 1e-4), 1 - 1e-4)
            return Model([], [], [], math.log(share / (1 - share)))
        centre, scale = np.median(features, axis=0), features.std(axis=0) + 1e-9
        x = np.clip((features - centre) / scale, -4, 4)
        beta = train_logistic(np.hstack([x, x**2]), labels, weight / weight.mean(), penalty=1.0)
        return Model(centre.tolist(), scale.tolist(), beta[:-1].tolist(), float(beta[-1]))

    def logit(self, features: Column) -> Column:
        """Log odds as an expression, within plus or minus 12."""
        total, m = F.lit(self.constant), len(self.centre)
        for i in range(m):
            z = F.greatest(F.least((F.get(features, F.lit(i)) - self.centre[i]) / self.scale[i], F.lit(4.0)), F.lit(-4.0))
            total = total + z * self.weights[i] + z * z * self.weights[m + i]
        return F.greatest(F.least(total, F.lit(12.0)), F.lit(-12.0))


def fit_from_tables(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learn ``quality`` from labelled documents whose crc32 of the id is not 0 modulo 5."""
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(crc_of_id("doc_id") % 5 != 0)
    wanted = wanted.groupBy("doc_id").agg(F.min("quality").alias("label"))
    counts = {r["label"]: r["n"] for r in wanted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [wanted.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in counts]
    if not parts:
        return Model.fit(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    taken = parts[0]
    for part in parts[1:]:
        taken = taken.unionAll(part)
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"), "_features").select("doc_id", "label", "_features").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    if not rows:
        return Model.fit(np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    found = np.array([r["label"] for r in rows], dtype=np.float64)
    weight = np.array([counts[r["label"]] for r in rows], dtype=np.float64) / np.array([max(1, (found == r["label"]).sum()) for r in rows])
    return Model.fit(np.array([r["_features"] for r in rows]), found, weight)


def site_of(host: str, path: str) -> tuple[Column, Column]:
    """Host and path of a row: a URL gives both, any other source is a host and ``path`` its section."""
    name = F.coalesce(F.col(host).cast("string"), F.lit(""))
    bare = F.regexp_replace(name, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    inner = F.split_part(bare, F.lit("/"), F.lit(2))
    return F.split_part(bare, F.lit("/"), F.lit(1)), F.when(inner != "", inner).otherwise(F.coalesce(F.col(path).cast("string"), F.lit("")))


def _strength(between: float, groups: float, outer: float, within: float, spread: float) -> float:
    """Prior strength (pseudo-documents) from sums of squares; large if sites do not differ."""
    excess = between - (groups - outer) * within
    if spread <= 0 or excess <= 0:
        return 1e6
    return float(min(max(within / (excess / spread), 1.0), 1e6))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, prior, strength, n, total) and the global mean, from rows (host, path, p).

    ``prior`` is the host's shrunken mean; a path's posterior is
    (total + strength * prior) / (n + strength).
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"))
    paths = materialise(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    joined = paths.join(small(hosts), "host")
    mean, host_mean = F.col("total") / F.col("n"), F.col("host_total") / F.col("host_n")
    inner = joined.agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("squares") - F.col("n") * mean * mean).alias("within"), F.count("*").alias("paths"),
        F.sum(F.col("n") * (mean - host_mean) ** 2).alias("between"), F.sum(F.col("n") * F.col("n") / F.col("host_n")).alias("part"),
    ).first()
    if not inner["n"]:
        return paths.select("host", "path", F.lit(0.5).alias("prior"), F.lit(1.0).alias("strength"), "n", "total"), 0.5
    n, centre = float(inner["n"]), float(inner["total"] / inner["n"])
    outer = hosts.agg(F.count("*").alias("hosts"), F.sum(F.col("host_n") * (host_mean - centre) ** 2).alias("between"), F.sum(F.col("host_n") * F.col("host_n")).alias("squares")).first()
    within = float(inner["within"]) / max(1.0, n - inner["paths"])
    path_strength = _strength(float(inner["between"]), float(inner["paths"]), float(outer["hosts"]), within, n - float(inner["part"]))
    host_strength = _strength(float(outer["between"]), float(outer["hosts"]), 1.0, within, n - float(outer["squares"]) / n)
    prior = (F.col("host_total") + host_strength * centre) / (F.col("host_n") + host_strength)
    return joined.select("host", "path", prior.alias("prior"), F.lit(path_strength).alias("strength"), "n", "total"), centre


def posterior(logit: Column, p: Column, centre: float) -> Column:
    """Final probability of a row joined to its site, its own share taken out of the site's."""
    site = (F.col("site.total") - p + F.col("site.strength") * F.col("site.prior")) / (F.col("site.n") - 1 + F.col("site.strength"))
    site = F.greatest(F.least(site, F.lit(1 - 1e-6)), F.lit(1e-6))
    base = min(max(centre, 1e-6), 1 - 1e-6)
    odds = logit + F.log(site / (1 - site)) - math.log(base / (1 - base))
    return 1 / (1 + F.exp(-odds))


def _sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, model: Model, keep: list[str], host: str = "source", path: str = "lang") -> DataFrame:
    """The columns ``keep`` of ``docs`` as a struct ``row``, with ``own`` (p of the text alone) and ``score``."""
    own_host, own_path = site_of(host, path)
    logit = model.logit(F.col("_features"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), own_host.alias("host"), own_path.alias("path"), F.col("text").cast("string").alias("text"))
    # texts are read once: what the sites and the scores need of them is written
    rows = compressed(with_features(rows, "_features").select("row", "host", "path", logit.alias("logit")), "logits")
    sites, centre = site_posteriors(rows.select("host", "path", _sigmoid(F.col("logit")).alias("p")))
    sites = small(materialise(sites, "sites"))
    sites = sites.select("host", "path", F.struct("prior", "strength", "n", "total").alias("site"))
    p = _sigmoid(F.col("logit"))
    return rows.join(sites, ["host", "path"]).select("row", "host", "path", p.alias("own"), posterior(F.col("logit"), p, centre).alias("score"))


def drop_low_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose posterior is below ``threshold``."""
    return score(docs, model, docs.columns).where(F.col("score") >= threshold).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: posteriors of all documents; source is the host and lang its section."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit_from_tables(docs, labels), ["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), (crc_of_id("row.doc_id") % 5 == 0).alias("held_out"), "host", "path", "own", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
