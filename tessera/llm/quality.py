"""Quality by hierarchical empirical Bayes.

A linear classifier on hashed byte trigrams gives each document evidence.
Evidence is summed by host (source) and by path (here lang within the host:
documents have no URL paths).  Variance components (within paths, between the
paths of a host, between hosts) are estimated by moments from these sums; each
level is shrunk toward the one above by the variance within over the variance
between.  A document is scored by its own evidence and by what the other
documents of its path, its host and the corpus say, so it isn't counted twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import fold, linear_svm, trigram_features
from .shared import doc_text, written
from .textscan import chunks
from .toxicity import labelled, logistic

SITES_TO_BROADCAST, STRONGEST = 50_000, 1000.0


def train(docs: DataFrame, labels: DataFrame, per_class: int, modulus: int) -> np.ndarray | None:
    """Weights of the trigrams and, last, bias; margins are scaled to log-odds on rows not fitted."""

    def featured(batches):
        for rows, data, offsets in chunks(batches, rows=256):
            x = trigram_features(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("half"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["label", "half", "x"])

    got = labelled(docs, labels, "quality", per_class, modulus).select("doc_id", "text", "label", "half").mapInArrow(featured, "label int, half boolean, x binary").collect()  # bounded by per_class
    got.sort(key=lambda r: (r.label, r.half, r.x))
    if len({(r.label, r.half) for r in got}) < 4:
        return None
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in got], dtype=np.float32)
    y, half = np.array([r.label for r in got]), np.array([r.half for r in got])
    w = linear_svm(x[half], np.where(y[half] == 1, 1.0, -1.0))
    margin = x[~half] @ w[:-1] + w[-1]
    a, b = logistic(margin[:, None], y[~half].astype(np.float64), ridge=1.0)
    return np.append(w[:-1] * a, w[-1] * a + b)


def strengths(paths: DataFrame) -> tuple[float, float, float]:
    """Prior mean, and how many documents the prior of a host and of a path weigh; paths: host, n, good, square.

    The strengths lie between 1 and STRONGEST, which also stands for levels that don't differ.
    """
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"), F.count(F.lit(1)).alias("paths"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("a"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    t = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("square").alias("square"), F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("hosts"), F.sum("a").alias("a"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("b"), F.sum(F.col("nn") / F.col("n")).alias("c"), F.sum(F.col("n") * F.col("n").cast("double")).alias("d")).collect()[0]  # one row
    if not t.n:
        return 0.5, STRONGEST, STRONGEST
    prior = min(max(t.good / t.n, 1e-3), 1 - 1e-3)
    within = max((t.square - t.a) / (t.n - t.paths) if t.n > t.paths else prior * (1 - prior), 1e-9)

    def strength(excess: float, room: float) -> float:
        between = excess / room if room > 0 else 0.0
        return min(max(within / between, 1.0), STRONGEST) if between > 0 else STRONGEST

    of_paths = strength(t.a - t.b - (t.paths - t.hosts) * within, t.n - t.c)
    of_hosts = strength(t.b - t.good**2 / t.n - (t.hosts - 1) * within, t.n - t.d / t.n)
    return prior, of_hosts, of_paths


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1000, modulus: int = 5, site_weight: float = 0.5) -> DataFrame:
    """doc_id, held_out, evidence, host_posterior, path_posterior, score, predicted for each row of docs.

    docs: doc_id, text, source, lang; labels: doc_id, quality (only rows
    outside fold 0 are learned from, at most about `per_class` a class).
    evidence is the document's own probability of quality 1.  host_posterior
    and path_posterior are those of the host's and the path's other documents.
    score adds `site_weight` of the path's log-odds, relative to the prior, to
    the evidence; predicted is score >= 0.5.
    Null hosts and langs form sites of their own.  Null and empty texts get
    the classifier's bias as evidence.  Without labels of both classes evidence
    is 0.5.  Null doc_ids count as fold 0.  Repeated rows count as rows.
    """
    model = train(docs, labels, per_class, modulus)

    def run(batches):
        for rows, data, offsets in chunks(batches, rows=512):
            z = trigram_features(data, offsets) @ model[:-1].astype(np.float32) + model[-1] if model is not None else np.zeros(rows.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -20, 20)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("host"), rows.column("path"), pa.array(p)], names=["doc_id", "host", "path", "evidence"])

    own = doc_text(docs, F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"))
    scored = written(own.mapInArrow(run, "doc_id long, host string, path string, evidence double"), "evidence")
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("good"), F.sum(F.col("evidence") * F.col("evidence")).alias("square")), "paths")
    prior, of_hosts, of_paths = strengths(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")).withColumnRenamed("host", "h")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("site"), F.col("path").alias("p"), "n", "good", "host_n", "host_good")
    sites = written(sites, "sites")
    if sites.count() <= SITES_TO_BROADCAST:
        sites = F.broadcast(sites)
    logit = lambda c: F.log(c / (1 - c))
    clipped = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("site")) & F.col("path").eqNullSafe(F.col("p")))
    out = out.withColumn("host_posterior", (F.col("host_good") - F.col("evidence") + of_hosts * prior) / (F.col("host_n") - 1 + of_hosts))
    out = out.withColumn("path_posterior", (F.col("good") - F.col("evidence") + of_paths * F.col("host_posterior")) / (F.col("n") - 1 + of_paths))
    z = logit(clipped(F.col("evidence"))) + site_weight * (logit(clipped(F.col("path_posterior"))) - float(np.log(prior / (1 - prior))))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).select("doc_id", (fold(modulus) == 0).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
