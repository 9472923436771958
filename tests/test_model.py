"""The bag model's products, activations and pooling against NumPy, and rank metrics in one pass."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, model
from tessera.plans import predictions

from .conftest import SMALL


def weights_of(spark, w):
    return spark.createDataFrame([(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1]) if w[i, j]], "i long, j long, w double")


@pytest.mark.parametrize("width", [1, 20, 64, 150])
def test_product_is_a_matrix_product(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    x, w = rng.normal(size=(9, 12)), rng.normal(size=(13, width))
    w[:, : width // 3][rng.random((13, width // 3)) < 0.7] = 0  # absent weights
    w[0, width - 1] = 1.5
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(9)] + [(9, None)], "key int, v array<double>")
    for most in (10**6, 0):
        monkeypatch.setattr(model, "WEIGHTS_TO_BROADCAST", most)
        got = {r.key: r.y for r in model.product(model.components(rows, ["key"], "v"), ["key"], weights_of(spark, w)).collect()}
        assert set(got) == set(range(9))
        want = np.hstack([x, np.ones((9, 1))]) @ w
        assert all(np.allclose(got[k], want[k], atol=1e-12) and len(got[k]) == width for k in got)


def test_gelu_is_exact(spark):
    xs = [-50.0, -7.5, -5.0, -1.0, -1e-9, 0.0, 0.3, 1.0, 2.5, 4.9, 7.0, 7.2, 80.0]
    got = model.with_gelu(spark.createDataFrame([(x, x) for x in xs], "x double, g double"), "g").collect()
    assert all(abs(r.g - 0.5 * r.x * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-10 for r in got)


def test_predictions_are_those_of_numpy(spark):
    """The whole chain for some bags: gains, attention, pooling, both heads."""
    layers = {}
    for name, (width, _) in predictions.LAYERS.items():
        w = np.zeros((predictions.SIZE + 1, width))
        for r in predictions.layer(spark, name).collect():
            w[r.i, r.j] = r.w
        layers[name] = w
    gains = {r.condition_name: np.array(r.gain) for r in predictions.gains(spark).collect()}
    assert len(gains) == 23
    crops = spark.read.parquet(f"{SMALL}/embeddings.parquet").filter("vec_id < 48").collect()
    with_one = lambda a: np.hstack([a, np.ones((len(a), 1))])
    got = {(r.stem, r.condition_name): r for r in predictions.bag_predictions(spark, SMALL).filter("stem < 3").collect()}
    assert len(got) == 3 * 23
    for (stem, name), r in got.items():
        own = [c for c in crops if c.vec_id // 16 == stem]
        x = np.array([np.array(c.embedding, dtype=np.float32).astype(float) for c in own]) * gains[name]
        y = with_one(x) @ layers["gate"]
        score = (np.tanh(y[:, :16]) / (1 + np.exp(-y[:, 16:]))) @ np.array(predictions.OUT)
        a = np.exp(score) / np.exp(score).sum()
        h = with_one((a @ x)[None]) @ layers["hidden"]
        h = 0.5 * h * (1 + np.vectorize(math.erf)(h / math.sqrt(2)))
        z = (with_one(h) @ layers["last"])[0]
        assert np.allclose(r.cls_prob, 1 / (1 + np.exp(-z[:10])), atol=1e-9)
        assert np.allclose(r.reg_prob, np.exp(z[10:]) / np.exp(z[10:]).sum(), atol=1e-9)
        assert np.allclose(r.habitat, [np.mean([c.label == k for c in own]) for k in range(10)])


def test_rank_metrics_of_one_pass(spark):
    rng = np.random.default_rng(8)
    rows = [(int(c), float(rng.integers(0, 12)) / 11, int(t), 1 - int(t)) for c in range(4) for t in (rng.random(60) < (0.0, 1.0, 0.3, 0.6)[c])]
    df = spark.createDataFrame(rows, "class int, p double, positive int, negative int")
    auc = {r["class"]: r.auc for r in metrics.class_auc(df, ["class"], "p").collect()}
    ap = {r["class"]: r.ap for r in metrics.class_ap(df, ["class"], "p").collect()}
    for r in metrics.class_ranks(df, ["class"], "p").collect():
        assert (r.auc is None) == (r["class"] not in auc) and (r.ap is None) == (r["class"] not in ap)
        assert r.auc is None or abs(r.auc - auc[r["class"]]) < 1e-12
        assert r.ap is None or abs(r.ap - ap[r["class"]]) < 1e-12


def test_bootstrap_of_many_families_on_one_score(spark, monkeypatch):
    """2,000 families share a score: cells are cut by rows, and the open score is carried on."""
    rng = np.random.default_rng(2)
    rows = [(f"f{k}", c, 0, 0.5 if k % 3 else float(rng.integers(0, 5)) / 4, float(rng.integers(0, 2))) for k in range(2000) for c in ("reference", "A1")]
    df = spark.createDataFrame(rows, "family string, condition_name string, class int, p double, t double")
    want = sorted(map(tuple, metrics.bootstrap_delta_auc(df, 20).collect()))
    monkeypatch.setattr(metrics, "ROWS_AT_ONCE", 37)
    by_cut = sorted(map(tuple, metrics.bootstrap_delta_auc(df, 20).collect()))
    monkeypatch.setattr(metrics, "FAMILIES_TO_BROADCAST", 1)
    by_join = sorted(map(tuple, metrics.bootstrap_delta_auc(df.filter(F.lit(True)), 20).collect()))
    for other in (by_cut, by_join):
        assert all(a[0] == b[0] and a[3] == b[3] and np.allclose(a[1:3], b[1:3], atol=1e-12) for a, b in zip(want, other, strict=True))
