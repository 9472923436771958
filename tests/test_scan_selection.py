"""The moving average's scan, exact selection, matching by rank, and vector sums against plain versions."""

import collections
import random

import numpy as np
import pytest

from tessera.operators import aggregates, ordered, selection


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_scan_is_the_recursion(spark, blocks):
    """Series of very different lengths, nulls at the start and inside, cut anywhere; a null key is a series too."""
    rng = random.Random(blocks)
    rows = []
    for key, n in (("long", 900), ("short", 7), ("one", 1), (None, 40), ("late", 60)):
        for i in range(n):
            missing = rng.random() < 0.1 or (key == "late" and i < 45)
            rows.append((key, i * 3, None if missing else rng.uniform(-5, 5)))
    want = {}
    for key in {r[0] for r in rows}:
        ema, place = None, 0
        for _, at, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            place += 1
            ema = ema if x is None else x if ema is None else 0.9 * ema + (1 - 0.9) * x
            want[key, at] = (ema, place)
    rng.shuffle(rows)
    got = ordered.moving_average(spark.createDataFrame(rows, "k string, t int, x double"), "k", "t", "x", 0.9, blocks).collect()
    assert len(got) == len(rows)
    for r in got:
        ema, place = want[r.k, r.t]
        assert r.place == place and (r.ema is None) == (ema is None) and (ema is None or abs(r.ema - ema) < 1e-9)


def test_scan_holds_no_series(spark):
    """A series of half of all rows is cut over the tasks."""
    df = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS k", "id AS t", "CAST(id % 7 AS DOUBLE) AS x")
    out = ordered.moving_average(df, "k", "t", "x", 0.9, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and out.filter("k = 'hot'").count() == 2000
    assert ordered.moving_average(df.limit(0), "k", "t", "x", 0.9).count() == 0


def _values(rng, kind, n):
    if kind == "ties":
        return [float(rng.randrange(3)) for _ in range(n)]
    if kind == "one":
        return [4.25] * n
    if kind == "skew":
        return [1e-300 * rng.random() if rng.random() < 0.9 else 1e12 * rng.random() for _ in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


@pytest.mark.parametrize("leaf", [0, 12, 4096])
def test_ranks_medians_and_bins(spark, monkeypatch, leaf):
    monkeypatch.setattr(selection, "BARS", 8)  # many steps
    monkeypatch.setattr(selection, "LEAF", leaf)
    rng = random.Random(6)
    rows, wanted, counts = [], [], []
    for k, (kind, n) in enumerate([("ties", 60), ("one", 41), ("skew", 120), ("plain", 200), ("plain", 1), ("plain", 2)]):
        rows += [(k, x, t) for t, x in enumerate(_values(rng, kind, n))]
        wanted += [(k, r) for r in {1, n, rng.randint(1, n), rng.randint(1, n), n + 5}]
        cuts = sorted(rng.randint(0, n) for _ in range(5))
        counts += [(k, b, hi - lo) for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, n], strict=True))]
    values = spark.createDataFrame(rows, "k int, v double, t long")
    of = {k: sorted((v, t) for key, v, t in rows if key == k) for k in range(6)}
    barred = selection.barred(values, "k", "v")
    got = {(r.k, r["rank"]): tuple(r.bound) for r in selection.at_ranks(barred, "k", "v", "t", spark.createDataFrame(wanted, "k int, rank long")).collect()}
    assert got == {(k, r): of[k][r - 1] for k, r in wanted if r <= len(of[k])}
    medians = {r.k: r.median for r in selection.medians(values, "k", "v").collect()}
    assert medians == {k: float(np.median([v for v, _ in held])) for k, held in of.items()}
    table = spark.createDataFrame(counts, "k int, bin int, n long")
    bins = {(r.k, r.t): r.bin for r in selection.matched_bins(values, table, "k", "v", "t").collect()}
    for k, held in of.items():
        want = [b for key, b, n in counts if key == k for _ in range(n)]
        assert [bins[k, t] for _, t in held] == want


def test_matching_sorts_no_specimen(spark):
    values = spark.range(5000).selectExpr("id % 2 AS k", "CAST(hash(id) AS DOUBLE) AS v", "id AS t")
    counts = spark.createDataFrame([(0, 0, 1000), (0, 1, 1500), (1, 0, 2500)], "k long, bin int, n long")
    out = selection.matched_bins(values, counts, "k", "v", "t")
    assert {(r.k, r.bin): r["count"] for r in out.groupBy("k", "bin").count().collect()} == {(0, 0): 1000, (0, 1): 1500, (1, 0): 2500}
    tops = collections.defaultdict(list)
    for r in out.collect():
        tops[r.k, r.bin].append(r.v)
    assert max(tops[0, 0]) <= min(tops[0, 1])
    assert selection.medians(values.limit(0), "k", "v").count() == 0


@pytest.mark.parametrize(("leaf", "broadcasts"), [(4096, 0), (0, 1)])
def test_matching_broadcasts_no_rows_or_bins(spark, monkeypatch, leaf, broadcasts):
    """Written tables of rows, ranks and bars look small by their files; only the keys of large groups may be broadcast.  Rows without a key have no bins."""
    monkeypatch.setattr(selection, "LEAF", leaf)
    values = spark.range(600).selectExpr("IF(id < 590, id % 10, NULL) AS k", "CAST(hash(id) AS DOUBLE) AS v", "id AS t")
    counts = spark.createDataFrame([(k, b, n) for k in range(10) for b, n in ((0, 9), (1, 50))], "k long, bin int, n long")
    out = selection.matched_bins(values, counts, "k", "v", "t")
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= broadcasts
    assert {(r.k, r.bin): r["count"] for r in out.groupBy("k", "bin").count().collect()} == {(k, b): n for k in range(10) for b, n in ((0, 9), (1, 50))}


def test_vector_sum(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(50, 6)), rng.random(50)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, w, strict=True)] + [(None, 1.0), ([0.0] * 6, None)]
    got = {r.place: r.total for r in aggregates.vector_sum(spark.createDataFrame(rows, "v array<double>, w double").repartition(5), "v", "w", 6).collect()}
    assert np.allclose([got[k] for k in range(6)], w @ x)
