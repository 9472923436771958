"""Periodic runs against definitions, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic, queries

from ..conftest import SMALL

WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(w, exponent=4, least=6):
    """Every (start, length, period): for each period the maximal stretches that keep it, unless a smaller period does."""
    n, spans = len(w), {}
    for p in range(1, n // exponent + 1):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and w[end] == w[end + p]:
                end += 1
            if end > start and end + p - start >= max(least, exponent * p):
                spans.setdefault((start, end + p - start), p)
            start = max(end, start) + 1
    return sorted((s, length, p) for (s, length), p in spans.items())


def planted(doc_id, text):
    w = re.findall(WORD, text or "")
    if doc_id is None or not w or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def brute_row(doc_id, text):
    w = planted(doc_id, text)
    found = brute_runs(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def rows_of(df):
    return [tuple(r)[:8] for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = rows_of(queries.op11_periodic_runs(spark, SMALL))
    assert sorted(got) == sorted(brute_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 9)])
def test_runs_of_small_alphabets(exponent, least):
    rng = random.Random(exponent)
    for trial in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.choice((0, 1, 5, 40, 90)))]
            if rng.random() < 0.5 and w:
                w = w[: rng.randint(1, 12)] * rng.randint(1, 9) + w
            texts.append(w)
        ids = np.array([x for w in texts for x in w], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        text, start, length, period = periodic.runs_of(ids, first, exponent, least)
        got = list(zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True))
        assert got == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w, exponent, least)], trial


def test_grid_points_that_agree_in_one_layout_only():
    """Four grid points of the first layout hold one word by chance; without the first text the grid lies elsewhere, and none do."""
    texts = [[2, 0, 3, 0, 2, 1, 3, 0, 3, 0, 2, 2], [3, 1, 3, 2, 3, 0, 3, 3, 0, 1, 2]]
    ids, first = np.array([x for w in texts for x in w], dtype=np.int64), np.array([0, 12, 23])
    assert [len(x) for x in periodic.runs_of(ids, first, 4, 6)] == [0, 0, 0, 0]
    assert not any(brute_runs(w) for w in texts)


def test_extensions_and_range_minima():
    rng = np.random.default_rng(3)
    for size in (1, 2, 15, 16, 17, 300):
        values = rng.integers(0, 9, size)
        least = periodic.RangeMin(values)
        low = rng.integers(0, size, 200)
        high = np.minimum(low + rng.integers(0, size, 200), size - 1)
        assert least.of(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]
    ids = rng.integers(0, 2, 400)
    lce = periodic.Extensions(np.append(ids, -1))
    i, j = rng.integers(0, 400, 500), rng.integers(0, 400, 500)
    i, j = i[i != j], j[i != j]

    def brute(a, b):
        n = 0
        while max(a, b) + n < len(ids) and ids[a + n] == ids[b + n]:
            n += 1
        return n

    assert lce.of(i, j).tolist() == [brute(a, b) for a, b in zip(i, j, strict=True)]


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names, an empty table."""
    long = "la " * 30_000 + "x y " * 5_000 + " ".join(map(str, range(20_000)))
    data = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c b c b c b c"), (None, None), (6, "é é\té\né é é"), (7, "q" * 500_000), (8, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "w", "n", "g", "a", "p", "runs", "start")})
    found = periodic.periodic_runs(docs)
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in found.collect()}
    assert got[5, 6] == ([(0, 6, 1)], "a") and got[6, 6] == ([(0, 6, 1)], "é") and got[None, 8] == ([(0, 8, 2)], "b c")
    assert got[1, 0] == got[2, 0] == got[None, 0] == ([], "") and got[4, 2] == ([], "a b") and got[7, 1] == ([], "q" * 500_000)
    assert got[8, 60_000][0] == [(0, 30_000, 1), (30_000, 10_000, 2)]
    assert got[8, 60_000][1] == "la x y " + " ".join(map(str, range(20_000)))
    assert found.count() == len(data) and periodic.periodic_runs(docs.limit(0)).count() == 0
    small = docs.filter("doc_id is null or doc_id < 8")
    assert sorted(map(str, rows_of(periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(small)))))) == sorted(str(brute_row(i, t)) for i, t in data[:-1])
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(docs, exponent=1)
