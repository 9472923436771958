"""SimHash fingerprints and components against definitions."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import queries, simhash

from ..conftest import SMALL

WORD = r"[^\x20\x09-\x0D]+"


def brute_print(text, width=3):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, distance=3):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = sorted(parent)
    for i, a in enumerate(held):
        for b in held[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return find


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    find, least = brute_roots(prints), {}
    key = lambda i: float("inf") if i is None else i
    for (i, _), p in zip(rows, prints, strict=True):
        root = find(p)
        least[root] = i if root not in least else min(i, least[root], key=key)
    return collections.Counter((i, f"{p:016x}", least[find(p)]) for (i, _), p in zip(rows, prints, strict=True))


def counted(df):
    return collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = counted(queries.op12_simhash(spark, SMALL))
    assert got == brute_components(rows)
    assert any(i != c for i, _, c in got)


def test_hash_is_that_of_spark(spark):
    text = "Ünï cödé words"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)


def test_odd_rows(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(400)]
    near = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(400)] = f"z{k}"
        near.append((100 + k, " ".join(w)))
    data = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (5, "one two three four"), (6, "one two three four"), (6, "one two three four"), (None, "one"), (None, None), (7, "x" * 300_000), (8, "word " * 100_000), *near]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rid", "fp", "least", "many", "root", "component", "hot", "known")})
    assert counted(simhash.components(docs)) == brute_components(data)
    assert simhash.components(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    least = {i for i, _, c in brute_components(data) if i is not None and i == c}
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(i for i, _ in data if i is None or i in least)
    nulls = spark.createDataFrame([(None, "some words here and there"), (None, "some words here and there")], "doc_id long, text string")
    assert [r.component_id for r in simhash.components(nulls).collect()] == [None, None]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_close_pairs_connect_what_is_close(spark, distance):
    """Families around centres, in small and in large groups, chains, and fingerprints far from all."""
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for size, flips in ((400, 6), (30, 3), (200, 12)):
        centre = rng.getrandbits(64)
        places = rng.sample(range(64), 14)
        for _ in range(size):
            prints.add(centre ^ sum(1 << b for b in rng.sample(places, rng.randint(0, flips))))
    at = rng.getrandbits(64)
    for _ in range(100):
        at ^= sum(1 << b for b in rng.sample(range(64), distance))
        prints.add(at)
    prints |= {0, (1 << 64) - 1, 1, 3, 7, 15}
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.close_pairs(spark.createDataFrame(signed, "fp long"), distance).distinct().collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links]
    assert all(a != b and (a ^ b).bit_count() <= distance for a, b in pairs)
    want, parent = brute_roots(prints, distance), {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = lambda f: {frozenset(g) for g in _grouped(prints, f).values()}
    assert groups(find) == groups(want)


def _grouped(prints, find):
    out = collections.defaultdict(set)
    for p in prints:
        out[find(p)].add(p)
    return out


def test_large_group_gives_a_forest():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 24, 200_000)).astype(np.uint64)
    i, j = simhash.forest(values, np.arange(24), 3)
    assert len(i) < 2 * len(values) and (np.bitwise_count(values[i] ^ values[j]) <= 3).all()
    assert not simhash.merged(np.arange(len(values)), i, j).any()
