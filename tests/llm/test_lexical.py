"""Ranked lexical search against its SQL and a plain version, through every tier."""

import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical, queries

from ..conftest import SMALL

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=20):
    held = [(i, collections.Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in set(items):
        asked[i].update(terms_of(t))
    out = []
    for item, q in asked.items():
        scored = []
        for doc, c, n in held:
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


def counted(df):
    return collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def plain(spark):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    return brute_search(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_query_matches_sql(spark, plain):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    want = con.sql(lexical.ORACLE)
    got = counted(queries.op13_lexical_search(spark, SMALL).select(*want.columns))
    assert got == collections.Counter(want.fetchall()) == plain


@pytest.mark.parametrize(("tiers", "vocabulary", "pairs"), [((), 10**6, 10**6), ((3,), 10**6, 10**6), ((1, 2, 40), 0, 10**6), ((5, 60), 10**6, 300)])
def test_tiers_vocabularies_and_blocks_agree(spark, plain, tiers, vocabulary, pairs):
    docs, items = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    found = lexical.search(docs, items, tiers=tiers, vocabulary=vocabulary, pairs=pairs)
    assert counted(found) == plain
    assert {r.tier for r in found.select("tier").distinct().collect()} <= set(range(len(tiers) + 1))


def test_rare_terms_are_proven_by_the_first_tier(spark):
    """A rare term's postings are whole in the first tier; common ones need the index."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("the", "of", "and", "to")) for _ in range(rng.randint(5, 60))) + (" zebra quagga" if i < 30 else "")) for i in range(300)]
    items = [(1, "zebra quagga zebra"), (2, "the of and"), (3, "zebra of")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tiers=(40,))
    assert counted(found) == brute_search(docs, items)
    assert {(r.item_id, r.tier) for r in found.select("item_id", "tier").distinct().collect()} >= {(1, 0), (2, 1)}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- !!"), (4, "Ärger ärger zoo"), (5, "zoo zoo"), (5, "zoo zoo"), (5, "a zoo"), (6, "zoo zoo"), (None, "zoo zoo"), (7, "zoo " * 200_000), (8, "y" * 300_000), (None, None)]
    items = [(1, "ZOO"), (1, "ZOO"), (1, "a"), (2, None), (3, ""), (4, "absent"), (None, "ärger zoo zoo"), (5, "zoo " * 50_000)]
    clash = {c: F.lit(1) for c in ("item", "term", "q", "chunk", "rid", "rank", "score", "tier")}
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    for tiers in ((), (1, 3)):
        assert counted(lexical.search(d, i, k=4, tiers=tiers)) == brute_search(docs, items, 4)
    assert lexical.search(d.limit(0), i).count() == lexical.search(d, i.limit(0)).count() == lexical.search(d.filter("doc_id < 4"), i).count() == 0
