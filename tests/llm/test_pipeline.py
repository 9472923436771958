"""The pipeline's stages against brute-force versions, each on its own input."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.shared import written

from ..conftest import SMALL
from .test_operators import brute_components, brute_cut, words_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, before, SMALL), f"stage{k}")
        old, new = before.collect(), after.collect()
        if k < 4:
            assert after.columns == columns
        assert {r.doc_id for r in new} <= {r.doc_id for r in old}
        if k == 0:
            assert {r.doc_id for r in old} - {r.doc_id for r in new} == {r.doc_id for r in old if not any(c.isalpha() for c in r.text or "")}
        if k == 1:
            least = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in old])}
            assert sorted(r.doc_id for r in new) == sorted(i for i, c in least.items() if i == c)
        if k == 2:
            want = brute_cut([(r.doc_id, r.text) for r in old], 256, 50)
            assert {r.doc_id: r.text for r in new} == want and any(want.get(r.doc_id) != r.text for r in old)
        if k == 3:
            items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in new for i in items)
            assert len(new) >= 0.9 * len(old)
        if k == 4:
            sizes = {r.doc_id: len(words_of(r.text)) for r in old}
            assert all(r["size"] == sizes[r.doc_id] and 0 < r.taken <= 2 * r["size"] for r in new)
            by = collections.Counter()
            for r in new:
                by[r.source] += r.taken
            largest = max(sizes.values())
            assert all(abs(by[r.source] - r.target) <= largest for r in new)
        before = after
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, before.collect()))


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, very long and repeated rows, a null id, an empty benchmark, and no documents at all."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hello = "Hello there my dear old friend"
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "123 456", "en", None, 7), (4, hello, None, "a", len(hello)), (4, hello, None, "a", len(hello)), (5, "word " * 50_000, "en", "b", 250_000), (None, "Another text stands here", "en", "b", 24), (6, hello, "en", "b", len(hello))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit(1)).withColumn("marks", F.lit("x"))
    kept = [{4, 5, 6, None}, {4, 5, None}, {4, None}, {4, None}]
    before, none = docs, docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, none = written(stage(spark, before, str(tmp_path)), f"odd{k}"), written(stage(spark, none, str(tmp_path)), f"none{k}")
        assert none.count() == 0
        if k < 4:
            got = before.collect()
            assert {r.doc_id for r in got} == kept[k] and sum(r.doc_id == 4 for r in got) == 2
            assert {r.text for r in got if r.doc_id == 4} == {hello}
    assert {r.doc_id for r in before.collect()} <= {4, None}
