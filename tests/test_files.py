"""The array source and sink, the listing, and view-wise tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.kernels import decode_array
from tessera.sources import arrays, folds


@pytest.fixture
def written(spark, tmp_path):
    spark.dataSource.register(arrays.NpyZst)
    rng = np.random.default_rng(0)
    held = {f"s{k}": rng.integers(0, 255, (4 + k, 5, 3), dtype=np.uint8) for k in range(6)} | {"flat": rng.normal(size=(3, 7))}
    rows = [arrays.described(k, v) for k, v in held.items()]
    folder = str(tmp_path / "arrays")
    spark.createDataFrame(rows, arrays.SCHEMA).repartition(3).write.format("npyzst").mode("append").option("path", folder).save()
    return folder, held


def test_round_trip_and_listing(spark, written, tmp_path):
    folder, held = written
    for read in (spark.read.format("npyzst").load(folder), arrays.read_arrays(spark, folder)):
        got = {r.stem: np.frombuffer(r.data, r.dtype).reshape([x for x in (r.height, r.width, r.channels) if x > 1]) for r in read.collect()}
        assert got.keys() == held.keys() and all((got[k] == held[k]).all() for k in held)
    assert sorted(p.name for p in (tmp_path / "arrays").iterdir()) == sorted(f"{k}.npy.zst" for k in held)
    assert (decode_array((tmp_path / "arrays" / "flat.npy.zst").read_bytes()) == held["flat"]).all()
    (tmp_path / "arrays" / "broken.npy.zst").write_bytes(b"no array at all")
    listed = arrays.listed(spark, folder)
    assert {r.stem for r in listed.collect()} == held.keys() | {"broken"}  # opened, it would fail
    assert all(r.bytes > 0 for r in listed.collect())


def test_only_wanted_files_are_opened(spark, written, tmp_path):
    folder, held = written
    for k in held.keys() - {"s1", "s4"}:
        (tmp_path / "arrays" / f"{k}.npy.zst").write_bytes(b"fails if it is opened")
    with arrays.pushed_filters(spark):
        load = lambda: spark.read.format("npyzst").option("pushdown", "true").load(folder)
        assert {r.stem for r in load().filter(F.col("stem").isin("s1", "s4", "absent")).collect()} == {"s1", "s4"}
        assert [r.height for r in load().filter("stem = 's4' AND height > 2").collect()] == [8]
        assert load().filter("stem = 's4' AND height > 20").count() == 0
        assert load().filter("stem = 's1' AND stem = 's4'").count() == 0
        with pytest.raises(Exception):  # noqa: B017
            load().collect()
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "false"


def test_a_failed_write_leaves_nothing(spark, written, tmp_path):
    folder, held = written
    before = sorted((p.name, p.read_bytes()) for p in (tmp_path / "arrays").iterdir())
    bad = [arrays.described(f"new{k}", np.zeros((2, 2))) for k in range(8)]
    bad[5] = (*bad[5][:1], 3, *bad[5][2:])  # its bytes don't fill that shape
    with pytest.raises(Exception, match="reshape|abort|cannot"):
        spark.createDataFrame(bad, arrays.SCHEMA).repartition(4).write.format("npyzst").mode("append").option("path", folder).save()
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "arrays").iterdir()) == before
    twice = [arrays.described("same", np.zeros((2, 2)))] * 2
    with pytest.raises(Exception, match="name"):
        spark.createDataFrame(twice, arrays.SCHEMA).repartition(2).write.format("npyzst").mode("append").option("path", folder).save()
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "arrays").iterdir()) == before
    with pytest.raises(Exception, match="lack"):
        spark.range(3).write.format("npyzst").mode("append").option("path", folder).save()
    spark.createDataFrame([arrays.described("only", np.ones((2, 2)))], arrays.SCHEMA).write.format("npyzst").mode("overwrite").option("path", folder).save()
    assert [p.name for p in (tmp_path / "arrays").iterdir()] == ["only.npy.zst"]
    with pytest.raises(ValueError, match="mounted"):
        arrays._mounted("s3a://bucket/x")


def test_views_are_pruned_at_run_time(spark, tmp_path):
    items = spark.range(300).selectExpr("id AS stem", "element_at(array('Back', 'Belly', 'Side'), CAST(id % 3 AS INT) + 1) AS view", "id * 2 AS v")
    by_view = folds.write_by_view(items.select("stem", "v", "view"), str(tmp_path / "views"))
    fold = spark.createDataFrame([(0, "Back", 1), (3, "Back", 1), (4, "Belly", 0)], "stem long, view string, fold int")
    kept = folds.kept_by_view(by_view, fold.filter("fold = 1"))
    assert sorted((r.stem, r.v) for r in kept.collect()) == [(0, 0), (3, 6)]
    disk = fold.write.parquet(str(tmp_path / "fold")) or spark.read.parquet(str(tmp_path / "fold"))
    assert "dynamicpruning" in folds.kept_by_view(by_view, disk.filter("fold = 1"))._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="no view"):
        folds.write_by_view(spark.createDataFrame([(1, "Top")], "stem long, view string"), str(tmp_path / "bad"))
