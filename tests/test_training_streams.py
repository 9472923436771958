"""Epoch orders, cache dispatch, and streams that stop, fail and go on."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, training
from tessera.streaming import events


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_each_epoch_is_a_permutation(n):
    at = np.arange(n)
    orders = [training.permuted(at, np.full(n, key), n) for key in (5, 12_345, 2_000_000_000)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 16 or len({tuple(o) for o in orders}) == 3
    mixed = training.permuted(np.tile(at, 2), np.repeat([5, 12_345], n), n)
    assert (mixed == np.concatenate(orders[:2])).all()


def test_dense_index_and_orders(spark):
    rows = [(k * 7919 % 501, f"s{k}") for k in range(500)]
    items = training.dense_index(spark.createDataFrame(rows, "a int, stem string").repartition(7), ["a", "stem"])
    got = {r.stem: r["index"] for r in items.collect()}
    assert got == {stem: i for i, (_, stem) in enumerate(sorted(rows))}
    orders = training.epoch_orders(items, "index", 3, 42).withColumn("key", training.draw_key(42, "index", "stem"))
    by = collections.defaultdict(list)
    for r in orders.collect():
        by[r.epoch].append(r.place)
        assert r.key == f"42|{r.epoch}|{r['index']}|{r.stem}"
    assert all(sorted(p) == list(range(500)) for p in by.values()) and len(by) == 3
    again = {(r.epoch, r.stem): r.place for r in training.epoch_orders(items, "index", 3, 42).collect()}
    assert again == {(r.epoch, r.stem): r.place for r in orders.collect()}
    assert "Window" not in orders._jdf.queryExecution().executedPlan().toString()
    assert training.epoch_orders(training.dense_index(items.drop("index").limit(0), ["a"]), "index", 2, 1).count() == 0


def test_only_misses_are_computed(spark):
    items = spark.createDataFrame([(k, k * 10) for k in range(10)], "stem int, v int")
    one, two = (spark.createDataFrame([(k, 0) for k in keys], "stem int, x int") for keys in ([0, 1, 2, 3, 3], [2, 3, 4]))
    computed = spark.sparkContext.accumulator(0)

    def costly(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    out = joins.from_caches(items, [one, two], "stem", lambda d: d, lambda d: d.mapInArrow(costly, d.schema)).collect()
    assert sorted((r.stem, r.source) for r in out) == [(k, "cache" if k in (2, 3) else "online") for k in range(10)]
    assert computed.value == 8
    with pytest.raises(Exception, match="was not built"):
        joins.required(items, one.dropDuplicates(["stem"]), ["stem"], "x").collect()


def losses(n):
    rng = np.random.default_rng(4)
    return [("run", k, float(a), float(b)) for k, (a, b) in enumerate(np.exp(rng.normal(0, 0.3, (n, 2))))]


def plain_weights(rows, decay=0.9, lag=3, temperature=0.5, band=(0.3, 0.7)):
    ema, held, out = None, [], {}
    for _, epoch, *now in rows:
        ema = now if ema is None else [decay * e + (1 - decay) * x for e, x in zip(ema, now, strict=True)]
        held.append(ema)
        w = 0.5
        if len(held) > lag:
            a, b = (held[-1][i] / held[-1 - lag][i] for i in (0, 1))
            w = min(max(1 / (1 + np.exp(-(a - b) / temperature)), band[0]), band[1])
        out[epoch] = w
    return out


SCHEMA = "run string, epoch int, a double, b double"


def test_balancer_stops_and_goes_on(spark, tmp_path):
    """Restarted from its checkpoint, and continued from a saved table, it weighs as if it had never stopped."""
    rows, log = losses(20), str(tmp_path / "log")
    want, at = plain_weights(rows), (str(tmp_path / "out"), str(tmp_path / "state"))

    def go(part, at, folder, saved=None):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        with events.with_rocksdb(spark):
            stream = spark.readStream.schema(SCHEMA).parquet(folder)
            return {r.epoch: r.weight_a for r in events.run_now(events.balanced(stream, 0.9, 3, 0.5, (0.3, 0.7), saved), "append", "w", at=at).collect()}

    go(rows[:7], at, log)
    got = go(rows[7:], at, log)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    saved = spark.createDataFrame([(r.run, r.epoch, r.ema_a, r.ema_b) for r in spark.read.parquet(at[0]).filter("epoch < 12").collect()], "run string, epoch int, ema_a double, ema_b double")
    rest = go(rows[12:], (str(tmp_path / "out2"), str(tmp_path / "state2")), str(tmp_path / "log2"), saved)
    assert rest.keys() == set(range(12, 20)) and all(abs(rest[k] - want[k]) < 1e-12 for k in rest)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "x").find("RocksDB") < 0


@pytest.mark.parametrize("how", ["append", "missing"])
def test_a_replayed_batch_replaces_its_rows(spark, tmp_path, monkeypatch, how):
    """The first run fails after a batch is written and before it is committed."""
    log, at = str(tmp_path / "log"), (str(tmp_path / "out"), str(tmp_path / "state"))
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "k int, v string").coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).parquet(log)
    done = spark.createDataFrame([], "k int, v string")
    go = (lambda: events.run_now(stream, "append", "x", at=at)) if how == "append" else (lambda: events.build_missing(stream, done, "k", lambda d: d, "x", at=at))
    writer = type(spark.range(1).write)
    plain, calls = writer.parquet, []

    def failing(self, path, *args, **kwargs):
        plain(self, path, *args, **kwargs)
        calls.append(path)
        if path.endswith("_batch=1"):
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(Exception, match="lost after the write"):
        go()
    monkeypatch.setattr(writer, "parquet", plain)
    got = sorted((r.k, r.v) for r in go().select("k", "v").collect())
    assert got == ([(1, "a"), (2, "b"), (2, "b"), (3, "c")] if how == "append" else [(1, "a"), (2, "b"), (3, "c")])
    assert any(p.endswith("_batch=1") for p in calls)
    assert sorted((r.k, r.v) for r in go().select("k", "v").collect()) == got
    assert spark.read.parquet(at[0]).select(F.max("_batch")).first()[0] == 1


def test_balancer_folds_blocks_and_goes_on(spark, tmp_path):
    """Two micro-batches, each dealt over many blocks, fold to the plain recursion; the stateful step gets a row a block, not a term's values."""
    rows = [("a" if i % 3 else "b", i % 7 * 10 + i // 7, i, float((i * 37) % 101)) for i in range(300)]
    schema, log, at = "event_type string, ts long, event_id long, value double", str(tmp_path / "log"), (str(tmp_path / "out"), str(tmp_path / "state"))
    want = {}
    for part in (rows[:180], rows[180:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        stream = events.balancer(spark.readStream.schema(schema).parquet(log), 0.9, 5)
        got = {r.term: (r.epochs, r.ema) for r in events.run_now(stream, "update", "b", ("term",), at).collect()}
        for term, _, _, x in sorted(part, key=lambda r: r[1:3]):
            n, ema = want.get(term, (0, None))
            want[term] = (n + 1, x if ema is None else 0.9 * ema + (1 - 0.9) * x)
    assert "MapInArrow" in stream._jdf.queryExecution().logical().toString()
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
