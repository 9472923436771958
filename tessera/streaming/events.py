"""Structured Streaming over event files: windows, incremental builds and a stateful loss balancer.

The reference workload has no streams; these are additions.  Every query runs
with trigger(availableNow) and keeps its state under a checkpoint location.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections import deque
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream with a TIMESTAMP event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def run_now(stream: DataFrame, mode: str, name: str, keys: tuple[str, ...] = (), at: tuple[str, str] | None = None) -> DataFrame:
    """All available input, then the result as a table: complete results replace, appended ones add up, updates replace by `keys`.

    A micro-batch is written to its own folder, replacing what is there: one
    that is replayed (a failure after its write, before its commit) adds no
    row twice.  at: (output folder, checkpoint folder) of a stream that goes on.
    """
    spark = stream.sparkSession
    out, state = at or (folder(spark, name), folder(spark, f"{name}-state"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(out)
    if mode != "update":
        return rows.drop("_batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_last")).select("_last.*")


def tumbling(stream: DataFrame, width: str, key: str, value: str) -> DataFrame:
    """Counts and sums by window; the watermark bounds what state is kept in append mode."""
    return stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, gap: str, key: str) -> DataFrame:
    return stream.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").cast("timestamp_ntz").alias("start"), key, "n")


def build_missing(stream: DataFrame, done: DataFrame, key: str, build, name: str, at: tuple[str, str] | None = None) -> DataFrame:
    """Each micro-batch builds only keys that no output of another batch has, into a folder of its own; see `run_now`."""
    spark = stream.sparkSession
    out, state = at or (folder(spark, name), folder(spark, f"{name}-state"))
    schema = build(spark.createDataFrame([], stream.schema)).schema
    held = StructType([*schema.fields, StructField("_batch", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key]).join(done, key, "left_anti")
        try:
            fresh = fresh.join(spark.read.schema(held).parquet(out).filter(F.col("_batch") < number).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no output
            if "PATH_NOT_FOUND" not in str(e):
                raise
        build(fresh).write.mode("overwrite").parquet(f"{out}/_batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(held).parquet(out).drop("_batch")


class Balancer(StatefulProcessor):
    """Weights of two loss terms, epoch by epoch: averages as a value, the last lag + 1 of them as a list."""

    def __init__(self, decay: float, lag: int, temperature: float, band: tuple[float, float]):
        self.decay, self.lag, self.temperature, self.band = decay, lag, temperature, band

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.averages = handle.getValueState("averages", "a double, b double")
        self.history = handle.getListState("history", "a double, b double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A saved table goes on: its rows (epoch, ema_a, ema_b) of the last lag + 1 epochs."""
        last = initialState.sort_values("epoch")[["ema_a", "ema_b"]].tail(self.lag + 1)
        if len(last):
            self.averages.update(tuple(map(float, last.iloc[-1])))
            self.history.put([tuple(map(float, r)) for r in last.itertuples(index=False)])

    def handleInputRows(self, key, rows, timerValues):
        epochs = pd.concat(list(rows)).sort_values("epoch")
        now = tuple(self.averages.get()) if self.averages.exists() else None
        held = deque((tuple(r) for r in self.history.get()), maxlen=self.lag + 1) if self.history.exists() else deque(maxlen=self.lag + 1)
        out = []
        for r in epochs.itertuples():
            now = (r.a, r.b) if now is None else tuple(self.decay * e + (1 - self.decay) * x for e, x in zip(now, (r.a, r.b), strict=True))
            held.append(now)
            weight = 0.5
            if len(held) > self.lag:
                ratios = [last / first for last, first in zip(held[-1], held[0], strict=True)]
                weight = min(max(1 / (1 + math.exp(-(ratios[0] - ratios[1]) / self.temperature)), self.band[0]), self.band[1])
            out.append((key[0], r.epoch, *now, weight, 1 - weight))
        self.averages.update(now)
        self.history.put(list(held))
        yield pd.DataFrame(out, columns=["run", "epoch", "ema_a", "ema_b", "weight_a", "weight_b"])

    def close(self) -> None:
        pass


WEIGHTS = "run string, epoch int, ema_a double, ema_b double, weight_a double, weight_b double"


def balanced(stream: DataFrame, decay: float, lag: int, temperature: float, band: tuple[float, float], saved: DataFrame | None = None) -> DataFrame:
    """run, epoch, ema_a, ema_b, weight_a, weight_b after each epoch of a stream of losses (run, epoch, a, b).

    The state is kept between micro-batches and over restarts from the
    checkpoint; saved: rows of an earlier result, from which a new stream goes
    on.  Epochs of a run arrive in order (those of one micro-batch are sorted).
    Needs the RocksDB state store (`with_rocksdb`).
    """
    initial = None if saved is None else saved.select("run", "epoch", "ema_a", "ema_b").groupBy("run")
    return stream.select("run", "epoch", "a", "b").groupBy("run").transformWithStateInPandas(statefulProcessor=Balancer(decay, lag, temperature, band), outputStructType=WEIGHTS, outputMode="append", timeMode="none", initialState=initial)


@contextmanager
def with_rocksdb(spark: SparkSession):
    """The state store that list states need, while a stream starts; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def balancer(stream: DataFrame, decay: float, blocks: int | None = None) -> DataFrame:
    """term, epochs, ema: a moving average of each term's values by epoch, held as state between batches.

    Values of one micro-batch are folded in the order of event time.  They are
    dealt by ranges of (term, ts, event_id); a block of a range folds its steps
    as if 0 came before and gives one row a term, and the rows of a term are
    folded in order into its state.  No task holds a term's values.
    """
    spark = stream.sparkSession
    blocks = blocks or max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def fold(batches):
        """(term, first ts, first event_id, values, the first one, steps after it folded from 0) of each term in a range."""
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("term", "ts", "event_id")])
        term, value = (rows.column(c).take(order).combine_chunks() for c in ("term", "value"))
        codes = term.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))[: len(codes)]
        x = value.to_numpy(zero_copy_only=False)
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
            local = 0.0
            for v in x[lo + 1 : hi].tolist():
                local = decay * local + (1 - decay) * v
            out.append((hi - lo, float(x[lo]), local))
        first = rows.take(order.take(pa.array(starts))).select(["term", "ts", "event_id"]).combine_chunks()
        new = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
        for batch in pa.Table.from_arrays([*first.columns, *new], names=["term", "ts", "event_id", "n", "first", "local"]).to_batches():
            yield batch

    def update(key, frames, state: GroupState):
        n, ema = state.get if state.exists else (0, None)
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():  # a row a block
            start = r.first if ema is None else decay * ema + (1 - decay) * r.first
            ema = r.local + decay ** (r.n - 1) * start
            n += r.n
        state.update((int(n), float(ema)))
        yield pd.DataFrame({"term": [key[0]], "epochs": [n], "ema": [ema]})

    values = stream.select(F.col("event_type").alias("term"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    kinds = ", ".join(f"{c} {t}" for c, t in values.dtypes if c != "value")
    folded = values.repartitionByRange(blocks, "term", "ts", "event_id").mapInArrow(fold, f"{kinds}, n long, first double, local double")
    return folded.groupBy("term").applyInPandasWithState(update, "term string, epochs long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
