"""Streaming additions as registered queries; all events are read, so results are those of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources.relations import EPOCHS
from tessera.streaming import events

from .ordered import BAND, DECAY, LAG, TEMPERATURE
from .registry import ORACLE_SQL, Source, query, rounded


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = events.run_now(events.tumbling(events.event_stream(spark, sf_dir), "1 day", "event_type", "value"), "complete", "tumbling")
    return rounded(out, "total", digits=4)


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s.s""")
def stream_session(spark, sf_dir):
    return events.run_now(events.sessions(events.event_stream(spark, sf_dir), "6 hours", "user_id"), "complete", "sessions")


@query("SELECT user_id, 'built' AS state FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def stream_incremental(spark, sf_dir):
    done = Source(spark, sf_dir).table("events").filter("user_id % 3 = 0").select("user_id").distinct()
    return events.build_missing(events.event_stream(spark, sf_dir), done, "user_id", lambda df: df.select("user_id", F.lit("built").alias("state")), "incremental")


@query("""
WITH RECURSIVE e AS (SELECT event_type AS term, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT term, i, CAST(value AS DOUBLE) AS ema FROM e WHERE i = 1
      UNION ALL SELECT e.term, e.i, CAST(0.9 AS DOUBLE) * m.ema + CAST(0.1 AS DOUBLE) * e.value FROM m JOIN e ON e.term = m.term AND e.i = m.i + 1)
SELECT term, i AS epochs, round(ema, 6) AS ema FROM m QUALIFY row_number() OVER (PARTITION BY term ORDER BY i DESC) = 1""")
def stream_balancer(spark, sf_dir):
    return rounded(events.run_now(events.balancer(events.event_stream(spark, sf_dir), 0.9), "update", "balancer", ("term",)), "ema")


@query(ORACLE_SQL["ema_balance"])
def stream_weights(spark, sf_dir):
    """ema_balance by a stream over the log of epochs, which is written in three parts; its state lasts from batch to batch."""
    losses = Source(spark, sf_dir).sql(EPOCHS)
    wide = losses.groupBy("epoch").agg(*(F.max(F.when(F.col("term") == t, F.col("loss"))).alias(n) for t, n in (("click", "a"), ("view", "b")))).withColumn("run", F.lit("run"))
    log, bounds = events.folder(spark, "log"), losses.agg(F.min("epoch"), F.max("epoch")).first()
    schema = wide.schema
    for k in range(3):
        cut = [bounds[0] + (bounds[1] + 1 - bounds[0]) * x // 3 for x in (k, k + 1)]
        wide.filter((F.col("epoch") >= cut[0]) & (F.col("epoch") < cut[1])).coalesce(1).write.mode("append").parquet(log)
    with events.with_rocksdb(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
        out = events.run_now(events.balanced(stream, DECAY, LAG, TEMPERATURE, BAND), "append", "weights")
    return rounded(out.select("epoch", "weight_a", "weight_b"), "weight_a", "weight_b")
