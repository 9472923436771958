"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

A document's fixed hash decides its place in its source.  Sizes are summed by
source and hash digit; the digit in which a source's budget ends is refined by
the next digit, and so on, until a threshold on the whole hash is known.  Then
a filter, without any sort of documents, picks what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 4


def doc_hash(doc_id):
    """48 bits of the id's MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes: source, source_size.  Adds target: `share` of all sizes dealt by weight, at most `cap` sizes each.

    Weights go round over the sources by code point, null last.  The level at
    which targets stop is found by filling the sources in order of cap/weight.
    This table has one row a source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    most = F.col("source_size") * F.lit(cap)
    fill = W.orderBy("ratio", "place")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = weighted.withColumn("most", most).withColumn("ratio", F.col("most") / F.col("weight")).withColumn("level", level)
    stop = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    return filled.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * stop, F.col("most").cast("double")))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source).

    taken is the size times the number of copies in the mix: every document of
    a source floor(target / source_size) times, and those under the source's
    hash threshold once more, so a source misses its target by less than the
    one document (or the rows of one doc_id) at the threshold.

    Null or empty text: size 0.  Null source: a source of its own, last.  Null
    doc_id: hashed as the empty string.  Repeated rows stand or fall together.
    A source whose sizes are all 0 has target 0.  An empty table gives no rows.
    """
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size")).withColumn("h", doc_hash(F.col("doc_id"))), "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("copies", copies).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    bounds = written(sources.select(F.col("source").alias("of"), "source_size", "target", "copies", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "targets")
    for level in range(1, LEVELS + 1):
        rest = BITS * (LEVELS - level)
        at = F.shiftright("h", rest)
        inside = sized.join(bounds.select("of", "prefix"), F.col("source").eqNullSafe(F.col("of"))).filter(F.shiftright(at, BITS) == F.col("prefix"))
        hist = inside.groupBy("of", at.alias("digit")).agg(F.sum("size").alias("tokens"))
        running = hist.withColumn("upto", F.sum("tokens").over(W.partitionBy("of").orderBy("digit"))).withColumnRenamed("of", "hist_of")
        joined = bounds.join(running, F.col("of").eqNullSafe(F.col("hist_of")), "left")
        over = F.col("below") + F.col("upto") > F.col("budget")
        crossing = F.min_by(F.struct((F.col("below") + F.col("upto") - F.col("tokens")).alias("below"), F.col("tokens")), F.when(over, F.col("digit")))
        found = joined.groupBy("of", "source_size", "target", "copies", "budget").agg(F.min(F.when(over, F.col("digit"))).alias("digit"), crossing.alias("c"), F.max("prefix").alias("old"), F.max("below").alias("old_below"))
        # No digit crosses (all sizes 0, or the budget is 0 and nothing is left): the threshold stays beyond every hash.
        beyond = F.shiftleft(F.col("old") + 1, BITS)
        bounds = found.select("of", "source_size", "target", "copies", "budget", F.coalesce("digit", beyond).alias("prefix"), F.coalesce("c.below", "old_below").alias("below"), F.col("c.tokens").alias("edge"))
        bounds = written(bounds, f"bounds{level}")
    nearer = F.coalesce(F.abs(F.col("below") + F.col("edge") - F.col("budget")) < F.abs(F.col("below") - F.col("budget")), F.lit(False))
    bounds = bounds.withColumn("threshold", F.col("prefix") + nearer.cast("long")).select("of", "source_size", "target", "copies", "threshold")
    taken = F.col("size") * (F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    return sized.join(bounds, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM ranked),
filled AS (
  SELECT *, CAST(most AS DOUBLE) / weight AS ratio,
         (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighted),
stopped AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS stop FROM filled),
targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(weight * stop, CAST(most AS DOUBLE))) AS target FROM stopped),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
groups AS (SELECT source, h, sum(size) AS tokens FROM sized GROUP BY source, h),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h) - tokens AS before FROM groups),
chosen AS (
  SELECT r.source, r.h, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS budget, CAST(r.before AS DOUBLE) AS before, CAST(r.tokens AS DOUBLE) AS tokens
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source),
picked AS (
  SELECT *, CASE WHEN before + tokens <= budget THEN 1
                 WHEN before <= budget AND abs(before + tokens - budget) < abs(before - budget) THEN 1 ELSE 0 END AS more
  FROM chosen)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.copies + p.more) AS BIGINT) AS taken
FROM sized s JOIN picked p ON s.source IS NOT DISTINCT FROM p.source AND s.h = p.h
"""
