"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers.  A block of rows keeps one bitmap over
its rows for each bit of each dimension's (value - block minimum).  A query adds
the bitmaps of its weights' bits with full adders on whole bitmaps: what comes
out are the bitmaps of the scores' bits.  The top rows are selected from the
most significant of them downward; the rows left at the boundary have one and
the same score, and the smaller ids among them are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_QUANTISED = "vec_id long, dim int, vals binary"
_FOUND = "query_id long, vec_id long, score long"


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    held = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    held[:, : bits.shape[1]] = bits
    return np.packbits(held, axis=1).view(np.uint64)


def places(bitmap: np.ndarray) -> np.ndarray:
    """The places of a bitmap's ones."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8)))


class BitSlices:
    """Rows of one dimension count, sorted by id: bitmaps over rows, one for each bit of each dimension."""

    def __init__(self, ids: np.ndarray, vals: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        low = vals.min(axis=0)
        above = (vals[order].astype(np.uint64) - low.astype(np.uint64)).T
        width = [int(x).bit_length() for x in above.max(axis=1, initial=0)]
        self.dim = np.repeat(np.arange(len(width)), width)
        self.bit = np.array([b for n in width for b in range(n)], dtype=np.int64)
        self.rows = bitmaps(np.ones((1, len(ids)), dtype=np.uint8))[0]
        self.slices = np.empty((len(self.dim), len(self.rows)), dtype=np.uint64)
        for i, (d, b) in enumerate(zip(self.dim, self.bit, strict=True)):
            self.slices[i] = bitmaps(((above[d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)[None, :])[0]
        self.low, self.full = low.tolist(), [(1 << n) - 1 for n in width]

    def added(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """The score's bitmaps, lowest bit first, and what is to be added to the number they write.

        A negative weight takes its dimension's complement (full - value), so
        that only sums of numbers from 0 on are made.
        """
        weight = np.abs(query)[self.dim]
        inverted = np.where(query < 0, ~np.uint64(0), np.uint64(0))[self.dim]
        terms = [np.flatnonzero((weight >> j) & 1) for j in range(int(weight.max(initial=0)).bit_length())]
        term = np.concatenate([np.zeros(0, dtype=np.int64), *terms])
        plane = np.concatenate([np.zeros(0, dtype=np.int64), *(self.bit[t] + j for j, t in enumerate(terms))])
        sums, carried = [], np.empty((0, len(self.rows)), dtype=np.uint64)
        while len(sums) <= plane.max(initial=-1) or len(carried):
            here = term[plane == len(sums)]
            held = np.empty((len(here) + len(carried), len(self.rows)), dtype=np.uint64)
            np.take(self.slices, here, axis=0, out=held[: len(here)])
            held[: len(here)] ^= inverted[here, None]
            held[len(here) :], carries = carried, []
            while len(held) > 2:  # three bitmaps become one of their sums, in the last one's place, and one of carries
                third = len(held) // 3
                a, b, c = held[:third], held[third : 2 * third], held[2 * third : 3 * third]
                both = a & b
                a ^= b
                np.bitwise_and(a, c, out=b)
                both |= b
                c ^= a
                carries.append(both)
                held = held[2 * third :]
            if len(held) == 2:
                carries.append(held[:1] & held[1:])
                held = held[:1] ^ held[1:]
            sums.append(held[0] if len(held) else np.zeros_like(self.rows))
            carried = np.concatenate(carries) if carries else carried[:0]
        base = sum(q * (low if q >= 0 else low + full) for q, low, full in zip(query.tolist(), self.low, self.full, strict=True))
        return np.array(sums, dtype=np.uint64).reshape(len(sums), len(self.rows)), base

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best rows but its own, ties to the smaller id."""
        sums, base = self.added(query)
        equal, above = self.rows.copy(), np.zeros_like(self.rows)
        own = np.zeros((1, len(self.ids)), dtype=np.uint8)
        own[0, np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, "right")] = 1
        equal &= ~bitmaps(own)[0]
        taken = 0
        for slice_ in sums[::-1]:
            ones = equal & slice_
            n = int(np.bitwise_count(ones).sum())
            if taken + n > k:
                equal = ones
            else:
                above |= ones
                equal &= ~slice_
                taken += n
                if taken == k:
                    break
        rows = np.concatenate([places(above), places(equal)[: k - taken]])
        bits = (sums.view(np.uint8)[:, rows >> 3] >> (7 - rows & 7).astype(np.uint8)) & 1
        scores = np.full(len(rows), base % (1 << 64), dtype=np.uint64)
        for i, ones in enumerate(bits[:64]):
            scores += ones.astype(np.uint64) << np.uint64(i)
        return self.ids[rows], scores.view(np.int64)


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, dim, vals (int64 little-endian floor(scale * x)); rows with a null or non-finite component, or no id, go."""

    def run(batches):
        for batch in batches:
            ids, dims, vals = [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = np.floor(scale * np.asarray(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64))
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    dims.append(len(x))
                    vals.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vals, pa.binary())], names=["vec_id", "dim", "vals"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, _QUANTISED)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k best other rows.

    The score is the integer inner product of floor(scale * x).  Every row is
    indexed; recall is 1 by construction.  Queries meet each block of rows once.

    Vectors that are null, or hold null or non-finite components, and rows
    without an id take no part.  Rows with the query's id are its own row and
    no candidates; a query id given twice asks once (its smallest vector).
    Vectors of another length are no candidates.  An empty vector scores 0.
    Ties go to the smaller vec_id.  Scores are exact below 2**62.
    """
    spark = vectors.sparkSession
    rows = quantise(vectors, scale)
    blocks = max(1, -(-vectors.count() // block_rows))
    index = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "*")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "vals")).alias("v")).select("vec_id", "v.dim", "v.vals")
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "*")

    def search(batches):
        held: dict[int, list] = {}
        index_of: dict[int, BitSlices] | None = None
        for batch in batches:
            found = []
            for kind, vec_id, dim, vals in zip(*(batch.column(c).to_pylist() for c in ("kind", "vec_id", "dim", "vals")), strict=True):
                if kind == 0:
                    held.setdefault(dim, []).append((vec_id, vals))
                    continue
                if index_of is None:
                    index_of = {d: BitSlices(np.array([x for x, _ in rows], dtype=np.int64), np.frombuffer(b"".join(v for _, v in rows), dtype="<i8").reshape(len(rows), d)) for d, rows in held.items()}
                    held.clear()
                if dim in index_of:
                    ids, scores = index_of[dim].top(vec_id, np.frombuffer(vals, dtype="<i8"), k)
                    found.append((np.full(len(ids), vec_id), ids, scores))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    met = index.unionByName(queries).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind").mapInArrow(search, _FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
