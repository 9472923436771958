"""The training items: a dense index of the united folds, and each epoch's order as a permutation computed row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import stored

ROUNDS, PRIME, FACTOR, STEP, EPOCH_STEP = 4, 2_147_483_647, 48_271, 104_729, 7_919
SPARE = 7  # low bits of a draw that aren't used; 24 are left, so there may be 2**48 items


def dense_index(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """rows with `name`, 0..n-1 in the given order (to be unique, else equal rows are numbered as they come).

    Rows are dealt by ranges and sorted; a row's number is its place in its
    partition and the rows of the partitions before, of which there are few.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = stored(dealt.withColumn("_id", F.monotonically_increasing_id()), "indexed")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, pairs = sorted((r.p, r.n) for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()), 0, []  # one row a partition
    for p, n in sizes:
        pairs.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(pairs, "_p long, _before long")
    return held.join(F.broadcast(offsets), part == F.col("_p")).select(*rows.columns, (place + F.col("_before")).alias(name))


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-width integer that holds 0..n-1."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permuted(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """A permutation of 0..n-1 for each key: Feistel rounds on two halves; what leaves 0..n-1 goes round again until it is back."""
    bits = half_bits(n)
    mask, out = (1 << bits) - 1, values.astype(np.int64).copy()
    open_ = np.arange(len(out))
    while len(open_):
        left, right, key = out[open_] >> bits, out[open_] & mask, keys[open_]
        for k in range(ROUNDS):
            x = (right * 31 + key + k * STEP) % PRIME
            mixed = (x * x % PRIME + x * FACTOR) % PRIME
            left, right = right, left ^ (mixed >> SPARE & mask)
        out[open_] = left << bits | right
        open_ = open_[out[open_] >= n]
    return out


def epoch_orders(items: DataFrame, index: str, epochs: int, run_seed: int) -> DataFrame:
    """items with epoch (0..epochs-1) and place: where the item stands in the epoch's order; each epoch permutes all items.

    Nothing is sorted or shuffled for an order: a row computes its own place.
    items: a dense index 0..n-1.
    """
    n = items.count()
    rows = items.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))

    def run(batches):
        for batch in batches:
            at, epoch = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (index, "epoch"))
            place = permuted(at, (run_seed * STEP + epoch * EPOCH_STEP) % PRIME, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "place long"]))


def draw_key(run_seed: int, index: str, stem: str) -> Column:
    """What a training draw is keyed by: run, epoch, index and stem."""
    return F.concat_ws("|", F.lit(str(run_seed)), F.col("epoch").cast("string"), F.col(index).cast("string"), F.col(stem).cast("string"))
