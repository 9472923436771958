"""Candidate tables of crop positions, parsed from their integer payload by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """struct(kind, fallback(y, x), cands(array of y, x, cell)) of [kind, ...].

    Kind 0 has no position, kind 1 one (y, x), any other n, then n ys, n xs and n cells.
    """
    kind = F.element_at(payload, 1)
    n = F.when(kind > 1, F.element_at(payload, 2)).otherwise(0)
    part = lambda i: F.slice(payload, (3 + i * n).cast("int"), n.cast("int"))
    cands = F.transform(F.arrays_zip(part(0).alias("y"), part(1).alias("x"), part(2).alias("cell")), lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), c["cell"].alias("cell")))
    fallback = F.when(kind == 1, F.struct(F.try_element_at(payload, F.lit(2)).alias("y"), F.try_element_at(payload, F.lit(3)).alias("x")))
    return F.struct(kind.alias("kind"), fallback.alias("fallback"), F.when(kind > 1, cands).otherwise(F.expr("CAST(array() AS array<struct<y:int,x:int,cell:int>>)")).alias("cands"))
