"""Native range bucketing: binary search of a value in a bounded, sorted array of splitters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_bucket(value: Column, splits: list[int]) -> Column:
    """Number of splitters that are <= value (null values: 0). JVM only; log2(len(splits)) steps a row."""
    if not splits:
        return F.lit(0)
    steps, step = [], 1 << (len(splits).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    bounds = F.array(*[F.lit(int(s)).cast("long") for s in splits])

    def advance(pos: Column, s: Column) -> Column:
        return F.when(F.coalesce(F.get(bounds, pos + s - 1) <= value, F.lit(False)), pos + s).otherwise(pos)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)
