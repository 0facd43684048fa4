"""Deterministic splits and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(*cols: Column | str, seed: int = 42) -> Column:
    """A uniform value in [0, 1) that depends on the columns and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def split(df: DataFrame, key: str, train: float = 0.5, val: float = 0.2, max_train: int | None = None, max_val: int | None = None, seed: int = 42) -> DataFrame:
    """df with split (train, val, test) by a hash of key; with caps, at most so many keys in train and val, the rest to test.

    Capped splits take the keys of smallest hash: a top-k, not a sort of all keys.
    """
    u = unit(key, seed=seed)
    out = df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))
    for name, cap in (("train", max_train), ("val", max_val)):
        if cap is not None:
            kept = out.filter(F.col("split") == name).select(key).distinct().orderBy(unit(key, seed=seed), key).limit(cap).withColumn("__kept", F.lit(True))
            out = out.join(F.broadcast(kept), key, "left").withColumn("split", F.when((F.col("split") == name) & F.col("__kept").isNull(), "test").otherwise(F.col("split"))).drop("__kept")
    return out


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").json(path)
