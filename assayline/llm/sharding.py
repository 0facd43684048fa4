"""Sharding by sampled splitters (JVM only).

Rows are ordered by (hash of the text, doc_id, text CRC). A size-weighted sample of the hashes gives quantile
boundaries; rows are range-partitioned into fine ranges, ranges that hold too many rows are subdivided in the order of
the hashes, a text that many documents share (one hash) by doc_id, and exact sums per range turn positions into shards.
Equal texts are always neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.ranges import range_bucket
from assayline.runtime import materialise

#: Quantile grids are collected to the driver; this bounds them whatever the input's size.
MAX_RANGES = 4096


def _unit(*cols: Column) -> Column:
    """A deterministic uniform value in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_range: int = 8192,
    sample_rows: int = 200_000,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): contiguous key ranges of near-equal bytes, slots gapless from 0 in each shard.

    size is the UTF-8 length plus 1; a null text counts as no bytes (CRC 0), a null id sorts first. Rows
    equal in text and id are interchangeable. A shard's bytes differ from total/n_shards by less than the largest row at each end.
    An empty table gives an empty result. Only narrow columns are shuffled, never the text.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text) + 1).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        F.xxhash64(text).alias("__key"),
    )
    rows = materialise(rows, "shard-keys")  # the text is read once; all that follows is narrow
    id_hash = F.coalesce(F.xxhash64("__id"), F.lit(0))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    out_cols = [
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
    ]
    if not n:
        return rows.select("*", F.lit(0).alias("__shard"), F.lit(0).cast("long").alias("__slot")).select(*out_cols)

    n_ranges = max(n_shards, min(MAX_RANGES, -(-n // rows_per_range)))
    grid = [F.lit(i / n_ranges) for i in range(1, n_ranges)]
    keep = _unit(F.lit("sample"), F.col("__key"), id_hash) < F.col("__size") * F.lit(sample_rows / total)
    quantiles = rows.filter(keep).agg(F.percentile_approx("__key", F.array(*grid), 20 * n_ranges)).first()[0] if grid else []
    splits = sorted(set(quantiles or []))
    rows = rows.withColumn("__range", range_bucket(F.col("__key"), splits))

    # A range over twice its share of rows is cut in the order of the keys: at equal steps between its lowest and highest
    # key, and a key that alone exceeds the share (a text that many documents have) at equal steps of the id's hash.
    share = -(-n // n_ranges)
    heavy = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__lo"), F.max("__key").alias("__hi")).filter(F.col("__n") > 2 * share)
    per_key = rows.join(F.broadcast(heavy.select("__range")), "__range", "left_semi").groupBy("__range", "__key").agg(F.count(F.lit(1)).alias("__k"))
    hot = per_key.filter(F.col("__k") > share).groupBy("__range").agg(F.array_sort(F.collect_list(F.struct(F.col("__key").alias("key"), (F.col("__k") / share).cast("int").alias("parts")))).alias("__hot"))
    # At most n_ranges ranges, and fewer than n / share hot keys in all of them: the broadcast has a fixed size.
    cuts = heavy.join(hot, "__range", "left").select("__range", "__lo", "__hi", F.ceil(F.col("__n") / F.lit(share)).cast("int").alias("__parts"), "__hot")
    rows = rows.join(F.broadcast(cuts), "__range", "left")
    none = F.coalesce("__hot", F.array().cast("array<struct<key:bigint,parts:int>>"))
    mine = F.get(F.filter(none, lambda x: x["key"] == F.col("__key")), F.lit(0))["parts"]
    below = F.size(F.filter(none, lambda x: x["key"] < F.col("__key")))
    # Differences of keys as doubles: monotone, and the last step includes the highest key.
    step = F.floor((F.col("__key").cast("double") - F.col("__lo").cast("double")) / (F.col("__hi").cast("double") - F.col("__lo").cast("double") + 1.0) * F.col("__parts"))
    spread = F.floor(_unit(F.lit("sub"), id_hash) * (mine + 1))
    cell = F.when(mine.isNotNull(), (2 * below + 1) * F.lit(1 << 32) + spread).otherwise(2 * below * F.lit(1 << 32) + F.greatest(step, F.lit(0)))
    rows = rows.withColumn("__sub", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(cell).cast("long")).drop("__lo", "__hi", "__parts", "__hot")
    # Order inside a subdivided range follows (sub, key, id): still one total order for all rows, and one that keeps equal texts together.
    per = Window.partitionBy("__range", "__sub").orderBy(
        F.col("__key"), F.col("__id").asc_nulls_first(), F.col("__crc").asc_nulls_first(), "__size"
    )
    run = per.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(
        "*", F.row_number().over(per).alias("__row"), F.sum("__size").over(run).alias("__sum")
    )
    # One row per (range, sub): at most MAX_RANGES + n/share rows, reduced in two steps (by range, then over ranges).
    cells = rows.groupBy("__range", "__sub").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__b"))
    by_range = cells.groupBy("__range").agg(F.sum("__n").alias("__rn"), F.sum("__b").alias("__rb"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select(
        "__range", F.coalesce(F.sum("__rn").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__rb").over(before), F.lit(0)).alias("__b0")
    )
    inside = Window.partitionBy("__range").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "__range", "__sub", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__n1"), F.coalesce(F.sum("__b").over(inside), F.lit(0)).alias("__b1")
    )
    offsets = cells.join(F.broadcast(by_range), "__range").select(
        "__range", "__sub", (F.col("__n0") + F.col("__n1")).alias("__n0"), (F.col("__b0") + F.col("__b1")).alias("__b0")
    )
    placed = placed.join(F.broadcast(offsets), ["__range", "__sub"])
    # The shard of a row is where the middle of its bytes falls.
    mid = F.col("__b0") + F.col("__sum") - F.col("__size") / 2
    placed = placed.select(
        "*",
        F.least(F.floor(mid * F.lit(n_shards) / F.lit(float(total))), F.lit(n_shards - 1)).cast("int").alias("__shard"),
        (F.col("__n0") + F.col("__row") - 1).cast("long").alias("__rank"),
    )
    first = placed.groupBy("__shard").agg(F.min("__rank").alias("__first"))
    return placed.join(F.broadcast(first), "__shard").withColumn("__slot", F.col("__rank") - F.col("__first")).select(*out_cols)
