"""Incremental ingestion: files as they arrive, upserts per batch, windowed and stateful aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """New files only: the checkpoint replaces lists of files seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def upsert_stream(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps in `target` (folders per batch) the newest row of each key; an interrupted batch is written again, not twice."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        newest.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/__batch_dir={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = spark.read.parquet(target).drop("__batch_dir")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "__batch"]), F.struct(order, "__batch")).alias("r")).select("r.*")


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Tumbling windows with a watermark; works on streams and on tables."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return rows.groupBy(F.window(time, window).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), *keys, "n", *(["total"] if value else []))


def run_states(stream: DataFrame, key: list[str], state: str, time: str) -> DataFrame:
    """The latest state of each run (local, submitted, downloaded), as an update-mode aggregate."""
    return stream.groupBy(*key).agg(F.max_by(state, time).alias(state), F.max(time).alias(time))
