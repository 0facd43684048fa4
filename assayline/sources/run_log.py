"""The versioned log of batch runs: read, write, upsert, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.sources.completions import sha_base64

KEYS = ["namespace", "version", "shard"]
STATES = ["aborted", "local", "submitted", "downloaded"]
SCHEMA = T.StructType(
    [T.StructField(n, T.LongType() if n == "shard" else T.BooleanType() if n == "structured" else T.StringType()) for n in (
        "namespace", "version", "shard", "status", "model_name", "llm_provider", "structured", "prompt_hash", "file_uuid", "batch_uuid", "batch_fpath", "corresp_fpath", "completion_fpath",
    )]
)
PATHS = ["batch_fpath", "corresp_fpath", "completion_fpath"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A missing log is empty; a prefix stored in a column _..._prefix is put before the paths again."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    if path.endswith(".tsv"):
        raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"a log is .tsv or .parquet, not {path}")
    stored = next((c for c in raw.columns if c.startswith("_") and c.endswith("_prefix")), None)
    raw = spark.createDataFrame([], SCHEMA).unionByName(raw.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in SCHEMA if f.name in raw.columns}), allowMissingColumns=True)
    if stored:
        raw = raw.withColumns({c: F.concat(F.coalesce(stored, F.lit("")), F.col(c)) for c in PATHS})
    return raw.select(*SCHEMA.names)


def prompt_hash(prompt: str):
    return sha_base64(F.lit(prompt))


def upsert(log: DataFrame, changes: DataFrame, insert: bool = True) -> DataFrame:
    """Non-null values of changes win on (namespace, version, shard), null shards meeting; with insert, new keys are appended."""
    value = [c for c in log.columns if c not in KEYS and c in changes.columns]
    new = changes.select(*[F.col(k).alias(f"__{k}") for k in KEYS], *[F.col(c).alias(f"__{c}") for c in value], F.lit(True).alias("__hit"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]
    updated = log.join(new, on, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in value else F.col(c) for c in log.columns])
    if not insert:
        return updated
    old = log.select(*[F.col(k).alias(f"__{k}") for k in KEYS])
    return updated.unionByName(changes.join(old, on, "left_anti"), allowMissingColumns=True).select(*log.columns)


def common_prefix(low: str | None, high: str | None) -> str:
    """What the smallest and the largest of some texts, hence all of them, begin with."""
    low, high = low or "", high or ""
    k = 0
    while k < min(len(low), len(high)) and low[k] == high[k]:
        k += 1
    return low[:k]


def relocate(log: DataFrame, root: str) -> DataFrame:
    """Paths under their common prefix, moved to another root."""
    paths = log.select(F.explode(F.array(*PATHS)).alias("p")).filter("p is not null")
    r = paths.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    prefix = common_prefix(r["lo"], r["hi"]).rpartition("/")[0]
    n = len(prefix)
    return log.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.lit(root.rstrip("/")), F.substring(F.col(c), n + 1, 1 << 30))) for c in PATHS})


def convert(log: DataFrame) -> DataFrame:
    """A log of an earlier layout in the present one: there is only one layout so far."""
    return log


def _number(c: str = "version"):
    return F.when(F.col(c).startswith("v"), F.substring(F.col(c), 2, 20).try_cast("bigint"))


def next_serial_version(log: DataFrame) -> str:
    """v and one more than the highest v-number of all namespaces."""
    return f"v{(log.agg(F.max(_number())).first()[0] or 0) + 1}"


def previous_version(log: DataFrame, namespace: str) -> str | None:
    n = log.filter(F.col("namespace") == namespace).agg(F.max(_number())).first()[0]
    return None if n is None else f"v{n}"


def next_plain_version(log: DataFrame) -> int:
    return (log.agg(F.max(F.col("version").try_cast("bigint"))).first()[0] or 0) + 1


def pending(log: DataFrame) -> DataFrame:
    return log.filter("status = 'submitted'")


def downloaded(log: DataFrame, results: DataFrame) -> DataFrame:
    """Marks runs with results (namespace, version, shard, completion_fpath) as downloaded."""
    return upsert(log, results.withColumn("status", F.lit("downloaded")), insert=False)
