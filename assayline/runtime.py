"""Session helpers shared by every subpackage: code shipping, shared scratch space, table reads."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to Python: a batch of long texts must not depend on its number of rows.
ARROW_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it installed (once per application), and bound Arrow batches by bytes."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="assayline-"), "assayline_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name, p.relative_to(root)))
    sc.addPyFile(to)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    where = tempfile.mkdtemp(prefix="assayline-scratch-")
    spark.sparkContext.setCheckpointDir(where)
    return where


#: Spark removes a query's shuffle files when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    at = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")  # this job's shuffle files serve nothing else
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(at)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() made, once nothing will read them again."""
    for df in tables:
        root = scratch_root(df.sparkSession).rstrip("/").removeprefix("file:").lstrip("/")
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
