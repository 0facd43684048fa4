"""Folders, manifests, markdown, FASTA, snapshots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "modificationTime", "length")


def manifest(spark: SparkSession, root: str, extension: str = ".pdf") -> DataFrame:
    """(fileroot, filename, pmid): pmid is the file name without its extension."""
    path = listing(spark, root, f"*{extension}").select("path")
    name = F.substring_index("path", "/", -1)
    return path.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("fileroot"), name.alias("filename"), F.expr(f"substr(substring_index(path, '/', -1), 1, length(substring_index(path, '/', -1)) - {len(extension)})").alias("pmid"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: parquet, csv or tsv (all columns text); others are an error."""
    kind = path.rstrip("/").rpartition(".")[2]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    raise ValueError(f"can't read {path}")


def write_any(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    kind = path.rpartition(".")[2]
    if kind == "tsv":
        df.write.mode(mode).option("header", True).option("sep", "\t").csv(path)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path if kind == "parquet" else path + ".parquet")


def diagonal(frames: list[DataFrame]) -> DataFrame:
    """Union of rows and of columns; where types differ the column becomes text."""
    types: dict[str, set] = {}
    for f in frames:
        for c, t in f.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, t in types.items() if len(t) > 1}
    frames = [f.withColumns({c: F.col(c).cast("string") for c in f.columns if c in mixed}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _layout(spark: SparkSession, path: str) -> tuple[str, str]:
    """(extension, schema or header line) of a file: files of one layout can be read together."""
    kind = path.rpartition(".")[2]
    if kind == "parquet":
        return kind, spark.read.parquet(path).schema.json()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at), "UTF-8"))
    try:
        return kind, reader.readLine() or ""
    finally:
        reader.close()


def read_folder(spark: SparkSession, root: str, skip: Callable[[str], bool] = lambda name: False) -> DataFrame | None:
    """All csv, tsv and parquet files of a folder but those that `skip` names, as one diagonal union with src_file; none gives
    None. Files of one layout are one scan: the plan grows with the layouts, not with the files."""
    groups: dict[tuple[str, str], list[str]] = {}
    for r in listing(spark, root).select("path").toLocalIterator():
        path = r["path"]
        if path.rpartition(".")[2] in ("csv", "tsv", "parquet") and not skip(path.rpartition("/")[2]):
            groups.setdefault(_layout(spark, path), []).append(path)
    frames = []
    for (kind, _), paths in sorted(groups.items()):
        if kind == "parquet":
            df = spark.read.parquet(*paths)
        else:
            df = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(paths)
        frames.append(df.select("*", F.col("_metadata.file_name").alias("src_file")))
    return diagonal(frames) if frames else None


def found_or_missing(df: DataFrame, key: str, value: str, missing: str = "not found") -> DataFrame:
    """Rows that found a value; of names never found anywhere, the rows that say so."""
    hit = df.filter(F.col(value) != missing)
    return hit.unionByName(df.filter(F.col(value) == missing).join(hit.select(key).distinct(), key, "left_anti").select(*df.columns))


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("modificationTime"))


def needs_rebuild(snapshot: DataFrame, fragments: DataFrame) -> bool:
    """No snapshot, or a fragment of any kind is newer than it."""
    at = newest(snapshot).first()["modificationTime"]
    return at is None or fragments.filter(F.col("modificationTime") > F.lit(at)).limit(1).count() > 0


def snapshot_or_rebuild(spark: SparkSession, snapshots: str, fragments: str, rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The newest parquet snapshot unless a fragment is newer: then it is rebuilt, written and read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(snapshots)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if not there or needs_rebuild(listing(spark, snapshots, "*.parquet"), listing(spark, fragments)):
        rebuild(read_folder(spark, fragments)).write.mode("overwrite").parquet(snapshots)
    return spark.read.parquet(snapshots)


def markdown_by_pmid(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, text) of files with '## PMID: ' headers; what stands before the first is left out."""
    whole = spark.read.text(path, wholetext=True)
    block = whole.select(F.explode(F.slice(F.split("value", r"(?m)^## PMID: "), 2, 1 << 30)).alias("b"))
    return block.select(F.trim(F.regexp_extract("b", r"^([^\n]*)", 1)).alias("pmid"), F.concat(F.regexp_replace(F.regexp_extract("b", r"(?s)^[^\n]*\n?(.*)$", 1), r"^\s+|\s+$", ""), F.lit("\n")).alias("text"))


def tables_by_pmid(names: DataFrame, col: str = "filename") -> DataFrame:
    """(pmid, files): markdown names grouped by what precedes the last underscore, sorted."""
    pmid = F.regexp_extract(col, r"^(.*)_[^_]*$", 1)
    return names.filter(F.col(col).endswith(".md")).groupBy(pmid.alias("pmid")).agg(F.array_sort(F.collect_list(col)).alias("files"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence), records cut at '>'."""
    from assayline.functions.text import recover_ncbi

    record = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)
    header = F.trim(F.regexp_extract("value", r"^([^\n]*)", 1))
    return record.select(recover_ncbi(header).alias("ncbi"), header.alias("header"), F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "").alias("sequence"))


def next_version(names: DataFrame, stem: str, col: str = "filename", extension: str = ".jsonl") -> int:
    """One more than the highest number that follows the stem; 1 if there is none."""
    n = F.regexp_extract(col, rf"^\Q{stem}\E_(\d+)\Q{extension}\E$", 1).try_cast("int")
    return (names.agg(F.max(n)).first()[0] or 0) + 1


def fasta_records(texts: DataFrame, col: str = "text") -> DataFrame:
    """(ncbi, descriptor, sequence) of FASTA texts of several records each."""
    from assayline.functions.text import recover_ncbi

    record = texts.select(F.explode(F.slice(F.split(col, ">"), 2, 1 << 30)).alias("r"))
    head = F.split_part("r", F.lit("\n"), F.lit(1))
    return record.select(recover_ncbi(head).alias("ncbi"), head.alias("descriptor"), F.replace(F.substr("r", F.char_length(head) + 2), F.lit("\n"), F.lit("")).alias("sequence"))


def code_table(df: DataFrame, top: int | None = None) -> DataFrame:
    """An alias table: viable_ecs as enzyme_ecs, with `top` also the first so many of them."""
    out = df.withColumnRenamed("viable_ecs", "enzyme_ecs")
    return out if top is None else out.withColumn(f"enzyme_ecs_top{top}", F.slice("enzyme_ecs", 1, top))


def register(spark: SparkSession, datasets: dict[str, str]) -> dict[str, DataFrame]:
    """Named datasets (name to path) as temporary views; returns them."""
    out = {name: read_any(spark, path) for name, path in datasets.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def files_with_key(lines: DataFrame, files: DataFrame, key: str, namespace: str | None = None, version: str | None = None) -> DataFrame:
    """(path, namespace, version, modificationTime) of line files that hold namespace_version_key, newest first; none is an error."""
    cid = F.get_json_object("value", "$.custom_id")
    part = lambda k: F.get(F.split(cid, "_", 3), F.lit(k))
    found = lines.select("path", part(0).alias("namespace"), part(1).alias("version"), part(2).alias("__key")).filter(F.col("__key") == key)
    for c, v in (("namespace", namespace), ("version", version)):
        found = found if v is None else found.filter(F.col(c) == v)
    found = found.drop("__key").distinct().join(files.select("path", "modificationTime"), "path")
    if found.isEmpty():
        raise FileNotFoundError(f"no file holds {key}")
    return found.orderBy(F.desc("modificationTime"), "path")


def read_keys(spark: SparkSession, path: str, name: str = "pmid") -> DataFrame:
    """Distinct lines of text files."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "").distinct()


def write_keys(df: DataFrame, root: str, namespace: str, version: int, name: str = "pmid") -> str:
    """A versioned list of keys; an existing version is an error."""
    path = f"{root}/{namespace}_{version}.txt"
    df.select(F.col(name).cast("string")).distinct().write.mode("errorifexists").text(path)
    return path


def key_versions(spark: SparkSession, root: str, namespace: str) -> list[int]:
    """Versions that write_keys() has written, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n[len(namespace) + 1 : -4]) for n in names if n.startswith(f"{namespace}_") and n.endswith(".txt") and n[len(namespace) + 1 : -4].isdigit())


def read_key_cache(spark: SparkSession, root: str, namespace: str, version: int | None = None, name: str = "pmid") -> DataFrame:
    """The list of a version, or of the latest; none is an error."""
    versions = key_versions(spark, root, namespace)
    if not versions:
        raise FileNotFoundError(f"no list of {namespace}")
    return read_keys(spark, f"{root}/{namespace}_{versions[-1] if version is None else version}.txt", name)


def remnants(listed: DataFrame, namespace: str, version: str | None = None) -> DataFrame:
    """Files whose names begin with the namespace (and version): what an earlier run left."""
    stem = f"{namespace}_" + (f"{version}" if version is not None else "")
    return listed.filter(F.substring_index("path", "/", -1).startswith(stem))


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet that an existing table keeps from being written, unless overwrite is set."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def accessions_by_file(texts: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """(filename, pdb, uniprot, refseq, genbank) of whole files' texts."""
    from assayline.functions.text import identifiers

    return texts.select(name, identifiers(F.col(text)).alias("i")).select(name, "i.*")


def mutants_by_file(texts: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """(filename, mutants): distinct codes joined by '; '."""
    from assayline.functions.mutants import codes

    return texts.select(name, F.array_join(F.array_distinct(codes(F.col(text))), "; ").alias("mutants"))


def drop_seen(files: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    return files.join(seen.select(key).distinct(), key, "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows stand for all old rows of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
