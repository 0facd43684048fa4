"""Cleaning of extracted and trusted tables before they are matched, and views of matched ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.mutants import widen
from assayline.functions.text import fix_kcat, fix_km, lengthened

_COMMENTS = {"variant_2": "comments_2", "descriptor_2": "comments_2"}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames the columns that are there, unless the new name is taken."""
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def is_integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.IntegralType)


def same_key_types(*tables: DataFrame, key: str = "pmid") -> list[DataFrame]:
    """The tables with keys that can meet: as text if they are integers in some tables and texts in others."""
    if len({is_integral(t, key) for t in tables}) == 1:
        return list(tables)
    return [t.withColumn(key, F.col(key).cast("string")) for t in tables]


def _with_unit(c: str, unit: str) -> Column:
    return F.concat(F.col(c).cast("string"), F.lit(f" {unit}"))


def database_units(df: DataFrame) -> DataFrame:
    """Numbers turnover_number and km_value as texts kcat and km with their units; comments as variant. Nulls stay."""
    df = df.withColumns({"km_value": _with_unit("km_value", "mM"), "turnover_number": _with_unit("turnover_number", "s^-1")})
    return df.withColumnsRenamed({"turnover_number": "kcat", "km_value": "km", "comments": "variant"})


def clean_columns(df: DataFrame) -> DataFrame:
    """A table ready for matching: a database dump gets units, an extraction normalised ones; integer pmids become text.

    doi serves as pmid where there is no pmid; a table with neither is an error.
    """
    if "turnover_number" in df.columns:
        df = database_units(df)
    else:
        df = renamed(df, {"doi": "pmid", "comments": "variant"})
        df = df.withColumns({"km": fix_km(F.col("km").cast("string")), "kcat": fix_kcat(F.col("kcat").cast("string"))})
    if "pmid" not in df.columns:
        raise ValueError("a table to match needs pmid or doi")
    return df.withColumn("pmid", F.col("pmid").cast("string")) if is_integral(df, "pmid") else df


def odd_units(df: DataFrame, col: str, known: list[str]) -> DataFrame:
    """(unit, n): the letters of a value column that are no known unit, and how often they stand; x is a times sign."""
    letters = F.regexp_replace(F.col(col), r"[^\p{L}]|[xX]", "")
    return df.select(letters.alias("unit")).filter((F.col("unit") != "") & ~F.col("unit").isin(known)).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def clean_values(df: DataFrame, database: bool = False) -> DataFrame:
    """kcat and km in one spelling, without thousands commas; doi in lower case; rows with neither value go."""

    def plain(c: Column) -> Column:
        return F.replace(F.replace(F.translate(c, "μ", "µ"), F.lit("S^-1"), F.lit("s^-1")), F.lit(","), F.lit(""))

    df = df.withColumns({"kcat": F.replace(plain(F.col("kcat")), F.lit("sec^-1"), F.lit("s^-1")), "km": plain(F.col("km")), "doi": F.lower("doi")})
    if database:
        df = df.withColumns({"kcat": _with_unit("kcat", "s^-1"), "km": _with_unit("km", "mM")})
    return df.dropna("all", subset=["kcat", "km"])


def complete_pairs(df: DataFrame, keys: DataFrame, key: str = "pmid") -> DataFrame:
    """Matched rows of the given keys that have both names and a value on each side."""
    df = df.join(keys.select(key).distinct(), key, "left_semi").dropna(subset=["enzyme", "substrate", "enzyme_2", "substrate_2"])
    return df.dropna("all", subset=["km", "kcat"]).dropna("all", subset=["km_2", "kcat_2"])


def split_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(theirs, ours) of a matched table: enzyme, substrate, comments or descriptor, km, kcat."""
    df = renamed(df, _COMMENTS)
    names = ["enzyme", "substrate", "comments", "km", "kcat"]
    return df.select(*[F.col(f"{c}_2").alias(c) for c in names]), df.select("enzyme", "substrate", "descriptor", "km", "kcat")


def fill_key(df: DataFrame, key: str = "pmid") -> DataFrame:
    """key from the other side where it is null or empty; the other side's key goes."""
    return df.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), F.col(f"{key}_2"))).drop(f"{key}_2")


def eval_format(df: DataFrame) -> DataFrame:
    """pmid and enzyme, substrate, variant of both sides as _a and _b; short enzyme names with their long form."""
    for side in ("", "_2"):
        if f"enzyme_full{side}" in df.columns:
            df = df.withColumn(f"enzyme{side}", lengthened(F.col(f"enzyme{side}"), F.col(f"enzyme_full{side}")))
    return df.select("pmid", *[F.col(f"{c}{side}").alias(f"{c}_{to}") for c in ("enzyme", "substrate", "variant") for side, to in (("", "a"), ("_2", "b"))])


def ground_truth(df: DataFrame) -> DataFrame:
    """A trusted table out of three layouts: a matched table's second side, hand annotations (kcat/km as kcat_km), or one
    that is canonical already. Mutant, pH and temperature come from the comments where they are missing."""
    df = renamed(df, {"doi": "pmid"}).withColumn("pmid", F.col("pmid").cast("string")) if "pmid" in df.columns or "doi" in df.columns else df
    if "enzyme_2" in df.columns:
        kept = ["enzyme", "pH", "temperature", "substrate", "comments", "km", "kcat", "kcat_km", "mutant"]
        df = df.select("pmid", *[F.col(f"{c}_2").alias(c) for c in kept])
    elif "seq_first_10" in df.columns:
        df = renamed(df, {"kcat/km": "kcat_km"})
    else:
        return df
    df = clean_columns(df)
    return widen(df, next(c for c in ("comments", "variant", "descriptor") if c in df.columns), reference=True)


def rows_without(df: DataFrame, col: str = "known_name") -> DataFrame:
    return df.filter(F.col(col).isNull())


def keys_with_gaps(df: DataFrame, columns: tuple[str, ...] = ("enzyme", "substrate", "organism"), key: str = "pmid") -> DataFrame:
    """Keys, as text, of rows in which one of the columns is null."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    return df.filter(gap).select(F.col(key).cast("string").alias(key)).distinct()
