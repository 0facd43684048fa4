"""Canonical exact digests of documents (JVM only).

A text's canonical form is NFC, full case folding and single spaces; its digest is two seeded xxHash64 values. Texts
whose digests meet are compared byte by byte; should two canonical forms ever share a digest, each gets its SHA-256 appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.ranges import range_bucket

#: Bound of the splitters that are collected to the driver, and of the boundary rows that are broadcast.
MAX_RANGES = 4096


def canonical(text: Column) -> Column:
    """NFC, case folding and white-space folding with ICU's own static methods; ASCII texts need only lower()."""
    ascii_only = F.octet_length(text) == F.char_length(text)

    def icu(x: Column) -> Column:
        composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))
        folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(False))

    folded = F.when(ascii_only, F.lower(text)).otherwise(icu(text))
    return F.btrim(F.regexp_replace(folded, "[\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+", " "))


def digest(canon: Column) -> Column:
    """128 bits in lowercase hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2)]))


def colliding_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest) of those that hold two canonical forms: the smallest and largest bytes of each bucket of two or more differ.

    min and max compare every member of a bucket and combine before the shuffle, whatever a bucket's size.
    """
    canon = canonical(F.coalesce(F.col(text_col), F.lit("")))
    return (
        docs.select(canon.alias("__canon"))
        .select(digest(F.col("__canon")).alias("digest"), "__canon")
        .groupBy("digest")
        .agg(F.min("__canon").alias("__low"), F.max("__canon").alias("__high"))
        .filter(F.col("__low") != F.col("__high"))
        .select("digest")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row. Null and empty texts share the fingerprint of the empty text; repeated rows repeat."""
    canon = canonical(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col), canon.alias("__canon")).select(id_col, "__canon", digest(F.col("__canon")).alias("digest"))
    return _resolved(rows, colliding_digests(docs, text_col), [("digest", "__canon", "fingerprint")]).select(id_col, "fingerprint")


def _resolved(rows: DataFrame, colliding: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """Adds SHA-256 to digests that hold two canonical forms.

    Such digests are one in 2**64 pairs; a count of them (not assumed to be none) decides whether the join is needed.
    """
    if colliding.isEmpty():
        return rows.withColumns({to: F.col(d) for d, _, to in columns})
    for d, canon, to in columns:
        hit = colliding.select(F.col("digest").alias(f"__{to}"))
        rows = rows.join(hit, F.col(d) == F.col(f"__{to}"), "left").withColumn(
            to, F.when(F.col(f"__{to}").isNotNull(), F.concat(d, F.lit("-"), F.sha2(F.col(canon), 256))).otherwise(F.col(d))
        )
    return rows


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 8 << 20) -> DataFrame:
    """(id, text, next_text): the text of the next row in ascending (id, text) order, the first row's after the last.

    Ids are range-partitioned at quantiles; each range gets a copy of the next range's first rows, so one shuffle of the
    texts serves and no window spans the table. Null ids sort first, repeated ids by text, null texts as empty.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    points = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    total, quantiles, low = rows.agg(
        F.sum(F.octet_length("__text")), F.percentile_approx("__id", F.array(*map(F.lit, points)), 20 * MAX_RANGES), F.min("__id")
    ).first()
    n_ranges = max(1, min(MAX_RANGES, -(-int(total or 0) // range_bytes)))
    step = max(1, MAX_RANGES // n_ranges)
    # The lowest id is no splitter: range 0 would hold only null ids.
    splits = [s for s in sorted(set((quantiles or [])[step - 1 :: step])) if s != low]
    rows = rows.withColumn("__range", range_bucket(F.col("__id"), splits))
    heads = rows.groupBy("__range").agg(F.min("__id").alias("__head"), F.count_if(F.col("__id").isNull()).alias("__nulls")).collect()
    heads.sort(key=lambda r: r["__range"])
    # The rows that begin each range stand again, flagged, at the end of the one before (the first range's after the last).
    pairs = [(prev["__range"], None if r["__nulls"] else r["__head"], r["__range"]) for prev, r in zip([heads[-1], *heads[:-1]], heads)] if heads else []
    schema = f"__to int, __head {rows.schema['__id'].dataType.simpleString()}, __from int"
    marks = docs.sparkSession.createDataFrame(pairs, schema)  # a row a range: MAX_RANGES at most
    firsts = (
        rows.join(F.broadcast(marks), (F.col("__range") == F.col("__from")) & F.col("__id").eqNullSafe(F.col("__head")))
        .groupBy("__to")
        .agg(F.min("__text").alias("__text"))
        .select(F.lit(None).cast(rows.schema["__id"].dataType).alias("__id"), "__text", F.col("__to").alias("__range"), F.lit(True).alias("__copy"))
    )
    both = rows.withColumn("__copy", F.lit(False)).unionByName(firsts)
    w = Window.partitionBy("__range").orderBy("__copy", F.col("__id").asc_nulls_first(), "__text")
    return (
        both.withColumn("__next", F.lead("__text").over(w))
        .filter(~F.col("__copy"))
        .select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), F.col("__next").alias("next_text"))
    )


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited form and of the next text, with byte-checked likeness (1.0 equal, else 0.0).

    The edited form's last floor(n/2) code points are the first as many of the next text. The digest is exact, so likeness has two values.
    Null texts count as empty; repeated rows repeat, rows of one id stand in the order of their texts; an empty table gives an
    empty result; other columns are not read. Digests of edited texts are compared byte by byte with their own text only.
    """
    rows = with_next_text(docs, id_col, text_col).withColumn("n_chars", F.char_length(text_col).cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn(
        "__edited", F.concat(F.substring(F.col(text_col), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    )
    rows = rows.select(
        id_col, "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col(text_col)).alias("__canon"), canonical(F.col("__edited")).alias("__canon_e"), canonical(F.col("next_text")).alias("__canon_n"),
    )
    rows = rows.withColumns({"__d": digest(F.col("__canon")), "__de": digest(F.col("__canon_e"))})
    rows = _resolved(rows, colliding_digests(docs, text_col), [("__d", "__canon", "fingerprint"), ("__de", "__canon_e", "edited_fingerprint")])
    same = lambda other: F.when(F.col("__canon") == F.col(other), F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("__canon_e").alias("near_edited"), same("__canon_n").alias("near_next")
    )
