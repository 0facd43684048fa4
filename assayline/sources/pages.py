"""Page texts with recognised characters put right: words and boxes come as tables, nothing is read from images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.joins import unit_replacements

# What may stand for mM or µM in a page's words, and control characters that OCR leaves.
WIDE_UNIT = r"(?i)\b[m\x00-\x08\x11\x12\x14-\x1F]m(?=$|\W)"
CONTROL = r"[\x00-\x08\x11\x12\x14-\x1F\x7F-\x9F]"

PAGE = ["pdfname", "pageno"]


def corrections(boxes: DataFrame, files: DataFrame | None = None, least: float = 0.98, must_meet: bool = False) -> DataFrame:
    """Boxes that surely show a mu. With files (pdfname), names get or lose '.pdf' as the files have it or not; must_meet
    raises if no file has a box."""
    out = boxes.filter((F.col("real_char") == "mu") & (F.col("confidence") > least))
    if files is None:
        return out
    has = lambda df: bool(df.agg(F.coalesce(F.bool_or(F.col("pdfname").endswith(".pdf")), F.lit(False))).first()[0])
    theirs, ours = has(files), has(out)
    if theirs and not ours:
        out = out.withColumn("pdfname", F.concat("pdfname", F.lit(".pdf")))
    elif ours and not theirs:
        out = out.withColumn("pdfname", F.regexp_replace("pdfname", r"\.pdf$", ""))
    if must_meet and out.join(files.select("pdfname").distinct(), "pdfname", "left_semi").isEmpty():
        raise ValueError("no file has a correction")
    return out


def _in_order(words: DataFrame, boxes: DataFrame, order: str, pattern: str) -> DataFrame:
    """(page, w): the words of each page that has a mu box, in order, with their replacements. A page bounds the list."""
    fixed = unit_replacements(words, boxes, PAGE, pattern)
    some = boxes.filter("real_char = 'mu'").select(*PAGE).distinct()
    item = F.struct(F.col(order).alias("k"), F.col("word").alias("w"), F.col("replacement").alias("r"))
    return fixed.join(some, PAGE, "left_semi").groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("__words"))


def _next(text: Column, word: Column, cursor: Column) -> Column:
    """Where the word stands from the cursor on (from 1), or the cursor itself if it doesn't."""
    at = F.position(word, text, cursor)
    return F.when(at > 0, at).otherwise(cursor)


def corrected_text(pages: DataFrame, words: DataFrame, boxes: DataFrame, order: str = "ctr", pattern: str = WIDE_UNIT) -> DataFrame:
    """pages (pdfname, pageno, text) with replaced words; what stands between words, control characters too, stays.

    Pages without a mu box are unchanged. What follows the last word is dropped on corrected pages.
    """
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        at = _next(F.col("text"), w["w"], acc["at"])
        gap = F.substring(F.col("text"), acc["at"], at - acc["at"])
        return F.struct((at + F.char_length(w["w"])).alias("at"), F.concat(acc["out"], gap, F.coalesce(w["r"], w["w"])).alias("out"))

    fixed = pages.join(_in_order(words, boxes, order, pattern), PAGE, "left")
    return fixed.withColumn("text", F.when(F.col("__words").isNull(), F.col("text")).otherwise(F.aggregate("__words", start, step, lambda a: a["out"]))).drop("__words")


def corrected_words(pages: DataFrame, words: DataFrame, boxes: DataFrame, order: str = "ctr", pattern: str = WIDE_UNIT) -> DataFrame:
    """words of pages with a mu box, corrected: a control character before m or M is a µ, others stand before their word,
    and µMo is µmo. Words of other pages are unchanged."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<k:bigint,word:string>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        at = _next(F.col("text"), w["w"], acc["at"])
        gap = F.regexp_replace(F.substring(F.col("text"), acc["at"], at - acc["at"]), r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")
        word = F.when(w["r"].isNotNull(), F.replace(w["r"], F.lit("µMo"), F.lit("µmo"))).otherwise(w["w"])
        micro = gap.rlike(f"{CONTROL}$") & word.rlike("^[mM]")
        before = F.when(micro, F.substring(gap, F.lit(1), F.char_length(gap) - 1)).otherwise(gap)
        made = F.concat(F.when(F.trim(before) != "", before).otherwise(""), F.when(micro, F.lit("µ")).otherwise(""), word)
        item = F.array(F.struct(w["k"].cast("bigint").alias("k"), made.alias("word")))
        return F.struct((at + F.char_length(w["w"])).alias("at"), F.concat(acc["out"], item).alias("out"))

    paged = _in_order(words, boxes.filter("real_char = 'mu'"), order, pattern).join(pages.select(*PAGE, "text"), PAGE)
    made = paged.select(*PAGE, F.explode(F.aggregate("__words", start, step, lambda a: a["out"])).alias("x")).select(*PAGE, F.col("x.k").alias(order), F.col("x.word").alias("__word"))
    return words.join(made, [*PAGE, order], "left").withColumn("word", F.coalesce("__word", "word")).drop("__word").select(*words.columns)
