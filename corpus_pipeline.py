"""A corpus pipeline over `documents`: toxic documents go, one of each group of near copies stays, contaminated documents
go, personal data and terms that give it away are generalised, and what remains is encoded.

Each stage reads what the one before kept, as Parquet in the shared scratch folder. Empty tables stay empty, and columns
beside doc_id and text keep their names and values (but for n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bpe, decontam, ngram_join, pii, toxicity
from assayline.runtime import discard, materialise, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the string-kernel classifier scores 0.7 or more go; null texts count as empty, repeated rows each by itself."""
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of Jaccard 0.8 on five-word shingles connect, the one with the smallest id stays (all rows of
    that id do); documents without words or an id stay."""
    ship(spark)
    return ngram_join.without_near_copies(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of `benchmark` go; null texts hold none."""
    ship(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, secrets and disclosing terms are generalised; n_chars follows the text. Every row stays, null texts null."""
    ship(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, a null text as empty; ids are little-endian unsigned 32-bit integers."""
    ship(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_decode(docs, path, bpe.build_lexicon(docs, path), cache=60_000)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("bpe", encode),
]

#: No SQL form: a trained classifier and a tokenizer decide the rows. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*made)  # what the stage has read
        made = [docs]
    return docs
