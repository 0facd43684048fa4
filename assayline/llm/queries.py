"""The registered queries of this subpackage, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bpe, decontam, fingerprint, langid, ngram_join, pii, sharding, substring_dedup, token_count, toxicity
from assayline.runtime import ship, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.find(table(spark, sf_dir, "documents"))


def op2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit_mixture(docs))


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, path = table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")
    return bpe.coding_digests(docs, path, bpe.build_lexicon(docs, path), cache=400_000)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_probe(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds; clean documents have none."""
    ship(spark)
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.join_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_count.token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=512)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=13, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


#: Whole tables, whole texts; the other operators have no SQL form and are tested against brute force.
SQL = {
    "op6_ngram_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op10_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN f USING (s), range(13) t(j) WHERE m < doc_id),
e AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
g AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM e ANTI JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
