"""Registered queries over the driver's tables, one or more per operator family, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import fuzzy, mutants, quality, quantity, sequences, similarity, text
from assayline.operators import assignment, joins, metrics, sampling, validation
from assayline.plans import pipelines
from assayline.runtime import ship, table
from assayline.sources import completions, extraction, files, markup, run_log
from assayline.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_S = lambda c: F.col(c).cast("bigint").cast("string")


# --- quantities and text -------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 1e-3 WHEN 2 THEN (l_quantity + 0.5) * 1e-2 ELSE l_quantity END, 9) AS value,
  CASE l_linenumber % 4 WHEN 0 THEN 'mM' WHEN 1 THEN 'M' WHEN 2 THEN 's^-1' ELSE 'min^-1' END AS unit,
  round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 1e-3 WHEN 1 THEN l_quantity * 1e-3 WHEN 2 THEN (l_quantity + 0.5) * 1e-2 ELSE l_quantity / 60 END, 9) AS true_value
FROM lineitem""")
def quantity_parse(spark: SparkSession, sf: str) -> DataFrame:
    n, q = F.col("l_linenumber") % 4, _S("l_quantity")
    t = F.when(n == 0, F.concat(q, F.lit(" mM"))).when(n == 1, F.concat(q, F.lit(" x 10^-3 M"))).when(n == 2, F.concat(q, F.lit(".5e-2 s^-1"))).otherwise(F.concat(q, F.lit(" ± 2 min^-1")))
    df = quantity.quantity_columns(table(spark, sf, "lineitem").withColumn("t", t), "t")
    return df.select("l_orderkey", "l_linenumber", F.round("t_value", 9).alias("value"), F.col("t_unit").alias("unit"), F.round("t_true_value", 9).alias("true_value"))


#: What follows a number, and what it becomes (None: no quantity of this kind).
_KM_CASES = [
    (" mm", " mM"), (",000 μM", "000 µM"), (" mg/ml", None), (" uM", " µM"), (" UM", " µM"), (" nm", " nM"), (" mmol/L", " mM"), (" g/L", None), (" pM", " pM"), (" x 10⁻² M", " x 10^-2 M"),
    (" nmol/mg", None), (" mM", " mM"), ("", ""),
]
_KCAT_CASES = [
    (" sec-1", " s^-1"), (" min−1", " min^-1"), (" µmol/min/mg", None), (" minute-1", " minute^-1"), (" second-1", " second^-1"), (" hour-1", " hour^-1"), (" day-1", " day^-1"), (" nkat/g", None),
    (" /g", None), (" MIN^-1", " MIN^-1"), (" nM", None), (" M", None), (" s⁻¹", " s^-1"), (" h-'", " h^-1"), (" U/mg", None), (",500 s^-1", "500 s^-1"), (" ", " "),
]


def _cases_sql(cases: list[tuple[str, str | None]], n: str) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || list_extract([{', '.join(text(b) for _, b in cases)}], CAST({n} % {len(cases)} + 1 AS INTEGER))"


@query(f"""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' x 10^-' || CAST(l_linenumber AS VARCHAR) || ' M' AS plain,
  {_cases_sql(_KM_CASES, "l_partkey")} AS km, {_cases_sql(_KCAT_CASES, "l_partkey")} AS kcat
FROM lineitem""")
def unit_normalisers(spark: SparkSession, sf: str) -> DataFrame:
    n, q, k = F.col("l_linenumber"), _S("l_quantity"), F.col("l_partkey")
    sup = F.translate(n.cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    case = lambda cases: F.concat(q, F.element_at(F.array(*[F.lit(a) for a, _ in cases]), (k % len(cases) + 1).cast("int")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.fix_scientific(F.concat(q, F.lit(" x 10⁻"), sup, F.lit(" M"))).alias("plain"), text.fix_km(case(_KM_CASES)).alias("km"), text.fix_kcat(case(_KCAT_CASES)).alias("kcat")
    )


@query("""
SELECT doc_id, sha256(replace(replace(replace(replace(replace(regexp_replace(lower(text), '[-᠆‑‒–—―﹘﹣－˗−‐⁻]', '-', 'g'), 'ß', 'beta'), '‘', ''''), '’', ''''), '“', '"'), '”', '"')) AS folded_sha256
FROM documents""")
def ascii_fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.ascii_fold(F.col("text")).cast("binary"), 256).alias("folded_sha256"))


_MUT = """'variant A' || CAST(p_partkey % 90 + 10 AS VARCHAR) || 'G, ala' || CAST(p_partkey % 7 + 1 AS VARCHAR) || 'Gly, Ser ' || CAST(p_size AS VARCHAR) || ' to Thr.'"""


@query("""
SELECT p_partkey, 'A' || CAST(p_partkey % 90 + 10 AS VARCHAR) || 'G; A' || CAST(p_partkey % 7 + 1 AS VARCHAR) || 'G' AS codes, CAST(2 AS INTEGER) AS n FROM part""")
def mutant_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat(F.lit("variant A"), (k % 90 + 10).cast("string"), F.lit("G, ala"), (k % 7 + 1).cast("string"), F.lit("Gly"))
    df = mutants.with_clean_mutants(table(spark, sf, "part").select("p_partkey", t.alias("mutant")))
    return df.select("p_partkey", F.array_join("clean_mutant", "; ").alias("codes"), F.size("clean_mutant").alias("n"))


@query("""
SELECT p_partkey, CAST(p_partkey % 9 + 1 AS VARCHAR) || 'XYZ' AS pdb, 'P1A2B' || CAST(p_partkey % 10 AS VARCHAR) AS uniprot, 'NP_' || CAST(p_partkey AS VARCHAR) || '.1' AS refseq,
  'AB' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS genbank FROM part""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.concat(F.lit("see "), (k % 9 + 1).cast("string"), F.lit("XYZ, P1A2B"), (k % 10).cast("string"), F.lit("; NP_"), k.cast("string"), F.lit(".1 and AB"), F.lpad(k.cast("string"), 6, "0"), F.lit("!"))
    i = table(spark, sf, "part").select("p_partkey", text.identifiers(t).alias("i"))
    # Accessions of several kinds may fit other patterns too; each list's own form is shown.
    own = lambda c, p: F.array_join(F.filter(F.col(f"i.{c}"), lambda x: x.rlike(p)), ",")
    return i.select("p_partkey", own("pdb", "XYZ$").alias("pdb"), own("uniprot", "^P1A2B").alias("uniprot"), own("refseq", "^NP_").alias("refseq"), own("genbank", "^AB").alias("genbank"))


@query("""
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Escherichia coli' WHEN 2 THEN 'Severe acute respiratory syndrome coronavirus 2' ELSE 'Bacillus' END AS organism,
  c_nationkey % 4 = 3 AS wild, 'ns' AS namespace, 'ns_v' || CAST(c_nationkey AS VARCHAR) AS versioned, CAST(c_custkey AS VARCHAR) || '_x' AS pmid,
  CASE WHEN c_nationkey % 2 = 0 THEN ['a', 'b, c'] ELSE ['a', 'b'] END AS parts FROM customer""")
def names_and_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    organism = F.element_at(F.array(*map(F.lit, ("human", "E. coli", "SARS-CoV 2", "Bacillus"))), n % 4 + 1)
    cid = text.id_parts(F.concat(F.lit("ns_v"), n.cast("string"), F.lit("_"), F.col("c_custkey").cast("string"), F.lit("_x")))
    return table(spark, sf, "customer").select(
        "c_custkey", text.fix_organism(organism).alias("organism"), text.is_wild_type(F.when(n % 4 == 3, "Wild-Type").otherwise("A12G")).alias("wild"), cid["namespace"].alias("namespace"),
        cid["versioned"].alias("versioned"), cid["pmid"].alias("pmid"), text.explode_field(F.when(n % 2 == 0, "a; b, c").otherwise("a, b")).alias("parts"),
    )


@query("""
WITH b AS (SELECT p_partkey, p_name, list_distinct([substr(p_name, i, 2) FOR i IN range(1, length(p_name))]) AS g FROM part)
SELECT x.p_partkey, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 9) AS jaccard FROM b x JOIN b y ON y.p_partkey = x.p_partkey + 1""")
def bigram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(similarity.bigram_jaccard(F.col("p_name"), F.col("other")), 9).alias("jaccard"))


@query()
def fuzzy_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The names of parts whose id is divisible by 20 (the search's queries) against all part types."""
    ship(spark)
    p = table(spark, sf, "part")
    return joins.similar_names(p.filter("p_partkey % 20 = 0"), p.select("p_type").distinct(), "p_name", "p_type", 5, 30.0)


@query()
def fuzzy_ratios(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    p = table(spark, sf, "part")
    return p.select("p_partkey", fuzzy.ratio("p_name", "p_type").alias("ratio"), fuzzy.partial_ratio("p_name", "p_type").alias("partial"), fuzzy.block_ratio("p_name", "p_type").alias("blocks"))


@query("""
SELECT l_orderkey, l_linenumber, round(1 - abs(l_quantity - l_linenumber) / greatest(l_quantity, l_linenumber), 9) AS closeness,
  round(least((l_quantity - l_linenumber - 3) ^ 2, (l_quantity - l_linenumber + 3) ^ 2), 9) AS with_difference,
  round(least((l_quantity - l_linenumber * 3) ^ 2, (l_quantity - l_linenumber / 3.0) ^ 2), 9) AS with_scale,
  CASE WHEN abs(l_quantity - l_linenumber) / greatest(l_quantity, l_linenumber) < 1e-6 THEN 1 ELSE 0 END AS close,
  round(power(10, abs(log10(l_quantity) - log10(l_linenumber))), 9) AS fold FROM lineitem""")
def numeric_similarity(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(similarity.float_similarity(a, b), 9).alias("closeness"), F.round(similarity.distance_with_difference(a, b), 9).alias("with_difference"),
        F.round(similarity.distance_with_scale(a, b), 9).alias("with_scale"), similarity.within_tolerance(a, b).alias("close"), F.round(similarity.fold_difference(a, b), 9).alias("fold"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 ELSE 0.0 END AS km_score,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'off by 10' WHEN 2 THEN 'off by 1000' ELSE 'unknown unit' END AS problem FROM lineitem""")
def value_feedback(spark: SparkSession, sf: str) -> DataFrame:
    n, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    a, b = q, q * F.element_at(F.array(F.lit(1.0), F.lit(10.0), F.lit(1000.0), F.lit(1.0)), (n + 1).cast("int"))
    missing = F.when(n == 3, None).otherwise(b)
    score = similarity.value_similarity(a, missing, q, q, "km")
    unit = F.when(n == 3, None).otherwise(F.lit("mM"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("km_score"), similarity.feedback(a, b, F.lit("mM"), unit, "km").alias("problem"))


# --- matching and metrics --------------------------------------------------------------------------------------------


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    return rows.filter("l_linenumber <= 3").drop("l_linenumber"), rows.filter("l_linenumber >= 2").drop("l_linenumber")


_COUNTS = """
WITH a AS (SELECT l_orderkey AS k, round(l_quantity, 6) AS v, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
b AS (SELECT l_orderkey AS k, round(l_quantity, 6) AS v, count(*) AS m FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b ON a.k = b.k AND a.v = b.v),
g AS (SELECT k, sum(least(n, m)) AS tp, sum(n) AS n, sum(m) AS m FROM j GROUP BY k)
"""


@query(_COUNTS + """, s AS (SELECT sum(tp) AS tp, sum(least(n, m) - tp) AS wrong, sum(greatest(n - m, 0)) AS left_only, sum(greatest(m - n, 0)) AS right_only, count(*) FILTER (n > 0 AND m > 0) AS num_keys FROM g),
r AS (SELECT *, tp / (tp + left_only + wrong) AS precision, tp / (tp + right_only + wrong) AS recall FROM s)
SELECT CAST(tp AS BIGINT) AS tp, CAST(wrong AS BIGINT) AS wrong, CAST(left_only AS BIGINT) AS left_only, CAST(right_only AS BIGINT) AS right_only, num_keys, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(2 * precision * recall / (precision + recall), 9) AS f1, round(tp / (tp + left_only + wrong + right_only + wrong), 9) AS accuracy FROM r""")
def exact_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    df = metrics.exact_precision_recall(a, b, "value", ["l_orderkey"])
    return df.select("tp", "wrong", "left_only", "right_only", "num_keys", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(_COUNTS + """SELECT outcome, CAST(sum(x) AS BIGINT) AS n FROM (SELECT tp, least(n, m) - tp AS wrong, greatest(n - m, 0) AS left_only, greatest(m - n, 0) AS right_only FROM g)
UNPIVOT (x FOR outcome IN (tp, wrong, left_only, right_only)) GROUP BY outcome""")
def assignment_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores by the solver."""
    ship(spark)
    a, b = _two(spark, sf)
    return metrics.matched_rows(a, b, "value", ["l_orderkey"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _square(a, b) -> np.ndarray:
    return (a["value"].to_numpy(float)[:, None] - b["value"].to_numpy(float)[None, :]) ** 2


_RANKS = """
WITH e AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber <= 2) = count(*) FILTER (l_linenumber BETWEEN 3 AND 4)),
a AS (SELECT l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem JOIN e USING (l_orderkey) WHERE l_linenumber <= 2),
b AS (SELECT l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem JOIN e USING (l_orderkey) WHERE l_linenumber BETWEEN 3 AND 4)
"""


def _equal_sizes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem")
    rows = rows.join(rows.groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") <= 2).alias("a"), F.count_if(F.col("l_linenumber").between(3, 4)).alias("b")).filter("a = b").select("l_orderkey"), "l_orderkey", "left_semi")
    rows = rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    return rows.filter("l_linenumber <= 2").drop("l_linenumber"), rows.filter("l_linenumber between 3 and 4").drop("l_linenumber")


@query(_RANKS + "SELECT l_orderkey, a.v AS value_1, b.v AS value_2 FROM a JOIN b USING (l_orderkey, r)")
def assignment_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return assignment.rank_join(*_equal_sizes(spark, sf), ["l_orderkey"], "value")


@query(_RANKS + "SELECT l_orderkey, sum((a.v - b.v) ^ 2) AS total FROM a JOIN b USING (l_orderkey, r) GROUP BY 1")
def assignment_solver(spark: SparkSession, sf: str) -> DataFrame:
    """Least squared distance by the solver: the totals of the rank-to-rank pairing."""
    ship(spark)
    pairs = assignment.assignment_join(*_equal_sizes(spark, sf), ["l_orderkey"], _square, maximize=False, objective_column="d")
    return pairs.groupBy("l_orderkey").agg(F.sum("d").alias("total"))


def _sided(spark: SparkSession, sf: str, how: str) -> DataFrame:
    ship(spark)
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    a, b = e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'purchase'").drop("event_type")
    return assignment.assignment_join(a, b, ["user_id"], assignment.equality("value"), how).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _sided_sql(keep: str) -> str:
    return f"""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(coalesce(n, 0), coalesce(m, 0)) AS n FROM a FULL JOIN b ON a.user_id = b.user_id WHERE {keep}"""


@query(_sided_sql("n IS NOT NULL AND m IS NOT NULL"))
def assignment_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _sided(spark, sf, "inner")


@query(_sided_sql("n IS NOT NULL"))
def assignment_left(spark: SparkSession, sf: str) -> DataFrame:
    return _sided(spark, sf, "left")


@query(_sided_sql("m IS NOT NULL"))
def assignment_right(spark: SparkSession, sf: str) -> DataFrame:
    return _sided(spark, sf, "right")


@query(_sided_sql("true"))
def assignment_outer(spark: SparkSession, sf: str) -> DataFrame:
    return _sided(spark, sf, "outer")


_FACTORS = [1000.0, 10.0, 100.0, 60.0, 1e6, 1e4, 3600.0]


@query("""SELECT CAST(f AS DOUBLE) AS factor, coalesce(n, 0) AS tp FROM (SELECT unnest([1, 1000, 10, 100, 60, 1000000, 10000, 3600]) AS f)
LEFT JOIN (SELECT list_extract([1000, 10, 100, 60, 1000000, 10000, 3600, 1], CAST(o_orderkey % 8 + 1 AS INTEGER)) AS f, count(*) AS n FROM orders GROUP BY 1) USING (f)""")
def off_by_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's price against itself, scaled by one of seven factors or not at all."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("value"))
    scale = F.element_at(F.array(*map(F.lit, [*_FACTORS, 1.0])), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return metrics.off_by(rows, rows.withColumn("value", F.col("value") * scale), "value", ["o_orderkey"], _FACTORS)


@query("""SELECT CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1000 ELSE 1 END AS DOUBLE) AS factor, count(*) AS tp FROM lineitem GROUP BY 1""")
def off_by_thousand(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("value"), "l_linenumber")
    theirs = rows.withColumn("value", F.when(F.col("l_linenumber") % 3 == 0, F.col("value") * 1000).otherwise(F.col("value")))
    return metrics.off_by(rows, theirs, "value", ["l_orderkey"], [1000.0])


@query("""WITH l AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click'), r AS (SELECT user_id, value AS v FROM events WHERE event_type = 'purchase')
SELECT event_id, any_value(l.value) AS value, arg_min(v, (abs(l.value - v), -v)) AS value_right FROM l LEFT JOIN r USING (user_id) GROUP BY event_id""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "value")
    return joins.asof_nearest(left, e.filter("event_type = 'purchase'").select("user_id", "value"), ["user_id"], "value", 1.0).select("event_id", "value", "value_right")


@query("""WITH l AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click'), r AS (SELECT user_id, value AS v FROM events WHERE event_type = 'purchase')
SELECT event_id, any_value(l.value) AS value, arg_min(v, (abs(l.value - v), -v)) FILTER (abs(l.value - v) <= 5.0) AS value_right FROM l LEFT JOIN r USING (user_id) GROUP BY event_id""")
def asof_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "value")
    return joins.asof_nearest(left, e.filter("event_type = 'purchase'").select("user_id", "value"), ["user_id"], "value", 5.0, 5.0).select("event_id", "value", "value_right")


@query("""SELECT count(*) FILTER (t > 0 AND q > 25 AND NOT (l_linenumber % 5 = 0)) AS tp_like, count(*) AS total FROM (SELECT l_linenumber, l_quantity AS q, l_extendedprice AS t FROM lineitem)""")
def presence_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("ours"), F.col("l_extendedprice").alias("theirs"), F.when(F.col("l_linenumber") % 5 == 0, "off by 10").alias("note")
    )
    df = metrics.presence_precision_recall(rows, "ours", "theirs", ["note"])
    return df.select(F.col("tp").alias("tp_like"), (F.col("pp") + F.col("fp") + F.col("fn")).alias("total"))


@query("""SELECT round(avg(abs(log10(l_quantity / l_linenumber))), 9) AS mean_log_ratio FROM lineitem""")
def mean_log_ratio(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_quantity", F.col("l_linenumber").cast("double").alias("n"))
    return metrics.mean_log_ratio(df, "l_quantity", "n").select(F.round("mean_log_ratio", 9).alias("mean_log_ratio"))


@query("""WITH r AS (SELECT log10(l_extendedprice) AS x, log10(l_quantity) AS y, l_orderkey AS k FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0),
q AS (SELECT *, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0) AS ry FROM r)
SELECT count(*) AS n, round(1 - sum((x - y) ^ 2) / (var_pop(y) * count(*)), 6) AS r2, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 6) AS mae,
  round(sqrt(avg((x - y) ^ 2)), 6) AS rmse, round(avg(CASE WHEN abs(x - y) < 0.0211892991 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(DISTINCT k) AS n_keys FROM q""")
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    df = metrics.correlations(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", "l_orderkey")
    return df.select("n", *[F.round(c, 6).alias(c) for c in ("r2", "pearson", "spearman", "mae", "rmse", "accuracy")], "n_keys")


@query("""SELECT o_orderkey, CAST(o_totalprice AS INTEGER) % 10000 >= 8000 AS same_enzyme, CAST(trunc(o_totalprice) AS INTEGER) % 1000 >= 800 AS same_mutant, CAST(trunc(o_totalprice) AS INTEGER) % 100 >= 80 AS same_substrate FROM orders""".replace("CAST(o_totalprice AS INTEGER) %", "CAST(trunc(o_totalprice) AS INTEGER) %"))
def flag_decode(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.decode_objective(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "same_enzyme", "same_mutant", "same_substrate")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 5)""")
def perfect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.keep_perfect(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") > 5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (l_linenumber % 2 = 0) AS agreement, count(*) AS total FROM lineitem""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, _S("l_quantity")).otherwise("none given").alias("ours"), _S("l_quantity").alias("theirs"), F.lit(None).cast("string").alias("note"))
    return metrics.agreement(rows, [("ours", "theirs")], ["note"])


# --- joins -------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN s.s_suppkey % 3 = 0 THEN s_name END, CASE WHEN p_partkey % 3 = 0 THEN p_name END, s_name) AS name
FROM lineitem LEFT JOIN supplier s ON nullif(l_suppkey, 1) IS NOT DISTINCT FROM nullif(s.s_suppkey, 1) LEFT JOIN part ON l_partkey = p_partkey""")
def cascade_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("l_suppkey") != 1, F.col("l_suppkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("sk"), F.col("l_partkey").alias("pk"))
    s = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") != 1, F.col("s_suppkey")).alias("sk"), "s_suppkey", "s_name")
    first = s.select("sk", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("name"))
    second = table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("name"))
    third = s.select("sk", F.col("s_name").alias("name"))
    return joins.cascade(rows, [(first, ["sk"], True), (second, ["pk"], False), (third, ["sk"], True)], ["name"]).select("l_orderkey", "l_linenumber", "name")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1""")
def best_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.best_per_key(rows, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber")])


@query("""SELECT c_custkey, list_sort(list_distinct(x.codes)) AS codes FROM customer LEFT JOIN (SELECT s_nationkey, list(s_name) AS codes FROM supplier GROUP BY 1) x ON c_nationkey = s_nationkey""")
def lookup_lists(spark: SparkSession, sf: str) -> DataFrame:
    d = joins.lookup_lists(table(spark, sf, "supplier").withColumnRenamed("s_name", "codes"), F.col("s_nationkey"), ["codes"], "c_nationkey")
    return table(spark, sf, "customer").join(d, "c_nationkey", "left").select("c_custkey", "codes")


@query("""WITH e AS (SELECT lower(n_name) AS a, list_sort(list_distinct(list(r_name))) AS codes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT c_custkey, codes FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN e ON lower(n_name) = a""")
def code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    t = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.array("r_name").alias("codes"))
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    return joins.add_codes(rows, t, ["name"], "codes", "alias", "codes").select("c_custkey", "codes")


@query("""SELECT s_suppkey, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def synonym_context(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as contexts whose synonyms are their nations' names."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    ctx = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("synonyms"))
    ctx = ctx.select(F.lit("1").alias("pmid"), F.col("r_name").alias("fullname"), "synonyms")
    data = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("1").alias("pmid"), "s_suppkey", F.col("n_name").alias("substrate"))
    return joins.join_context(data, ctx, ["pmid"], "substrate").select("s_suppkey", F.col("ctx_fullname").alias("region"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'µM' ELSE 'mM' END AS replacement FROM lineitem""")
def box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A word 'mM' in each cell of a page; a character box inside it where the line number isn't divisible by three."""
    n = F.col("l_linenumber").cast("double")
    rows = table(spark, sf, "lineitem")
    box = lambda a, b: [(n * 10 + a).alias("x0"), F.lit(0.0).alias("y0"), (n * 10 + b).alias("x1"), F.lit(5.0).alias("y1")]
    words = rows.select("l_orderkey", "l_linenumber", F.lit("mM").alias("word"), *box(0, 8))
    chars = rows.filter("l_linenumber % 3 != 0").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 1, "mu").otherwise("m").alias("real_char"), *box(1, 3))
    return joins.unit_replacements(words, chars, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "replacement")


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return joins.page_text(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)""")
def drop_range_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validation.drop_keys_with(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") > 48).select("l_orderkey", "l_linenumber")


# --- sources -----------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_CHAT_IDS = "'ns_v1_' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR)"


@query(f"""SELECT {_CHAT_IDS} AS custom_id, text AS content, CASE WHEN turn % 2 = 0 THEN 'stop' ELSE 'length' END AS finish_reason, length(text) AS input_tokens, turn AS output_tokens FROM conversations""")
def completion_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Each of the three response shapes, built from turns and decoded again."""
    c = table(spark, sf, "conversations")
    cid = F.concat(F.lit("ns_v1_"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    n, t = F.char_length("text").cast("bigint"), F.col("turn").cast("bigint")
    chat = F.struct(cid.alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.when(F.col("turn") % 2 == 0, "stop").otherwise("length").alias("finish_reason"))).alias("choices"),
            F.struct(n.alias("prompt_tokens"), t.alias("completion_tokens")).alias("usage")).alias("body")).alias("response"))
    msg = F.struct(cid.alias("custom_id"), F.struct(F.struct(F.array(F.struct("text")).alias("content"), F.when(F.col("turn") % 2 == 0, "end_turn").otherwise("max_tokens").alias("stop_reason"),
            F.struct(n.alias("input_tokens"), t.alias("output_tokens")).alias("usage")).alias("message")).alias("result"))
    cand = F.struct(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(cid.alias("text"))).alias("parts"))).alias("contents")).alias("request"),
            F.struct(F.array(F.struct(F.struct(F.array(F.struct("text")).alias("parts")).alias("content"), F.when(F.col("turn") % 2 == 0, "STOP").otherwise("MAX_TOKENS").alias("finishReason"))).alias("candidates"),
            F.struct(n.alias("promptTokenCount"), t.alias("candidatesTokenCount")).alias("usageMetadata")).alias("response"))
    kind = F.pmod(F.col("conv_id"), F.lit(3))
    parts = [completions.decode(c.filter(kind == k).select(F.to_json(x).alias("value")), shape) for k, (x, shape) in enumerate(((chat, "chat"), (msg, "message")))]
    last = completions.decode(c.filter(kind == 2).select(F.to_json(cand).alias("value")), "candidate")
    asked = c.filter(kind == 2).select(completions.sha_base64(cid).alias("input_sha256"), cid.alias("custom_id"))
    parts.append(completions.with_correspondence(last, asked).select(*completions.COLUMNS))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT conv_id, count(*) AS docs, string_agg(text, chr(31) ORDER BY turn) AS joined FROM conversations WHERE turn > 0 GROUP BY 1""")
def request_build(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as requests (turn 0 the system message), read back from their JSON."""
    c = table(spark, sf, "conversations")
    docs = c.filter("turn > 0").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("docs"))
    made = docs.select(completions.chat_request(F.concat(F.lit("ns_v1_"), F.col("conv_id").cast("string")), F.lit("system"), F.col("docs"), "model").alias("value"))
    back = completions.request_docs(made)
    return back.select(F.split_part("custom_id", F.lit("_"), F.lit(3)).cast("bigint").alias("conv_id"), F.size("docs").cast("bigint").alias("docs"), F.array_join("docs", "\x1f").alias("joined"))


def _yaml_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A completion per order: a datum per line, the enzymes and substrates of its lines as context."""
    q = F.concat(F.lit("    - descriptor: enzyme-"), F.col("l_suppkey").cast("string"), F.lit("; part-"), F.col("l_partkey").cast("string"), F.lit("; pH 7."), F.col("l_linenumber").cast("string"),
                 F.lit("\n      kcat: "), _S("l_quantity"), F.lit(" s^-1\n      Km: "), F.col("l_linenumber").cast("string"), F.lit(" mM"))
    item = F.struct("l_linenumber", q.alias("y"), F.concat(F.lit("        - fullname: enzyme-"), F.col("l_suppkey").cast("string"), F.lit("\n          synonyms: sup; E"), F.col("l_suppkey").cast("string")).alias("e"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    doc = F.concat(F.lit("Here it is.\n```yaml\ndata:\n"), F.array_join(F.transform("i", lambda x: x["y"]), "\n"), F.lit("\ncontext:\n    enzymes:\n"), F.array_join(F.transform("i", lambda x: x["e"]), "\n"), F.lit("\n```\n"))
    return g.select(F.col("l_orderkey").cast("string").alias("pmid"), doc.alias("content"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, 'enzyme-' || l_suppkey || '; part-' || l_partkey || '; pH 7.' || l_linenumber AS descriptor, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' s^-1' AS kcat,
  l_linenumber || ' mM' AS km, CAST(3 AS INTEGER) AS fragments FROM lineitem""")
def yaml_relations(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    data = extraction.five_relations(extraction.parse(_yaml_documents(spark, sf), records=False))["data"]
    return data.select("pmid", "descriptor", "kcat", "km", F.size("fragments").alias("fragments"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, 'enzyme-' || l_suppkey AS enzyme, '7.' || l_linenumber AS pH, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' s^-1' AS kcat, l_linenumber || ' mM' AS km FROM lineitem""")
def context_resolution(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return extraction.measurements(extraction.parse(_yaml_documents(spark, sf))).select("pmid", "enzyme", "pH", "kcat", "km")


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return table(spark, sf, "pages").select("page_id", markup.html_text("html").alias("text"), F.size(markup.html_tables("html")).alias("tables"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'downloaded' ELSE 'submitted' END AS status FROM orders""")
def versioned_upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    log = o.select(F.lit("ns").alias("namespace"), F.col("o_orderkey").cast("string").alias("version"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("shard"), F.lit("submitted").alias("status"))
    done = log.filter(F.col("version").cast("bigint") % 5 == 0).withColumn("status", F.lit("downloaded"))
    return run_log.upsert(log, done).select(F.col("version").cast("bigint").alias("o_orderkey"), "status")


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def diagonal_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return files.diagonal([a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("""SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 10 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def found_or_missing(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("not found").alias("v"))
    return files.found_or_missing(p, "p_partkey", "v").select(F.col("p_partkey").alias("id"), F.col("v").try_cast("int").alias("size"))


@query("""SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages WHERE page_id % 2 = 1 GROUP BY 1""")
def incremental_unseen(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    fresh = files.drop_seen(p, p.filter("page_id % 2 = 0"), "page_id")
    return fresh.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    w = incremental.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "1 day", value="value")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) * 1000 AS BIGINT) AS shard FROM orders""")
def request_shards(spark: SparkSession, sf: str) -> DataFrame:
    return completions.shard_suffix(table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey")).select("o_orderkey", "shard")


@query()
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split(table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id", max_train=100, max_val=50).select("conv_id", "split")


@query("""SELECT p_partkey, CAST(p_partkey % 5 - 2 AS INTEGER) AS shift FROM part""")
def sequence_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Codes A11G, C13W, D16E against a sequence in which they stand p_partkey % 5 - 2 places off."""
    ship(spark)
    shift = (F.col("p_partkey") % 5 - 2).cast("int")
    s = F.concat(F.repeat(F.lit("K"), 10 + shift), F.lit("AKCKKDKKKKKKKKKK"))
    return table(spark, sf, "part").select("p_partkey", sequences.sequence_offset(s, F.lit("A11G, C13W, D16E")).alias("shift"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'no yaml' WHEN 1 THEN 'mixed s and min' ELSE '' END AS problems FROM lineitem""")
def answer_rules(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    t = F.when(n == 0, F.lit("plain")).when(n == 1, F.lit("```yaml\ndata:\n  - kcat: 1 s^-1\n  - kcat: 2 min^-1\n```")).otherwise(F.lit("```yaml\ndata:\n  - kcat: 1 s^-1\n```"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(quality.answer_problems(t), ", ").alias("problems"))


@query("""SELECT n.n_name AS name, list_sort(list_distinct(list(s_suppkey) FILTER (s_suppkey IS NOT NULL))) AS ids FROM nation n LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def thesaurus(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    d = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.upper("n_name").alias("word"), F.col("s_suppkey").alias("ids"))
    return pipelines.thesaurus(n.select(F.col("n_name").alias("name")), [(d, "word", "ids")]).select("name", "ids")


@query("""SELECT l_orderkey AS pmid, 19990.01 AS objective, TRUE AS same_enzyme, TRUE AS same_mutant, TRUE AS same_substrate, 1.0 AS kcat_diff, 1.0 AS km_diff FROM lineitem""")
def weighted_match(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order against themselves, paired by the weighted objective: each with itself, as its mutant is its own."""
    ship(spark)
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pmid"), F.concat(F.lit("enzyme "), F.col("l_suppkey").cast("string")).alias("enzyme"), F.lit(None).cast("string").alias("enzyme_full"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("substrate"), F.lit(None).cast("string").alias("substrate_full"), F.col("l_returnflag").alias("organism"),
        F.concat(F.lit("A"), (F.col("l_linenumber") + 10).cast("string"), F.lit("G")).alias("mutant"), F.concat(_S("l_quantity"), F.lit(" s^-1")).alias("kcat"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" mM")).alias("km"),
    )
    ours = pipelines.prepared(rows)
    found = pipelines.match(ours, ours)
    return found.select("pmid", F.round("objective", 6).alias("objective"), "same_enzyme", "same_mutant", "same_substrate", F.round("kcat_diff", 9).alias("kcat_diff"), F.round("km_diff", 9).alias("km_diff"))
