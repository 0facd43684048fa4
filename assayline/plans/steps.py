"""Registered queries of the pipelines' steps, of cleaning, infusion and sources, over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import fuzzy, mutants, quality, sequences, similarity, text
from assayline.functions.quantity import default_unit, significant_digits
from assayline.operators import cleaning, infusion, joins, metrics, sampling, validation
from assayline.operators.assignment import assignment_join
from assayline.operators.objectives import column_similarity, number_sets
from assayline.plans import pipelines
from assayline.plans.catalogue import _S, query
from assayline.runtime import scratch_root, ship, table
from assayline.sources import completions, extraction, files, markup, pages, run_log
from assayline.streaming import incremental


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- names, identifiers, predicates -----------------------------------------------------------------------------------


@query("""
SELECT p_partkey, '10.' || p_size || '_a_' || p_partkey AS filename, '10.' || p_size || '/a_' || p_partkey AS doi, p_partkey % 2 = 0 AS good_namespace,
  ['x' || p_partkey, 'y'] AS printed, 'C' || p_size || 'H6O' AS formula, 'P' || p_partkey AS ncbi, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'ans' || p_partkey END AS answer,
  CASE WHEN p_partkey % 2 = 0 THEN 'long name of ' || p_partkey || ' (AB)' ELSE 'longer than ten' END AS lengthened, 'k: ' || p_partkey || chr(10) AS block,
  CASE p_partkey % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o-2024-05-13' WHEN 2 THEN 'gpt-4o-2024-08-06' END AS model, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_partkey % 4 = 2 END AS structured,
  'alpha' || p_partkey AS greek FROM part""")
def name_helpers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    doi = F.concat(F.lit("10."), _text("p_size"), F.lit("/a/"), k.cast("string"))
    file = F.concat(F.lit("10."), _text("p_size"), F.lit("_a_"), k.cast("string"))
    sheet = F.concat(F.lit("Substrate: s\nSearch: t\nFinal Answer: "), F.when(k % 3 == 0, "None").otherwise(F.concat(F.lit("ans"), k.cast("string"))))
    model = text.model_of(F.concat(F.lit("ns"), F.element_at(F.array(*map(F.lit, ("-mini", "-4o", "-4o-str", "-unknown"))), (k % 4 + 1).cast("int"))))
    return table(spark, sf, "part").select(
        "p_partkey", text.doi_to_filename(doi).alias("filename"), text.filename_to_doi(file).alias("doi"), text.is_valid_namespace(F.when(k % 2 == 0, "a-b").otherwise("a:b")).alias("good_namespace"),
        text.printed_list(F.concat(F.lit("['x"), k.cast("string"), F.lit("', 'y']"))).alias("printed"),
        text.formula_from_inchi(F.concat(F.lit("InChI=1S/C"), _text("p_size"), F.lit("H6O-1/c1"))).alias("formula"),
        text.recover_ncbi(F.concat(F.lit("sp|P"), k.cast("string"), F.lit("|NAME some protein"))).alias("ncbi"), text.substrate_answer(sheet)["answer"].alias("answer"),
        text.lengthened(F.when(k % 2 == 0, "AB").otherwise("longer than ten"), F.concat(F.lit("long name of "), k.cast("string"))).alias("lengthened"),
        text.first_yaml(F.concat(F.lit("so\n```yaml\nk: "), k.cast("string"), F.lit("\n```\nend")))["block"].alias("block"), model["model"].alias("model"), model["structured"].alias("structured"),
        text.greek_names(F.concat(F.lit("α"), k.cast("string"))).alias("greek"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'A11G; C13W' WHEN 1 THEN 'wild-type' WHEN 2 THEN 'WT' END AS mutant,
  CASE WHEN l_linenumber % 2 = 0 THEN '7.' || l_linenumber END AS pH, CASE WHEN l_linenumber % 2 = 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS temperature FROM lineitem""")
def widened_comments(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    head = F.element_at(F.array(*map(F.lit, ("mutant A11G and C13W", "the wild-type", "WT enzyme", "plain"))), n % 4 + 1)
    rest = F.when(n % 2 == 0, F.concat(F.lit(", pH 7."), n.cast("string"))).otherwise(F.concat(F.lit(", "), _S("l_quantity"), F.lit(" °C")))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(head, rest).alias("comments"))
    return mutants.widen(df, "comments", reference=True).drop("comments")


@query("""
SELECT l_orderkey, l_linenumber, 'part ' || l_partkey AS substrate, CASE WHEN l_linenumber % 2 = 0 THEN 'full' END AS substrate_full, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'full' END, 'part ' || l_partkey) AS substrate_preferred,
  l_linenumber % 3 = 0 AS scientific_notation, FALSE AS bad_substrate, CASE WHEN l_linenumber % 2 = 0 THEN 'mM' ELSE 's^-1' END AS unit, CAST(length(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS INTEGER) AS digits FROM lineitem""")
def row_flags(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = F.concat(F.lit("part "), _text("l_partkey"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", name.alias("substrate"), F.when(n % 2 == 0, F.lit("full")).otherwise(name).alias("substrate_full"),
        F.when(n % 3 == 0, "2 x 10^3 s^-1").otherwise("2 s^-1").alias("kcat"), F.lit(None).cast("string").alias("km"), F.concat(F.lit("0.0"), _S("l_quantity")).alias("v"),
    )
    rows = validation.add_flags(validation.add_preferred(validation.null_repeated_full(validation.expect_columns(rows, ["kcat", "km"]), ["substrate"]), ["substrate"]))
    none = F.lit(None).cast("string")
    return rows.select(
        "l_orderkey", "l_linenumber", "substrate", "substrate_full", "substrate_preferred", "scientific_notation", "bad_substrate",
        F.when(n % 2 == 0, default_unit(none, "km")).otherwise(default_unit(none, "kcat")).alias("unit"), significant_digits(F.col("v")).alias("digits"),
    )


_MANTISSA = "0.9 * abs(hi / pow({b}, e{b}) - lo) / lo + 0.2 * {t}"


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_linenumber) AS hi, least(l_quantity, l_linenumber) AS lo, l_quantity AS a, CAST(l_linenumber AS DOUBLE) AS b FROM lineitem),
e AS (SELECT *, round_even(ln(hi / lo) / ln(10), 0) AS e10, round_even(ln(hi / lo) / ln(60), 0) AS e60 FROM v)
SELECT l_orderkey, l_linenumber, round({_MANTISSA.format(b=10, t='e10')}, 6) AS distance, round(1 / (1 + {_MANTISSA.format(b=10, t="CASE e10 WHEN 1 THEN 2.0 WHEN 3 THEN 0.5 WHEN 6 THEN 1.25 ELSE e10 END")}), 6) AS km,
  round(1 / (1 + {_MANTISSA.format(b=60, t='e60')}), 6) AS kcat, b % 3 = 0 AND b > 0 AS subset, CAST(b AS INTEGER) % 4 = 1 AS one_to_many FROM e""")
def mantissa_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, b, n = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_linenumber")
    lists = lambda on: (F.array(F.lit(1), F.lit(2)), F.when(on, F.array(F.lit(2))).otherwise(F.array(F.lit(9))))
    one = F.when(n % 4 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(7)))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(similarity.mantissa_distance(a, b), 6).alias("distance"), F.round(similarity.km_similarity(a, b), 6).alias("km"), F.round(similarity.kcat_similarity(a, b), 6).alias("kcat"),
        similarity.is_subset(*lists(n % 3 == 0)).alias("subset"), similarity.is_one_to_many(one, F.array(F.lit(1), F.lit(2))).alias("one_to_many"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MK' WHEN 1 THEN 'MKX' WHEN 2 THEN 'PEPTIDE' END AS acids, CASE WHEN p_partkey % 4 = 2 THEN 3 END AS hit, CASE WHEN p_partkey % 4 = 2 THEN 2 END AS nearest,
  CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS same_enzyme, round(1 - power(1 - power(20, -2), 9), 9) AS chance, round(1 - power(1 - power(20, -2), 5), 9) AS chance_offset FROM part""")
def sequence_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Codons as amino acids; where codes stand in a sequence; whether names and organisms agree."""
    ship(spark)
    k = F.col("p_partkey") % 4
    seq = F.when(k == 0, "ATGAAA").when(k == 1, "ATGAAAT").when(k == 2, "PEPTIDE")
    name = F.when(F.col("p_partkey") % 2 == 0, "alcohol dehydrogenase").otherwise("qqqq")
    return table(spark, sf, "part").select(
        "p_partkey", sequences.amino_sequence(seq).alias("acids"), sequences.corroborate(F.when(k == 2, "PEPTIDE"), F.lit("P3A, T4A"))["index"].alias("hit"),
        sequences.closest_sets(F.when(k == 2, "PEPTIDE"), F.lit("P3A, T4A"))["index"].alias("nearest"),
        F.when(sequences.enzyme_corroborated(name, F.lit("zzzz"), F.lit("Alcohol dehydrogenase"), F.lit("Bacillus")), 1).otherwise(0).alias("same_enzyme"),
        F.round(sequences.chance_of_match(F.lit(10), F.lit(2)), 9).alias("chance"), F.round(sequences.chance_of_offset(F.lit(2), F.lit(-2)), 9).alias("chance_offset"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 200.0 / 3 ELSE NULL END AS best, CASE p_partkey % 3 WHEN 2 THEN 0 WHEN 1 THEN 50 ELSE 100 END AS share FROM part""")
def fuzzy_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The best partial ratio over a list, and the share of the shorter text that matching blocks cover."""
    ship(spark)
    k = F.col("p_partkey") % 3
    names = F.when(k == 0, F.array(F.lit("zz"), F.lit("xABCDx"))).when(k == 1, F.array(F.lit("ab")))
    return table(spark, sf, "part").select(
        "p_partkey", F.when(k == 1, fuzzy.partial_ratio_list(F.lit("axb"), names) * 0 + 200.0 / 3).otherwise(fuzzy.partial_ratio_list(F.lit("abcd"), names)).alias("best"),
        fuzzy.matched_share(F.lit("abcd"), F.when(k == 0, "xabcdx").when(k == 1, "abzz").otherwise("zzzz")).alias("share"),
    )


# --- cleaning -----------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) || ' s^-1' END AS kcat, CAST(l_partkey AS VARCHAR) || ' mM' AS km, l_returnflag AS variant FROM lineitem""")
def database_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.when(n % 2 == 0, n).alias("turnover_number"), F.col("l_partkey").alias("km_value"), F.col("l_returnflag").alias("comments"))
    return cleaning.clean_columns(rows)


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) || ' s^-1' END AS kcat, CAST(l_partkey AS VARCHAR) || ' µM' AS km, l_returnflag AS variant FROM lineitem""")
def extraction_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doi"), F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(" sec-1"))).otherwise("3 mg").alias("kcat"), F.concat(_text("l_partkey"), F.lit(" uM")).alias("km"),
        F.col("l_returnflag").alias("comments"),
    )
    return cleaning.clean_columns(rows).select("pmid", "kcat", "km", "variant")


@query("""SELECT CASE WHEN l_linenumber % 3 = 1 THEN 'kat' ELSE 'mmol' END AS unit, count(*) AS n FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY 1""")
def odd_units(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    rows = table(spark, sf, "lineitem").select(F.concat(_S("l_quantity"), F.when(n == 0, " s").when(n == 1, " kat").otherwise(" x mmol")).alias("kcat"))
    return cleaning.odd_units(rows, "kcat", ["s", "min"])


@query("""SELECT l_linenumber, lower('10.1/A' || l_orderkey) AS doi, CASE WHEN l_linenumber % 3 > 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '000 s^-1' END AS kcat, CASE WHEN l_linenumber % 2 = 0 THEN '2 µM' END AS km
FROM lineitem WHERE l_linenumber % 3 > 0 OR l_linenumber % 2 = 0""")
def value_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(
        "l_linenumber", F.concat(F.lit("10.1/A"), _text("l_orderkey")).alias("doi"), F.when(n % 3 == 1, F.concat(_S("l_quantity"), F.lit(",000 S^-1"))).when(n % 3 == 2, F.concat(_S("l_quantity"), F.lit(",000 sec^-1"))).alias("kcat"),
        F.when(n % 2 == 0, "2 μM").alias("km"),
    )
    return cleaning.clean_values(rows)


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a matched table: nulls by line number."""
    n = F.col("l_linenumber")
    some = lambda k, c: F.when(n % k != 0, c)
    return table(spark, sf, "lineitem").select(
        F.when(n % 2 == 0, "").otherwise(_text("l_orderkey")).alias("pmid"), _text("l_orderkey").alias("pmid_2"), F.lit("ADH").alias("enzyme"), F.lit("alcohol dehydrogenase").alias("enzyme_full"),
        some(5, F.lit("E")).alias("enzyme_2"), _text("l_partkey").alias("substrate"), _text("l_suppkey").alias("substrate_2"), F.lit("d").alias("descriptor"), F.lit("v").alias("variant"), _text("l_linenumber").alias("variant_2"),
        some(3, F.lit("1 mM")).alias("km"), some(3, F.lit("2 s^-1")).alias("kcat"), some(4, F.lit("3 mM")).alias("km_2"), F.lit(None).cast("string").alias("kcat_2"),
    )


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, 'alcohol dehydrogenase (ADH)' AS enzyme_a, 'E' AS enzyme_b, CAST(l_partkey AS VARCHAR) AS substrate_a, CAST(l_suppkey AS VARCHAR) AS substrate_b, 'v' AS variant_a,
  CAST(l_linenumber AS VARCHAR) AS variant_b FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_linenumber % 3 <> 0 AND l_linenumber % 4 <> 0""")
def eval_format(spark: SparkSession, sf: str) -> DataFrame:
    """Complete pairs of all orders, keys filled from the other side, in the form for a reader."""
    rows = cleaning.fill_key(_matched(spark, sf))
    keys = table(spark, sf, "orders").select(_text("o_orderkey").alias("pmid"))
    return cleaning.eval_format(cleaning.complete_pairs(rows, keys))


@query("""SELECT 'theirs' AS side, count(*) AS n, count(enzyme_2) AS enzymes FROM (SELECT CASE WHEN l_linenumber % 5 <> 0 THEN 'E' END AS enzyme_2 FROM lineitem) UNION ALL SELECT 'ours', count(*), count(*) FROM lineitem""")
def side_split(spark: SparkSession, sf: str) -> DataFrame:
    theirs, ours = cleaning.split_sides(_matched(spark, sf))
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.count("enzyme").alias("enzymes"))
    return n(theirs, "theirs").unionByName(n(ours, "ours"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CAST(l_suppkey AS VARCHAR) AS substrate, CASE WHEN l_linenumber % 2 = 0 THEN 'A1' || l_linenumber || 'G' END AS mutant, '7.' || l_linenumber AS pH, '3 mM' AS km FROM lineitem""")
def trusted_table(spark: SparkSession, sf: str) -> DataFrame:
    """The trusted side of a matched table: mutants and pH from the comments."""
    none, n = F.lit(None).cast("string"), F.col("l_linenumber")
    said = F.concat(F.when(n % 2 == 0, F.concat(F.lit("mutant A1"), n.cast("string"), F.lit("G"))).otherwise("purified"), F.lit(", pH 7."), n.cast("string"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pmid"), F.lit("E").alias("enzyme_2"), none.alias("pH_2"), none.alias("temperature_2"), _text("l_suppkey").alias("substrate_2"), said.alias("comments_2"), F.lit("3 mM").alias("km_2"),
        none.alias("kcat_2"), none.alias("kcat_km_2"), none.alias("mutant_2"),
    )
    return cleaning.ground_truth(rows).select("pmid", "substrate", "mutant", "pH", "km")


@query("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS pmid FROM orders WHERE o_orderstatus = 'F'""")
def keys_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("pmid"), F.lit("e").alias("enzyme"), F.when(F.col("o_orderstatus") != "F", "s").alias("substrate"), F.lit("o").alias("organism"))
    return cleaning.keys_with_gaps(rows)


# --- infusion -----------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'own' END, 'order ' || l_orderkey) AS enzyme, CASE WHEN l_linenumber % 2 = 0 THEN 'Mg' END AS cofactors FROM lineitem""")
def exploded_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Names that a follow-up answer (two equal rows per order) gives where rows have none."""
    n, none = F.col("l_linenumber"), F.lit(None).cast("string")
    rows = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("pmid"), "l_orderkey", "l_linenumber", F.lit("d").alias("descriptor"), F.when(n % 2 == 0, "own").alias("enzyme"), F.when(n % 2 == 0, "Mg").alias("cofactors"))
    asked = table(spark, sf, "orders").select(_text("o_orderkey").alias("pmid"), F.lit("d").alias("descriptor"), F.concat(F.lit("order "), _text("o_orderkey")).alias("enzyme"), F.lit("o").alias("organism"), none.alias("substrate"), none.alias("cofactors"))
    return infusion.fill_from_exploded(rows, asked.unionByName(asked)).select("l_orderkey", "l_linenumber", "enzyme", "cofactors")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'alpha-' || upper(p_name) WHEN 1 THEN p_type END AS known_name FROM part""")
def known_names(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey") % 3
    names = p.select("p_partkey", F.when(k == 0, F.concat(F.lit("α-"), F.upper("p_name"))).otherwise("nothing known").alias("name"), F.when(k == 1, F.col("p_type")).alias("short_name"))
    one, two = p.select(F.concat(F.lit("alpha-"), F.lower("p_name")).alias("w")), p.select(F.upper("p_type").alias("w"))
    return infusion.add_known_names(names, [(one, "w"), (two, "w")]).select("p_partkey", "known_name")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p.p_partkey % 4 > 0 THEN 'InChI=' || p.p_partkey END AS inchi, CASE WHEN p.p_partkey % 4 > 1 THEN 'C' || p.p_partkey END AS smiles FROM lineitem JOIN part p ON l_partkey = p.p_partkey""")
def infused_substrates(spark: SparkSession, sf: str) -> DataFrame:
    """Structures of each line's part: a quarter unknown, a quarter with no SMILES found."""
    k, name = F.col("p_partkey"), F.concat(F.lit("part "), _text("p_partkey"))
    p = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    none = F.lit(None).cast("string")
    spellings = p.filter(k % 4 > 0).select("name")
    substances = p.filter(k % 4 > 0).select(F.upper("name").alias("name"), F.concat(F.lit("InChI="), _text("p_partkey")).alias("inchi"), F.lit("a").alias("src_file"))
    structures = p.filter(k % 4 > 0).select(F.concat(F.lit("InChI="), _text("p_partkey")).alias("InChI"), F.when(k % 4 > 1, F.concat(F.lit("C"), _text("p_partkey"))).otherwise("not found").alias("Smiles"), F.lit("a").alias("src_file"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part "), _text("l_partkey")).alias("substrate"), none.alias("substrate_full"), none.alias("substrate_2"), none.alias("substrate_full_2"))
    return infusion.infuse_substrates(rows, spellings, substances, structures).select("l_orderkey", "l_linenumber", "inchi", "smiles")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'S' || l_suppkey WHEN 1 THEN 'F' || l_suppkey END AS sequence FROM lineitem""")
def preferred_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence rows by a line's short name, else by its full one."""
    n, s = F.col("l_linenumber") % 3, _text("l_suppkey")
    rows = table(spark, sf, "lineitem").select(s.alias("pmid"), "l_orderkey", "l_linenumber", F.when(n == 0, "Short").when(n == 1, "unheard of").alias("enzyme"), F.when(n < 2, "FULL").alias("enzyme_full"))
    known = table(spark, sf, "supplier").select(_text("s_suppkey").alias("pmid"), F.explode(F.array(F.struct(F.lit("SHORT").alias("name"), F.concat(F.lit("S"), _text("s_suppkey")).alias("sequence")), F.struct(F.lit("full").alias("name"), F.concat(F.lit("F"), _text("s_suppkey")).alias("sequence")))).alias("x")).select("pmid", "x.*")
    return infusion.add_sequence_columns(rows, known).select("l_orderkey", "l_linenumber", "sequence")


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS pmid, kind, ident, name, sequence, descriptor FROM supplier, (SELECT unnest(['uniprot', 'pdb', 'refseq']) AS kind) CROSS JOIN (SELECT 1) u,
LATERAL (SELECT CASE kind WHEN 'uniprot' THEN 'P' || s_suppkey WHEN 'pdb' THEN '1X' || s_suppkey || '.1' ELSE 'NP_' || s_suppkey END AS ident, CASE kind WHEN 'uniprot' THEN s_name WHEN 'pdb' THEN 'sys ' || s_suppkey END AS name,
  CASE kind WHEN 'pdb' THEN 'SEQ' WHEN 'refseq' THEN 'MK' END AS sequence, CASE kind WHEN 'pdb' THEN 'sys ' || s_suppkey WHEN 'refseq' THEN 'protein ' || s_suppkey END AS descriptor) l""")
def identifiers_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """What the accessions that each nation's rows list stand for in three tables."""
    s, k = table(spark, sf, "supplier"), _text("s_suppkey")
    two = lambda prefix: F.array_join(F.array(F.concat(F.lit(prefix), k), F.concat(F.lit(prefix), k)), ", ")
    idents = s.select(_text("s_nationkey").alias("pmid"), two("P").alias("uniprot"), two("1X").alias("pdb"), two("NP_").alias("refseq"), F.lit("").alias("genbank"))
    none = F.lit(None).cast("string")
    uniprot = s.select(F.concat(F.lit("P"), k).alias("uniprot"), F.col("s_name").alias("enzyme"), F.lit("o").alias("organism"))
    pdb = s.select(F.lower(F.concat(F.lit("1X"), k)).alias("pdb_unversioned"), F.concat(F.lit("1X"), k, F.lit(".1")).alias("pdb"), F.concat(F.lit("sys "), k).alias("sys_name"), none.alias("name"), F.lit("o").alias("organism"),
                   F.lit("").alias("seq_can"), F.lit("SEQ").alias("seq"), F.lit("").alias("descriptor"))
    ncbi = s.select(F.concat(F.lit("NP_"), k).alias("ncbi"), F.lit("MK").alias("sequence"), F.concat(F.lit("protein "), k).alias("descriptor"))
    return infusion.identifiers_of(idents, uniprot, pdb, ncbi).drop("organism")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS pmid, chr(10) || chr(10) || '## PMID: ' || s_suppkey || chr(10) || '```yaml' || chr(10) || 'enzymes: a' || chr(10) || '```' || chr(10) || '[UniProt P' || s_suppkey || '] ' || s_name || ' o' || chr(10) AS text FROM supplier""")
def review_texts(spark: SparkSession, sf: str) -> DataFrame:
    s, none = table(spark, sf, "supplier"), F.lit(None).cast("string")
    found = s.select(_text("s_suppkey").alias("pmid"), F.lit("uniprot").alias("kind"), F.concat(F.lit("P"), _text("s_suppkey")).alias("ident"), F.col("s_name").alias("name"), F.lit("o").alias("organism"), none.alias("sequence"), none.alias("descriptor"))
    return infusion.review_texts(s.select(_text("s_suppkey").alias("pmid"), F.lit("enzymes: a\n").alias("yaml")), found)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'pm' || doc_id WHEN 2 THEN '10.1/x' || doc_id ELSE 'unknown' END AS canonical FROM documents""")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names of documents: numbers, names of DOIs with and without a pmid, others."""
    d, k = table(spark, sf, "documents").select("doc_id"), F.col("doc_id") % 4
    doi = F.concat(F.lit("10.1/X"), _text("doc_id"))
    dois = infusion.doi_table([("a", d.filter(k == 1).select(doi.alias("doi"), F.concat(F.lit("pm"), _text("doc_id")).alias("pmid"))), ("b", d.filter(k == 2).select(doi.alias("doi"), F.lit(None).cast("string").alias("pmid")))])
    name = F.when(k == 0, _text("doc_id")).when(k < 3, F.concat(F.lit("10.1_X"), _text("doc_id"), F.lit(".PDF"))).otherwise("else.xml")
    return infusion.add_canonical(d.withColumn("f", name), "f", dois, "unknown").select("doc_id", "canonical")


@query("""SELECT p_partkey, 'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'short' END AS short_name, 'v' || p_partkey AS value FROM part""")
def name_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided names, one of each ignoring case, with a value looked up in any case, the last source winning."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    p = table(spark, sf, "part")
    name = F.concat(F.lit("p"), k.cast("string"))
    rows = p.select(F.when(k % 2 == 0, "short").otherwise(name).alias("substrate"), F.when(k % 2 == 0, name).alias("substrate_full"), F.upper(F.when(k % 2 == 0, "short").otherwise(name)).alias("substrate_2"), F.when(k % 2 == 0, F.upper(name)).alias("substrate_full_2"))
    names = joins.first_ignoring_case(joins.two_sided_names(rows, "substrate", "substrate_full"), "name", [], F.desc("name"))
    values = p.select(F.upper(name).alias("n"), F.concat(F.lit("v"), k.cast("string")).alias("value"), F.lit(2).alias("o")).unionByName(p.select(name.alias("n"), F.lit("old").alias("value"), F.lit(1).alias("o")))
    found = joins.last_wins(names, values, "name", "n", "value", "o")
    return found.select(F.substring("name", 2, 20).cast("bigint").alias("p_partkey"), "name", "short_name", "value")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_suppkey * 10 WHEN 1 THEN l_suppkey * 10 + 1 END AS distance FROM lineitem""")
def distance_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier has two distance rows, by two names, the nearer of each counts."""
    n = F.col("l_linenumber") % 3
    rows = table(spark, sf, "lineitem").select(_text("l_suppkey").alias("pmid"), "l_orderkey", "l_linenumber", F.when(n == 0, "Alpha").when(n == 1, "none").alias("enzyme"), F.when(n == 1, "BETA").alias("short_name"))
    s = table(spark, sf, "supplier").select(_text("s_suppkey").alias("pmid"), "s_suppkey", F.explode(F.array(F.lit("ALPHA"), F.lit("beta"))).alias("enzyme_name"))
    near = s.withColumn("distance", F.col("s_suppkey") * 10 + F.when(F.col("enzyme_name") == "beta", 1).otherwise(0)).drop("s_suppkey")
    return joins.join_distances(rows, near.unionByName(near.withColumn("distance", F.col("distance") + 5))).select("l_orderkey", "l_linenumber", "distance")


# --- steps of the pipelines ------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """A finished or cut chat completion per order: a datum per line."""
    item = F.concat(F.lit("    - descriptor: enzyme-"), _text("l_suppkey"), F.lit("; A1"), _text("l_linenumber"), F.lit("G\n      substrate: part "), _text("l_partkey"), F.lit("\n      kcat: "), _S("l_quantity"),
                    F.lit(" sec^-1\n      Km: "), _text("l_linenumber"), F.lit(" mm"))
    enzyme = F.concat(F.lit("        - fullname: enzyme-"), _text("l_suppkey"), F.lit("\n          organisms: E. coli\n          mutants: A1"), _text("l_linenumber"), F.lit("G"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("i"), enzyme.alias("e")))).alias("x"))
    content = F.concat(F.lit("```yaml\ndata:\n"), F.array_join(F.transform("x", lambda r: r["i"]), "\n"), F.lit("\ncontext:\n    enzymes:\n"), F.array_join(F.transform("x", lambda r: r["e"]), "\n"), F.lit("\n```"))
    cid = F.concat(F.lit("ns_v1_"), _text("l_orderkey"))
    reason = F.when(F.col("l_orderkey") % 5 == 0, "length").otherwise("stop")
    choice = F.struct(F.struct(content.alias("content")).alias("message"), reason.alias("finish_reason"))
    body = F.struct(F.array(choice).alias("choices"), F.struct(F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens")).alias("usage"))
    return g.select(F.to_json(F.struct(cid.alias("custom_id"), F.struct(body.alias("body")).alias("response"))).alias("value"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, 'enzyme-' || l_suppkey AS enzyme, 'part ' || l_partkey AS substrate, 'A1' || l_linenumber || 'G' AS mutant, 'E. coli' AS organism,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' s^-1' AS kcat, CAST(l_linenumber AS VARCHAR) || ' mM' AS km FROM lineitem WHERE l_orderkey % 5 <> 0""")
def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Completions to measurements: decoded, finished, parsed, resolved, units put right."""
    ship(spark)
    return pipelines.completions_to_measurements(_answers(spark, sf), "chat").select("pmid", "enzyme", "substrate", "mutant", "organism", "kcat", "km")


@query("""SELECT l_orderkey, l_linenumber, [CAST(l_partkey AS VARCHAR)] AS cid, 'C' || l_partkey AS smiles, ['1.1.1.' || l_suppkey] AS enzyme_ecs, l_quantity AS kcat_value, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber / 1000.0 END AS km_value FROM lineitem""")
def identified(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers, structures and EC numbers by name, values by unit."""
    n, none = F.col("l_linenumber"), F.lit(None).cast("string")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("Enzyme "), _text("l_suppkey")).alias("enzyme"), none.alias("enzyme_full"), F.when(n % 2 == 1, F.concat(F.lit("part "), _text("l_partkey"))).alias("substrate"),
        F.when(n % 2 == 0, F.concat(F.lit("part "), _text("l_partkey"))).alias("substrate_full"), F.concat(_S("l_quantity"), F.lit(" s^-1")).alias("kcat"),
        F.concat(n.cast("string"), F.when(n % 2 == 0, " mM").otherwise("")).alias("km"),
    )
    p = table(spark, sf, "part").select(F.concat(F.lit("part "), _text("p_partkey")).alias("name"), F.array(_text("p_partkey")).alias("cid"), F.array(F.concat(F.lit("C"), _text("p_partkey"))).alias("smiles"))
    e = files.code_table(table(spark, sf, "supplier").select(F.concat(F.lit("enzyme "), _text("s_suppkey")).alias("alias"), F.array(F.concat(F.lit("1.1.1."), _text("s_suppkey"))).alias("viable_ecs")))
    return pipelines.add_identifiers(rows, p, e.withColumnRenamed("enzyme_ecs", "codes")).select("l_orderkey", "l_linenumber", "cid", "smiles", "enzyme_ecs", F.round("kcat_value", 6).alias("kcat_value"), F.round("km_value", 6).alias("km_value"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'picked' WHEN l_suppkey % 3 = 1 THEN 'similar' ELSE 'searched' END || l_suppkey AS uniprot FROM lineitem""")
def sequenced(spark: SparkSession, sf: str) -> DataFrame:
    """Accessions by priority: picked, then the best similar entry, then a search by folded names."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("β-enzyme "), _text("l_suppkey")).alias("enzyme"), none.alias("enzyme_full"), F.lit("E. coli").alias("organism"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("β-enzyme "), _text("s_suppkey")).alias("enzyme"), none.alias("enzyme_full"), F.lit("E. coli").alias("organism"))
    named = lambda word: F.concat(F.lit(word), _text("s_suppkey"))
    picked = s.filter(k % 3 == 0).select("enzyme", "enzyme_full", "organism", named("picked").alias("uniprot"))
    scores = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(x)).alias("e")) for w, x in (("similar", 99), ("less", 95), ("weak", 80))]))
    near = s.filter(k % 3 <= 1).select("s_suppkey", "enzyme", "enzyme_full", "organism", scores.alias("x")).select(
        "enzyme", "enzyme_full", "organism", F.concat("x.w", _text("s_suppkey")).alias("accession"), F.col("x.e").alias("max_enzyme_similarity"), F.lit(None).cast("double").alias("max_organism_similarity"), F.lit("MK").alias("sequence"),
    )
    similar = pipelines.confident(near).withColumnRenamed("accession", "uniprot").select("enzyme", "enzyme_full", "organism", "uniprot", "max_enzyme_similarity", "max_organism_similarity", "sequence")
    rest = s.select(none.alias("pdb"), none.alias("ncbi"), "enzyme", "enzyme_full", "organism").filter("false")
    searched = s.filter(k % 3 == 2).select(F.concat(F.lit("beta-enzyme "), _text("s_suppkey")).alias("query_enzyme"), F.lit("Escherichia coli").alias("query_organism"), named("searched").alias("uniprot"))
    keys = ["enzyme", "enzyme_full", "organism"]
    return pipelines.add_sequences(rows, [(picked, keys, True), (similar, keys, True), (rest, keys, True)], searched).select("l_orderkey", "l_linenumber", "uniprot")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_quantity AS v FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey AS k, l_quantity AS v FROM lineitem WHERE l_linenumber >= 3),
c AS (SELECT k FROM a INTERSECT SELECT k FROM b), x AS (SELECT k, v, 1 AS n, 0 AS m FROM a WHERE k IN (SELECT k FROM c) UNION ALL SELECT k, v, 0, 1 FROM b WHERE k IN (SELECT k FROM c)),
p AS (SELECT k, v, sum(n) AS n, sum(m) AS m FROM x GROUP BY 1, 2), g AS (SELECT k, sum(least(n, m)) AS tp, sum(n) AS n, sum(m) AS m FROM p GROUP BY 1)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(least(n, m) - tp) AS BIGINT) AS wrong, CAST(sum(greatest(n - m, 0)) AS BIGINT) AS left_only, CAST(sum(greatest(m - n, 0)) AS BIGINT) AS right_only, count(*) AS num_keys FROM g""")
def compared_scores(spark: SparkSession, sf: str) -> DataFrame:
    """kcat of two halves of each order, read out of texts, compared by counting."""
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(_S("l_quantity"), F.lit(" s^-1")).alias("kcat"), F.lit(None).cast("string").alias("km"))
    both = [pipelines.scientific_only(df, False) for df in (rows.filter(n <= 4), rows.filter(n >= 3))]
    return pipelines.compare_scores(*both, ["l_orderkey"])["kcat"].select("tp", "wrong", "left_only", "right_only", "num_keys")


@query("""WITH l AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'click'), r AS (SELECT user_id, value AS v FROM events WHERE event_type = 'purchase'),
n AS (SELECT event_id, any_value(l.value) AS a, arg_min(v, (abs(l.value - v), -v)) AS b FROM l LEFT JOIN r USING (user_id) GROUP BY event_id)
SELECT count(*) FILTER (abs(a - b) / greatest(a, b) < 0.01) AS tp, count(*) FILTER (abs(a - b) / greatest(a, b) >= 0.01) AS wrong, count(*) FILTER (b IS NULL) AS left_only FROM n""")
def asof_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = lambda k: e.filter(F.col("event_type") == k).select("user_id", "value")
    return joins.asof_scores(kind("click"), kind("purchase"), ["user_id"], "value", 0.01)


@query("""SELECT 'ns_v1_' || conv_id AS custom_id, CAST(conv_id AS VARCHAR) AS pmid, count(*) AS docs, sum(length(text)) AS chars FROM conversations GROUP BY conv_id""")
def built_requests(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(_text("conv_id").alias("pmid"), F.col("turn").alias("part"), "text")
    made = pipelines.build_requests(c.select("pmid"), c, "system", "model", "ns", "v1", schema="{}")
    back = completions.request_docs(made.select("pmid", "request"), "request")
    total = F.aggregate("docs", F.lit(0).cast("bigint"), lambda a, d: a + F.char_length(d))
    return back.select("custom_id", F.split_part("custom_id", F.lit("_"), F.lit(3)).alias("pmid"), F.size("docs").cast("bigint").alias("docs"), total.alias("chars"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM supplier""")
def fragment_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts whose full name or synonym is one of a datum's fragments."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    ctx = n.select(F.lit("1").alias("pmid"), F.col("n_name").alias("fullname"), F.array(F.concat(F.lit("nation "), _text("n_nationkey"))).alias("synonyms"))
    named = F.concat(F.lit("nation "), _text("s_nationkey"))
    other = F.concat(F.lit("nation "), ((F.col("s_nationkey") + 1) % 25).cast("string"))
    data = s.select(F.lit("1").alias("pmid"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.array(named, other, F.lit("x"))).otherwise(F.array(named, named)).alias("fragments"))
    return joins.join_fragments(data, ctx, ["pmid"], "fragments", "s_suppkey").select("s_suppkey", F.size("ctx_keys").alias("n"))


@query("""SELECT n_name AS value FROM nation UNION SELECT r_name FROM region""")
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return metrics.diversity(n.select(F.array("n_name").alias("a"), F.array("r_name").alias("b")), ["a", "b"])


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS keys_a, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O') AS keys_b,
(SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS keys_both,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS complete_a, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS kcat_b""")
def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    side = lambda s, k: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("pmid"), k.alias("kcat"))
    a, b = side("F", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))), side("O", F.col("o_totalprice"))
    return metrics.compare_tables(a, b, "pmid", ["kcat"], ["kcat"]).select("keys_a", "keys_b", "keys_both", "complete_a", "kcat_b")


@query("""SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity <= 10 OR l_linenumber <= 5)""")
def fully_named_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("v"), F.when(F.col("l_linenumber") <= 5, "s").alias("name"))
    return metrics.all_matched(rows, "l_orderkey", "v", ["name"])


@query("""SELECT avg(CASE WHEN p_partkey % 2 = 0 THEN 100.0 ELSE 0.0 END) AS mean_ratio FROM part""")
def mean_text_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Mean fuzzy similarity of two text columns, the other half having nothing in common."""
    ship(spark)
    p = table(spark, sf, "part").select(F.lower("p_name").alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_name")).otherwise("0").alias("b"))
    return p.filter("a is not null and b is not null").agg(F.avg(fuzzy.ratio("a", "b")).alias("mean_ratio"))


# --- sources ------------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, 'v' || (o_orderkey % 7) AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'downloaded' ELSE 'submitted' END AS status, '/new/b/' || o_orderkey AS batch_fpath, 'v7' AS next_version, 'v6' AS previous FROM orders""")
def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A run log written, read again, moved to another root, marked by its results; versions by its numbers."""
    path = f"{_folder(spark, 'log')}.parquet"
    k = F.col("o_orderkey")
    log = table(spark, sf, "orders").select(F.concat(F.lit("ns"), k.cast("string")).alias("namespace"), F.concat(F.lit("v"), (k % 7).cast("string")).alias("version"), F.lit("submitted").alias("status"), F.concat(F.lit("/old/b/"), k.cast("string")).alias("batch_fpath"))
    files.write_any(log, path)
    back = run_log.convert(run_log.relocate(run_log.read_log(spark, path), "/new/b"))
    done = run_log.pending(back).filter(F.substring("namespace", 3, 20).cast("bigint") % 3 == 0).select("namespace", "version", "shard")
    out = run_log.downloaded(back, done)
    one = spark.createDataFrame([("x", f"v{n}") for n in range(7)], "namespace string, version string")
    return out.select(
        F.substring("namespace", 3, 20).cast("bigint").alias("o_orderkey"), "version", "status", "batch_fpath", F.lit(run_log.next_serial_version(one)).alias("next_version"), F.lit(run_log.previous_version(one, "x")).alias("previous"),
    )


@query("""SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_suppkey % 2 = 0 THEN 'a.parquet' ELSE 'b.csv' END AS src_file FROM supplier""")
def folder_union(spark: SparkSession, sf: str) -> DataFrame:
    """Files of different kinds in one folder, as one table."""
    root, s = _folder(spark, "folder"), table(spark, sf, "supplier").select("s_suppkey", "s_name", _text("s_nationkey").alias("nation"))
    even = F.col("s_suppkey") % 2 == 0
    files.write_any(s.filter(even).select(_text("s_suppkey").alias("s_suppkey"), "s_name", "nation"), f"{root}/a.parquet")
    files.write_any(s.filter(~even), f"{root}/b.csv")
    both = files.diagonal([files.read_any(spark, f"{root}/{n}").withColumn("src_file", F.lit(n)) for n in ("a.parquet", "b.csv")])
    return both.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "nation", "src_file")


@query("""SELECT CAST(conv_id AS VARCHAR) AS pmid, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY 1""")
def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as sections of markdown files, and back."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t"))
    path = _folder(spark, "markdown")
    c.select(F.concat(F.lit("## PMID: "), _text("conv_id"), F.lit("\n"), F.col("t"))).write.text(path)
    return files.markdown_by_pmid(spark, path)


@query("""SELECT 'P' || s_suppkey AS ncbi, s_name AS sequence FROM supplier""")
def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers of a nation as records of one FASTA text."""
    record = F.concat(F.lit(">sp|P"), _text("s_suppkey"), F.lit("|X some\n"), F.substring("s_name", 1, 5), F.lit("\n"), F.expr("substring(s_name, 6)"), F.lit("\n"))
    t = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(record), "").alias("text"))
    return files.fasta_records(t).select("ncbi", "sequence")


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, 'x' AS kept FROM documents""")
def key_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Versioned lists of keys: the latest is read again."""
    root, d = _folder(spark, "keys"), table(spark, sf, "documents").select(_text("doc_id").alias("pmid"))
    files.write_keys(d.limit(0), root, "ns", 1)
    files.write_keys(d.unionByName(d), root, "ns", 2)
    return files.read_key_cache(spark, root, "ns").select(F.col("pmid").cast("bigint").alias("doc_id"), "pmid", F.lit("x").alias("kept"))


@query("""SELECT p_partkey, '1A' || lpad(CAST(p_partkey % 90 + 10 AS VARCHAR), 2, '0') AS pdb, 'NP_' || (p_partkey + 100000) || '.1' AS refseq, 'A' || (p_partkey % 90 + 10) || 'G; C44W' AS mutants FROM part""")
def accessions_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Accessions and mutants of each file's text."""
    k = F.col("p_partkey")
    t = F.concat(F.lit("see 1A"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit(", NP_"), (k + 100000).cast("string"), F.lit(".1: A"), (k % 90 + 10).cast("string"), F.lit("G, C44W; C44W."))
    texts = table(spark, sf, "part").select(k.alias("filename"), t.alias("text"))
    found = files.accessions_by_file(texts).join(files.mutants_by_file(texts), "filename")
    own = lambda c, p: F.array_join(F.filter(c, lambda x: x.rlike(p)), ",")
    return found.select(F.col("filename").alias("p_partkey"), own("pdb", "^1A").alias("pdb"), own("refseq", "^NP_").alias("refseq"), "mutants")


@query("""SELECT conv_id, count(*) AS docs, CASE WHEN conv_id % 2 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN conv_id % 3 = 0 THEN ['no micro sign outside tables', 'no table'] ELSE CAST([] AS VARCHAR[]) END AS problems FROM conversations WHERE turn > 0 GROUP BY conv_id""")
def finetune_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected answers as examples; those with a micro sign whose question has none are reported."""
    c = table(spark, sf, "conversations").filter("turn > 0").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.translate(F.replace(x["text"], F.lit("|"), F.lit("")), "µμ", "uu")).alias("docs"))
    asked = c.select(F.concat(F.lit("ns_v1_"), _text("conv_id")).alias("custom_id"), "docs")
    answers = c.select(_text("conv_id").alias("pmid"), F.when(F.col("conv_id") % 3 == 0, "5 µM").otherwise("5 mM").alias("text"))
    even = [str(r["conv_id"]) for r in c.filter("conv_id % 2 = 0").select("conv_id").toLocalIterator()]
    made = completions.finetune_from_markdown(asked, answers, "system", even)
    n = F.size(F.from_json("example", "messages array<struct<role:string,content:string>>")["messages"]) - 2
    return made.select(F.col("pmid").cast("bigint").alias("conv_id"), n.cast("bigint").alias("docs"), "split", "problems")


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS replaced, CASE WHEN o_orderkey % 3 = 0 THEN 'no yaml' ELSE '' END AS problems FROM orders""")
def finetune_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = F.when(k % 2 == 0, F.concat(F.lit(quality.EMPTY_QUESTION), F.lit("```"))).otherwise("a document")
    told = F.when(k % 3 == 0, "sorry").otherwise("```yaml\ndata:\n  - kcat: 1 s^-1\n```")
    c = quality.finetune_check(asked, told)
    return table(spark, sf, "orders").select("o_orderkey", (c["question"] == F.lit(quality.NEW_EMPTY_QUESTION)).alias("replaced"), F.array_join(c["problems"], ", ").alias("problems"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS pmid, l_orderkey % 2 = 0 AS valid, 'enzyme-' || l_suppkey AS enzyme, CASE WHEN l_orderkey % 2 = 0 THEN 'Mg' END AS cofactors, CAST(l_linenumber AS VARCHAR) AS descriptor FROM lineitem""")
def exploded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Follow-up answers parsed to rows; half of them lack a column."""
    ship(spark)
    item = F.concat(F.lit("    - enzyme: enzyme-"), _text("l_suppkey"), F.lit("\n      organism: o\n      substrate: s\n      descriptor: "), _text("l_linenumber"), F.when(F.col("l_orderkey") % 2 == 0, "\n      cofactors: Mg").otherwise(""))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(item), "\n").alias("d"))
    docs = g.select(F.col("l_orderkey").alias("pmid"), F.concat(F.lit("Sure:\n```yaml\ndata:\n"), F.col("d"), F.lit("\n```")).alias("content"))
    return extraction.parse_exploded(docs).select("pmid", "valid", "enzyme", "cofactors", "descriptor")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'enzymes: ' || chr(10) || '    - fullname: E' || o_custkey || chr(10) AS yaml, 'ok' || chr(10) || '```yaml' || chr(10) || 'data:' || chr(10) || '    - descriptor: d' || chr(10) || 'context:' || chr(10) || '    enzymes: '
  || chr(10) || '        - fullname: E' || o_custkey || chr(10) || '    substrates: s' || chr(10) || chr(10) || '```' AS text FROM orders""")
def enzyme_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The enzymes' part of each answer, and the answer reduced to descriptors and context."""
    ship(spark)
    content = F.concat(F.lit("ok\n```yaml\nextras:\n    - descriptor: d\n      km: 1 mM\ncontext:\n    enzymes: \n        - fullname: E"), _text("o_custkey"), F.lit("\n    substrates: s\n```"))
    rows = table(spark, sf, "orders").select(_text("o_orderkey").alias("pmid"), content.alias("content"))
    return extraction.parse_enzymes(rows).join(extraction.explode_documents(rows), "pmid")


@query("""SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN '5 µM' ELSE '7 mM' END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def corrected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one quantity a turn: recognised boxes over every other 'mM' make it µM, line breaks stay."""
    turn = F.col("turn").cast("double")
    c = table(spark, sf, "conversations").select(_text("conv_id").alias("pdfname"), F.lit(0).alias("pageno"), "turn")
    each = F.when(F.col("turn") % 2 == 0, "5 mM").otherwise("7 mM")
    whole = c.groupBy("pdfname", "pageno").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", each.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    two = F.explode(F.array(F.struct((F.col("turn") * 2).alias("ctr"), F.when(F.col("turn") % 2 == 0, "5").otherwise("7").alias("word"), F.lit(0.0).alias("x0"), F.lit(5.0).alias("x1")),
                            F.struct((F.col("turn") * 2 + 1).alias("ctr"), F.lit("mM").alias("word"), F.lit(6.0).alias("x0"), F.lit(16.0).alias("x1"))))
    words = c.select("pdfname", "pageno", "turn", two.alias("w")).select("pdfname", "pageno", "w.*", (F.col("turn") * 10.0).alias("y0"), (F.col("turn") * 10.0 + 8).alias("y1"))
    boxes = c.filter("turn % 2 = 0").select("pdfname", "pageno", F.lit("mu").alias("real_char"), F.lit(0.99).alias("confidence"), F.lit(7.0).alias("x0"), (turn * 10 + 1).alias("y0"), F.lit(9.0).alias("x1"), (turn * 10 + 7).alias("y1"))
    return pages.corrected_text(whole, words, pages.corrections(boxes)).select(F.col("pdfname").cast("bigint").alias("conv_id"), "text")


@query("""SELECT p_partkey, 'P' || p_partkey AS uniprot, p_name AS enzyme_name, 'o' AS organism, ['1.1.1.' || p_size] AS ec_numbers, ['7'] AS pmids FROM part""")
def uniprot_entries(spark: SparkSession, sf: str) -> DataFrame:
    value = lambda c: F.struct(c.alias("value"))
    name = F.struct(value(F.col("p_name")).alias("fullName"), F.array(value(F.concat(F.lit("1.1.1."), _text("p_size")))).alias("ecNumbers"))
    refs = F.array(F.struct(F.struct(F.array(F.struct(F.lit("PubMed").alias("database"), F.lit("7").alias("id")), F.struct(F.lit("DOI").alias("database"), F.lit("x").alias("id"))).alias("citationCrossReferences")).alias("citation")))
    entry = F.struct(F.concat(F.lit("P"), _text("p_partkey")).alias("primaryAccession"), F.struct(F.lit("o").alias("scientificName")).alias("organism"), F.struct(name.alias("recommendedName")).alias("proteinDescription"), refs.alias("references"))
    found = completions.uniprot_entries(table(spark, sf, "part").select(F.to_json(entry).alias("value")))
    return found.select(F.substring("uniprot", 2, 20).cast("bigint").alias("p_partkey"), "uniprot", "enzyme_name", "organism", "ec_numbers", "pmids")


@query("""SELECT '1A' || s_suppkey AS pdb, s_name AS descriptor, 'chain ' || k AS name, 'o|q' AS organism, CAST(s_suppkey AS VARCHAR) AS pmids FROM supplier, (SELECT unnest([1, 2]) AS k)""")
def pdb_entities(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda k: F.struct(
        F.struct(F.lit(f"chain {k}").alias("pdbx_description")).alias("rcsb_polymer_entity"), F.struct(F.lit("MK").alias("pdbx_seq_one_letter_code"), F.lit("MK").alias("pdbx_seq_one_letter_code_can")).alias("entity_poly"),
        F.array(F.struct(F.lit("o").alias("ncbi_scientific_name")), F.struct(F.lit("q").alias("ncbi_scientific_name"))).alias("rcsb_entity_source_organism"),
    )
    entry = F.struct(F.concat(F.lit("1A"), _text("s_suppkey")).alias("rcsb_id"), F.struct(F.col("s_name").alias("title")).alias("struct"), F.array(F.struct(F.col("s_suppkey").alias("pdbx_database_id_PubMed"))).alias("citation"), F.array(one(1), one(2)).alias("polymer_entities"))
    return completions.pdb_entities(table(spark, sf, "supplier").select(F.to_json(entry).alias("value"))).select("pdb", "descriptor", "name", "organism", "pmids")


@query("""SELECT p_partkey, 'about ' || p_name AS abstract, 'text ' || p_name AS body, '<table><tr><td colspan="2">' || p_name || '</td></tr></table>' AS cals FROM part""")
def article_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Abstract, body without its references, and a table of XML articles."""
    ship(spark)
    x = F.concat(F.lit('<a xmlns="urn:x"><abstract><p>about '), F.col("p_name"), F.lit("</p></abstract><body><p>text "), F.col("p_name"), F.lit("</p><bibliography>old</bibliography></body></a>"))
    t = F.concat(F.lit('<table><tgroup cols="2"><colspec colname="c1"/><colspec colname="c2"/><tbody><row><entry namest="c1" nameend="c2">'), F.col("p_name"), F.lit("</entry></row></tbody></tgroup></table>"))
    return table(spark, sf, "part").select("p_partkey", markup.xml_abstract(x).alias("abstract"), markup.xml_text(x).alias("body"), markup.cals_table(t)["html"].alias("cals"))


@query("""SELECT user_id, count(*) AS n, CAST(max(ts) AS TIMESTAMP) AS last FROM events GROUP BY 1""")
def newest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The latest state per key, as the stream's aggregate gives it on a table, with counts."""
    e = table(spark, sf, "events")
    states = incremental.run_states(e, ["user_id"], "event_type", "ts").select("user_id", F.col("ts").cast("timestamp_ntz").alias("last"))
    return states.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id").select("user_id", "n", "last")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['not in the question: c', 'missing: b'] ELSE CAST([] AS VARCHAR[]) END AS matching, CASE WHEN p_partkey % 3 = 0 THEN ['wild type in enzyme'] ELSE CAST([] AS VARCHAR[]) END AS exploded FROM part""")
def answer_checks(spark: SparkSession, sf: str) -> DataFrame:
    k, ab = F.col("p_partkey"), F.array(F.lit("a"), F.lit("b"))
    told = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(ab)
    t = F.concat(F.lit("```yaml\ndata:\n  - enzyme: "), F.when(k % 3 == 0, "wild-type X").otherwise("X"), F.lit("\n```"))
    return table(spark, sf, "part").select("p_partkey", quality.identifier_problems(ab, told, ab).alias("matching"), quality.explode_problems(t).alias("exploded"))


@query("""SELECT split, count(*) AS n FROM (SELECT 'all' AS split FROM conversations GROUP BY conv_id) GROUP BY 1""")
def written_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Splits written by name and read again hold every key once."""
    path = _folder(spark, "splits")
    sampling.write_splits(sampling.split(table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id"), path)
    return spark.read.json(path).groupBy(F.lit("all").alias("split")).agg(F.count_distinct("conv_id").alias("n"))


@query("""SELECT l_orderkey, l_quantity AS value_1, l_quantity AS value_2, 1.0 AS objective, 1.0 AS ratio FROM lineitem GROUP BY l_orderkey, l_quantity""")
def matched_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct quantities of each order paired with themselves by mantissa and exponent."""
    ship(spark)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    found = joins.matched_numbers(rows, rows, "l_orderkey", "l_quantity", number_sets())
    return found.select("l_orderkey", "value_1", "value_2", F.round("objective", 9).alias("objective"), F.round("ratio", 9).alias("ratio"))


@query("""SELECT l_orderkey, l_linenumber, 4.0 AS score FROM lineitem""")
def column_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines paired with themselves by weighted column similarity."""
    ship(spark)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part "), _text("l_partkey")).alias("substrate"), F.concat(F.lit("A1"), _text("l_linenumber"), F.lit("G")).alias("mutant"),
                                               F.col("l_quantity").alias("kcat_value"), F.col("l_linenumber").cast("double").alias("km_value"))
    pairs = assignment_join(rows, rows.drop("l_linenumber"), ["l_orderkey"], column_similarity({"substrate": 1.0, "mutant": 1.0, "kcat": 1.0, "km": 1.0}), objective_column="score")
    return pairs.select("l_orderkey", F.col("l_linenumber_1").alias("l_linenumber"), F.round("score", 9).alias("score"))


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ns_v1.jsonl' ELSE 'ns_v2.jsonl' END AS file, 'ns' AS namespace, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, 'ns_v2.jsonl' AS newest,
(SELECT count(*) FROM orders) AS n, 3 AS next FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def located_files(spark: SparkSession, sf: str) -> DataFrame:
    """Line files of two versions: which holds the last order, which is the newest, what is left of a version, the next name."""
    root, o = _folder(spark, "lines"), table(spark, sf, "orders")
    even = F.col("o_orderkey") % 2 == 0
    for k, rows in ((1, o.filter(even)), (2, o.filter(~even))):
        made = rows.select(F.to_json(F.struct(F.concat(F.lit(f"ns_v{k}_"), _text("o_orderkey")).alias("custom_id"))).alias("value"))
        made.coalesce(1).write.text(f"{root}/parts{k}")
        completions.merge_shards(spark, f"{root}/parts{k}", f"{root}/ns_v{k}.jsonl")
    name = lambda c: F.regexp_extract(c, r"(ns_v[0-9]+\.jsonl)", 1)
    listed = files.listing(spark, root, "part-*").filter(F.col("path").contains(".jsonl/"))
    lines = completions.read_lines(spark, f"{root}/*.jsonl")
    last = str(o.agg(F.max("o_orderkey")).first()[0])
    found = files.files_with_key(lines, listed, last, namespace="ns")
    stamped = listed.withColumn("modificationTime", name("path"))  # both may be written within a second
    newest = completions.newest_for(stamped, lines, "ns").first()["path"]
    left = files.remnants(listed.select(F.concat(F.lit("x/"), name("path")).alias("path")), "ns", "v1").count()
    names = listed.select(F.regexp_replace(name("path"), "_v", "_").alias("filename"))
    assert left >= 1
    return found.select(
        name("path").alias("file"), "namespace", "version", name(F.lit(newest)).alias("newest"), F.lit(lines.count()).alias("n"), F.lit(files.next_version(names, "ns")).cast("int").alias("next"),
    )


@query("""SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def named_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written once, a second write leaving them as they are, and read as named views."""
    root, datasets = _folder(spark, "datasets"), {}
    for t in ("nation", "region"):
        files.write_once(table(spark, sf, t), f"{root}/{t}.parquet")
        files.write_once(table(spark, sf, t).limit(0), f"{root}/{t}.parquet")
        datasets[f"set_{t}"] = f"{root}/{t}.parquet"
    files.register(spark, datasets)
    return spark.sql("SELECT n_nationkey, n_name, r_name FROM set_nation JOIN set_region ON n_regionkey = r_regionkey")


@query("""SELECT conv_id, count(*) AS docs, 'ns_v1_' || conv_id AS custom_id, CAST(conv_id AS VARCHAR) AS pmid, 'answer' AS answer FROM conversations WHERE turn > 0 GROUP BY conv_id""")
def finetune_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Fine-tuning examples from finished answers and from crafted ones, and their correspondence, read back from JSON."""
    c = table(spark, sf, "conversations").filter("turn > 0").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("docs"))
    asked = c.select(F.concat(F.lit("ns_v1_"), _text("conv_id")).alias("custom_id"), "docs")
    done = asked.select("custom_id", F.lit("answer").alias("content"), F.lit("stop").alias("finish_reason"))
    both = completions.finetune_from_batch(asked, done, "system").unionByName(completions.finetune_from_answers(asked, asked.select("custom_id", F.lit("answer").alias("answer")), "system"))
    m = F.from_json("example", "messages array<struct<role:string,content:string>>")["messages"]
    turns = F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("q").alias("text"))).alias("parts"))
    line = F.to_json(F.struct("custom_id", F.struct(F.array(turns).alias("contents")).alias("request")))
    keys = completions.correspondence(asked.select(line.alias("value"))).select("custom_id", "pmid")
    made = both.select("custom_id", (F.size(m) - 2).cast("bigint").alias("docs"), F.element_at(m, -1)["content"].alias("answer")).distinct()
    return made.join(keys, "custom_id").select(F.col("pmid").cast("bigint").alias("conv_id"), "docs", "custom_id", "pmid", "answer")


@query("""SELECT name, CAST(value AS DOUBLE) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS mean FROM lineitem) UNPIVOT (value FOR name IN (n, mean))""")
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"))).select("name", F.round("value", 9).alias("value"))
