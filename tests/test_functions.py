"""Column functions, on small tables with nulls."""

import pytest
from pyspark.sql import functions as F

from assayline.functions import fuzzy, mutants, quality, quantity, sequences, similarity, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "t,value,unit",
    [
        ("3.5e-05 mM", 3.5e-5, "mM"), ("4.2 * 10^-5 M", 4.2e-5, "M"), ("4.2 x 10^-5 M", 4.2e-5, "M"), ("4.2 × 10^-5 M", 4.2e-5, "M"), ("4.2 x 10^5 M", 4.2e5, "M"), ("10^-4 M", 1e-4, "M"),
        ("e-4 mM", None, None), ("10 mM", 10, "mM"), ("10 M", 10, "M"), ("10 µM", 10, "µM"), ("10 μM", 10, "µM"), ("42.5 mM", 42.5, "mM"), ("10 ± 1 mM", 10, "mM"), ("5 per s", 5, "s^-1"), ("2/min", 2, "min^-1"),
        ("7 pM", 7, "pM"), ("5 mol L^-1", 5, "M"), ("5 mmol L^-1", 5, "mM"), ("3 -- 4 s^-1", 3, "s^-1"), ("n.d.", None, None), ("", None, None), ("12", 12, None),
    ],
)
def test_quantity(spark, t, value, unit):
    q = one(spark, quantity.parse_quantity(F.col("t")), t=t)
    assert q.unit == unit and (q.value is None if value is None else q.value == pytest.approx(value))


def test_quantity_values(spark):
    assert one(spark, quantity.quantity(F.col("t")), t="60 min^-1") == pytest.approx(1.0)
    assert one(spark, quantity.quantity(F.col("t"), False), t="60") is None and one(spark, quantity.quantity(F.col("t")), t=None) is None
    assert one(spark, quantity.significant_digits(F.col("t")), t="0.0120") == 3
    assert one(spark, quantity.default_unit(F.col("t"), "km"), t=None) == "mM"


def test_normalisers(spark):
    assert one(spark, text.fix_scientific(F.col("t")), t="3 x 10⁻⁵ M") == "3 x 10^-5 M"
    assert one(spark, text.fix_km(F.col("t")), t="1,200 μm") == "1200 µM" and one(spark, text.fix_km(F.col("t")), t="2 mg/ml") is None and one(spark, text.fix_km(F.col("t")), t="3 mol/L") == "3 M"
    assert one(spark, text.fix_kcat(F.col("t")), t="5 sec–1") == "5 s^-1" and one(spark, text.fix_kcat(F.col("t")), t="5 U/mg") is None and one(spark, text.fix_kcat(F.col("t")), t="5") == "5"
    assert one(spark, text.ascii_fold(F.col("t")), t="β‐D®") == "beta-d"
    assert one(spark, text.fix_organism(F.col("t")), t="E. coli") == "Escherichia coli"
    assert one(spark, text.is_wild_type(F.col("t")), t="Wild Type") and one(spark, text.is_wild_type(F.col("t"), False), t="") is False
    assert one(spark, text.is_na(F.col("t")), t="0") and one(spark, text.has_number(F.col("t")), t="a1")
    assert one(spark, text.explode_field(F.col("t")), t="a; b, c") == ["a", "b, c"] and one(spark, text.explode_field(F.col("t")), t=None) == []
    assert one(spark, text.recover_ncbi(F.col("t")), t="sp|P1|NAME x") == "P1" and one(spark, text.recover_ncbi(F.col("t")), t="a|b") is None and one(spark, text.recover_ncbi(F.col("t")), t="WP_1.1 y") == "WP_1.1"
    assert one(spark, text.formula_from_inchi(F.col("t")), t="InChI=1S/C2H6O/c1") == "C2H6O"
    assert one(spark, text.filename_to_doi(text.doi_to_filename(F.col("t"))), t="10.1/a.b") == "10.1/a.b"
    assert one(spark, text.first_yaml(F.col("t")), t="a```yaml\nb\n```c").asDict() == {"before": "a", "block": "b\n", "after": "c"}
    assert one(spark, text.substrate_answer(F.col("t")), t="Substrate: x\nSearch: y\nFinal Answer: none").asDict() == {"substrate": "x", "search": "y", "answer": None}
    assert one(spark, text.lengthened(F.col("a"), F.col("b")), a="ADH", b="alcohol dehydrogenase") == "alcohol dehydrogenase (ADH)"


def test_mutants(spark):
    assert one(spark, mutants.codes(mutants.compact_arrows(F.col("t"))), t="A12G, Ser 30, ala5gly") == ["A12G", "A5G"]
    assert one(spark, mutants.codes(mutants.compact_arrows(F.col("t"))), t="Ser30 → Thr") == ["S30T"]
    assert one(spark, mutants.mutant_similarity(F.col("a"), F.col("b")), a="WT", b="wild-type") == 1.0 and one(spark, mutants.mutant_similarity(F.col("a"), F.col("b")), a=None, b="WT") == 0.2
    df = spark.createDataFrame([("mutant R120Z A12G pH 7.5 at 25 °C",), ("wild-type",), (None,)], "c string")
    got = [tuple(r) for r in mutants.widen(df, "c").select("mutant", "pH", "temperature").collect()]
    assert got == [("A12G", "7.5", "25"), ("wild-type", None, None), (None, None, None)]


def test_similarity(spark):
    f = lambda c, a, b: one(spark, c(F.col("a"), F.col("b")), a=a, b=b)
    assert f(similarity.off_by_similarity, 1.0, 1000.0) == 0.9 and f(similarity.off_by_similarity, 0.0, 1.0) == 0.0 and f(similarity.off_by_similarity, 1.0, 1e5) == 0.3
    assert all(f(similarity.km_similarity, float(i), i + 0.1) > 0.9 for i in (2, 50, 998))
    assert f(similarity.bigram_jaccard, "abc", "abd") == pytest.approx(1 / 3) and f(similarity.bigram_jaccard, "", "a") == 1.0
    assert f(similarity.fold_difference, 1.0, 10.0) == pytest.approx(10.0) and f(similarity.fold_difference, 0.0, 1.0) is None
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], ["a"]), (None, ["a"]), (["c"], ["a"])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(similarity.is_subset(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(similarity.is_one_to_many(F.col("x"), F.col("y"))).collect()] == [True, False, False, False]


def test_fuzzy(spark):
    assert fuzzy.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13) and fuzzy.indel_ratio("", "") == 100.0
    assert fuzzy.best_partial_ratio("abc", "xxabcxx") == 100.0 and fuzzy.best_partial_ratio("", "a") == 0.0
    df = spark.createDataFrame([("abc", ["zz", "abcd"]), ("abc", []), (None, ["a"])], "a string, b array<string>")
    assert [r[0] for r in df.select(fuzzy.partial_ratio_list("a", "b")).collect()] == [100.0, None, None]


def test_sequences(spark):
    seq = "MALWMRLLPL"
    assert sequences.offset_of(seq, [("M", 1, "A"), ("W", 4, "A")]) == 0 and sequences.offset_of(seq, [("W", 2, "A"), ("R", 4, "A")]) == 2 and sequences.offset_of(seq, [("W", 20, "A"), ("K", 21, "A")]) is None
    assert sequences.pattern_of([("A", 109, "G"), ("C", 111, "T")]) == ("A.C", 109) and sequences.pattern_of([]) is None
    assert sequences.nearest_hit("KAKCKAKC", [("A", 6, "G"), ("C", 8, "T")]) == (6, 6)
    assert sequences.translate("ATGGCC") == "MA" and sequences.translate("ATGGC") == "MX" and sequences.translate("MKL") == "MKL"
    assert one(spark, sequences.chance_of_match(F.lit(10), F.lit(1.0)), t="x") == pytest.approx(1 - 0.95**10)


def test_quality(spark):
    assert one(spark, quality.answer_problems(F.col("t")), t="none") == ["no yaml"]
    asked = spark.createDataFrame([(["P1"], ["P1", "P2"], ["P3"])], "a array<string>, b array<string>, c array<string>")
    assert asked.select(quality.identifier_problems(F.col("a"), F.col("b"), F.col("c"))).first()[0] == ["not in the question: P2", "missing: P3"]
