"""Cleaning, infusion and page correction on small tables with nulls, repeats and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayline.functions import quantity, text
from assayline.operators import cleaning, infusion, metrics
from assayline.sources import extraction, pages


def test_units(spark):
    cases = {"5 uM": "5 µM", "5 UM": "5 µM", "5 mm": "5 mM", "5 g/L": None, "5 nmol/mg": None, "1,000 μM": "1000 µM", "7 pM": "7 pM", None: None, "": ""}
    got = {r.t: r.x for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.fix_km(F.col("t")).alias("x")).collect()}
    assert got == cases
    cases = {"10 MIN^-1": "10 MIN^-1", "5 nkat/g": None, "12 /g": None, "2 minute-1": "2 minute^-1", "3 second-1": "3 second^-1", "6 day-1": "6 day^-1", "5 sec−1": "5 s^-1", "n.d.": "n.d.", None: None}
    got = {r.t: r.x for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.fix_kcat(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_quantities_agree_as_column_and_as_steps(spark):
    texts = ["3.5e-05 mM", "4.2 x 10^-5 M", "10^-4 M", "3 ± 0.2 min^-1", "5 per s", "e-4 mM", "5 mol L^-1", "", None, "12"]
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, value int")
    steps = quantity.with_quantity(df, F.col("t"), "v", "u", "si").collect()
    column = df.select("t", quantity.parse_quantity(F.col("t")).alias("q"), quantity.quantity(F.col("t")).alias("si")).collect()
    assert [(r.v, r.u, r.si) for r in steps] == [(r.q and r.q.value, r.q and r.q.unit, r.si) for r in column] and all(r.value == 1 for r in steps)


def test_clean_columns(spark):
    extracted = spark.createDataFrame([(7, "2 sec-1", "3 mm", None), (8, None, "1 mg/ml", "c")], "doi int, kcat string, km string, comments string")
    assert [tuple(r) for r in cleaning.clean_columns(extracted).collect()] == [("7", "2 s^-1", "3 mM", None), ("8", None, None, "c")]
    dump = spark.createDataFrame([("a", 2.0, None, "x")], "pmid string, turnover_number double, km_value double, comments string")
    assert cleaning.clean_columns(dump).first().asDict() == {"pmid": "a", "kcat": "2.0 s^-1", "km": None, "variant": "x"}
    with pytest.raises(ValueError):
        cleaning.clean_columns(spark.createDataFrame([("1", "2")], "kcat string, km string"))
    assert cleaning.clean_columns(extracted.limit(0)).count() == 0
    a, b = cleaning.same_key_types(spark.createDataFrame([(1,)], "pmid long"), spark.createDataFrame([("1",)], "pmid string"))
    assert a.join(b, "pmid").count() == 1
    assert {r.pmid for r in cleaning.keys_with_gaps(spark.createDataFrame([(1, None, "s", "o"), (2, "e", "s", "o"), (1, None, "s", "o")], "pmid long, enzyme string, substrate string, organism string")).collect()} == {"1"}
    assert cleaning.odd_units(dump.withColumn("kcat", F.lit("3 kat x")), "kcat", ["s"]).first().asDict() == {"unit": "kat", "n": 1}


def test_infusion(spark):
    rows = spark.createDataFrame([("1", "d", None, "o"), ("1", "d", "own", None), ("2", None, None, None)], "pmid string, descriptor string, enzyme string, organism string")
    asked = spark.createDataFrame([("1", "d", "E", "O", "S", None), ("1", "d", "E", "O", "S", None), ("2", None, "X", "X", "X", "X")], "pmid string, descriptor string, enzyme string, organism string, substrate string, cofactors string")
    got = sorted(((r.pmid, r.enzyme, r.organism, r.substrate, r.cofactors) for r in infusion.fill_from_exploded(rows, asked).collect()), key=str)
    assert got == sorted([("1", "E", "o", "S", None), ("1", "own", "O", "S", None), ("2", None, None, None, None)], key=str)
    names = spark.createDataFrame([("β-Glucan", "g"), ("odd", "KNOWN"), (None, "known"), ("odd", None)], "name string, short_name string")
    words = spark.createDataFrame([("BETA-glucan",), ("known",), (None,)], "w string")
    assert [r.known_name for r in infusion.add_known_names(names, [(words, "w")]).orderBy("name", "short_name").collect()] == [None, None, "KNOWN", "beta-Glucan"]
    dois = infusion.doi_table([("a", spark.createDataFrame([("10.1/X", None), (None, None)], "doi string, pmid string")), ("b", spark.createDataFrame([("10.1/x", "5")], "doi string, `ids.pmid` string"))])
    files = spark.createDataFrame([("10.1_x.pdf",), ("77",), ("77.xml",), ("none",), (None,)], "f string")
    assert {r.f: r.canonical for r in infusion.add_canonical(files, "f", dois).collect()} == {"10.1_x.pdf": "5", "77": "77", "77.xml": "77", "none": None, None: None}


def test_corrected_pages(spark):
    page = spark.createDataFrame([("a", 0, "5 mM\x01\n7 \x02M mMol"), ("b", 0, "5 mM")], "pdfname string, pageno int, text string")
    box = lambda x: (x, 0.0, x + 8.0, 5.0)
    words = [("a", 0, k, w, *box(10.0 * k)) for k, w in enumerate(("5", "mM", "7", "M", "mMol", "absent"))] + [("b", 0, 0, "5", *box(0.0)), ("b", 0, 1, "mM", *box(10.0))]
    words = spark.createDataFrame(words, "pdfname string, pageno int, ctr int, word string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([("a.pdf", 0, "mu", 0.99, 11.0, 1.0, 14.0, 4.0), ("a.pdf", 0, "mu", 0.5, 41.0, 1.0, 44.0, 4.0)], "pdfname string, pageno int, real_char string, confidence double, x0 double, y0 double, x1 double, y1 double")
    sure = pages.corrections(boxes, page.select("pdfname"))
    assert [r.pdfname for r in sure.collect()] == ["a"]
    assert {r.pdfname: r.text for r in pages.corrected_text(page, words, sure).collect()} == {"a": "5 µM\x01\n7 \x02M mMolabsent", "b": "5 mM"}
    got = {(r.pdfname, r.ctr): r.word for r in pages.corrected_words(page, words, sure).collect()}
    assert [got["a", k] for k in range(5)] == ["5", "µM", "\x017", "µM", "mMol"] and got["b", 1] == "mM"
    with pytest.raises(ValueError):
        pages.corrections(boxes, spark.createDataFrame([("z.pdf",)], "pdfname string"), must_meet=True)


def test_context_resolution():
    def record(descriptor, enzymes=(), substrates=(), **lists):
        rel = extraction.relations({"data": [{"descriptor": descriptor}], "context": {"enzymes": list(enzymes), "substrates": list(substrates), **lists}}, [])
        return extraction.resolve(rel)[0]

    two = [{"fullname": "long enzyme A", "synonyms": "A1", "organisms": "human", "mutants": "A12G"}, {"fullname": "other enzyme", "synonyms": "B1", "organisms": "mouse; rat", "mutants": "C3W"}]
    r = record("A12G; pH 7.5; 25 °C; with Mg2+", two)
    assert (r["pH"], r["temperature"], r["cofactors"], r["mutant"]) == ("7.5", "25", "with Mg2+", "A12G")
    assert (r["enzyme"], r["enzyme_full"], r["organism"]) == ("long enzyme A", "long enzyme A", "human")
    assert record("B1", two)["enzyme_full"] == "other enzyme" and record("B1", two)["organism"] is None
    assert record("x", two)["enzyme"] is None and record("with B1", two)["enzyme"] is None
    assert record("x", substrates=[{"fullname": "water", "synonyms": ""}])["substrate"] == "water"
    assert record("Tris; KCl", solvents=["Tris"], inhibitors=["KCl"])["solution"] == "Tris" and record("KCl", inhibitors=["KCl"])["other"] == "KCl"


def test_off_by_takes_the_smallest_right_value_and_counts_once(spark):
    ours = spark.createDataFrame([("k", 5.0), ("k", 5.0), ("k", 7.0), ("k", None), (None, 1.0)], "k string, v double")
    theirs = spark.createDataFrame([("k", 5.0), ("k", 0.5), ("k", 0.005), ("k", 7000.0), (None, 1.0)], "k string, v double")
    got = {r.factor: r.tp for r in metrics.off_by(ours, theirs, "v", ["k"], [10.0, 1000.0]).collect()}
    assert got == {1.0: 1, 10.0: 1, 1000.0: 1}
    assert {r.factor: r.tp for r in metrics.off_by(ours.limit(0), theirs, "v", ["k"], [10.0]).collect()} == {1.0: 0, 10.0: 0}


def test_off_by_passes_take_in_turn_with_plans_that_do_not_grow(spark, monkeypatch):
    """Seven factors whose candidates compete, against passes by hand; no step reads more tables after many passes than after few."""
    factors = [1000.0, 10.0, 100.0, 60.0, 1e6, 1e4, 3600.0]
    ours = [(k, v) for k in (1, 2) for v in (1.0, 1.0, 6.0, 10.0, 100.0, 360.0, 7.0)]
    theirs = [(k, v) for k in (1, 2) for v in (10.0, 100.0, 600.0, 1000.0, 1000.0, 6e4, 1e6, 3600.0, 21600.0, 70000.0)] + [(3, 1.0)]
    want, left, right = {}, Counter(ours), Counter(theirs)
    for n, f in enumerate([1.0, *[g for x in factors for g in (x, 1 / x)]]):
        for (k, v) in sorted(left):
            for (q, r) in sorted(right):
                t = min(left[k, v], right[q, r]) if k == q and round(r * f, 6) == v else 0
                if t:
                    left[k, v], right[q, r] = left[k, v] - t, right[q, r] - t
                    want[max(f, 1 / f)] = want.get(max(f, 1 / f), 0) + t
                    if n:
                        break
    scans, write = [], metrics.materialise
    monkeypatch.setattr(metrics, "materialise", lambda df, label: scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation")) or write(df, label))
    a, b = (spark.createDataFrame(rows, "k long, v double") for rows in (ours, theirs))
    got = {r.factor: r.tp for r in metrics.off_by(a, b, "v", ["k"], factors).collect()}
    assert got == {f: want.get(f, 0) for f in [1.0, *factors]} and sum(n > 0 for n in want.values()) > 4
    assert max(scans) <= 4


def test_off_by_broadcasts_no_table_however_well_its_file_compresses(spark, monkeypatch):
    """Few bytes on disk may be many rows: no join of any step builds a table in the driver; rows that can't meet leave before their join."""
    ours = [(k, v) for k in range(50) for v in (1.0, 6.0, 60.0, 600.0)]
    theirs = [(k, v) for k in range(50) for v in (10.0, 60.0, 360.0, 6000.0, 36000.0)]
    a, b = (spark.createDataFrame(rows, "k long, v double") for rows in (ours, theirs))
    plans, write = [], metrics.materialise
    monkeypatch.setattr(metrics, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df, label))
    got = {r.factor: r.tp for r in metrics.off_by(a, b, "v", ["k"], [10.0, 60.0]).collect()}
    assert got == {1.0: 50, 10.0: 100, 60.0: 50}
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 1e6 and len(plans) > 4
    assert not any("Broadcast" in x for x in plans) and sum("SortMergeJoin" in x for x in plans) > 2


def test_off_by_range_of_left_values_keeps_whatever_can_meet(spark):
    """Bounds of a key's left values, zeros, NaN, negatives and one side alone, with and without keys."""
    nan = float("nan")
    a = spark.createDataFrame([("k", -5.0), ("k", 0.5), ("z", -0.0), ("n", nan), ("n", 2.0), ("only", 1.0), ("few", 7.0)], "k string, v double")
    b = spark.createDataFrame([("k", -50.0), ("k", 5.0), ("z", 0.0), ("n", nan), ("n", 0.2), ("other", 10.0), ("few", 700.0)], "k string, v double")
    assert {r.factor: r.tp for r in metrics.off_by(a, b, "v", ["k"], [10.0]).collect()} == {1.0: 2, 10.0: 3}
    assert {r.factor: r.tp for r in metrics.off_by(a, b, "v", [], [10.0]).collect()} == {1.0: 2, 10.0: 4}
    c = a.withColumn("v", a.v.cast("decimal(12,3)")).filter("k <> 'n'")
    assert {r.factor: r.tp for r in metrics.off_by(c, b, "v", ["k"], [10.0]).collect()} == {1.0: 1, 10.0: 2}
