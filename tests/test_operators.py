"""Joins, assignment, metrics and checks."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.operators import assignment, joins, metrics, sampling, validation


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False), st.booleans())
def test_solver_is_optimal(n, m, rnd, maximize):
    score = np.array([[rnd.randint(-5, 9) for _ in range(m)] for _ in range(n)], dtype=float)
    k = max(n, m)
    square = np.zeros((k, k))
    square[:n, :m] = score
    totals = [sum(square[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k))]
    got = assignment.assign(score, maximize)
    assert sum(v for _, _, v in got) == pytest.approx(max(totals) if maximize else min(totals))
    assert sorted(i for i, _, _ in got if i >= 0) == list(range(n)) and sorted(j for _, j, _ in got if j >= 0) == list(range(m))


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0), ("C", 4.0), (None, 5.0)], "g string, v double")
    b = spark.createDataFrame([("A", 2.0), ("B", 3.0), ("B", 9.0), ("D", 7.0), (None, 5.0)], "g string, v double")
    return a, b


@pytest.mark.parametrize("how,keys", [("inner", {"A", "B", None}), ("left", {"A", "B", "C", None}), ("right", {"A", "B", "D", None}), ("outer", {"A", "B", "C", "D", None})])
def test_assignment_join(sides, how, keys):
    got = assignment.assignment_join(*sides, ["g"], assignment.equality("v"), how, objective_column="z").collect()
    assert {r.g for r in got} == keys
    assert sum(r.g == "A" for r in got) == 2 and sum(r.g == "B" for r in got) == 2 and all(r.z is None for r in got if r.g in ("C", "D"))
    assert {(r.v_1, r.v_2) for r in got if r.z == 1} == {(2.0, 2.0), (3.0, 3.0), (5.0, 5.0)}


def test_assignment_without_keys_and_bounds(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, value string")
    b = spark.createDataFrame([(3, 30), (1, 10), (2, 20)], "id long, score long")
    objective = assignment.by_rows(lambda x, y: -abs(x["id"] - y["id"]))
    assert {(r.id_1, r.id_2) for r in assignment.assignment_join(a, b, [], objective).collect()} == {(1, 1), (2, 2), (3, 3)}
    with pytest.raises(Exception, match="max_group"):
        assignment.assignment_join(a, b, [], objective, max_group=2).collect()
    with pytest.raises(ValueError, match="how"):
        assignment.assignment_join(a, b, [], objective, how="cross")


def test_counting_equals_solving(spark):
    rng = np.random.default_rng(3)
    make = lambda: spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 12, 80), "value": rng.integers(0, 4, 80).astype(float)}))
    a, b = make(), make()
    counted = metrics.exact_precision_recall(a, b, "value", ["k"]).first()
    solved = {r.outcome: r["count"] for r in metrics.matched_rows(a, b, "value", ["k"]).groupBy("outcome").count().collect()}
    assert all(counted[c] == solved.get(c, 0) for c in ("tp", "wrong", "left_only", "right_only"))
    assert counted.tp + counted.wrong + counted.left_only == 80


def test_empty_scores(spark):
    none = spark.createDataFrame([], "k long, value double")
    r = metrics.exact_precision_recall(none, none, "value", ["k"]).first()
    assert (r.tp, r.precision, r.f1, r.accuracy) == (0, 0.0, 0.0, 0.0)


def test_off_by(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 6.0), (1, 7.0), (2, 8.0)], "k long, value double")
    b = spark.createDataFrame([(1, 5.0), (1, 6000.0), (1, 0.007), (2, 3.0)], "k long, value double")
    assert {r.factor: r.tp for r in metrics.off_by(a, b, "value", ["k"], [1000.0, 10.0]).collect()} == {1.0: 1, 1000.0: 2, 10.0: 0}


def test_asof(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 5.0), ("y", 2.0), ("z", 1.0), ("x", None)], "k string, v double")
    b = spark.createDataFrame([("x", 0.5), ("x", 1.5), ("x", 9.0), ("y", 7.0)], "k string, v double")
    free = {(r.k, r.v): r.v_right for r in joins.asof_nearest(a.filter("v is not null"), b, ["k"], "v", 1.0).collect()}
    assert free == {("x", 1.0): 1.5, ("x", 5.0): 1.5, ("y", 2.0): 7.0, ("z", 1.0): None}
    near = {(r.k, r.v): r.v_right for r in joins.asof_nearest(a.filter("v is not null"), b, ["k"], "v", 1.0, 1.0).collect()}
    assert near == {("x", 1.0): 1.5, ("x", 5.0): None, ("y", 2.0): None, ("z", 1.0): None}


def test_cascade(spark):
    df = spark.createDataFrame([(1, None), (2, "e"), (None, None)], "id long, e string")
    first = spark.createDataFrame([(1, "one"), (None, "none")], "id long, s string")
    second = spark.createDataFrame([("e", "two")], "e string, s string")
    got = {r.id: r.s for r in joins.cascade(df, [(first, ["id"], True), (second, ["e"], False)], ["s"]).collect()}
    assert got == {1: "one", 2: "two", None: "none"}
    with pytest.raises(ValueError, match="unique"):
        joins.cascade(df, [(first.unionByName(first), ["id"], True)], ["s"])


def test_boxes_and_pages(spark):
    words = spark.createDataFrame([(1, 0, "5", 0.0, 4.0), (1, 1, "mM", 5.0, 9.0), (1, 2, "MM", 50.0, 60.0)], "page long, wordno int, word string, x0 double, x1 double").selectExpr("*", "0d as y0", "1d as y1")
    boxes = spark.createDataFrame([(1, 5.0, 7.0, "mu"), (1, 6.0, 8.0, "m")], "page long, x0 double, x1 double, real_char string").selectExpr("*", "0d as y0", "1d as y1")
    assert {r.wordno: r.replacement for r in joins.unit_replacements(words, boxes, ["page"]).collect()} == {0: None, 1: "µM", 2: None}
    assert joins.page_text(words, ["page"]).first().text == "5 mM MM"


def test_similar_names(spark):
    names = spark.createDataFrame([("glucose",), ("Glucose-6-phosphate",), ("fructose",), (None,)], "n string")
    q = spark.createDataFrame([("GLUCOSE",), ("glucos",), ("zz",), (None,)], "q string")
    got = {(r.query, r.name): r.similarity for r in joins.similar_names(q, names, "q", "n").collect()}
    assert got[("GLUCOSE", "glucose")] == 100.0 and got[("glucos", "glucose")] > 90 and not any(k[0] == "zz" for k in got)


def test_similar_names_against_brute_force(spark):
    from assayline.functions.fuzzy import indel_ratio

    p = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    asked = sorted({r[0] for r in p.filter("p_partkey % 20 = 0").select("p_name").collect()})
    known = sorted({r[0] for r in p.select("p_type").collect()} | {"ab", "gear"})
    got = joins.similar_names(spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in known], "n string"), "q", "n", 5, 30.0)
    want = set()
    for x in asked:
        scored = sorted((-indel_ratio(x.lower(), y.lower()), y) for y in known)
        want |= {(x, y, -v) for v, y in scored[:5] if -v > 30}
    assert {tuple(r) for r in got.collect()} == want and ("blue gear", "LARGE") in {k[:2] for k in want}


def test_checks(spark):
    df = spark.createDataFrame([("a", "a", "10^3", "1", "p"), ("b", None, None, None, "p"), ("123", None, "1", "2", "q")], "substrate string, substrate_full string, kcat string, km string, pmid string")
    assert [r.substrate_full for r in validation.null_repeated_full(df, ["substrate"]).collect()] == [None, None, None]
    flags = [(r.scientific_notation, r.bad_substrate) for r in validation.add_flags(df).collect()]
    assert flags == [(True, True), (False, True), (False, True)]
    assert validation.drop_keys_with(df, "pmid", F.col("kcat") == "1").count() == 2
    for bad in (lambda: validation.expect_columns(df, ["x"]), lambda: validation.expect_not_columns(df, ["km"]), lambda: validation.expect_schema(df, {"km": "double"})):
        with pytest.raises(ValueError):
            bad()


def test_perfect_and_split(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "k string, ok boolean")
    assert [r.k for r in metrics.keep_perfect(df, "k", F.col("ok")).collect()] == ["b"]
    s = sampling.split(spark.range(1000), "id", 0.5, 0.2, 100, 50)
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 100, "val": 50, "test": 850}


def test_small_tables(spark):
    from assayline.operators.objectives import number_sets

    a = spark.createDataFrame([(1, x) for x in (1.0, 3.0, 7.0, 8.0, 1000.0)], "k long, v double")
    b = spark.createDataFrame([(1, float(x)) for x in (1, 2, 6, 7, 8, 9, 10)], "k long, v double")
    got = joins.matched_numbers(a, b, "k", "v", number_sets()).collect()
    assert len(got) == 7 and {(r.value_1, r.value_2) for r in got} >= {(1.0, 1.0), (7.0, 7.0), (8.0, 8.0)}
    d = spark.createDataFrame([("p", 3, "Adh"), ("p", 1, "adh"), ("p", 5, "x"), ("q", 2, "only")], "pmid string, distance int, enzyme_name string")
    rows = spark.createDataFrame([("p", "ADH", None), ("p", "zz", "X"), ("q", "zz", None), ("r", "a", None)], "pmid string, enzyme string, short_name string")
    assert sorted((r.pmid, r.enzyme, r.distance) for r in joins.join_distances(rows, d).collect()) == [("p", "ADH", 1), ("p", "zz", 5), ("q", "zz", 2), ("r", "a", None)]
    t = spark.createDataFrame([("A", "x", 1), ("a", "y", 2)], "n string, v string, o int")
    assert joins.last_wins(spark.createDataFrame([("a",), ("b",)], "k string"), t, "k", "n", "v", "o").orderBy("k").collect()[0].v == "y"
    assert joins.first_ignoring_case(t, "n", [], F.asc("o")).first().n == "A"
    names = spark.createDataFrame([("s", "full", None, "t")], "e string, e_full string, e_full_2 string, e_2 string")
    assert {tuple(r) for r in joins.two_sided_names(names, "e", "e_full").collect()} == {("full", "s"), ("t", None)}
    c = metrics.compare_tables(a, b, "k", ["v"], ["v"]).first()
    assert (c.keys_both, c.complete_a, c.v_b) == (1, 5, 7)
    lists = spark.createDataFrame([(["a"], None), (["b"], ["a"])], "x array<string>, y array<string>")
    assert {r.value for r in metrics.diversity(lists, ["x", "y"]).collect()} == {"a", "b"}
    m = spark.createDataFrame([("k", 1.0, "n"), ("k", None, None), ("l", 1.0, None)], "k string, v double, n string")
    assert [r.k for r in metrics.all_matched(m, "k", "v", ["n"]).collect()] == ["k"]


def test_weighted_match_covers_every_order(spark):
    from assayline.plans import catalogue

    sf = "/root/testdata/sf0.001"
    lines = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").count().collect()}
    got = catalogue.weighted_match(spark, sf).select("pmid", "objective").collect()
    assert {r.pmid for r in got} == set(lines) and len(got) == sum(lines.values())
    # A line against itself reaches organism, enzyme, mutant, substrate and kinetic in full.
    assert all(r.objective >= 19990 for r in got)


def test_column_similarity_scores_only_cells_that_can_win(monkeypatch):
    """The pairs of the solver on whole matrices; texts are compared only where a bound leaves room."""
    import random

    import pyarrow as pa

    from assayline.operators import objectives

    rnd, kind = random.Random(5), pa.schema([("substrate", pa.string()), ("mutant", pa.string()), ("kcat_value", pa.float64()), ("km_value", pa.float64())])
    f, values = objectives.column_similarity({"substrate": 1.0, "mutant": 1.0, "kcat": 1.0, "km": 0.5}), {
        "substrate": [None, "", "part 1", "Part 1", "part 12", "glucose"], "mutant": [None, "", "WT", "wild type", "A1G", "a1g"], "kcat_value": [None, float("nan"), 0.0, 2.0, -1.0], "km_value": [None, 1.0, 5.5],
    }
    for _ in range(200):
        a, b = ([{c: rnd.choice(v) for c, v in values.items()} for _ in range(rnd.randint(1, 5))] for _ in "ab")
        b = [*a[::-1]] if rnd.random() < 0.3 else b
        cells = f.cells(pa.Table.from_pylist(a, kind), pa.Table.from_pylist(b, kind))
        whole = np.array([[f.pair(x, y) for y in b] for x in a])
        for maximize in (True, False):
            got = assignment._assign_cells(cells, np.arange(len(a))[None], np.arange(len(b))[None], maximize)
            assert sorted(zip(*[v.tolist() for v in got])) == sorted(assignment.assign(whole, maximize))
    calls, whole = [], objectives.SequenceMatcher
    monkeypatch.setattr(objectives, "SequenceMatcher", lambda *a: calls.append(a) or whole(*a))
    rows = [{"substrate": f"part {k}", "mutant": f"A{k}G", "kcat_value": 1.0 + k, "km_value": 1.0 + k} for k in range(40)]
    got = assignment._assign_cells(f.cells(*[pa.Table.from_pylist(rows, kind)] * 2), np.arange(40)[None], np.arange(40)[None], True)
    assert got[0].tolist() == got[1].tolist() == list(range(40)) and set(got[2]) == {3.5} and not calls
