"""Files, completions, the run log, documents, markup, streaming and the query catalogue."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from assayline.runtime import ship
from assayline.sources import completions, extraction, files, markup, run_log
from assayline.streaming import incremental

DOC = """text
```yaml
data:
    - descriptor: "WT; enzyme A; substrate X; pH 7.5; 25 °C; with Mg2+"
      substrate: X
      kcat: 33 ± 0.3 s^-1
      Km: 2 mM
    - descriptor: "A12G; EA"
      kcat: null
context:
    enzymes:
        - fullname: enzyme A
          synonyms: EA; alpha
          organisms: Homo sapiens
          mutants: A12G; WT
    substrates:
        - fullname: substance X
          synonyms: X
    temperatures: 25 °C
    pHs: pH 7.5
```
"""


def test_documents(spark):
    ship(spark)
    df = spark.createDataFrame([("1", DOC), ("2", "```yaml\ndata: [\n```"), ("3", "nothing"), ("4", None), ("5", '{"data": [{"descriptor": "d", "km": "1 mM"}], "context": {}}')], "pmid string, content string")
    parsed = extraction.parse(df).cache()
    rel = extraction.five_relations(parsed)
    assert {(r.pmid, r.kcat, r.km) for r in rel["data"].collect()} == {("1", "33 ± 0.3 s^-1", "2 mM"), ("1", None, None), ("5", None, "1 mM")}
    assert [r.pmid for r in rel["errors"].collect()] == ["2"] and rel["enzyme_ctx"].first().synonyms == ["EA", "alpha"]
    m = {(r.pmid, r.descriptor): r for r in extraction.measurements(parsed).collect()}
    a = m[("1", "WT; enzyme A; substrate X; pH 7.5; 25 °C; with Mg2+")]
    assert (a.enzyme, a.mutant, a.organism, a.pH, a.temperature, a.cofactors, a.substrate_full) == ("enzyme A", "WT", "Homo sapiens", "pH 7.5", "25 °C", "with Mg2+", "substance X")
    b = m[("1", "A12G; EA")]
    assert (b.enzyme, b.enzyme_full, b.mutant, b.substrate) == ("EA", "enzyme A", "A12G", None) or b.enzyme_full == "enzyme A"


def test_blocks():
    two = "## PMID: 7\n```yaml\ndata:\n    - descriptor: a\n```\n```yaml\ncontext:\n    enzymes: b\n```\n## PMID: 8\n```yaml\ndata: x\n```\n```yaml\nopen"
    assert extraction.joined_blocks(extraction.blocks(two)) == [("7", "data:\n    - descriptor: a\ncontext:\n    enzymes: b"), ("8", "data: x")]
    assert extraction.only_descriptors("data:\n  - descriptor: a\n    km: 1\ncontext:\n  x: y") == "data:\n  - descriptor: a\ncontext:\n  x: y"
    assert extraction.merge_documents({"data": [{"a": 1}], "context": {"enzymes": [1]}}, {"data": [{"b": 2}], "context": {"enzymes": [2]}}) == {"data": [{"a": 1, "b": 2}], "context": {"enzymes": [1, 2]}}


def test_completions(spark, tmp_path):
    bad = spark.createDataFrame([("not json",), ('{"custom_id": "a_b_1", "response": {"body": {"choices": [{"message": {"content": "x"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3}}}}',), ("{broken",)], "value string")
    got = completions.decode(bad, "chat").collect()
    assert [tuple(r) for r in got] == [("a_b_1", "x", "stop", 3, None)]
    assert [r.pmid for r in completions.ids_of(bad).collect()] == ["1"]
    docs = spark.createDataFrame([("a_b_1", ["d1", "d2"])], "id string, docs array<string>")
    req = json.loads(docs.select(completions.chat_request(F.col("id"), F.lit("sys"), F.col("docs"), "m")).first()[0])
    assert [m["content"] for m in req["body"]["messages"]] == ["sys", "d1", "d2"] and req["body"]["temperature"] == 0
    pdf = json.loads(docs.select(completions.message_request(F.col("id"), F.lit("sys"), F.col("docs"), "m", F.lit(b"%PDF"))).first()[0])
    assert pdf["params"]["messages"][0]["content"][0]["source"]["media_type"] == "application/pdf"
    completions.write_lines(docs.select(F.to_json(F.struct("id")).alias("j")), "j", str(tmp_path / "out"))
    assert completions.read_lines(spark, str(tmp_path / "out")).first().value == '{"id":"a_b_1"}'


def test_run_log(spark, tmp_path):
    log = run_log.read_log(spark, str(tmp_path / "none.tsv"))
    assert log.count() == 0 and run_log.next_serial_version(log) == "v1" and run_log.next_plain_version(log) == 1
    new = spark.createDataFrame([("ns", "v3", None, "submitted", "/r/a/b.jsonl"), ("ns", "v3", 1000, "submitted", "/r/a/c.jsonl")], "namespace string, version string, shard long, status string, batch_fpath string")
    log = run_log.upsert(log, new)
    log.write.parquet(str(tmp_path / "log.parquet"))
    log = run_log.read_log(spark, str(tmp_path / "log.parquet"))
    done = spark.createDataFrame([("ns", "v3", None, "/r/out.jsonl")], "namespace string, version string, shard long, completion_fpath string")
    after = {r.shard: (r.status, r.completion_fpath) for r in run_log.downloaded(log, done).collect()}
    assert after == {None: ("downloaded", "/r/out.jsonl"), 1000: ("submitted", None)}
    assert run_log.previous_version(log, "ns") == "v3" and run_log.next_serial_version(log) == "v4"
    assert {r.batch_fpath for r in run_log.relocate(log, "/new").collect()} == {"/new/b.jsonl", "/new/c.jsonl"}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("name,x\nn1,1\n")
    (tmp_path / "in/b.tsv").write_text("name\ty\nn2\t2\n")
    (tmp_path / "in/skip.csv").write_text("name\nzz\n")
    got = files.read_folder(spark, str(tmp_path / "in"), lambda n: n.startswith("skip"))
    assert {(r.name, r.x, r.y) for r in got.collect()} == {("n1", "1", None), ("n2", None, "2")}
    (tmp_path / "m.md").write_text("lost\n## PMID: 1\nbody\n\n## PMID: 2\nmore")
    assert {r.pmid: r.text for r in files.markdown_by_pmid(spark, str(tmp_path / "m.md")).collect()} == {"1": "body\n", "2": "more\n"}
    (tmp_path / "f.fa").write_text(">sp|P1|X desc\nMK\nLL\n>Q2\nAA\n")
    assert {(r.ncbi, r.sequence) for r in files.fasta(spark, str(tmp_path / "f.fa")).collect()} == {("P1", "MKLL"), ("Q2", "AA")}
    snap = files.snapshot_or_rebuild(spark, str(tmp_path / "snap.parquet"), str(tmp_path / "in"), lambda df: df.select("name"))
    assert snap.count() == 3
    names = spark.createDataFrame([("p1_0.md",), ("p1_1.md",), ("x.txt",), ("run_2.jsonl",)], "filename string")
    assert files.tables_by_pmid(names).first().files == ["p1_0.md", "p1_1.md"] and files.next_version(names, "run") == 3
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), spark.createDataFrame([("a", 5)], "k string, v long")
    assert {tuple(r) for r in files.replace_rows(old, new, "k").collect()} == {("a", 5), ("b", 2)}


def test_markup(spark):
    html = "<html><head><title>t</title></head><body><p>a  b<br>c</p><script>no</script><table><tr><td>1</td><th>2</th></tr></table></body></html>"
    r = spark.createDataFrame([(html,), (None,)], "h string").select(markup.html_text("h").alias("t"), markup.html_tables("h").alias("b")).collect()
    assert r[0].t.startswith("a b\nc") and "no" not in r[0].t and r[0].b == ["<table><row>1, 2</row></table>"] and r[1].t is None
    cals = '<table xmlns="u"><label>L</label><tgroup cols="3"><colspec colname="c1"/><colspec colname="c2"/><colspec colname="c3"/><thead><row><entry namest="c1" nameend="c2">h</entry><entry>k</entry></row></thead><tbody><row><entry morerows="1" align="left">a</entry><entry>b</entry><entry>c</entry></row></tbody></tgroup></table>'
    assert markup.cals_to_html(cals) == ('<table><tr><th colspan="2">h</th><th>k</th></tr><tr><td rowspan="2" align="left">a</td><td>b</td><td>c</td></tr></table>', "L")
    assert markup.cals_to_html("<table/>") == (None, None) and markup.cals_to_html("<broken") == (None, None)
    assert markup.article_text("<doc><body><p>One <sc>two</sc></p><references>x</references></body></doc>") == "One TWO"


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    schema = "k string, v long, t long"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], schema).write.parquet(src)
    incremental.upsert_stream(incremental.file_stream(spark, src, schema), out, ["k"], "t", check).awaitTermination()
    spark.createDataFrame([("a", 9, 3)], schema).write.mode("append").parquet(src)
    incremental.upsert_stream(incremental.file_stream(spark, src, schema), out, ["k"], "t", check).awaitTermination()
    assert {(r.k, r.v) for r in incremental.current(spark, out, ["k"], "t").collect()} == {("a", 9), ("b", 1)}


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return f"{float(v):.9g}" if not hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_catalogue(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
