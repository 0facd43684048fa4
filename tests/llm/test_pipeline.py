"""The pipeline against its stages' own brute-force forms, stage by stage."""

import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from assayline.llm import pii, toxicity
from assayline.runtime import materialise
from tests.llm.test_exact_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {"": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = materialise(f(spark, docs, SF), "test")
        out[name] = docs
        if name != "bpe":
            assert docs.columns == out[""].columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in out.items()}
    rows = [(r.doc_id, r.text) for r in out["toxicity"].collect()]
    assert ids["ngram_jaccard_join"] == {i for i, (n, c) in brute_components(rows, 5, 80).items() if c == i or not n}
    model = toxicity.fit(out[""], spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in out[""].collect()}
    assert ids["toxicity"] == {i for i, t in texts.items() if model.score([t or ""])[0] < 0.7}
    norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids["decontamination"] == {i for i in ids["ngram_jaccard_join"] if not any(x in norm(texts[i]) for x in items)}
    clean = {r.doc_id: r for r in out["pii"].collect()}
    assert set(clean) == ids["decontamination"] and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.values())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out["bpe"].collect():
        want = tok.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want) and r.n_tokens == len(want) and r.decoded == tok.decode(want, skip_special_tokens=False)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in corpus_pipeline.STAGES:
        for some in (plain, plain.limit(0)):
            got = f(spark, some, SF)
            got.count()
            assert name == "bpe" or got.columns == plain.columns
