"""Operators that learn: held-out accuracy on the driver's tables, and cases of their methods."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from assayline.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_languages(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_mixtures(spark, docs, none):
    train = [(i, "the cat and the dog with that house " * 5, "en") for i in range(30)] + [(100 + i, "der hund und die katze mit dem haus nicht " * 5, "de") for i in range(30)]
    model = langid.fit_mixture(spark.createDataFrame([*train, (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    one, two, und, null = model.infer(["the dog and that cat " * 10, "the cat and the dog with that house " * 10 + "der hund und die katze mit dem haus " * 10, "12 -- 3", ""])
    assert one[0][0] == "en" and one[0][1] == 1.0 and und == null == []
    assert {k for k, _ in two} == {"en", "de"} and all(0.35 < v < 0.65 for _, v in two)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[400].lang_pred == got[401].lang_pred == got[402].lang_pred == "und" and got[403].lang_pred != "und" and got[400].score == 0
    assert langid.predict(none, model).count() == 0
    assert langid.predict(docs.limit(2), langid.fit_mixture(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_mixtures_against_plain_em():
    """One text at a time, a dictionary of trigrams, eight steps, one number of languages after the other."""
    import math

    from tests.llm.conftest import sentence

    langs = {x: " ".join(invented(k, 150).split()) for k, x in enumerate(("aa", "bb", "cc"))}
    counts = {x: np.bincount(langid.trigrams([t], 1 << 10)[1], minlength=1 << 10) for x, t in langs.items()}
    model = langid.Mixture.fit(counts)
    texts = [invented(0, 80), invented(0, 60) + " " + invented(1, 60), " ".join(invented(k, 50) for k in range(3)), sentence(3, 20), "x", "1 2"]

    def em(terms, some):
        theta = {j: 1 / len(some) for j in some}
        for _ in range(model.steps):
            new = dict.fromkeys(some, 0.0)
            for b, n in terms.items():
                total = sum(theta[j] * math.exp(model.log_p[b, j]) for j in some)
                for j in some:
                    new[j] += n * theta[j] * math.exp(model.log_p[b, j]) / total
            theta = {j: v / sum(terms.values()) for j, v in new.items()}
        return theta, sum(n * math.log(sum(theta[j] * math.exp(model.log_p[b, j]) for j in some)) for b, n in terms.items())

    for text, got in zip(texts, model.infer(texts)):
        row, bucket, has = langid.trigrams([text], 1 << 10)
        terms = {int(b): int(n) for b, n in zip(*np.unique(bucket, return_counts=True))}
        if not has[0]:
            assert got == []
            continue
        n = sum(terms.values())
        full, _ = em(terms, range(3))
        order = sorted(range(3), key=lambda j: -full[j])
        single = [sum(m * model.log_p[b, j] for b, m in terms.items()) for j in range(3)]
        best, cost = {max(range(3), key=lambda j: single[j]): 1.0}, -2 * max(single)
        for k in (2, 3):
            theta, ll = em(terms, order[:k])
            c = -2 * ll + model.penalty * 4 * math.log(max(n, 2)) * (k - 1)
            if c < cost:
                best, cost = theta, c
        want = {model.langs[j]: v for j, v in best.items() if v > 1e-3}
        assert {x for x, _ in got} == set(want) and all(abs(v - want[x]) < 2e-3 for x, v in got)


def invented(lang: int, n: int) -> str:
    """Words over two consonants and two vowels of their own."""
    c, v = "bcdfghjklmnpqrstvwxz"[lang % 20 :] + "bcdfghjklmnpqrstvwxz"[: lang % 20], "aeiouyäöüéè"
    w = [c[0], v[lang // 20 % 11], c[3], v[(lang // 20 + 1 + lang % 3) % 11]]
    return " ".join(w[i % 4] + w[(i // 4) % 4] + w[(i // 16) % 4] + w[(i + i // 5) % 4] for i in range(n))


def test_long_texts_are_counted_in_pieces():
    counts = {x: np.bincount(langid.trigrams([invented(k, 200)], 1 << 14)[1], minlength=1 << 14) for k, x in enumerate(("a", "b"))}
    model = langid.Mixture.fit(counts)
    long = " ".join([invented(0, 120_000), invented(1, 60_000)])
    assert len(long) > 800_000 and dict(model.infer([long])[0])["a"] > 0.5
    bucket = langid.trigrams([long], 1 << 14)[1]
    parts = np.concatenate([langid.trigrams([t], 1 << 14)[1] for part in langid.portions([long]) for _, t in part])
    assert (np.bincount(bucket) == np.bincount(parts)).all()


def test_more_than_four_languages_in_one_text():
    names = [f"l{k}" for k in range(7)]
    counts = {x: np.bincount(langid.trigrams([invented(k, 200)], 1 << 14)[1], minlength=1 << 14) for k, x in enumerate(names)}
    got = langid.Mixture.fit(counts).infer([" ".join(invented(k, 120) for k in range(6)), invented(2, 120)])
    assert {k for k, v in got[0] if v > 0.05} == set(names[:6]) and got[0][0][1] < 0.3
    assert got[1][0] == ("l2", 1.0)


def test_every_language_is_learned(spark):
    rows = [(10 * k + i, invented(k % 200, 30), f"l{k}") for k in range(300) for i in range(6)]
    model = langid.fit_mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {r.lang for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~langid.held_out("doc_id")).select("lang").distinct().collect()}
    assert len(want) > 256 and set(model.langs) == want


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, sf).join(labels, "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    # The labels carry noise in both directions.
    for langs, least in ({"en"}, 0.9), ({"de", "fr", "es"}, 0.5):  # 62 documents in the three together
        toxic = [r.predicted for r in rows if r.toxic and r.lang in langs]
        assert toxic and sum(toxic) >= least * len(toxic), (langs, sum(toxic), len(toxic))
    assert sum(r.predicted for r in rows if not r.toxic) < 0.01 * len(rows)


def brute_features(form, decay):
    """Subsequences of three characters with decay to the characters skipped at their tightest place, in characters' classes."""
    out = {}
    c = toxicity._classes()
    for ix in itertools.combinations(range(len(form)), 3):
        u = tuple(int(c[ord(form[i])]) for i in ix)
        out[u] = max(out.get(u, 0.0), decay ** (ix[-1] - ix[0] - 2))
    return out


def brute_kernel(s, t, decay=0.9, power=4):
    a, b = brute_features(s, decay), brute_features(t, decay)
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return (sum(v * b.get(k, 0.0) for k, v in a.items()) / norm) ** power if norm else 0.0


def test_subsequence_kernel():
    words = ["^idiot", "^idxiot", "^worthless", "^banana", "^bandana", "^aaaa", "^日本語です", "^" + "abcdefghijklmnopqrstuvw", "^id", "^xyzzy"]
    model = toxicity.StringKernelSvm(words)
    k = model.matrix(words)
    assert np.allclose(k, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-9)
    assert np.linalg.eigvalsh(k).min() > -1e-9 and np.allclose(k, k.T)
    assert toxicity.forms("ab") == [] and toxicity.forms("I-d.i_ot!") == ["^Idiot"] and all(len(f) <= 24 for f in toxicity.forms("ab" * 100))


def brute_raw(model, text):
    """The highest sentence, word by word."""
    best = None
    for line in text.lower().split("\n"):
        sentence, run = [], []
        for w in [*line.split(), None]:
            if run and (w is None or len(w) != 1 or len(sentence) == 32 or sentence[-1][-1] in ".!?"):
                if len(run) >= 3:
                    sentence.append("".join(run))
                run = []
            if sentence and (w is None or len([x for x in sentence]) >= 32 or sentence[-1][-1] in ".!?"):
                gain = sum(sum(brute_kernel(f, m, model.decay, model.power) * x for m, x in zip(model.landmarks, model.weights)) for s in sentence for f in toxicity.forms(s))
                best = gain if best is None else max(best, gain)
                sentence = []
            if w is not None:
                sentence.append(w)
                if len(w) == 1:
                    run.append(w)
    return (best or 0.0) + model.bias


def gapped_model():
    texts = [f"some plain words number{i} about weather{i % 7} today" for i in range(300)]
    labels = [0] * 300
    for i in range(60):
        texts.append(f"you person{i} blockhead{'' if i % 2 else '!'} again{i % 9} and so. fine words here")
        labels.append(1)
    return toxicity.train(texts, labels)


def test_gapped_insults():
    model = gapped_model()
    s = model.score(["a blockhead there", "a block-head there", "b l o c k h e a d", "a blxockhead there", "plain weather words", "", "z" * 5000])
    assert min(s[:4]) > 0.7 and max(s[4:]) < 0.3


def test_scores_equal_brute_force():
    model = gapped_model()
    texts = ["a blockhead there. plain weather!\nyou b l o c k h e a d", "x y z words. q", "", " \n ", "number1 " * 70 + "blockhead", "w" * 60 + " so", "fine words here. fine words here."]
    assert np.allclose(model.raw(texts), [brute_raw(model, t) for t in texts], atol=1e-6)
    long = "plain words about weather. " * 60_000 + "you blockhead again"
    assert model.score([long])[0] == model.score(["you blockhead again"])[0] > 0.7


def test_toxicity_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    assert set(got) == {i for i, _ in rows} and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.scores(none, toxicity.fit(none, labels.limit(0))).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    assert spark.range(1).select(F.lit(None).cast("long").alias("x")).select(langid.held_out("x").alias("h")).first().h is False
