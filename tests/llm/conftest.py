import pytest

from assayline.runtime import ship

WORDS = "the of and to in that is was for with as on be at by this from or an are it his her not but have had they you were".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): prose, copies, near copies, shared passages, nulls, empty, white space, very long, odd characters."""
    out = [(i, sentence(i, 30 + i % 40)) for i in range(60)]
    passage = sentence(999, 60)
    out += [(100 + i, f"{sentence(500 + i, 20)} {passage} {sentence(700 + i, 20)}") for i in range(12)]
    base = sentence(4242, 120)
    out += [(200 + i, base) for i in range(15)]
    words = base.split()
    for i in range(15):
        w = list(words)
        w[(i * 7) % 120] = f"edit{i}"
        if i % 3 == 0:
            w[(i * 11 + 5) % 120] = f"more{i}"
        out.append((300 + i, " ".join(w)))
    out += [(400, None), (401, ""), (402, " \t\n "), (403, "a"), (404, "one two three"), (405, "x" * 50_000), (406, "word " * 20_000), (407, "Ünïcödé ΣΑΣ ﬁ 日本語 🎉 é"), (408, "one two three")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Extra columns carry names that operators use themselves."""
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("h", "token", "node", "n", "size", "range", "term", "lang", "source", "digest", "shard")
    return df.selectExpr("*", *[f"cast(null as string) as {n}" for n in names], "cast(length(text) as int) as n_chars").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
