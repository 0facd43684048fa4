"""Operators with one right answer, against brute force: fingerprints, sharding, coding, counts, personal data, joins, dedup."""

import hashlib
import re
import struct
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayline.llm import bpe, components, decontam, fingerprint, ngram_join, pii, sharding, substring_dedup, token_count
from assayline.llm.lexicon import Lexicon, compile_lexicon

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def test_sharding(spark, docs, rows, none):
    got = sharding.shard_by_bytes(docs, 8, rows_per_range=16).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").encode()) + 1) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.shard_by_bytes(none, 8).count() == 0


def test_sharding_is_balanced_with_a_hot_text(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    df = df.unionByName(df.filter("doc_id < 50"))  # repeated rows
    got = sharding.shard_by_bytes(df, 8, rows_per_range=128).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and all(r.m == r.n - 1 for r in got)
    mean = sum(r.b for r in got) / 8
    assert max(abs(r.b - mean) for r in got) <= 20


def test_sharding_against_brute_force(docs, rows):
    """One range: rows in the order of their texts' hashes, cut where the middle of a row's bytes passes a shard's share."""
    key = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    order = sorted(((key[i], i, len((t or "").encode()) + 1) for i, t in rows))
    total, at, want, slots = sum(x[2] for x in order), 0, {}, defaultdict(int)
    for _, i, size in order:
        shard = min(7, int((at + size / 2) * 8 / total))
        want[i] = (size, shard, slots[shard])
        slots[shard] += 1
        at += size
    assert {r.doc_id: (r.size, r.shard, r.slot) for r in sharding.shard_by_bytes(docs, 8).collect()} == want


def test_equal_texts_are_neighbours(spark):
    """Two thirds of the rows share two texts; many other texts stand twice, and tiny rows fill ranges of their own."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("text"))
    got = sorted((r.shard, r.slot, r.doc_id) for r in sharding.shard_by_bytes(df, 4, rows_per_range=64).collect())
    text = {r.doc_id: r.text for r in df.collect()}
    seen, last = set(), None
    for _, _, i in got:
        if text[i] != last:
            assert text[i] not in seen
            seen.add(text[i])
            last = text[i]
    assert len(got) == 6000


def test_fingerprints_against_an_independent_form(spark, docs, rows):
    """Unicode by the standard library, xxHash by its own binding; Spark chains the two hashes by their seeds."""
    import unicodedata

    import xxhash

    def form(t):
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
        return re.sub("[\\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", t).strip(" ")

    def mark(t):
        return "".join(f"{xxhash.xxh64_intdigest(form(t).encode(), xxhash.xxh64_intdigest(struct.pack('<i', s), 42)):016x}" for s in (1, 2))

    more = [(5000, "Ａ ＢＣ straße"), (5001, "STRASSE \u2003 e\u0301"), (5002, "strasse É"), (5003, "ΣΑΣ ς"), (5004, "x\u200by")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert got == {i: mark(t or "") for i, t in [*rows, *more]}
    edited = {r.doc_id: r for r in fingerprint.edit_probe(df).collect()}
    order = sorted((i, t or "") for i, t in [*rows, *more])
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        assert (edited[i].fingerprint, edited[i].edited_fingerprint) == (mark(t), mark(new))
        assert (edited[i].near_edited, edited[i].near_next) == (float(form(t) == form(new)), float(form(t) == form(nxt)))


def test_fingerprints(docs, rows, none):
    order = sorted(((i, t or "") for i, t in rows))
    got = {r.doc_id: r for r in fingerprint.edit_probe(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].near_edited == 1.0) == (got[i].fingerprint == got[i].edited_fingerprint)
    assert len({got[i].fingerprint for i in range(200, 215)}) == 1 and got[200].near_next == 1.0
    assert got[400].fingerprint == got[401].fingerprint == got[402].fingerprint
    assert fingerprint.edit_probe(none).count() == 0


def test_fingerprint_ranges_agree_with_one_range(docs):
    a = {r.doc_id: r for r in fingerprint.edit_probe(docs).collect()}
    b = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next_text(docs, range_bytes=2000).collect()}
    c = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next_text(docs, range_bytes=1 << 30).collect()}
    assert b == c and set(b) == set(a)


def test_canonical_folding_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "Café  X"), (2, "café x"), (2, "other"), (None, "CAFÉ x"), (3, "cafe x")], "doc_id long, text string")
    got = [(r[0], r[1]) for r in fingerprint.fingerprints(df).collect()]
    marks = {f for i, f in got if i in (1, None)}
    assert len(got) == 5 and len(marks) == 1 and sum(f in marks for _, f in got) == 3
    assert fingerprint.edit_probe(df).count() == 5
    assert fingerprint.colliding_digests(df).isEmpty()


def test_coding_and_counts(docs, rows, none):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    wt, bt = Tokenizer.from_file(word), Tokenizer.from_file(byte)
    lexicon = bpe.build_lexicon(docs, word, size=500)
    got = {r.doc_id: r for r in bpe.coding_digests(docs, word, lexicon).collect()}
    n = {r.doc_id: r for r in token_count.token_counts(docs, byte).collect()}
    for i, t in rows:
        ids = wt.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(wt.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        m = len(bt.encode(t or "", add_special_tokens=False).ids)
        assert (n[i].n_bytes, n[i].n_tokens, n[i].over_limit) == (len((t or "").encode()), m, m > 512)
    assert bpe.coding_digests(none, word, bpe.build_lexicon(none, word)).count() == 0 and token_count.token_counts(none, byte).count() == 0


def test_counts_of_random_odd_texts():
    """Pieces cut at safe boundaries count as the whole text does, whatever stands beside them."""
    import random

    rng = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, tok = token_count.Counter(path), Tokenizer.from_file(path)
    parts = ["a", "bc ", " ", "  ", "\n", "é", "12", "'s", "...", "\x1c", "\x85", "\u180e", "\u200b", "\u2060", "\ufeff", "\u00a0", "日本", "<|endoftext|>", "word ", " word", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    assert counter.count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(token_count.pieces("x\u200b " + "many words " * 1000)[1]) > 1900


def test_special_tokens_and_odd_text(spark):
    texts = ["a<|endoftext|>b", "<|STARTOFTEXT|> <|startoftext|>", "x\x1cy\x85z", "½²³ 12ab'LL I'VE", "İΣΑΣ", "  lead  and\ttrail ", "​zero﻿", "_x_ __"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    wt, bt = Tokenizer.from_file(word), Tokenizer.from_file(byte)
    got = {r.doc_id: r for r in bpe.encode_decode(df, word).collect()}
    n = {r.doc_id: r.n_tokens for r in token_count.token_counts(df, byte).collect()}
    for i, t in enumerate(texts):
        ids = wt.encode(t, add_special_tokens=False).ids
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[i].decoded == wt.decode(ids, skip_special_tokens=False)
        assert n[i] == len(bt.encode(t, add_special_tokens=False).ids)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", "x" * 40])}
    sizes = compile_lexicon(words | {b"y" * 41: [9]}, str(tmp_path / "l.bin"))
    lex = Lexicon(str(tmp_path / "l.bin"))
    asked = [*words, b"ta", b"stopss", b"", b"y" * 41, b"zz"]
    ranks = lex.ranks(asked)
    for w, r in zip(asked, ranks):
        assert (r >= 0) == (w in words)
        if r >= 0:
            assert lex.ids_at(r).tolist() == words[w]
    trie = 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert sizes["words"] == 8 and sizes["states"] < trie
    compile_lexicon({}, str(tmp_path / "e.bin"))
    assert Lexicon(str(tmp_path / "e.bin")).ranks([b"a"]).tolist() == [-1]


def test_base_spans():
    assert pii.base_spans("mail a.b@x.org or 1.2.3.4 and 256.1.1.1, call +1 (555) 123-4567") == [("email", 5, 14), ("ip", 18, 25), ("phone", 46, 63)]
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)] and pii.base_spans("4111 1111 1111 1112") == []
    assert pii.base_spans("@x.y a@b a@b.c@d.e") == [("email", 9, 14)]
    assert pii.base_spans("9" * 100_000 + "." + "8" * 100_000) == []


def test_base_spans_against_the_literal_patterns():
    import random

    rng = random.Random(11)
    luhn = lambda ds: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(ds))) % 10 == 0
    digits = lambda t: [int(c) for c in t if "0" <= c <= "9"]
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    parts = ["a.b", "@", "x-y", ".org", ".", "1", "25", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+", "-", " ", "é", "12345678901234", "\n", "(", ")", "+44 20"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [(name, m.start(), m.end()) for name, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]
        assert pii.base_spans(t) == want, t


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'call me, token = "{key}" or supercalifragilisticexpialidocious and 4111111111111111 in chapter_and_verse_of_book_12345678'
    assert pii.every_span(text, 80.0) == [("card", 102, 118), ("secret", 18, 58)]
    assert pii.secret_spans("a1" * 30, [], 80.0) == [] and pii.secret_spans("x" * 50_000, [], 80.0) == [] and pii.secret_spans("", [], 80.0) == []
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert (got[1].n_card, got[1].n_secret, got[1].n_private) == (1, 1, 2) and got[1].spans == "card:102:118,secret:18:58"
    assert got[1].base_sha256 == hashlib.sha256(b"card:102:118").hexdigest() and got[2].n_private == got[3].n_private == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[SECRET]" in clean[1] and key not in clean[1] and clean[2] == "plain" and clean[3] is None


@pytest.fixture(scope="module")
def leaky(spark):
    """A code word that stands beside one address in different contexts, and nowhere else; common words do not disclose."""
    out = [(i, f"note{i} common filler words go here and there number{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}") for i in range(400)]
    out += [(1000 + i, f"about{'abcdefgh'[i]}x zanzibarproject common {'qwertyui'[i]}side boss@corp.example.com wrote{'asdfghjk'[i]}z") for i in range(8)]
    return spark.createDataFrame(out + [(None, None), (5000, ""), (5001, "zanzibarproject again")], "doc_id long, text string")


@pytest.mark.parametrize("block", [200_000, 0])
def test_disclosing_terms(leaky, block):
    policy = pii.Policy(block=block)
    terms = {r.term: r for r in pii.disclosing_terms(leaky, policy).collect()}
    assert "zanzibarproject" in terms and "common" not in terms
    got = {r.doc_id: r for r in pii.find(leaky, policy).collect()}
    assert got[1000].spans.startswith("email:") and "term:" in got[1000].spans and got[5001].spans == "term:0:15" and got[1].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(leaky, policy).collect()}
    assert "zanzibarproject" not in clean[5001] and "[EMAIL]" in clean[1000] and clean[1].startswith("note1 common") and clean[5000] == "" and clean[None] is None


def test_disclosing_terms_against_brute_force(leaky):
    """Counts, information and the decision from plain dictionaries; contexts() names what stands near an entity."""
    import math

    texts = [r.text for r in leaky.collect()]
    windows, n_pair, n_term, own = defaultdict(set), defaultdict(int), defaultdict(int), defaultdict(int)
    for t in filter(None, texts):
        near = defaultdict(set)
        for entity, term, seen in pii.contexts(t, 8):
            near[entity, term].add(seen)
        for k, some in near.items():
            windows[k] |= some
            (n_pair if k[1] else own)[k if k[1] else k[0]] += 1
        words = set(pii._TERM.findall(t.lower()))
        for w in words | {w[:3] + "*" for w in words}:
            n_term[w] += 1
    want = {}
    for (entity, term), some in windows.items():
        p = own[entity] / len(texts)
        if term and len(some) >= 3 and not term.endswith("*"):
            pmi, ic = math.log2(min(1.0, n_pair[entity, term] / n_term[term]) / p), -math.log2(p)
            if ic > 0 and pmi >= 0.9 * ic:
                want[term] = max(want.get(term, (-1.0,)), (pmi, entity, n_pair[entity, term], n_term[term]))
    got = {r.term: (r.pmi, r.entity, r.n_pair, r.n_term) for r in pii.disclosing_terms(leaky).collect()}
    assert got.keys() == want.keys() and "zanzibarproject" in got
    assert all(abs(got[t][0] - want[t][0]) < 1e-9 and got[t][1:] == want[t][1:] for t in got)


def test_every_window_of_a_document_counts(spark):
    """Four windows in one document are four contexts of one document; a repeated window is one."""
    line = "about{0}x zanzibarproject common {0}side boss@corp.example.com wrote{0}z finally{0}y again{0}w and{0}v then{0}u until{0}t over{0}s more{0}r"
    out = [(i, f"note{i} common filler words go here") for i in range(50)]
    out += [(100, " ".join(line.format(x) for x in ("qwe", "rty", "uio", "asd"))), (101, " ".join([line.format("cv").replace("zanzibarproject", "timbuktuplan").replace("boss@", "mate@")] * 4))]
    terms = {r.term: r for r in pii.disclosing_terms(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert terms["zanzibarproject"].n_pair == 1 and "common" not in terms


def test_pii_edges(docs, rows, none):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert set(got) == {i for i, _ in rows} and got[400].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(none).count() == 0 and pii.sanitise(docs).columns == docs.columns


def shingles(t, k):
    w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            n = len(x & y)
            if x and y and 100 * n >= percent * (len(x) + len(y) - n):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k,percent,hot", [(4, 85, 32), (4, 85, 3), (5, 80, 3)])
def test_ngram_join(docs, rows, k, percent, hot):
    members, edges = ngram_join.links(docs, k, percent, hot_sets=hot)
    found = {r.node: r.component for r in components.components(edges).collect()}
    got = {r["__id"]: (r.n, found.get(r.node, r.node)) for r in members.collect()}
    assert got == brute_components(rows, k, percent)


def test_tokens_far_apart_are_hot(spark):
    """A phrase in every fiftieth text, of which a task never sees two at a time."""
    from tests.llm.conftest import sentence

    texts = [(i, sentence(i, 30) + (" a phrase that comes again" if i % 50 == 0 else "")) for i in range(20_000)]
    rows = spark.createDataFrame(texts, "__id long, __text string").coalesce(2)
    phrase = ngram_join.shingle_sets(pa.array(["a phrase that comes again"]), 4)[0]
    hot = ngram_join.hot_tokens(rows, 4, 32, task_tokens=1000)
    assert set(phrase.tolist()) <= set(hot.tolist())


def test_ngram_join_edges(spark, docs, rows, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(docs).collect()}
    assert got == brute_components(rows, 4, 85)
    assert ngram_join.join_components(none).count() == 0 and ngram_join.without_near_copies(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (3, "g h i j k l"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in ngram_join.join_components(odd).collect()), key=str) == sorted([(None, None), (None, None), (2, 2), (2, 2), (3, 2), (3, 2)], key=str)
    kept = ngram_join.without_near_copies(docs)
    want = {i for i, (n, c) in brute_components(rows, 5, 80).items() if c == i or not n}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_dedup(rows, window):
    words = {i: SPLIT.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        drop = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                drop[k : k + window] = [True] * window
        out[i] = (len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d))
    return out


@pytest.mark.parametrize("bits", [1 << 28, 1 << 12])
def test_substring_dedup(docs, rows, bits):
    """With few bits the sieve lets nearly all anchors and windows pass."""
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs, max_bits=bits).collect()}
    assert got == brute_dedup(rows, 13)


def test_substring_dedup_edges(spark, none):
    assert substring_dedup.dedup(none).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text + " tail")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in substring_dedup.dedup(df).collect()), key=str) == sorted([(None, 0), (1, 0), (1, 0), (2, 20)], key=str)


def test_decontamination(spark, docs, none):
    passage = "Quartz brackets tolerate vivid harbour signals while seven jumping walruses quietly describe mixed zebra opinions about frozen oxygen pipes"
    noisy = passage.replace("vivid", "vived").replace("jumping", "jumpng").upper()
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "short one"), (5, "entirely different wording that no document of this little table ever repeats at all, not once")], "item_id long, text string")
    more = spark.createDataFrame([(900, f"before {passage} after"), (901, f"x {noisy}, y"), (902, passage[:60]), (903, passage.replace(" ", "\n"))], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    got = decontam.matches(df, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(900, 1), (901, 1), (903, 1)}
    r = next(r for r in got if r.doc_id == 900)
    assert (r.start, r.edits) == (7, 0) and next(r for r in got if r.doc_id == 901).edits > 0
    assert {r.doc_id for r in decontam.without_contaminated(df, items).collect()} == {r.doc_id for r in df.collect()} - {900, 901, 903}
    assert {(r.doc_id, r.item_id) for r in decontam.matches(df, items, block_bytes=64).collect()} == {(900, 1), (901, 1), (903, 1)}
    assert decontam.matches(none, items).count() == 0 and decontam.matches(df, items.limit(0)).count() == 0


def test_decontamination_finds_passages_anywhere():
    """Any 13 words or 100 characters of an item, exact or with a few edits; 8 words are no passage."""
    import numpy as np

    from tests.llm.conftest import sentence

    items = [sentence(3000 + i, 40) for i in range(6)]
    index = decontam.Index(list(range(6)), [decontam.reduced([t])[0] for t in items])
    rng, docs, want = np.random.default_rng(5), [], set()
    for n in range(120):
        t, words = items[n % 6], items[n % 6].split()
        if n % 3 == 0:
            w = int(rng.integers(0, len(t) - 100))
            part = t[w : w + 100]
        else:
            w = int(rng.integers(0, len(words) - 13))
            part = " ".join(words[w : w + 13])
            if n % 3 == 2:
                part = part[:20] + "#" + part[21:50] + "qq" + part[51:]
        docs.append(f"{sentence(n, 15)} zz {part.strip()} zz {sentence(9000 + n, 15)}")
        want.add((n, n % 6))
    docs += [f"{sentence(n, 15)} zz {' '.join(items[n].split()[5:13])} zz" for n in range(6)]
    assert {g[:2] for g in index.search(docs)} == want
    for text, item, lo, hi, edits in index.search(docs):
        assert edits <= 6 and 0 <= lo < hi <= len(docs[text])


def test_decontamination_against_edit_distances():
    """Every window of every item against every document by plain alignment: the same pairs, none missed and none added."""
    import numpy as np

    from tests.llm.conftest import sentence

    rng = np.random.default_rng(17)
    items = [sentence(4000 + i, 22) for i in range(3)] + ["quartz brackets tolerate vivid harbour signals", "abc abc abc abc abc abc abc abc abc abc abc abc abc abc abc abc"]
    index = decontam.Index(list(range(len(items))), [decontam.reduced([t])[0] for t in items])
    docs = []
    for n in range(60):
        t = items[n % len(items)]
        w = int(rng.integers(0, max(1, len(t) - 100)))
        part = list(t[w : w + int(rng.integers(60, 130))])
        for _ in range(int(rng.integers(0, 9))):
            at, kind = int(rng.integers(0, len(part))), int(rng.integers(0, 3))
            part[at : at + (kind != 0)] = ["q"] if kind < 2 else []
        docs.append(f"{sentence(n, 6)} {''.join(part)} {sentence(800 + n, 6)}")

    def distance(patterns, doc):
        """The least edits of each pattern (rows of equal length) within doc, which may begin and end anywhere."""
        cost = np.zeros((len(patterns), doc.size + 1), dtype=np.int64)
        ramp = np.arange(doc.size + 1)
        for r in range(patterns.shape[1]):
            new = np.empty_like(cost)
            new[:, 0] = cost[:, 0] + 1
            new[:, 1:] = np.minimum(cost[:, :-1] + (patterns[:, r : r + 1] != doc), cost[:, 1:] + 1)
            cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
        return cost.min(axis=1)

    want = set()
    for d, text in enumerate(docs):
        doc = decontam.reduced([text])[0]
        for i, x in enumerate(index.items):
            start, length, k, need = index._windows(x)
            for n in np.unique(length):
                some = np.flatnonzero(length == n)
                if (distance(np.stack([x[s : s + n] for s in start[some]]), doc) <= k[some]).any():
                    want.add((d, i))
    assert {g[:2] for g in index.search(docs)} == want and len(want) > 30


def test_decontamination_of_repeated_grams_is_bounded():
    import tracemalloc

    spam = "spam " * 200
    index = decontam.Index([1], [decontam.reduced([spam])[0][:-1]])
    tracemalloc.start()
    got = index.search(["spam " * 16_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g[:2] for g in got] == [(0, 0)] and peak < 300 << 20


def test_decontamination_of_long_texts_in_pieces(monkeypatch):
    from tests.llm.conftest import sentence

    items = [sentence(7000 + i, 30) for i in range(3)]
    index = decontam.Index([0, 1, 2], [decontam.reduced([t])[0] for t in items])
    text = "  ".join([sentence(1, 300), items[2], "?! " * 40, items[0].replace(" ", " \n - "), sentence(2, 500)])
    whole = sorted(index.search([text, "short"]))
    for piece in (211, 400, 1000, 1601):
        monkeypatch.setattr(decontam, "PIECE", piece)
        assert sorted(index.search([text, "short"])) == whole and {g[1] for g in whole} == {0, 2}


def _join_rows(plan) -> list[int]:
    """Rows that each join of an executed plan made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _join_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _join_rows(plan.plan())
    kids, own = plan.children(), plan.metrics().get("numOutputRows")
    rows = [own.get().value()] if "Join" in name and own.isDefined() else []
    return rows + [n for k in range(kids.size()) for n in _join_rows(kids.apply(k))]


def test_ngram_join_members_meet_at_shared_tokens_only(spark):
    """A group of 100 sets with 30 tokens each is opened with 60 sets, each like one of its members."""
    own = [(1000 * m + t, 1, 100, m, 0) for m in range(1, 101) for t in range(30)]
    other = [(1000 * m + t, 1000 + m, 100, 1000 + m, 0) for m in range(1, 61) for t in range(4)]
    few = [(1000 * m + t, 2000 + m, 100, 2000 + m, 0) for m in range(1, 61) for t in range(10, 13)]
    cold = spark.createDataFrame([*own, *other, *few], "token long, label long, n int, node long, room int")
    found = ngram_join._opened_cold(cold, 80, 4)
    assert sorted((r.a, r.b) for r in found.collect()) == [(m, 1000 + m) for m in range(1, 61)]
    made = _join_rows(found._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 1000  # not 100 x 30 x 60
