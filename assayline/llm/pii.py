"""Personal data: pattern spans, and terms that give protected entities away.

Base spans (email, ip, card, phone) come from patterns. Their values, and the groups those belong to (mail domain,
network, card prefix, phone prefix), are the protected entities. Over the whole corpus, documents in which a term stands
within a window around an entity estimate p(entity | term); a term whose pointwise mutual information with an entity
reaches a share of the entity's information content discloses it. Such a term is generalised to its class (its first
letters) if the class doesn't disclose the entity too, else removed. A run of letters and digits whose own information
reaches a number of bits (a key, a token) is a secret: it says nothing but itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import bitmap_of, slices
from assayline.runtime import discard, materialise

KINDS = ("email", "ip", "card", "phone")

# Fixed by the contract of the base kinds.
_EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"(?<![A-Za-z0-9+/=_])[A-Za-z0-9+/=_]{20,}")
_TURN = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches in linear time: each @ with a domain takes all local characters before it."""
    if "@" not in text:
        return
    free = 0
    for m in _EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start. The searches don't backtrack over long runs."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]], least_bits: float) -> list[tuple[str, int, int]]:
    """("secret", start, end) of runs of 20 or more letters and digits, mixed in at least three places, that no base span
    touches: their length times the entropy of their characters reaches least_bits."""
    out = []
    if _DIGIT.search(text) is None:
        return out
    for m in _RUN.finditer(text):
        run = m.group()
        if len(_TURN.findall(run)) < 3 or any(s < m.end() and m.start() < e for _, s, e in base):
            continue
        n = len(run)
        if -sum(k * math.log2(k / n) for k in Counter(run).values()) >= least_bits:
            out.append(("secret", m.start(), m.end()))
    return out


def every_span(text: str, secret_bits: float) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + secret_spans(text, base, secret_bits)


def entities(kind: str, value: str) -> list[str]:
    """A span's value in one form, and the group it belongs to."""
    if kind == "email":
        value = value.lower()
        return [f"email={value}", f"domain={value.rpartition('@')[2]}"]
    if kind == "ip":
        return [f"ip={value}", f"network={value.rpartition('.')[0]}"]
    digits = "".join(filter(str.isdigit, value))
    return [f"{kind}={digits}", f"{kind}s={digits[:6] if kind == 'card' else digits[:4]}"]


def term_class(term: str, letters: int = 3) -> str:
    return term[:letters] + "*"


def contexts(text: str, window: int) -> Iterator[tuple[str, str, int]]:
    """(entity, term or class or '', hash of the window) for each entity in a text; '' stands once for the entity itself."""
    base = base_spans(text)
    if not base:
        return
    words = list(_outside(text, base))
    starts = [m.start() for m in words]
    for kind, s, e in base:
        at, end = bisect_left(starts, s), bisect_left(starts, e)
        near = [m.group().lower() for m in words[max(0, at - window) : at] + words[end : end + window]]
        seen = int.from_bytes(hashlib.blake2b(" ".join(near).encode(), digest_size=8).digest(), "little", signed=True)
        terms = set(near)
        terms |= {term_class(t) for t in terms}
        for entity in entities(kind, text[s:e]):
            yield entity, "", seen
            for t in terms:
                yield entity, t, seen


def _outside(text: str, base: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The terms that no base span touches, in one sweep."""
    spans, k = sorted((s, e) for _, s, e in base), 0
    reach = 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if m.start() >= reach:
            yield m


@dataclass(frozen=True)
class Policy:
    """window: terms on each side of an entity. contexts: different windows that a pair must be seen in. share: of the
    entity's information content at which its mutual information with a term counts as disclosure. block: terms that are
    applied in one pass over the documents, the bound of what is broadcast. secret_bits: information at which a run of
    letters and digits is a secret."""

    window: int = 8
    contexts: int = 3
    share: float = 0.9
    block: int = 200_000
    secret_bits: float = 80.0


def disclosing_terms(docs: DataFrame, policy: Policy = Policy(), text_col: str = "text") -> DataFrame:
    """(term, entity, pmi, ic, n_pair, n_term, generalised string or null) for each disclosing term's strongest entity.

    Three reductions over all documents: pairs near entities, then documents by candidate term (a bitmap of fixed size
    keeps other words at home), then the decision. Every count combines before its shuffle.
    """
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("__text"))
    window = policy.window

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import pii as here

        for batch in batches:
            for part in slices(batch, "__text"):
                found: list[tuple[str, str, int, int]] = []
                for text in part.column("__text").to_pylist():
                    per: dict[tuple[str, str], set[int]] = {}
                    for entity, term, seen in here.contexts(text, window):
                        per.setdefault((entity, term), set()).add(seen)
                    # The document itself counts with the first of its windows.
                    found += [(e, t, s, int(k == 0)) for (e, t), some in per.items() for k, s in enumerate(some)]
                    if len(found) > 100_000:
                        yield here.pair_rows(found)
                        found = []
                yield here.pair_rows(found)

    near = (
        rows.mapInArrow(pairs, "entity string, term string, seen bigint, n bigint")
        .groupBy("entity", "term", "seen").agg(F.sum("n").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("contexts"))
        .filter((F.col("contexts") >= policy.contexts) | (F.col("term") == ""))
    )
    near = materialise(near, "pii-pairs")
    candidates = near.filter("term != ''").select("term").distinct().select("term", F.xxhash64("term").alias("h"))
    n_docs, n_terms = docs.count(), candidates.count()
    names = "term string, n bigint"
    if n_terms:
        bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(candidates.withColumn("h", F.crc32(F.col("term").cast("binary"))), "h", n_terms, max_bits=1 << 26))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from assayline.llm import pii as here

            seen: Counter = Counter()
            for batch in batches:
                for part in slices(batch, "__text"):
                    here.count_terms(part.column("__text").to_pylist(), seen)
                if len(seen) > 400_000:
                    yield here.counted(seen, bits.value)
                    seen = Counter()
            yield here.counted(seen, bits.value)

        totals = rows.mapInArrow(count, names).groupBy("term").agg(F.sum("n").alias("n_term"))
    else:
        totals = docs.sparkSession.createDataFrame([], "term string, n_term bigint")
    own = near.filter("term = ''").select("entity", F.col("n_pair").alias("n_entity"))
    p_entity = F.col("n_entity") / F.lit(float(max(n_docs, 1)))
    scored = near.filter("term != ''").join(own, "entity").join(totals, "term")
    scored = scored.select(
        "entity", "term", "n_pair", "n_term", F.log2(F.least(F.col("n_pair") / F.col("n_term"), F.lit(1.0)) / p_entity).alias("pmi"), (-F.log2(p_entity)).alias("ic")
    ).withColumn("discloses", (F.col("pmi") >= F.lit(policy.share) * F.col("ic")) & (F.col("ic") > 0))
    found = materialise(scored.filter("discloses"), "pii-disclosing")
    discard(near)
    scored = found.select("entity", "term", "n_pair", "n_term", "pmi", "ic")
    classes = scored.filter(F.col("term").endswith("*")).select("entity", F.col("term").alias("class"), F.lit(True).alias("__too"))
    out = scored.filter(~F.col("term").endswith("*")).withColumn("class", F.concat(F.substring("term", 1, 3), F.lit("*"))).join(classes, ["entity", "class"], "left")
    best = F.max_by(F.struct("entity", "pmi", "ic", "n_pair", "n_term"), F.struct("pmi", "entity")).alias("b")
    # A class that discloses any of a term's entities can't stand for the term.
    out = out.groupBy("term", "class").agg(best, F.bool_or(F.coalesce("__too", F.lit(False))).alias("__too"))
    out = materialise(out.select("term", "b.*", F.when(~F.col("__too"), F.col("class")).alias("generalised")), "pii-terms")
    discard(found)
    return out


def pair_rows(found: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["entity", "term", "seen", "n"])


def count_terms(texts: list[str], into: Counter) -> None:
    """Adds one for each text's distinct terms and classes."""
    for text in texts:
        terms = set(_TERM.findall(text.lower()))
        into.update(terms)
        into.update({t[:3] + "*" for t in terms})


def counted(seen: Counter, bits) -> pa.RecordBatch:
    """The counts of the terms and classes that may be candidates."""
    from zlib import crc32

    import numpy as np

    terms = list(seen)
    hashes = np.fromiter((crc32(t.encode()) for t in terms), dtype=np.int64, count=len(terms))
    kept = [terms[k] for k in np.flatnonzero(bits.has(hashes))] if terms else []
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([seen[t] for t in kept], pa.int64())], ["term", "n"])


_HITS = "array<struct<s:int,e:int,g:string>>"


def _with_hits(rows: DataFrame, terms: DataFrame, policy: Policy):
    """(rows with __hits, broadcast {term: generalised}): up to policy.block terms travel as a dict, more by a join on the term.

    In the join a bitmap of fixed size keeps words at home that are no such term; a row's hits are bounded by its text.
    """
    spark, n = rows.sparkSession, terms.count()
    if n <= policy.block:
        known = {r["term"]: r["generalised"] for r in terms.select("term", "generalised").collect()}
        return rows.withColumn("__hits", F.lit(None).cast(_HITS)), spark.sparkContext.broadcast(known)
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "pii-rows")
    bits = spark.sparkContext.broadcast(bitmap_of(terms.withColumn("h", F.crc32(F.col("term").cast("binary"))), "h", n, max_bits=1 << 26))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import pii as here

        for batch in batches:
            for part in slices(batch, "__text"):
                yield here.maybe_hits(part, bits.value, policy.secret_bits)

    found = rows.select("__row", "__text").mapInArrow(maybe, "__row bigint, term string, s int, e int").join(terms.select("term", F.col("generalised").alias("g")), "term")
    hits = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "g"))).alias("__hits"))
    return rows.join(hits, "__row", "left").drop("__row"), spark.sparkContext.broadcast({})


def maybe_hits(part: pa.RecordBatch, bits, secret_bits: float) -> pa.RecordBatch:
    from zlib import crc32

    import numpy as np

    out: list[tuple[int, str, int, int]] = []
    for row, text in zip(part.column("__row").to_pylist(), part.column("__text").to_pylist()):
        found = list(_outside(text or "", every_span(text or "", secret_bits)))
        words = [m.group().lower() for m in found]
        hit = bits.has(np.fromiter((crc32(w.encode()) for w in words), dtype=np.int64, count=len(words))) if words else []
        out += [(row, words[k], found[k].start(), found[k].end()) for k in np.flatnonzero(hit)]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["__row", "term", "s", "e"])


def term_hits(text: str, terms: dict[str, str | None], base: list[tuple[str, int, int]], hits: list | None) -> list[tuple[int, int, str | None]]:
    """(start, end, generalised form or None) of the disclosing terms outside base spans."""
    if hits is not None:
        return [(h["s"], h["e"], h["g"]) for h in hits]
    if not terms:
        return []
    found = _TERM.finditer(text) if not base else _outside(text, base)
    return [(m.start(), m.end(), terms[w]) for m in found if (w := m.group().lower()) in terms]


def joined(spans: list[tuple]) -> str:
    return ",".join([f"{s[0]}:{s[1]}:{s[2]}" for s in spans])


def find(docs: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_secret, n_private, n_term, base_sha256, spans) of every row; null texts count as empty.

    Repeated rows repeat; an empty table gives an empty result; other columns are not read. spans has the base spans by
    kind and start, then secrets, then the disclosing terms (kind `term`); n_private counts all but the terms.
    """
    terms = disclosing_terms(docs, policy, text_col)
    rows, known = _with_hits(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")), terms, policy)
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_secret bigint, n_private bigint, n_term bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import pii as here

        for batch in batches:
            for part in slices(batch, "__text"):
                n, sha, spans = [[] for _ in range(7)], [], []
                for text, hits in zip(part.column("__text").to_pylist(), part.column("__hits").to_pylist()):
                    base = here.base_spans(text)
                    direct = base + here.secret_spans(text, base, policy.secret_bits)
                    extra = [("term", s, e) for s, e, _ in here.term_hits(text, known.value, direct, hits)]
                    for k, name in enumerate((*here.KINDS, "secret")):
                        n[k].append(sum(s[0] == name for s in direct) if direct else 0)
                    n[5].append(len(direct))
                    n[6].append(len(extra))
                    sha.append(hashlib.sha256(here.joined(base).encode()).hexdigest())
                    spans.append(here.joined(direct + extra))
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                    ["__id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_private", "n_term", "base_sha256", "spans"],
                )

    return rows.select("__id", "__text", "__hits").mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def replaced(text: str, base: list[tuple[str, int, int]], hits: list[tuple[int, int, str | None]]) -> str:
    """The text with each span generalised: base spans and secrets to their kind, terms to their class or to nothing. Overlapping
    spans become one, named by the one that starts first (the longer of two)."""
    spans = [(s, e, f"[{kind.upper()}]") for kind, s, e in base] + [(s, e, g or "") for s, e, g in hits]
    out, at = [], 0
    for s, e, to in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], to]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def sanitise(docs: DataFrame, policy: Policy = Policy(), text_col: str = "text") -> DataFrame:
    """docs with text_col sanitised; all other columns, whatever their names, and all rows, repeated ones too, stay; null texts
    stay null, an empty table stays empty."""
    terms = disclosing_terms(docs, policy, text_col)
    rows, known = _with_hits(docs.withColumn("__text", F.col(text_col)), terms, policy)

    @F.arrow_udf("string")
    def clean(texts: pa.Array, hits: pa.Array) -> pa.Array:
        from assayline.llm import pii as here

        parts = []
        for part in slices(pa.RecordBatch.from_arrays([texts, hits], ["t", "h"]), "t"):
            out = []
            for text, hit in zip(part.column("t").to_pylist(), part.column("h").to_pylist()):
                if text is not None:
                    spans = here.every_span(text, policy.secret_bits)
                    text = here.replaced(text, spans, here.term_hits(text, known.value, spans, hit))
                out.append(text)
            parts.append(pa.array(out, pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return rows.withColumn(text_col, clean(F.col("__text"), F.col("__hits"))).select(*docs.columns)
