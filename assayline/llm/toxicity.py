"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

Two words are alike by their common subsequences of three characters. A subsequence counts once for a word, discounted by
the tightest gaps that it needs there: characters put between those of an insult cost little, however often they stand.
This is an inner product of explicit features, so it, its normalised form and whole powers of that are positive definite.
A sentence is the sum of its words' Nystroem features; a linear SVM is trained on labelled sentences as they are and with
characters put into their words, and a document takes its highest sentence, calibrated on labelled documents.
"""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import Cache, held, portions, slices, tidy
from assayline.llm.langid import held_out

_STRIP = re.compile(r"[\W_]+")
#: Characters of a form, of a word (longer ones are cut), and words of a segment.
_WIDTH, _LONGEST, _SEGMENT = 24, 256, 32


def forms(word: str) -> list[str]:
    """What is compared: a start mark and the word without marks; long words in overlapping pieces of 24 characters."""
    w = "^" + _STRIP.sub("", word)
    if len(w) <= _WIDTH:
        return [w] if len(w) > 3 else []
    return [w[k : k + _WIDTH] for k in range(0, len(w) - _WIDTH // 2, _WIDTH // 2)]


@cache
def _classes() -> np.ndarray:
    """Code point -> 1 to 63: a letter of a-z, a digit or the start mark has its own class, the rest share 26 by a hash."""
    c = np.arange(0x110000, dtype=np.uint64)
    out = (38 + (c * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(26)).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = np.arange(28, 38)
    out[ord("^")] = 27
    return out


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every i < j < k below length, and k - i."""
    at = np.array(list(itertools.combinations(range(length), 3)), dtype=np.int64).reshape(-1, 3).T
    return at, (at[2] - at[0]).astype(np.uint32)


def subsequences(words: list[str], decay: float, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in words, triples, weights) of words of one length at a time, about `most` triples: a triple is three
    classes in 18 bits; its weight is decay to the characters skipped in its tightest place, and 0 where it is repeated."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    power = decay ** np.maximum(np.arange(32) - 2.0, 0.0)
    for n in np.unique(lens):
        if n < 3:
            continue
        (i, j, k), span = _triples(int(n))
        every = np.flatnonzero(lens == n)
        for at in range(0, every.size, per := max(1, most // i.size)):
            some = every[at : at + per]
            codes = np.frombuffer("".join([words[x] for x in some]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            c = _classes()[codes].reshape(some.size, n).astype(np.uint32)
            key = c[:, i] << np.uint32(17) | c[:, j] << np.uint32(11) | c[:, k] << np.uint32(5) | span
            key.sort(axis=1)
            triple = key >> np.uint32(5)
            weight = power[key & np.uint32(31)]
            weight[:, 1:][triple[:, 1:] == triple[:, :-1]] = 0.0
            yield some, triple, weight


@dataclass
class StringKernelSvm:
    """weights are by landmark: a word's part in a score is its kernels with the landmarks, times them."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    slope: float = 1.0
    offset: float = 0.0
    decay: float = 0.9
    power: int = 4

    def __post_init__(self):
        found = [(t, j, v) for some, triple, weight in subsequences(self.landmarks, self.decay) for r, j in enumerate(some) for t, v in zip(triple[r], weight[r] / np.sqrt((weight[r] ** 2).sum())) if v]
        found.sort()
        t = np.array([x[0] for x in found], dtype=np.int64)
        self.column, self.value = np.array([x[1] for x in found], dtype=np.int64), np.array([x[2] for x in found])
        # Where each triple's landmarks begin and how many they are.
        self.first, self.count = np.searchsorted(t, np.arange(1 << 18)).astype(np.int32), np.bincount(t, minlength=1 << 18).astype(np.int32)
        self.key = uuid.uuid4().hex
        self.cache = Cache(50_000)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.cache = held(("toxicity", self.key), lambda: Cache(100_000))

    def kernels(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in words, their kernels with every landmark), some words at a time; words of under 3 characters have none."""
        m = len(self.landmarks)
        for some, triple, weight in subsequences(words, self.decay) if m else ():
            norm = np.sqrt((weight**2).sum(axis=1))
            row, col = np.nonzero((self.count[triple] > 0) & (weight > 0))
            t = triple[row, col]
            n = self.count[t]
            back = np.repeat(np.arange(t.size), n)
            entry = np.arange(back.size) - np.repeat(np.cumsum(n) - n, n) + self.first[t][back]
            k = np.bincount(row[back] * m + self.column[entry], weights=weight[row, col][back] * self.value[entry], minlength=some.size * m)
            k = k.reshape(some.size, m) / norm[:, None]
            out = k.copy()
            for _ in range(self.power - 1):
                out *= k
            yield some, out

    def matrix(self, some_forms: list[str]) -> np.ndarray:
        """The kernels of forms with the landmarks, all in memory."""
        out = np.zeros((len(some_forms), len(self.landmarks)))
        for some, k in self.kernels(some_forms):
            out[some] = k
        return out

    def gains(self, words: list[str]) -> np.ndarray:
        """What each word adds to the score of its sentence, from the cache where it is known."""
        new = self.cache.missing(set(words))
        owner = [(k, f) for k, w in enumerate(new) for f in forms(w)]
        out, at = np.zeros(len(new)), np.array([k for k, _ in owner], dtype=np.int64)
        for some, k in self.kernels([f for _, f in owner]):
            out += np.bincount(at[some], weights=k @ self.weights, minlength=len(new))
        self.cache.update(zip(new, out.tolist()))
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.float64, count=len(words))

    def raw(self, texts: list[str], change=None) -> np.ndarray:
        """The highest sentence of each text, its words changed if asked; the bias for a text without words."""
        out = np.full(len(texts), -np.inf)
        for part in portions(texts):
            got = Segments(part)
            if got.of.size:
                gains = self.gains(got.words if change is None else [change(w) for w in got.words])
                sums = np.bincount(got.segment, weights=gains[got.ids], minlength=got.of.size)
                np.maximum.at(out, got.of, sums)
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text."""
        raw = self.raw(texts)
        tidy()
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))


class Segments:
    """Sentences of texts, in segments of at most 32 words. words: the different lower-cased words at white space; ids and
    segment: of each word in turn; of: the text of each segment. A sentence ends at . ! ? or a line's end; three or more
    single characters in a row count as one more word."""

    def __init__(self, part: list[tuple[int, str]]):
        tokens, starts, owner = [], [], []
        for k, t in part:
            for line in t.lower().split("\n"):
                line_words = line.split()
                if line_words:
                    starts.append(len(tokens))
                    owner.append(k)
                    if len(line) > _LONGEST and max(map(len, line_words)) > _LONGEST:
                        line_words = [w[x : x + _LONGEST] for w in line_words for x in range(0, len(w), _LONGEST)]
                    tokens += line_words
        known = {w: k for k, w in enumerate(dict.fromkeys(tokens))}
        self.ids = np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        self.words = list(known)
        n, place = self.ids.size, np.arange(self.ids.size)
        start = np.zeros(n, dtype=bool)
        start[np.array(starts, dtype=np.int64)] = True
        ends = np.fromiter((w[-1] in ".!?" for w in self.words), dtype=bool, count=len(self.words))
        start[1:] |= ends[self.ids[:-1]]
        start |= (place - np.maximum.accumulate(np.where(start, place, 0))) % _SEGMENT == 0
        first = np.flatnonzero(start)
        self.segment = np.cumsum(start) - 1
        self.of = np.array(owner, dtype=np.int64)[np.searchsorted(np.array(starts), first, "right") - 1] if n else first
        one = np.fromiter((len(w) == 1 for w in self.words), dtype=bool, count=len(self.words))[self.ids]
        begin = np.flatnonzero(one & np.r_[True, ~one[:-1] | start[1:]][:n])
        if begin.size:
            stop = np.flatnonzero(one & np.r_[~one[1:] | start[1:], True][-n:]) + 1
            some = np.flatnonzero(stop - begin >= 3)
            joined = ["".join(tokens[begin[x] : stop[x]]) for x in some]
            for w in joined:
                if w not in known:
                    known[w] = len(known)
                    self.words.append(w)
            self.ids = np.r_[self.ids, np.array([known[w] for w in joined], dtype=np.int64)]
            self.segment = np.r_[self.segment, self.segment[begin[some]]]


def contrasting(texts: list[str], labels: list[int], least: int = 5, least_z: float = 5.0) -> list[str]:
    """Words and word beginnings (4 to 7 letters) that toxic texts use far more often than their share of all words, the
    most contrasting first.

    A text counts for a word if it brings a context (the words before and after) that no earlier text had: neither
    copies of a text nor one long text make its words count.
    """
    def starts(w: str) -> set[str]:
        return {w[:k] for k in (4, 5, 6, 7, len(w))} if 3 < len(w) <= 20 else set()

    def own(text: str) -> set[str]:
        return set().union(*(starts(_STRIP.sub("", w)) for w in set(text.lower().split())))

    # By texts first, so that contexts are kept for few words only.
    toxic = Counter(w for text, label in zip(texts, labels) if label for w in own(text))
    toxic = {w: n for w, n in toxic.items() if n >= least}
    clean = Counter(w for text, label in zip(texts, labels) if not label for w in own(text) & toxic.keys())
    some = {w for w, n in toxic.items() if n / (n + clean[w]) > 0.5}
    contexts: dict[str, set] = defaultdict(set)
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for text, label in zip(texts, labels):
        found: dict[str, set] = defaultdict(set)
        words = ["", *text.lower().split(), ""]
        known = {w: starts(_STRIP.sub("", w)) & some for w in set(words)}
        for at in range(1, len(words) - 1):
            for w in known[words[at]]:
                found[w].add((words[at - 1], words[at + 1]))
        for w, around in found.items():
            if not around <= contexts[w]:
                contexts[w] |= around
                seen[w][label] += 1
    base = (sum(toxic.values()) + 1) / (sum(toxic.values()) + sum(clean.values()) + 2)
    out = []
    for w, (n_clean, n_toxic) in seen.items():
        if n_toxic >= least:
            every = n_clean + n_toxic
            z = (n_toxic - base * every) / np.sqrt(base * (1 - base) * every)
            if n_toxic / every > 0.6 and z > least_z:
                out.append((-z, w))
    return ["^" + w for _, w in sorted(out)]


def choose_landmarks(texts: list[str], labels: list[int], contrast: int = 96, cover: int = 32, pool: int = 3000) -> tuple[list[str], int]:
    """(landmarks, how many are contrasting words) by pivoted Cholesky steps on the kernel, so that none lies in the span of others: first of the contrasting
    words (the most contrasting of each beginning, then each one's second, and so on), then of the most frequent words, always the one that those chosen cover least."""
    words: Counter = Counter()
    for text in texts:
        words.update({"^" + w for w in map(lambda x: _STRIP.sub("", x), set(text.lower().split())) if 2 < len(w) < _WIDTH})
        if len(words) > 200_000:
            words = Counter(dict(words.most_common(100_000)))
    stems, turns = Counter(), []
    for place, w in enumerate(contrasting(texts, labels)):
        stems[w[:5]] += 1
        turns.append((stems[w[:5]], place, w))
    first = [w for _, _, w in sorted(turns)[: 8 * contrast]]
    names = first + [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:pool] if w not in set(first)]
    rest, done, out = np.ones(len(names)), np.zeros((len(names), 0)), []

    def take(at: int) -> None:
        nonlocal rest, done
        column = StringKernelSvm([names[at]]).matrix(names)[:, 0]
        new = (column - done @ done[at]) / np.sqrt(rest[at])
        done, rest = np.c_[done, new], np.maximum(rest - new**2, 0.0)
        out.append(names[at])

    for at in range(len(first)):
        if len(out) < contrast and rest[at] > 0.2:
            take(at)
    n = len(out)
    while names and len(out) < n + cover and rest.max() > 0.05:
        take(int(np.argmax(rest)))
    return out, n


def disguised(word: str, n: int, salt: int) -> str:
    """A word with a character put in at n places; a hash with the salt chooses which and where."""
    for _ in range(n):
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"), salt)
        at = 1 + (h >> 8) % max(1, len(word) - 1)
        word = word[:at] + "xzq0"[h % 4] + word[at:]
    return word


def train(texts: list[str], labels: list[int], c: float = 10.0, emphasis: float = 1.0, near: float = 0.5, **landmark_options) -> StringKernelSvm:
    """Trains on the sentences of labelled texts. Each sentence has its text's label; a repeated one counts once, as toxic
    if any of its texts is. Words whose kernel with a contrasting landmark is over `near` count again without the rest of
    their sentence, `emphasis` times each: as they are, with one (twice, at different places) and with two characters put into them."""
    landmarks, n_contrast = choose_landmarks(texts, labels, **landmark_options) if 0 < sum(labels) < len(labels) else ([], 0)
    model = StringKernelSvm(landmarks)
    if not landmarks:
        rate = (sum(labels) + 1) / (len(labels) + 2)
        return StringKernelSvm([], np.zeros(0), -1.0, 0.0, float(np.log(rate / (1 - rate))))
    k = model.matrix(landmarks)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-8))) @ vector.T  # Nystroem: features are kernels times K^(-1/2)
    order = sorted(range(len(texts)), key=lambda x: -labels[x])  # toxic ones first: theirs is the label of what repeats
    seen, insults, parts, ys, times = set(), set(), [], [], []

    def words_matrix(words: list[str]) -> np.ndarray:
        owner = [(x, f) for x, w in enumerate(words) for f in forms(w)]
        out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
        np.add.at(out, np.array([w for w, _ in owner], dtype=np.int64), model.matrix([f for _, f in owner]).astype(np.float32))
        return out

    for part in portions([texts[x] for x in order], 100_000):
        got = Segments(part)
        if not got.of.size:
            continue
        same = np.fromiter(map(hash, got.words), dtype=np.int64, count=len(got.words)).astype(np.uint64)
        prints = np.zeros(got.of.size, dtype=np.uint64)
        np.add.at(prints, got.segment, same[got.ids] * np.uint64(0x9E3779B97F4A7C15) ^ same[got.ids] >> np.uint64(29))
        new = np.fromiter((p not in seen and not seen.add(p) for p in prints.tolist()), dtype=bool, count=prints.size)
        by = np.argsort(got.segment, kind="stable")
        ids, first = got.ids[by], np.searchsorted(got.segment[by], np.arange(got.of.size))
        y = np.array([labels[order[t]] * 2.0 - 1 for t in got.of])
        x = words_matrix(got.words)
        strong = x[:, :n_contrast].max(axis=1, initial=0.0) > near
        insults.update(got.words[w] for w in np.flatnonzero(strong))
        parts.append((np.add.reduceat(x[ids], first, axis=0)[new] @ root).astype(np.float32))
        ys.append(y[new])
        times.append(np.ones(int(new.sum())))
        at = np.flatnonzero(strong[ids])
        if not at.size:
            continue
        names, back = np.unique(ids[at], return_inverse=True)
        owners = got.segment[by][at]
        begin = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        keep = new[owners[begin]]
        for put, salt in ((0, 0), (1, 1), (1, 2), (2, 3)):
            some = words_matrix([disguised(got.words[w], put, salt) for w in names])
            parts.append((np.add.reduceat(some[back], begin, axis=0)[keep] @ root).astype(np.float32))
            ys.append(y[owners[begin]][keep])
            times.append(np.full(int(keep.sum()), emphasis))
    # A sentence unlike all landmarks counts as clean, a tenth as often as all that were seen.
    parts, ys, times = [np.zeros((1, len(landmarks)), np.float32), *parts], [np.array([-1.0]), *ys], [np.array([1 + len(seen) / 10]), *times]
    w, b = squared_hinge(parts, np.concatenate(ys), np.concatenate(times), c)
    model = StringKernelSvm(landmarks, root @ w, b)
    # Calibrated on the documents as they are and with a character in each of their strong words.
    raw = np.concatenate([model.raw(texts), model.raw(texts, lambda w: disguised(w, 1, 1) if w in insults else w)])
    model.slope, model.offset = platt(raw, np.array([*labels, *labels], dtype=float))
    model.cache = Cache(50_000)
    return model


def squared_hinge(parts: list[np.ndarray], y: np.ndarray, n: np.ndarray, c: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss on rows (in parts) that stand n times, by Newton steps on the active rows."""
    size = parts[0].shape[1] + 1
    reg = np.eye(size)
    reg[-1, -1] = 1e-6
    w = np.zeros(size)
    for _ in range(steps):
        left, right, at = reg.copy(), np.zeros(size), 0
        for p in parts:
            x = np.c_[p, np.ones(len(p))].astype(float)
            own, times = y[at : at + len(p)], n[at : at + len(p)]
            on = own * (x @ w) < 1
            weighted = x[on].T * (c * times[on])
            left += weighted @ x[on]
            right += weighted @ own[on]
            at += len(p)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def platt(raw: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve from raw scores to labels, with a weak pull towards slope 1; Newton steps,
    halved until the loss falls."""
    x, pull = np.c_[raw, np.ones(raw.size)], np.diag([1.0, 1e-6])
    goal = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0.0, z) - label * z).sum() + (w - goal) @ pull @ (w - goal) / 2)

    w = goal
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - label) + pull @ (w - goal)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, g)
        now, size = loss(w), 1.0
        while size > 1e-9 and not loss(w - size * step) < now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, sample_bytes: int = 24 << 20, row_bytes: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> StringKernelSvm:
    """Trains on labelled rows that aren't held out: about sample_rows of them and sample_bytes of text, chosen by a hash of
    the id, none of over row_bytes (the bounds of what is broadcast and collected). Rows with a null text or label are
    left out; a repeated id counts once, as toxic if any row says so. Without rows of both labels every score is their rate."""
    known = (
        labels.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    )
    short = docs.filter(F.octet_length(text_col) <= row_bytes)
    mean = short.agg(F.avg(F.octet_length(text_col))).first()[0] or 1.0
    rate = min(sample_rows, sample_bytes / mean) / max(1, known.count())
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("toxic"), F.col("__id")), 11) / F.lit(float(1 << 53))
    rows = short.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known.filter(unit < F.lit(rate))), "__id")
    got = sorted({(r["__text"], int(r["__label"] > 0)) for r in rows.select("__text", "__label").toLocalIterator()})
    return train([t for t, _ in got], [y for _, y in got])


def scores(docs: DataFrame, model: StringKernelSvm, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, repeated ids as often as they stand; null and empty texts get the
    score of a text without words. Other columns, whatever their names, are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", keep=True):
                s = sent.value.score(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["__id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("__id", id_col)


def without_toxic(docs: DataFrame, model: StringKernelSvm, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at least the threshold (null texts count as empty); every column of the others
    stays, whatever its name, and an empty table stays empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score([t or "" for t in texts.to_pylist()]) < threshold)

    return docs.filter(clean(F.col(text_col)))
