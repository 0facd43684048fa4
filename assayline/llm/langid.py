"""Language proportions of documents: expectation-maximisation over character n-gram likelihoods.

A document is a mixture of languages; each of its letter trigrams comes from one of them. EM estimates the proportions,
for one language, then two, and so on; the number with the best penalised likelihood (BIC with a weight for the overlap
of trigrams) wins. A document's search ends only when a bound on the likelihood of any mixture shows that no larger number can win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import portions, slices

#: No code point from here on is a letter in Unicode.
_TOP = 0x33480
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case form if it is a letter, else a space."""
    if not _TABLE:
        t = np.full(_TOP + 1, 32, dtype=np.uint32)
        for c in range(_TOP):
            x = chr(c)
            if x.isalpha():
                t[c] = ord(x.lower()[0])
        _TABLE.append(t)
    return _TABLE[0]


def trigrams(texts: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every letter trigram of the texts, and whether each text has a letter. n_buckets is a power of 2."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    codes = np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = _letters()[np.minimum(codes, _TOP)]
    row = np.repeat(np.arange(len(texts)), lens)
    is_space = chars == 32
    has = np.bincount(row[~is_space], minlength=len(texts)) > 0
    keep = np.ones(chars.size, dtype=bool)
    keep[1:] = ~(is_space[1:] & is_space[:-1] & (row[1:] == row[:-1]))
    chars, row = chars[keep], row[keep]
    if chars.size < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    h = chars[:-2] * np.uint32(0x9E3779B1) ^ chars[1:-1] * np.uint32(0x85EBCA77) ^ chars[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(32 - n_buckets.bit_length() + 1)).astype(np.int64)
    inside = (row[:-2] == row[2:]) & (chars[1:-1] != 32)
    return row[:-2][inside], bucket[inside], has


@dataclass
class Mixture:
    """langs, and log likelihoods of the trigram buckets by language (buckets x languages)."""

    langs: list[str]
    log_p: np.ndarray
    penalty: float = 3.0
    steps: int = 8

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray], smooth: float = 0.5, **kw) -> Mixture:
        langs = sorted(counts)
        if not langs:
            return cls([], np.zeros((1, 0), np.float32), **kw)
        c = np.stack([counts[k] for k in langs], axis=1).astype(np.float64) + smooth
        return cls(langs, np.log(c / c.sum(axis=0)).astype(np.float32), **kw)

    def infer(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        """For each text its languages with proportions, largest first; none if it has no letter."""
        out: list[list[tuple[str, float]]] = []
        n_buckets = self.log_p.shape[0]
        if not self.langs:
            return [[] for _ in texts]
        # Fewer texts at a time where the table is wide.
        per = max(1, (1 << 24) // (n_buckets * max(4, len(self.langs))))
        for at in range(0, len(texts), per):
            out += self._infer(texts[at : at + per], n_buckets)
        return out

    def _infer(self, texts: list[str], n_buckets: int) -> list[list[tuple[str, float]]]:
        # Long texts are counted in pieces that end at spaces: no trigram spans one.
        dense, has = np.zeros(len(texts) * n_buckets, dtype=np.int64), np.zeros(len(texts), dtype=bool)
        for part in portions(texts):
            owner = np.array([k for k, _ in part], dtype=np.int64)
            row, bucket, some = trigrams([t for _, t in part], n_buckets)
            dense += np.bincount(owner[row] * n_buckets + bucket, minlength=dense.size)
            has[owner[some]] = True
        cell = np.flatnonzero(dense)
        row, bucket, n = cell // n_buckets, cell % n_buckets, dense[cell].astype(np.float32)
        docs, first = np.unique(row, return_index=True)
        shares = np.zeros((len(texts), len(self.langs)), dtype=np.float64)
        if docs.size:
            total = np.add.reduceat(n, first).astype(np.float64)
            log_p = self.log_p[bucket]
            single = np.add.reduceat(log_p * n[:, None], first, axis=0).astype(np.float64)
            ranked = np.argsort(-single, axis=1, kind="stable")
            best = np.zeros_like(single)
            best[np.arange(docs.size), ranked[:, 0]] = 1.0
            cost = -2 * single.max(axis=1)
            live = np.arange(docs.size)
            p_all = np.exp(log_p - log_p.max(axis=1, keepdims=True))
            top = log_p.max(axis=1)
            # The order of languages to try comes from the full mixture, not from single likelihoods.
            theta, ll, gain = self._em(p_all, top, n, first, total, np.full_like(single, 1 / single.shape[1]))
            order = np.argsort(-theta, axis=1, kind="stable")
            # The likelihood is concave in the proportions: no mixture exceeds this one by more than the best direction's gain.
            most = ll + total * np.log(np.maximum(gain, 1.0))
            # k - 1 free proportions; overlapping trigrams are not independent, hence the weight.
            per_language = self.penalty * 2 * np.log(np.maximum(total, 2)) * 2
            lens = np.diff(np.append(first, n.size))
            for k in range(2, len(self.langs) + 1):
                live = live[-2 * most[live] + per_language[live] * (k - 1) < cost[live]]
                if not live.size:
                    break
                pick = np.repeat(np.isin(np.arange(docs.size), live), lens)
                f = np.append(0, np.cumsum(lens[live])[:-1])
                some = p_all[pick] if k == len(self.langs) else np.take_along_axis(p_all[pick], np.repeat(order[live, :k], lens[live], axis=0), axis=1)
                theta, ll, _ = self._em(some, top[pick], n[pick], f, total[live], np.full((live.size, some.shape[1]), 1 / k))
                c = -2 * ll + per_language[live] * (k - 1)
                better = c < cost[live]
                won = live[better]
                best[won] = 0.0
                if k == len(self.langs):
                    best[won] = theta[better]
                else:
                    best[won[:, None], order[won, :k]] = theta[better]
                cost[won] = c[better]
            shares[docs] = best
        out = []
        for k in range(len(texts)):
            some = [(self.langs[j], float(shares[k, j])) for j in np.argsort(-shares[k], kind="stable") if shares[k, j] > 1e-3]
            # Letters but no trigram inside one word can't happen: a lone letter has its spaces.
            out.append(some if has[k] else [])
        return out

    def _em(self, p, top, n, first, total, theta):
        """(proportions, log likelihood, largest factor by which a further step would raise a proportion) of each text."""
        lens = np.diff(np.append(first, n.size))
        theta = theta.astype(np.float32)
        for step in range(self.steps + 1):
            w = p * np.repeat(theta, lens, axis=0)
            s = np.maximum(w.sum(axis=1), 1e-30)
            if step == self.steps:
                gain = (np.add.reduceat(p * (n / s)[:, None], first, axis=0) / total[:, None]).max(axis=1)
                return theta.astype(np.float64), np.add.reduceat((np.log(s) + top) * n, first).astype(np.float64), gain.astype(np.float64)
            w *= (n / s)[:, None]
            theta = (np.add.reduceat(w, first, axis=0) / total[:, None]).astype(np.float32)


def held_out(id_col: str) -> Column:
    """Rows kept from learning: CRC-32 of the id as text, modulo 3, is 1 (null ids are never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_mixture(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 2000, n_buckets: int = 1 << 14
) -> Mixture:
    """Learns from labelled rows that aren't held out.

    Every language is learned, from about per_lang rows of it chosen by a hash of the id: the model's documented bound.
    Tasks send one count vector per language.
    """
    labelled = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = [(r["lang"], per_lang / r["count"]) for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().toLocalIterator()]
    if not sizes:
        return Mixture.fit({})
    rates = F.broadcast(docs.sparkSession.createDataFrame(sizes, "__lang string, __rate double"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.col(id_col)), 11) / F.lit(float(1 << 53))
    sample = labelled.select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"), unit.alias("__unit")).join(rates, "__lang").filter("__unit < __rate").select("__text", "__lang").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import langid as here

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "__text"):
                langs = part.column("__lang").to_pylist()
                row, bucket, _ = here.trigrams(part.column("__text").to_pylist(), n_buckets)
                names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
                dense = np.bincount(code[row] * n_buckets + bucket, minlength=len(names) * n_buckets).reshape(-1, n_buckets)
                for name, v in zip(names, dense):
                    sums[name] = sums.get(name, 0) + v
                if len(sums) > 256:
                    yield sent()
                    sums = {}
        yield sent()

    total: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], dtype="<i8")
    return Mixture.fit(total)


def predict(docs: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, mixture) of every row: the largest proportion and all of them.

    A null text or one without a letter gives `und` and 0; so does a model that has learned nothing. Of equal proportions the
    language first in the alphabet counts. Repeated rows repeat; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                got = sent.value.infer(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id"), part.column("held_out"), pa.array([g[0][0] if g else "und" for g in got], pa.string()),
                        pa.array([min(1.0, g[0][1]) if g else 0.0 for g in got], pa.float64()), pa.array([",".join(f"{k}:{v:.3f}" for k, v in g) for g in got], pa.string()),
                    ],
                    ["__id", "held_out", "lang_pred", "score", "mixture"],
                )

    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, held_out boolean, lang_pred string, score double, mixture string").withColumnRenamed("__id", id_col)
