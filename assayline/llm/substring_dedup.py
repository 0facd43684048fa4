"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. Windows of `window` words are what counts. Content
picks anchors (the smallest of the hashes of `anchor` words inside each window), so equal windows have equal
anchors; an anchor that only one document holds can't lie in a repeat. The anchors that several hold form the index.
Parsing goes from anchor to anchor: if all its occurrences have the same words around them,
the whole stretch is copied from the smallest document: a factor. Where occurrences differ, a factor ends or begins,
and each window across that boundary is looked up by itself. What factors and boundary windows cover is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import Bitmap, bitmap_of, slices
from assayline.llm.words import Words, powers, runs
from assayline.runtime import discard, materialise

SLICE = 1 << 19


class Anchored:
    """A slice's words and the anchors of its windows: at, hash, and the first and last window (lo, hi, by their first
    words) that have the anchor; every window has one, the leftmost of equal hashes."""

    def __init__(self, column: pa.Array, window: int, anchor: int, seeds: int = 1):
        w = self.words = Words(column, seeds=seeds)
        self.window, self.anchor = window, anchor
        n = w.size - window + 1
        if n <= 0:
            self.at = self.lo = self.hi = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.int64)
            return
        h = runs(w.hashes[0], anchor)
        best = leftmost_minimum(h, window - anchor + 1)
        start = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
        # Anchors move forward with their windows, so the windows of one follow each other.
        new = np.flatnonzero(np.append(True, best[start][1:] != best[start][:-1])) if start.size else start
        self.at, self.lo = best[start[new]], start[new]
        self.hi = start[np.append(new[1:], start.size) - 1] if start.size else start
        self.hash = h[self.at].view(np.int64)

    def stretch(self, keep: np.ndarray) -> list[np.ndarray]:
        """Two hashes of all words of the chosen anchors' windows, of their number and of where the anchor stands in them."""
        at, lo, hi = self.at[keep], self.lo[keep], self.hi[keep]
        out = []
        for h in self.words.hashes:
            up, down = powers(0xE7037ED1A0B428DB, h.size + 1)
            sums = np.zeros(h.size + 1, dtype=np.uint64)
            np.cumsum(h * up[: h.size], out=sums[1:])
            place = (at - lo).astype(np.uint64) * np.uint64(64) + (hi - lo).astype(np.uint64)
            out.append((sums[hi + self.window] - sums[lo]) * down[lo] + place * np.uint64(0x9E3779B97F4A7C15))
        return out


def leftmost_minimum(h: np.ndarray, k: int) -> np.ndarray:
    """Position of the smallest of every k consecutive entries, the first of equals."""
    at, width = np.arange(h.size), 1

    def better(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(h[q] < h[p], q, p)

    while 2 * width <= k:
        at = better(at[: at.size - width], at[width:])
        width *= 2
    rest = k - width
    return better(at[: at.size - rest], at[rest:]) if rest else at


def _int(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that can take part: an id and a text. __hash tells texts apart that share an id."""
    return docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text")
    )


def shared_anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(h): anchors that at least two ids hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            # Combines before the shuffle: an anchor leaves a task once, with its smallest and largest id.
            h = np.concatenate([x[0] for x in held])
            ids = np.concatenate([x[1] for x in held])
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if h.size else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([_int(h[new]), _int(ids[new]), _int(ids[np.append(new[1:], h.size) - 1] if h.size else ids)], ["h", "lo", "hi"])

        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                a = Anchored(part.column("__text"), window, anchor)
                ids = part.column("__id").to_numpy(zero_copy_only=False)
                held.append((a.hash, ids[a.words.row[a.at]]))
                size += a.at.size
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = rows.select("__id", "__text").mapInArrow(run, "h bigint, lo bigint, hi bigint")
    return found.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("h")


def _sieve(hashes: DataFrame, max_bits: int):
    """A broadcast bitmap of the hashes, of at most max_bits. Over a large index it lets more pass; it is never cut into
    blocks, so documents are read once, and what passes wrongly falls out in the reduction that follows."""
    return hashes.sparkSession.sparkContext.broadcast(bitmap_of(hashes, "h", hashes.count(), 16, max_bits))


def occurrences(rows: DataFrame, index: DataFrame, window: int, anchor: int, max_bits: int) -> DataFrame:
    """(h, id, hash, at, lo, hi, s1, s2) of the index's anchors, and some others, in every document: where, the windows around, their words' hashes."""
    sent = _sieve(index, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                a = Anchored(part.column("__text"), window, anchor, seeds=2)
                keep = sent.value.has(a.hash)
                lo, hi, h = a.lo[keep], a.hi[keep], a.hash[keep]
                row = a.words.row[lo]
                s1, s2 = a.stretch(keep)
                base = a.words.first[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [_int(h), part.column("__id").take(take), part.column("__hash").take(take), *[pa.array((x - base).astype(np.int32)) for x in (lo, hi)], _int(s1), _int(s2)],
                    ["h", "__id", "__hash", "lo", "hi", "s1", "s2"],
                )

    return rows.mapInArrow(run, "h bigint, __id bigint, __hash bigint, lo int, hi int, s1 bigint, s2 bigint")


class _Edges:
    """The windows of a slice whose anchor may be one of the mixed ones: starts, and 128 bits of their words."""

    def __init__(self, part: pa.RecordBatch, window: int, anchor: int, bits: Bitmap):
        a = Anchored(part.column("__text"), window, anchor, seeds=2)
        keep = bits.has(a.hash)
        lo, n = a.lo[keep], a.hi[keep] - a.lo[keep] + 1
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.row = a.words.row[at] if at.size else at
        self.start = (at - a.words.first[self.row]).astype(np.int32)
        self.w1, self.w2 = [runs(h, window)[at].view(np.int64) if at.size else np.zeros(0, np.int64) for h in a.words.hashes]


def boundary_windows(rows: DataFrame, mixed: DataFrame, window: int, anchor: int, max_bits: int) -> DataFrame:
    """(__id, __hash, lo): boundary windows that begin in a text with a smaller id too.

    Two passes over the documents instead of a stored table of all boundary windows: the first reduces them to those
    that several ids hold, each with its smallest id; the second sends only what may be one of those to the join.
    """
    sent = _sieve(mixed, max_bits)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            w1, w2, ids = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.lexsort((ids, w2, w1))
            w1, w2, ids = w1[order], w2[order], ids[order]
            new = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))) if w1.size else np.zeros(0, np.int64)
            last = ids[np.append(new[1:], w1.size) - 1] if w1.size else ids
            return pa.RecordBatch.from_arrays([_int(x) for x in (w1[new], w2[new], ids[new], last)], ["w1", "w2", "lo", "hi"])

        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                e = _Edges(part, window, anchor, sent.value)
                held.append((e.w1, e.w2, part.column("__id").to_numpy(zero_copy_only=False)[e.row]))
                size += e.row.size
                if size > 400_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    firsts = rows.mapInArrow(reduce, "w1 bigint, w2 bigint, lo bigint, hi bigint").groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    firsts = materialise(firsts.filter("first < last").select("w1", "w2", "first"), "rlz-firsts")
    again = _sieve(firsts.select(F.col("w1").alias("h")), max_bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                e = _Edges(part, window, anchor, sent.value)
                k = np.flatnonzero(again.value.has(e.w1)) if e.row.size else e.row
                take = pa.array(e.row[k])
                yield pa.RecordBatch.from_arrays(
                    [_int(e.w1[k]), _int(e.w2[k]), part.column("__id").take(take), part.column("__hash").take(take), pa.array(e.start[k])], ["w1", "w2", "__id", "__hash", "lo"]
                )

    found = rows.mapInArrow(emit, "w1 bigint, w2 bigint, __id bigint, __hash bigint, lo int").join(firsts, ["w1", "w2"])
    found = materialise(found.filter("__id > first").select("__id", "__hash", "lo"), "rlz-boundaries")
    discard(firsts)
    return found


def duplicate_spans(docs: DataFrame, window: int = 13, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28) -> DataFrame:
    """(__id, __hash, spans): for texts with repeats, the runs of words [lo, hi) that windows of smaller ids cover.

    Rows without an id or a text take no part. Nothing is gathered by anchor or window: reductions combine first, and the
    joins back are plain equi-joins, which adaptive execution splits where a key is hot.
    """
    rows = _rows(docs, id_col, text_col)
    index = materialise(shared_anchors(rows, window, anchor), "rlz-index")
    found = materialise(occurrences(rows, index, window, anchor, max_bits), "rlz-occurrences")
    discard(index)
    kinds = found.groupBy("h").agg(
        F.min("__id").alias("first"), F.max("__id").alias("last"),
        ((F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))).alias("pure"),
    ).filter("first < last")
    kinds = materialise(kinds, "rlz-kinds")
    factors = found.select("h", "__id", "__hash", "lo", "hi").join(kinds.filter("pure").select("h", "first"), "h").filter("__id > first")
    factors = materialise(factors.select("__id", "__hash", "lo", (F.col("hi") + window).alias("hi")), "rlz-factors")
    discard(found)
    crossing = boundary_windows(rows, kinds.filter("not pure").select("h"), window, anchor, max_bits)
    discard(kinds)
    # A document's spans: bounded by its own words.
    both = factors.unionByName(crossing.select("__id", "__hash", "lo", (F.col("lo") + window).alias("hi")))
    spans = materialise(both.groupBy("__id", "__hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "rlz-spans")
    discard(factors, crossing)
    return spans


def _kept(text: bytes, spans) -> tuple[int, int, bytes]:
    words = text.split()  # bytes split at exactly the six white-space bytes
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, [s["lo"] for s in spans], 1)
    np.add.at(edge, [s["hi"] for s in spans], -1)
    drop = np.cumsum(edge)[:-1] > 0
    return len(words), int(drop.sum()), b" ".join([w for w, d in zip(words, drop) if not d])


def dedup(docs: DataFrame, window: int = 13, anchor: int = 6, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 28, digests: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): every row's words that no window of a smaller id covers, joined by one space.

    digests: kept_sha256 instead of kept. Null texts have no words; texts of fewer than `window` words and rows with a
    null id keep all of theirs. Rows that share an id don't remove from one another; an empty table gives an empty result.
    """
    spans = duplicate_spans(docs, window, anchor, id_col, text_col, max_bits)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(spans.select("__hash"), "__hash", spans.count(), 16, max_bits))
    rows = docs.select(
        F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts that can't have spans are finished here; only the others travel to meet theirs.
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                maybe = bits.value.has(part.column("__hash").to_numpy(zero_copy_only=False))
                texts = part.column("__text").cast(pa.binary()).to_pylist()
                done = [(None, None) if m else here_kept(t) for m, t in zip(maybe, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__hash"), pa.array([t.decode() if m else None for m, t in zip(maybe, texts)], pa.string()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                    ["__id", "__hash", "__text", "n_words", "kept"],
                )

    def here_kept(text: bytes) -> tuple[int, str]:
        n, _, kept = _kept(text, None)
        return n, _told(kept, digests)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                n, removed, kept = part.column("n_words").to_pylist(), [], part.column("kept").to_pylist()
                for k, (text, spans) in enumerate(zip(part.column("__text").to_pylist(), part.column("spans").to_pylist())):
                    gone = 0
                    if text is not None:
                        n[k], gone, words = _kept(text.encode(), spans)
                        kept[k] = _told(words, digests)
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["__id", "n_words", "n_removed", "kept"])

    parted = rows.mapInArrow(split, f"__id bigint, __hash bigint, __text string, n_words bigint, kept string")
    both = parted.join(spans, ["__id", "__hash"], "left").select("__id", "__text", "n_words", "kept", "spans")
    out = both.mapInArrow(finish, f"__id bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnsRenamed({"__id": id_col, "kept": "kept_sha256" if digests else "kept"})


def _told(kept: bytes, digests: bool) -> str:
    return hashlib.sha256(kept).hexdigest() if digests else kept.decode()
