"""Benchmark decontamination by the q-gram lemma.

Documents and benchmark items are reduced to lower-case letters and digits with single spaces. A window of an item is any 13
words in a row or any 100 characters in a row, or the whole item if it has fewer. If the L characters of a window
occur in a document with at most k edits, they share at least L + 1 - q(k + 1) q-grams whose positions differ by
nearly the same amount. Shared q-grams are therefore counted in overlapping bands of diagonals; in bands that reach
the bound, every window that reaches its own is verified by an alignment that is confined to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import slices
from assayline.runtime import materialise

Q = 12
#: Bytes of text whose arrays are held at a time.
SLICE = 1 << 19
#: Characters of a text that are searched at a time.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_TOP = 0x33480
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point -> lower-case letter or digit, anything else a space."""
    if not _TABLE:
        t = np.full(_TOP + 1, 32, dtype=np.uint32)
        for c in range(_TOP):
            if chr(c).isalnum():
                t[c] = ord(chr(c).lower()[0])
        _TABLE.append(t)
    return _TABLE[0]


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, position in its text, number of its text) of all texts' reduced forms, one after another."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = _table()[np.minimum(codes, _TOP)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    pos = (np.arange(codes.size) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
    keep = chars != 32
    # Of a run of spaces the first stays, unless it begins the text.
    keep[1:] |= (chars[:-1] != 32) & (row[1:] == row[:-1])
    return chars[keep], pos[keep], row[keep]


def gram_hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the Q characters from each position on (the last Q - 1 positions have none)."""
    n = chars.size - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    b = [pow(_BASE, e, 1 << 64) for e in (1, 2, 4, 8)]
    h = chars.astype(np.uint64)
    h = h[:-1] + h[1:] * np.uint64(b[0])
    h = h[:-2] + h[2:] * np.uint64(b[1])
    h4 = h[:-4] + h[4:] * np.uint64(b[2]) if h.size > 4 else h[:0]
    return (h4[:n] + h[8 : 8 + n] * np.uint64(b[3])) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """A block of benchmark items. words, window: words or characters in a row that must match; edits: share of the characters
    that may differ."""

    ids: list
    items: list[np.ndarray]
    words: int = 13
    window: int = 100
    edits: float = 0.06
    band: int = 32

    def __post_init__(self):
        grams = [gram_hashes(x) for x in self.items]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [g.size for g in grams])
        at = np.concatenate([*[np.arange(g.size) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        h, self.item, self.at = h[order], item[order], at[order]
        self.hashes, first = np.unique(h, return_index=True)
        self.first = np.append(first, h.size)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        # The least q-grams that a window of the item shares: what a band must have.
        self.bound = np.array([self._windows(x)[3].min() for x in self.items], dtype=np.int64)

    def _windows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, edits, q-grams that must be shared) of each window of an item, by start and length."""
        first = np.flatnonzero(np.append(True, x[:-1] == 32))
        last = np.append(first[1:] - 1, x.size)
        n = first.size - self.words + 1
        size = min(x.size, self.window)
        starts = np.arange(x.size - size + 1)
        both = np.stack([starts, np.full(starts.size, size)], axis=1)
        if n > 0:
            both = np.concatenate([both, np.stack([first[:n], last[self.words - 1 :] - first[:n]], axis=1)])
        start, length = np.unique(both, axis=0).T
        # Short windows: as many edits as leave a shared q-gram sure.
        k = np.maximum(0, np.minimum(np.floor(length * self.edits).astype(np.int64), length // Q - 1))
        return start, length, k, length + 1 - Q * (k + 1)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(number of the text, number of the item, start, end, edits): the first window that holds, for each text and item.

        A text over PIECE characters goes through in pieces; each begins with what the one before ends with, as much as a
        window with its edits can take.
        """
        if not self.hashes.size:
            return []
        short = [k for k, t in enumerate(texts) if len(t) <= PIECE]
        found = [(short[g[0]], *g[1:]) for g in self._search(*reduced([texts[k] for k in short]), len(short))]
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                first: dict[int, tuple] = {}
                for part in self._pieces(t):
                    for g in self._search(*part, 1):
                        first.setdefault(g[1], (k, *g[1:]))
                found += first.values()
        return found

    def _pieces(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The reduced form of a text, some at a time, with its last characters again at the next one's beginning."""
        longest = max(int(self._windows(x)[1].max()) for x in self.items)
        overlap = 2 * (longest + self.band + Q)
        chars, pos = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for at in range(0, len(text), PIECE):
            c, p, _ = reduced([text[at : at + PIECE]])
            if chars.size and c.size and chars[-1] == 32 and c[0] == 32:
                c, p = c[1:], p[1:]
            elif not c.size or (at and c[0] != 32 and not text[at - 1].isalnum() and chars.size and chars[-1] != 32):
                c, p = np.append(np.uint32(32), c), np.append(0, p)
            chars, pos = np.concatenate([chars[-overlap:], c]), np.concatenate([pos[-overlap:], p + at])
            yield chars, pos, np.zeros(chars.size, dtype=np.int32)

    def _pairs(self, hit: np.ndarray, g: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the texts, item, place in it) of shared q-grams, about `most` at a time: one repeated in a text and in
        an item gives the product of their numbers."""
        n = self.first[g + 1] - self.first[g]
        total, at = np.cumsum(n), 0
        while at < g.size:
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            m = n[at:stop]
            flat = np.repeat(self.first[g[at:stop]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(hit[at:stop], m), self.item[flat], self.at[flat]
            at = stop

    def _search(self, chars: np.ndarray, pos: np.ndarray, row: np.ndarray, n_texts: int) -> list[tuple[int, int, int, int, int]]:
        h = gram_hashes(chars)
        if not h.size:
            return []
        hit = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        g = np.minimum(np.searchsorted(self.hashes, h[hit]), self.hashes.size - 1)
        ok = (self.hashes[g] == h[hit]) & (row[hit] == row[hit + Q - 1])
        hit, g = hit[ok], g[ok]
        # Shared q-grams are counted by text, item and band of diagonals, not listed. Bands of twice the width overlap by
        # half: k edits move a diagonal by at most k <= band.
        shift = int(self.at.max(initial=0)) + self.band
        n_bands, n_items = (chars.size + shift) // self.band + 2, len(self.items)
        cells, counts, held = [], [], 0
        for i, item, j in self._pairs(hit, g):
            half = (i - j + shift) // self.band
            owner = (row[i].astype(np.int64) * n_items + item) * n_bands
            k, n = np.unique(np.concatenate([owner + half, owner + half - 1]), return_counts=True)
            cells.append(k)
            counts.append(n)
            held += k.size
            if held > 1 << 21:
                cells, counts = map(list, zip(_summed(cells, counts)))
                held = cells[0].size
        cell, count = _summed(cells, counts)
        cell = cell[count >= self.bound[cell // n_bands % n_items]] if cell.size else cell
        bounds = np.searchsorted(row, np.arange(n_texts + 1))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for c in cell.tolist():
            key, half = divmod(c, n_bands)
            text, item = divmod(key, n_items)
            if (text, item) in found:
                continue
            lo, hi = half * self.band - shift, (half + 2) * self.band - shift  # of i - j
            base, end = int(bounds[text]), int(bounds[text + 1])
            some = slice(*np.searchsorted(hit, [max(base, lo), min(end, hi + self.items[item].size)]))
            shared, low, high = np.zeros(self.items[item].size, dtype=np.int64), hi, lo
            for i, it, j in self._pairs(hit[some], g[some]):
                d = i - j
                own = (it == item) & (d >= lo) & (d < hi)
                if own.any():
                    shared += np.bincount(j[own], minlength=shared.size)
                    low, high = min(low, int(d[own].min())), max(high, int(d[own].max()))
            got = self._verify(chars[base:end], item, shared, low - base, high - base)
            if got is not None:
                a, b, edits = got
                found[(text, item)] = (int(pos[base + a]), int(pos[base + b - 1]) + 1, edits)
        return [(t, it, *v) for (t, it), v in found.items()]

    def _verify(self, doc: np.ndarray, item: int, shared: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """The first window of the item that aligns within its edits near the diagonals low to high; shared: the number of
        q-grams that each place of the item has in common with the band."""
        x = self.items[item]
        start, length, k, need = self._windows(x)
        below = np.append(0, np.cumsum(shared))
        some = below[start + length - Q + 1] - below[start] >= need
        start, length, k = start[some], length[some], k[some]
        at, count = 0, 1
        while at < start.size:
            part = slice(at, at + count)
            most = int(k[part].max())
            ok = np.flatnonzero(least_edits(x, doc, start[part], length[part], low - most, high + most, most) <= k[part])
            if ok.size:
                w, size = int(start[part][ok[0]]), int(length[part][ok[0]])
                return banded(x[w : w + size], doc, w + low - most, w + high + most, most)
            at, count = at + count, min(4 * count, 256)
        return None


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, with the sums of their counts."""
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, back = np.unique(np.concatenate(cells), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts), minlength=k.size).astype(np.int64)


def least_edits(x: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """For each window of x the edits of the best alignment that `banded` would find between start + low and start + high;
    over k if there is none within k."""
    big = 1 << 14
    width = high - low + 2 * k + 1
    out = np.full(start.size, big)
    live = np.arange(start.size)
    at = np.arange(width)
    lo = start + low - k
    # Outside the document stand characters that nothing equals; entering them costs too much.
    base, end = int(lo.min()), int((lo + length).max()) + width
    padded = np.full(end - base + 1, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(0, base), min(doc.size, end)
    if a < b:
        padded[a - base : b - base] = doc[a:b]
    cell = lo[:, None] + at
    cost = np.where((cell >= 0) & (cell <= doc.size), 0, big).astype(np.int32)
    ramp = at.astype(np.int32)
    for r in range(int(length.max())):
        p = cell + r
        step = cost + (padded[p - base] != x[start + r][:, None])
        step[(p < 0) | (p >= doc.size)] = big
        skip = np.empty_like(cost)
        skip[:, :-1] = cost[:, 1:] + 1
        skip[:, -1] = big
        cost = np.minimum.accumulate(np.minimum(step, skip) - ramp, axis=1) + ramp
        best = cost.min(axis=1)
        ended = length == r + 1
        out[live[ended]] = best[ended]
        keep = ~ended & (best <= k)
        if not keep.all():
            live, start, length, cell, cost = live[keep], start[keep], length[keep], cell[keep], cost[keep]
            if not live.size:
                break
    return out


def banded(pattern: np.ndarray, doc: np.ndarray, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best alignment of the whole pattern that starts in doc between first and last, within
    diagonals first - k to last + k; None if it takes more than k edits."""
    width = last - first + 2 * k + 1
    lo = first - k
    big = 1 << 20
    at = np.arange(width)
    cost = np.where((lo + at >= 0) & (lo + at <= doc.size), 0, big)  # cell d: pattern prefix of 0 ends before doc[lo + d]
    origin = lo + at
    for r, c in enumerate(pattern):
        p = lo + r + at  # the doc character a diagonal step takes
        ok = (p >= 0) & (p < doc.size)
        same = np.zeros(width, dtype=bool)
        same[ok] = doc[p[ok]] == c
        step = np.where(ok, cost + ~same, big)
        skip = np.append(cost[1:] + 1, big)  # a pattern character without partner
        new = np.minimum(step, skip)
        start = np.where(step <= skip, origin, np.append(origin[1:], 0))
        # Doc characters without partner: along the row, by a running minimum of cost - position.
        run = np.minimum.accumulate(new - at)
        better = run + at < new
        source = np.maximum.accumulate(np.where(new - at == run, at, 0))
        cost = np.where(better, run + at, new)
        origin = np.where(better, start[source], start)
        if cost.min() > k:
            return None
    best = int(cost.argmin())
    end = lo + pattern.size + best
    return (max(0, int(origin[best])), min(doc.size, end), int(cost[best])) if cost[best] <= k else None


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, Index]]:
    """(whether it is the last, index) of at most about block_bytes of text: what is collected and broadcast at a time."""
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    for b in range(n_blocks):
        part = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64("__text"), F.lit(n_blocks)) == b)
        got = sorted(((r["__id"], r["__text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        chars = [reduced([t])[0] for _, t in got]
        chars = [c[:-1] if c.size and c[-1] == 32 else c for c in chars]
        kept = [k for k, c in enumerate(chars) if c.size >= Q]
        yield b == n_blocks - 1, Index([got[k][0] for k in kept], [chars[k] for k in kept])


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20
) -> DataFrame:
    """(id, item, start, end, edits): the first window of each item that each document holds, in code points of its text.

    Nulls and empty texts match nothing, nor do items of fewer than 12 reduced characters; empty tables give an empty
    result, other columns are not read. Benchmarks over block_bytes are searched block by block, each block's index
    broadcast only while its pass runs. Repeated documents repeat their matches; repeated items count once.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind, item_kind = rows.schema["__id"].dataType.simpleString(), items.schema[item_col].dataType
    text_item = item_kind.simpleString() == "string"
    out = None
    for last, index in blocks(items, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "__text", SLICE):
                    got = sent.value.search(part.column("__text").to_pylist())
                    ids = part.column("__id").take(pa.array([g[0] for g in got], pa.int64()))
                    cols = [pa.array([sent.value.ids[g[1]] for g in got], pa.string() if text_item else pa.int64()), *[pa.array([g[k] for g in got], pa.int32()) for k in (2, 3, 4)]]
                    yield pa.RecordBatch.from_arrays([ids, *cols], ["__id", "__item", "start", "end", "edits"])

        found = rows.mapInArrow(run, f"__id {kind}, __item {'string' if text_item else 'bigint'}, start int, end int, edits int")
        if not last or out is not None:
            found = materialise(found, "decontamination-block")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"__id": id_col, "__item": item_col})


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", block_bytes: int = 8 << 20, **kw) -> DataFrame:
    """docs without the rows whose text holds a window of an item; every column and row of the others stays, null texts too."""
    several = False
    for last, index in blocks(items, kw.get("item_col", "item_id"), kw.get("item_text_col", "text"), block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.filter(_is_clean(sent)(F.col(text_col)))
        if not last or several:
            docs, several = materialise(docs, "decontamination-block"), True
            sent.destroy()
    return docs


def _is_clean(sent):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        keep, at = np.ones(len(texts), dtype=bool), 0
        for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t", SLICE):
            for g in sent.value.search([t or "" for t in part.column("t").to_pylist()]):
                keep[at + g[0]] = False
            at += part.num_rows
        return pa.array(keep)

    return clean
