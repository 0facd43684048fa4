"""Words and word sequences of Arrow text columns as 64-bit hashes, computed for a whole slice at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes that are hashed at a time. Words over half as long are hashed by another function.
CHUNK = 1 << 18


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and its inverses modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or have[0].size < n:
        size = max(n, CHUNK + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            filled, step = 1, b
            while filled < size:  # doubles the filled part
                m = min(filled, size - filled)
                p[filled : filled + m] = p[:m] * np.uint64(step)
                step = step * step % (1 << 64)
                filled += m
            out.append(p)
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column with 32- or 64-bit offsets; a null counts as empty."""
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        raise TypeError(f"texts come as strings, not as {column.type}")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return off - off[0], np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]


def _long_word(word: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(2, "little")).digest(), "little")


class Words:
    """hashes: one array for each of `seeds` independent hashes of every word; row: the text of each word; first: where
    each text's words begin (one more entry than texts). Words are runs of bytes other than space and \\t to \\r. Nulls have
    none. Beside the texts, memory holds a few arrays of CHUNK bytes and 24 bytes a word, however long a text is."""

    def __init__(self, column: pa.Array, lower: bool = False, seeds: int = 1):
        off, data = text_bytes(column)
        parts: list[list[np.ndarray]] = [[] for _ in range(seeds)]
        begins, at = [], 0
        while at < data.size:
            stop = self._cut(off, data, at)
            s = self._chunk(off, data[at:stop], at, lower, parts)
            begins.append(s + at)
            at = stop
        s = np.concatenate([*begins, np.zeros(0, np.int64)])
        self.hashes = [np.concatenate([*p, np.zeros(0, np.uint64)]) for p in parts]
        self.first = np.searchsorted(s, off)
        self.row = np.repeat(np.arange(off.size - 1), np.diff(self.first))
        self.size = s.size

    @staticmethod
    def _cut(off: np.ndarray, data: np.ndarray, at: int) -> int:
        """The end of the bytes that are hashed next: before a space or a text's beginning."""
        stop = at + CHUNK
        if stop >= data.size:
            return data.size
        space = np.flatnonzero(_WS[data[at:stop]])
        text = off[np.searchsorted(off, stop, "right") - 1]
        last = max(at + int(space[-1]) if space.size else at, int(text))
        while last <= at:  # no end in sight: on to the end of this word
            end = min(stop + CHUNK, data.size)
            space = np.flatnonzero(_WS[data[stop:end]])
            text = off[np.searchsorted(off, stop, "right")]
            last = min(stop + int(space[0]) if space.size else data.size, int(text), data.size) if space.size or text <= end or end == data.size else at
            stop = end
        return last

    @staticmethod
    def _chunk(off: np.ndarray, data: np.ndarray, at: int, lower: bool, parts: list[list[np.ndarray]]) -> np.ndarray:
        """Appends the hashes of a chunk's words; returns where they begin in it."""
        if lower:
            data = _LOWER[data]
        seen = ~_WS[data]
        begin, end = seen.copy(), seen.copy()
        begin[1:] &= ~seen[:-1]
        end[:-1] &= ~seen[1:]
        inner = off[np.searchsorted(off, at, "right") : np.searchsorted(off, at + data.size)] - at  # texts that begin inside
        begin[inner] = seen[inner]
        end[inner - 1] = seen[inner - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = np.flatnonzero(e - s > CHUNK // 2)
        value = data.astype(np.uint64) + np.uint64(1) if data.size <= CHUNK else None  # else one long word
        for k, (base, p) in enumerate(zip(_BASES, parts)):
            if value is None:
                h = np.zeros(s.size, dtype=np.uint64)
            else:
                up, down = powers(base, data.size + 1)
                sums = np.zeros(data.size + 1, dtype=np.uint64)
                np.cumsum(value * up[: data.size], out=sums[1:])
                h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            for w in long:
                h[w] = _long_word(data[s[w] : e[w]].tobytes(), k)
            p.append(h)
        return s


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries (by position; fewer than k at the end have none)."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base, out, done, power, width = 0xE7037ED1A0B428DB, np.zeros(n, dtype=np.uint64), 0, h, 1
    while done < k:  # k in binary: `power` holds hashes of `width` entries
        if k & width:
            out = out * np.uint64(pow(base, width, 1 << 64)) + power[done : done + n]
            done += width
        width *= 2
        if done < k:
            half = width // 2
            power = power[: power.size - half] * np.uint64(pow(base, half, 1 << 64)) + power[half:]
    return mix(out)

