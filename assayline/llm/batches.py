"""Helpers for Arrow functions over texts: slices of bounded bytes, a bounded cache, and bounded broadcast bitmaps."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 2 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice's texts have at most max_bytes, or it is one row. Without `keep` the worker drops what
    held() keeps: the operator that runs now has no use for it."""
    if not keep:
        _HELD.clear()
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start, held = np.cumsum(sizes, dtype=np.int64), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, held + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start, held = stop, int(ends[stop - 1])
    tidy()


def portions(texts: list[str], chars: int = 500_000) -> Iterator[list[tuple[int, str]]]:
    """(position, text) of about `chars` characters at a time; a longer text is cut at spaces (in it, if none is near)."""
    held_now, part = 0, []
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at > chars:
            stop = max(t.rfind(" ", at + chars // 2, at + chars), t.rfind("\n", at + chars // 2, at + chars)) + 1 or at + chars
            yield [(k, t[at:stop])]
            at = stop
        if part and held_now + len(t) - at > chars:
            yield part
            held_now, part = 0, []
        part.append((k, t[at:] if at else t))
        held_now += len(t) - at
    if part:
        yield part


def tidy() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and others run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


class Cache(dict):
    """A dict of two generations: once the young one is full it becomes the old one, so at most 2 * limit entries live."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: set) -> list:
        """The keys that are in neither generation; those in the old one move up. Call before looking up any of them."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys - self.keys():
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out


_HELD: dict = {}


def held(key: tuple, make):
    """A worker's one large object: kept from task to task until another operator (or model) asks for its own."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class Bitmap:
    """A set of 64-bit hashes as a bit array: no false negatives; its size is fixed by n_bits, not by the data."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(bits.size * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bitmap_of(df: DataFrame, hash_col: str, n_rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> Bitmap:
    """The bitmap of a long column, built by Spark's bitmap aggregate: at most max_bits / 8 bytes reach the driver.

    Beyond max_bits / bits_per_row rows it only filters less; callers must treat a hit as 'maybe'.
    """
    n_bits = 1 << 18
    while n_bits < min(max_bits, n_rows * bits_per_row):
        n_bits <<= 1
    low = F.col(hash_col).bitwiseAND(F.lit(n_bits - 1))
    parts = df.groupBy(F.bitmap_bucket_number(low + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low + 1)).alias("b"))
    bits = np.zeros(n_bits >> 3, dtype=np.uint8)
    for r in parts.toLocalIterator():
        at = (r["k"] - 1) * 4096
        got = np.frombuffer(bytes(r["b"]), dtype=np.uint8)
        bits[at : at + got.size] = got[: bits.size - at]
    return Bitmap(bits)
