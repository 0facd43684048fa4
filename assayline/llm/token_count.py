"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split where the tokenizer's own splitting must break (between a visible character and one space before
another visible character), so a text's count is the sum over its pieces. Pieces are cached by their count; unseen ones
are encoded in batches of equal bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import Cache, held, slices

#: A space at either end or beside other white space: splitting at every single space would not be safe.
_ODD_SPACE = re.compile(r"^\s|\s$|\s\s")
#: Characters that count as white space in some of the engines involved and not in others.
_DISPUTED = re.compile(r"[\x1c-\x1f\x85᠎​⁠﻿]")


#: Before a single space between two characters that all engines count as visible.
_SAFE = re.compile(rf"(?<=[^\s{_DISPUTED.pattern[1:-1]}])(?= [^\s{_DISPUTED.pattern[1:-1]}])")


def pieces(text: str) -> tuple[str, list[str]]:
    """(first piece, later pieces without the single space they begin with); their tokens concatenate to the text's."""
    if _ODD_SPACE.search(text) or _DISPUTED.search(text):
        parts = _SAFE.split(text)
        return parts[0], [p[1:] for p in parts[1:]]
    parts = text.split(" ")
    return parts[0], parts[1:]


class Counter:
    """Counts tokens with a tokenizers file; one lives in each Python worker."""

    def __init__(self, path: str, cache: int = 250_000, batch_bytes: int = 1 << 18):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.later, self.batch_bytes = Cache(cache), batch_bytes
        # Pieces begin with their space, as one kind of tokenizer has it: any other file is refused.
        probe = ["It's 12 naïve_x  y\tz’s\n日本語 straße  don't a-b", " lead (c) ½ ", ""]
        if self.count(probe) != [len(self.tok.encode(t, add_special_tokens=False).ids) for t in probe]:
            raise ValueError("not a byte-level BPE whose words begin with their space")

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts in batches that hold about batch_bytes each, longest texts last."""
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        out, batch, held = [0] * len(texts), [], 0
        for i in order:
            batch.append(i)
            held += (len(texts[i]) if texts[i].isascii() else len(texts[i].encode())) + 16
            if held >= self.batch_bytes:
                self._encode(texts, batch, out)
                batch, held = [], 0
        self._encode(texts, batch, out)
        return out

    def _encode(self, texts: list[str], batch: list[int], out: list[int]) -> None:
        if batch:
            for i, e in zip(batch, self.tok.encode_batch_fast([texts[i] for i in batch], add_special_tokens=False)):
                out[i] = len(e)

    def count(self, texts: list[str]) -> list[int]:
        split = [pieces(t) for t in texts]
        new = self.later.missing(set().union(*(rest for _, rest in split)))
        self.later.update(zip(new, self.lengths([" " + p for p in new])))
        get = self.later.__getitem__
        return [n + sum(map(get, rest)) for n, (_, rest) in zip(self.lengths([first for first, _ in split]), split)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, repeated rows included; a null text counts as empty (0 tokens). An
    empty table gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import token_count as here

        counter = held(("count", tokenizer_path), lambda: here.Counter(tokenizer_path))
        for batch in batches:
            for part in slices(batch, "__text", keep=True):
                n = pa.array(counter.count(part.column("__text").to_pylist()), pa.int64())
                size = pc.cast(pc.binary_length(part.column("__text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("__id"), size, n, pc.greater(n, limit)], ["__id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("__id", id_col)
