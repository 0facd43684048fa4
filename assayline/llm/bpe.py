"""Encoding and decoding with a word BPE: frequent words come from a memory-mapped transducer, others are merged exactly.

White space is a boundary of this tokenizer and never a token, so a text is cut into chunks at white space; a chunk's
ids and decoded form don't depend on its neighbours. Corpus counts choose the words that are compiled into the lexicon
(see lexicon.py); the file reaches every executor through SparkContext.addFile, also those that replace lost ones.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.batches import Cache, held, slices
from assayline.llm.lexicon import Lexicon, compile_lexicon

#: Bytes of text that are split at a time.
SLICE = 1 << 20
#: Text in which Python's own case and space rules agree with the tokenizer's normaliser, and NFC changes nothing.
_PLAIN = re.compile(r"[\t-\r -~¡-ÿ]*")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: The tokenizer's own word pattern, for lower-cased characters of _PLAIN.
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return out


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes whole texts; one lives in each Python worker."""

    def __init__(self, tokenizer_path: str, lexicon_path: str | None = None, cache: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = str.maketrans({b: c for b, c in _byte_chars().items()})
        self.token = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.chunks = Cache(cache)
        self.tally = {"looked_up": 0, "merged": 0}
        self._check()

    def _check(self) -> None:
        """This codec cuts, lower-cases and joins as one kind of tokenizer does: any other file is refused."""
        for text in ("It's 12.5 ÀÉ naïve_x y\tz’s\n日本語 Straße  don't", "  a-b (c) ½²", ""):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            got, decoded = self.code([text])[0]
            if np.frombuffer(got, dtype="<u4").tolist() != ids or decoded != self.tok.decode(ids, skip_special_tokens=False):
                raise ValueError("not a lower-casing byte-level word BPE whose words are joined by spaces")
        self.tally = {"looked_up": 0, "merged": 0}

    def words(self, chunk: str) -> list[bytes]:
        """The tokenizer's words of a normalised chunk, as UTF-8."""
        if _PLAIN.fullmatch(chunk):
            return [w.encode() for w in _WORDS.findall(chunk)]
        back = {c: b for b, c in _byte_chars().items()}
        return [bytes(back[c] for c in w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(chunk)]

    def merge(self, word: bytes) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(word.decode("latin-1").translate(self.alphabet))]

    def normal_chunks(self, text: str) -> list[str]:
        """Normalised chunks of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return text.lower().split()
        return [c for c in self.tok.normalizer.normalize_str(text).split(" ") if c]

    def learn(self, chunks: set[str]) -> None:
        """Puts what isn't cached into the cache: the lexicon answers all words of all chunks at once, the rest is merged."""
        new = self.chunks.missing(chunks)
        split = [self.words(c) for c in new]
        words = list(set().union(*split))
        ranks = self.lexicon.ranks(words) if self.lexicon else np.full(len(words), -1)
        ids = {}
        for w, r in zip(words, ranks):
            ids[w] = self.lexicon.ids_at(r).tolist() if r >= 0 else self.merge(w)
        known = int((ranks >= 0).sum())
        self.tally["looked_up"] += known
        self.tally["merged"] += len(words) - known
        token, chunks = self.token, self.chunks
        for c, ws in zip(new, split):
            all_ids = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            chunks[c] = (_packed(all_ids), token[all_ids[0]] if len(all_ids) == 1 else " ".join([token[i] for i in all_ids]))

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split: list[list[str | int]] = []
        for text in texts:
            if self.cut is not None and self.cut.search(text):
                parts: list[str | int] = []
                for p in self.cut.split(text):
                    parts += [self.special[p]] if p in self.special else self.normal_chunks(p)
                split.append(parts)
            else:
                split.append(self.normal_chunks(text))
        self.learn(set().union(*split) - set(self.special.values()))
        get, out = self.chunks.__getitem__, []
        for parts in split:
            try:
                got = list(map(get, parts))
            except KeyError:  # a special token's id stands among the chunks
                got = [get(p) if p.__class__ is str else (_packed([p]), self.token[p]) for p in parts]
            ids, decoded = zip(*got) if got else ((), ())
            out.append((b"".join(ids), " ".join(decoded)))
        return out


def _codec(tokenizer_path: str, lexicon_name: str | None, cache: int = 120_000) -> Codec:
    return held(("bpe", tokenizer_path, lexicon_name, cache), lambda: Codec(tokenizer_path, SparkFiles.get(lexicon_name) if lexicon_name else None, cache))


def frequent_words(docs: DataFrame, tokenizer_path: str, size: int, text_col: str = "text", task_words: int = 100_000) -> DataFrame:
    """The (word, n) that occur most often in all texts, at most size rows.

    A task keeps a heavy-hitter table: past 2 * task_words words it keeps the task_words most frequent, and it sends
    those seen twice or more. The lexicon only decides where ids are found, never which, so the table may be approximate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import bpe as here

        codec, seen = here._codec(tokenizer_path, None), Counter()
        for batch in batches:
            for part in slices(batch, "__text", SLICE, keep=True):
                chunks: Counter = Counter()
                for text in part.column("__text").to_pylist():
                    chunks.update(codec.normal_chunks(text))
                for chunk, n in chunks.items():
                    for w in codec.words(chunk):
                        seen[w] += n
                if len(seen) > 2 * task_words:
                    seen = Counter(dict(seen.most_common(task_words)))
        kept = [(w, n) for w, n in seen.items() if n > 1]
        for at in range(0, len(kept), 50_000):
            some = kept[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("__text"))
    counted = rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(size)


def build_lexicon(docs: DataFrame, tokenizer_path: str, size: int = 32_768, text_col: str = "text") -> str:
    """Compiles the corpus' frequent words (at most size of them: the driver's bound) and ships the file; returns its name."""
    words = [bytes(r["word"]) for r in frequent_words(docs, tokenizer_path, size, text_col).collect()]
    codec = Codec(tokenizer_path)
    path = os.path.join(tempfile.mkdtemp(prefix="assayline-"), f"lexicon-{uuid.uuid4().hex}.bin")
    compile_lexicon({w: codec.merge(w) for w in words}, path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_decode(
    docs: DataFrame, tokenizer_path: str, lexicon_name: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = 120_000
) -> DataFrame:
    """(id, ids binary, decoded string) of every row; cache: chunks that a worker remembers at least. Null and empty texts give no ids and an empty string;
    repeated rows repeat, an empty table gives an empty result, other columns are not read.

    ids are little-endian unsigned 32-bit integers. Strings of special tokens inside a text are encoded as those tokens
    and kept by decoding, as the library does by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import bpe as here

        codec = here._codec(tokenizer_path, lexicon_name, cache)
        for batch in batches:
            for part in slices(batch, "__text", SLICE, keep=True):
                got = codec.code(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], ["__id", "ids", "decoded"]
                )

    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, ids binary, decoded string").withColumnRenamed("__id", id_col)


def coding_digests(
    docs: DataFrame, tokenizer_path: str, lexicon_name: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = 120_000
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) as encode_decode gives them (with the same cache), hashed where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from assayline.llm import bpe as here

        codec = here._codec(tokenizer_path, lexicon_name, cache)
        for batch in batches:
            for part in slices(batch, "__text", SLICE, keep=True):
                got = codec.code(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id"), pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                        pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()),
                    ],
                    ["__id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("__id", id_col)
