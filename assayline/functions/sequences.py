"""Mutant codes against amino-acid sequences."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.constants import AMINO

_CODE = re.compile(r"\b([A-Z])(\d+)([A-Z])\b")
_LONG = re.compile(rf"\b({'|'.join(AMINO)})-?(\d+)({'|'.join(AMINO)})?\b", re.IGNORECASE)
_BASES = "TCAG"
#: The standard genetic code in the order of T, C, A, G.
_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codes_of(text: str | None) -> list[tuple[str, int, str | None]]:
    """(original, position, mutant) of one- and three-letter codes, by position; a three-letter code may lack its tail."""
    out = [(a, int(n), b) for a, n, b in _CODE.findall(text or "")]
    out += [(AMINO[a.title()], int(n), AMINO[b.title()] if b else None) for a, n, b in _LONG.findall(text or "")]
    return sorted(set(out), key=lambda c: (c[1], c[0], c[2] or ""))


def offset_of(sequence: str | None, codes: list[tuple[str, int, str | None]], which: str = "orig") -> int | None:
    """The shift nearest 0 (negative first) at which every code's letter stands at its position plus the shift."""
    if not sequence or not codes:
        return None
    want: dict[int, set[str]] = {}
    for a, n, b in codes:
        letters = {x for x in ((a,) if which == "orig" else (b,) if which == "mut" else (a, b)) if x}
        want[n] = want[n] & letters if n in want and which == "orig" else want.get(n, set()) | letters
    lo, hi = 1 - min(want), len(sequence) - max(want)
    for shift in sorted(range(lo, hi + 1), key=lambda s: (abs(s), s)):
        if all(sequence[n + shift - 1] in letters for n, letters in want.items()):
            return shift
    return None


@F.pandas_udf(T.IntegerType())
def sequence_offset(sequence: pd.Series, codes: pd.Series) -> pd.Series:
    """Offset of a text of codes in a sequence, null if it doesn't fit anywhere."""
    return pd.Series([offset_of(s, codes_of(c)) for s, c in zip(sequence, codes)], dtype="Int32")


def pattern_of(codes: list[tuple[str, int, str | None]], allow_mutant: bool = False) -> tuple[str, int] | None:
    """(regular expression with '.' between the codes' letters, first position)."""
    at: dict[int, set[str]] = {}
    for a, n, b in codes:
        at.setdefault(n, set()).update(x for x in ((a, b) if allow_mutant else (a,)) if x)
    if not at:
        return None
    spots, out = sorted(at), ""
    for k, n in enumerate(spots):
        gap = n - spots[k - 1] - 1 if k else 0
        letters = "".join(sorted(at[n]))
        out += ("." if gap == 1 else f".{{{gap}}}" if gap else "") + (letters if len(letters) == 1 else f"[{letters}]")
    return out, spots[0]


def nearest_hit(sequence: str | None, codes: list[tuple[str, int, str | None]], allow_mutant: bool = False) -> tuple[int, int] | None:
    """(found position, wanted position) of the overlapping match nearest the codes' own place, both from 1."""
    p = pattern_of(codes, allow_mutant)
    if p is None or not sequence:
        return None
    hits = [m.start() + 1 for m in re.finditer(f"(?={p[0]})", sequence)]
    return (min(hits, key=lambda h: (abs(h - p[1]), h)), p[1]) if hits else None


def nearest_set_hit(sequence: str | None, wanted: dict[int, str], start: int) -> tuple[int | None, int]:
    """(index, target), both from 0: where the letters allowed at each position stand in a row, nearest to their own place;
    of equally near hits the first."""
    if not wanted or not sequence:
        return None, -1
    target, span = start - 1, max(wanted) - start
    hits = [i for i in range(len(sequence) - span) if all(sequence[i + p - start] in letters for p, letters in wanted.items())]
    return (min(hits, key=lambda i: abs(i - target)) if hits else None), target


def allowed_letters(codes: list[tuple[str, int, str | None]]) -> dict[int, str]:
    """Position to the letters of its codes, original and mutant."""
    out: dict[int, set] = {}
    for a, n, b in codes:
        out.setdefault(n, set()).update(x for x in (a, b) if x)
    return {n: "".join(sorted(x)) for n, x in out.items()}


@F.pandas_udf(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("target", T.IntegerType())]))
def closest_sets(sequence: pd.Series, codes: pd.Series) -> pd.DataFrame:
    """nearest_set_hit() of a text of codes in a sequence."""
    rows = []
    for s, c in zip(sequence, codes):
        wanted = allowed_letters(codes_of(c))
        rows.append(nearest_set_hit(s, wanted, min(wanted)) if wanted else (None, -1))
    return pd.DataFrame(rows, columns=["index", "target"]).astype("Int32")


@F.pandas_udf(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("target", T.IntegerType())]))
def corroborate(sequence: pd.Series, codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([nearest_hit(s, codes_of(c)) or (None, None) for s, c in zip(sequence, codes)], columns=["index", "target"]).astype("Int32")


def translate(sequence: str | None) -> str | None:
    """A nucleotide sequence as amino acids (unknown codons X, incomplete ones padded with N); other sequences unchanged."""
    if not sequence or set(sequence.upper()) - set("CAGT"):
        return sequence
    s = sequence.upper() + "N" * (-len(sequence) % 3)
    of = lambda c: _ACIDS[16 * _BASES.index(c[0]) + 4 * _BASES.index(c[1]) + _BASES.index(c[2])] if "N" not in c else "X"
    return "".join(of(s[k : k + 3]) for k in range(0, len(s), 3))


@F.pandas_udf(T.StringType())
def amino_sequence(sequence: pd.Series) -> pd.Series:
    return pd.Series([translate(s) for s in sequence], dtype=object)


def chance_of_match(n: Column, k: Column, alphabet: int = 20) -> Column:
    """1 - (1 - alphabet^-k)^(n - k + 1): that k letters stand somewhere in n by chance."""
    return 1 - F.pow(1 - F.pow(F.lit(float(alphabet)), -k), F.greatest(n - k + 1, F.lit(0)))


def chance_of_offset(k: Column, offset: Column, alphabet: int = 20) -> Column:
    return 1 - F.pow(1 - F.pow(F.lit(float(alphabet)), -k), 1 + 2 * F.abs(offset))


def share_score(a: str | None, b: str | None) -> int:
    """0 to 3 by how much of the shorter text matching blocks cover: all, over 80 %, over 40 % or a block over 10 characters."""
    if not a or not b:
        return 0
    blocks = [m.size for m in SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).get_matching_blocks()]
    share = sum(blocks) / min(len(a), len(b))
    return 3 if share == 1 else 2 if share > 0.8 else 1 if share > 0.4 or max(blocks) > 10 else 0


@F.pandas_udf(T.BooleanType())
def enzyme_corroborated(name: pd.Series, organism: pd.Series, found_name: pd.Series, found_organism: pd.Series) -> pd.Series:
    return pd.Series([share_score(n, fn) + share_score(o, fo) >= 2 for n, o, fn, fo in zip(name, organism, found_name, found_organism)])
