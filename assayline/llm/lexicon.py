"""A minimal acyclic transducer from words to token ids, kept as flat arrays in one file that workers memory-map."""

from __future__ import annotations

import numpy as np

_MAGIC = 0x4C58_4131
_MAX_BYTES = 40


def compile_lexicon(entries: dict[bytes, list[int]], path: str) -> dict[str, int]:
    """Writes the automaton of the words (each at most 40 bytes, none empty) to path; returns its sizes.

    States are merged as soon as their suffix languages are known to be equal (words come sorted), so the automaton is
    minimal. An edge carries the number of words that sort before those below it: the sum along a path is the word's
    rank, the transducer's output, which points to its run of ids.
    """
    words = sorted(w for w in entries if 0 < len(w) <= _MAX_BYTES)
    # A state: [final, {label: target}]; the register maps a frozen state to its number.
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path_states: list[list] = [[False, {}]]

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1].items()))
        at = register.get(key)
        if at is None:
            at = register[key] = len(frozen)
            frozen.append(key)
        return at

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            child = path_states.pop()
            path_states[-1][1][last[depth - 1]] = freeze(child)
        for _ in word[common:]:
            path_states.append([False, {}])
        path_states[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        child = path_states.pop()
        path_states[-1][1][last[depth - 1]] = freeze(child)
    root = freeze(path_states[0])

    below = [0] * len(frozen)  # targets are frozen before their sources
    keys, targets, outputs = [], [], []
    for s, (final, edges) in enumerate(frozen):
        n = int(final)
        for label, to in edges:
            keys.append(s << 8 | label)
            targets.append(to)
            outputs.append(n)
            n += below[to]
        below[s] = n
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    ids: list[int] = []
    for k, w in enumerate(words):
        ids += entries[w]
        starts[k + 1] = len(ids)
    arrays = [
        np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int64), np.array(outputs, dtype=np.int64),
        np.array([f for f, _ in frozen], dtype=np.int64), starts, np.array(ids, dtype=np.int64),
    ]
    order = np.argsort(arrays[0], kind="stable")
    arrays[:3] = [a[order] for a in arrays[:3]]
    head = np.array([_MAGIC, root, *[a.size for a in arrays]], dtype=np.int64)
    with open(path, "wb") as out:
        for a in [head, *arrays]:
            out.write(a.tobytes())
    return {"words": len(words), "states": len(frozen), "edges": len(keys)}


class Lexicon:
    """The memory-mapped automaton; looks up many words at a time."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.int64, mode="r")
        if raw[0] != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root, sizes, at, got = int(raw[1]), raw[2:8], 8, []
        for n in sizes:
            got.append(raw[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = got

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it isn't in the lexicon."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words or not self.keys.size:
            return out
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        live = np.flatnonzero((lens > 0) & (lens <= _MAX_BYTES))
        if not live.size:
            return out
        width = int(lens[live].max())
        chars = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in live), dtype=np.uint8).reshape(-1, width)
        state, rank = np.full(live.size, self.root, dtype=np.int64), np.zeros(live.size, dtype=np.int64)
        row = np.arange(live.size)
        for depth in range(width):
            done = lens[live[row]] == depth
            if done.any():
                stop = row[done]
                ok = self.final[state[stop]] == 1
                out[live[stop[ok]]] = rank[stop[ok]]
                row = row[~done]
            if not row.size:
                return out
            want = state[row] << 8 | chars[row, depth]
            at = np.minimum(np.searchsorted(self.keys, want), self.keys.size - 1)
            hit = self.keys[at] == want
            row, at = row[hit], at[hit]
            state[row] = self.targets[at]
            rank[row] += self.outputs[at]
        ok = self.final[state[row]] == 1
        out[live[row[ok]]] = rank[row[ok]]
        return out

    def ids_at(self, rank: int) -> np.ndarray:
        return self.ids[int(self.starts[rank]) : int(self.starts[rank + 1])]
