"""A minimal acyclic transducer from words to lists of ids, laid out for memory mapping."""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np

_MAGIC = b"WFTR0001"


class _Builder:
    """Incremental minimisation: words come in order, and finished suffixes are shared through a register."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = [[]]
        self.final: list[bool] = [False]
        self.register: dict[tuple, int] = {}
        self.open: list[int] = [0]  # states of the last word
        self.last = b""

    def add(self, word: bytes) -> None:
        same = 0
        while same < min(len(word), len(self.last)) and word[same] == self.last[same]:
            same += 1
        self._close(same)
        for byte in word[same:]:
            self.edges.append([])
            self.final.append(False)
            self.edges[self.open[-1]].append((byte, len(self.edges) - 1))
            self.open.append(len(self.edges) - 1)
        self.final[self.open[-1]] = True
        self.last = word

    def _close(self, keep: int) -> None:
        while len(self.open) > keep + 1:
            state = self.open.pop()
            key = (self.final[state], *self.edges[state])
            known = self.register.setdefault(key, state)
            if known != state:
                parent = self.edges[self.open[-1]]
                parent[-1] = (parent[-1][0], known)

    def finish(self) -> tuple[np.ndarray, ...]:
        """Arrays of the reachable states: edge starts, finality, labels, targets and words to skip."""
        self._close(0)
        order, number, stack = [], {}, [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                if s not in number:
                    number[s] = len(order)
                    order.append(s)
            elif s not in number:
                stack.append((s, True))
                stack.extend((t, False) for _, t in self.edges[s])
        words: dict[int, int] = {}
        starts, labels, targets, skips = [0], bytearray(), [], []
        for s in order:  # children come first
            n = int(self.final[s])
            for byte, t in self.edges[s]:
                labels.append(byte)
                targets.append(number[t])
                skips.append(n)
                n += words[t]
            words[s] = n
            starts.append(len(targets))
        final = np.array([self.final[s] for s in order], dtype=np.uint8)
        return np.array(starts, "<i4"), final, np.frombuffer(bytes(labels), np.uint8), np.array(targets, "<i4"), np.array(skips, "<i4")


def compile_words(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct words and their ids, as bytes.

    Suffixes are shared between words with different ids: a path spells out the rank of its word, and the rank finds
    the ids.
    """
    entries = sorted(words)
    builder = _Builder()
    for word, _ in entries:
        builder.add(word)
    starts, final, labels, targets, skips = builder.finish()
    at = np.zeros(len(entries) + 1, "<i4")
    np.cumsum([len(ids) for _, ids in entries], out=at[1:])
    ids = np.array([i for _, ids in entries for i in ids], "<i4")
    parts = [starts, targets, skips, at, ids, final, labels]
    head = _MAGIC + struct.pack("<7q", *[p.nbytes for p in parts])
    return b"".join([head, *[p.tobytes() + bytes(-p.nbytes % 8) for p in parts]])


class Transducer:
    """Looks words up in a compiled automaton, mapped from a file or held as bytes."""

    def __init__(self, data: bytes | mmap.mmap):
        if data[:8] != _MAGIC:
            raise ValueError("not a transducer file")
        self.data = data
        view, pos, parts = memoryview(data), 64, []
        for n in struct.unpack("<7q", data[8:64]):
            parts.append((pos, n))
            pos += n + -n % 8
        self.starts, self.targets, self.skips, self.at, self.ids = (view[p : p + n].cast("i") for p, n in parts[:5])
        self.final = view[parts[5][0] : sum(parts[5])]
        self.labels = parts[6][0]
        self.root = len(self.starts) - 2

    @classmethod
    def open(cls, path: str) -> "Transducer":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __len__(self) -> int:
        return len(self.at) - 1

    def get(self, word: bytes) -> list[int] | None:
        state, rank, find, base = self.root, 0, self.data.find, self.labels
        for k in range(len(word)):
            edge = find(word[k : k + 1], base + self.starts[state], base + self.starts[state + 1]) - base
            if edge < 0:
                return None
            rank += self.skips[edge]
            state = self.targets[edge]
        return self.ids[self.at[rank] : self.at[rank + 1]].tolist() if self.final[state] else None
