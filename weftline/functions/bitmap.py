"""Compressed integer sets: sorted 16-bit arrays for thin blocks, 65,536-bit words for dense ones."""

from __future__ import annotations

import numpy as np

#: A block with more members than this is kept as a bit field (both forms then take 8 KiB).
DENSE = 4096
_BLOCK = 1 << 16


def _words(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BLOCK, dtype=bool)
    bits[low] = True
    return np.packbits(bits)


def _members(block: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(block)).astype(np.uint16) if block.dtype == np.uint8 else block


def _pack(low: np.ndarray) -> np.ndarray:
    return _words(low) if len(low) > DENSE else low


class Bitmap:
    """An immutable set of non-negative integers below 2**47, in blocks of 2**16."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, np.ndarray] | None = None):
        self.blocks = blocks or {}

    @classmethod
    def of(cls, ids) -> "Bitmap":
        ids = np.unique(np.asarray(ids, dtype=np.int64))
        if not len(ids):
            return cls()
        high = ids >> 16
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        low = (ids & 0xFFFF).astype(np.uint16)
        return cls({int(high[s]): _pack(low[s:e]) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)})

    def _each(self, other: "Bitmap", keep_missing: bool, dense, thin) -> "Bitmap":
        out = {}
        for k, a in self.blocks.items():
            b = other.blocks.get(k)
            if b is None:
                if keep_missing:
                    out[k] = a
                continue
            if a.dtype == np.uint8 and b.dtype == np.uint8:
                low = _members(dense(a, b))
            elif b.dtype == np.uint8:
                hit = (b[a >> 3] >> (7 - (a & 7))) & 1
                low = a[thin(hit.astype(bool))]
            else:
                a = _members(a)
                low = a[thin(np.isin(a, b, assume_unique=True))]
            if len(low):
                out[k] = _pack(low)
        return Bitmap(out)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        return self._each(other, True, lambda a, b: a & ~b, lambda hit: ~hit)

    def and_(self, other: "Bitmap") -> "Bitmap":
        return self._each(other, False, lambda a, b: a & b, lambda hit: hit)

    def decode(self) -> np.ndarray:
        """The members in ascending order."""
        parts = [(k << 16) + _members(b).astype(np.int64) for k, b in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    def __len__(self) -> int:
        return sum(int(np.bitwise_count(b).sum()) if b.dtype == np.uint8 else len(b) for b in self.blocks.values())

    def nbytes(self) -> int:
        return sum(b.nbytes for b in self.blocks.values())
