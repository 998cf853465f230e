"""Longest common subsequences, one pair at a time and for many pairs at once."""

from __future__ import annotations

import numpy as np


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = masks.get(ch)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (len a + len b); two empty texts are alike."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


_WIDTH = 64


class TextColumn:
    """Texts as rows of small integers (0: the end; 1-26 the letters, 27 the rest), cut for the bulk path at 64."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = "".join(t[:_WIDTH].ljust(_WIDTH, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32).reshape(len(texts), _WIDTH)
        small = codes.astype(np.int64) - 96
        self.codes = np.where(codes == 0, 0, np.where((small < 1) | (small > 26), 27, small)).astype(np.uint8)
        self.plain = (self.sizes <= _WIDTH) & ((self.codes != 27).all(axis=1))


def lcs_pairs(column: TextColumn, left: np.ndarray, right: np.ndarray, other: TextColumn | None = None, step: int = 1 << 15) -> np.ndarray:
    """LCS length of ``column[left]`` and ``other[right]``; texts too long or with other characters go one by one."""
    other = other or column
    out = np.zeros(len(left), np.int64)
    for s in range(0, len(left), step):
        a, b = left[s : s + step], right[s : s + step]
        n = len(a)
        A, B = column.codes[a], other.codes[b]
        rows = np.arange(n)
        masks = np.zeros((28, n), np.uint64)
        for i in range(int(min(_WIDTH, column.sizes[a].max(initial=0)))):
            masks[A[:, i], rows] |= np.uint64(1) << np.uint64(i)
        masks[0] = 0
        masks[27] = 0
        row = np.full(n, np.uint64(2**64 - 1))
        for j in range(int(min(_WIDTH, other.sizes[b].max(initial=0)))):
            u = row & masks[B[:, j], rows]
            row = (row + u) | (row - u)
        out[s : s + step] = 64 - np.bitwise_count(row).astype(np.int64)
        for k in np.flatnonzero(~(column.plain[a] & other.plain[b])):
            out[s + k] = lcs(column.texts[a[k]], other.texts[b[k]])
    return out
