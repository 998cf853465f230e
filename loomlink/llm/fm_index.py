"""A compressed full-text index (FM-index over a wavelet matrix) on numpy arrays, searched in bulk."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols of a sequence by their bits, packed in 64-bit words with counts per word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(symbols) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at``, restricted to ``symbol``, ends on the lowest level."""
        for k in range(self.bits):
            word, inside = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << inside) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


def collection_suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of texts laid end to end, each closed by a 0 at ``ends``; the closing zeros count as different, in order."""
    n = len(codes)
    rank = codes.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of a collection of texts, each with an owner; -1 owns as someone else than anybody."""

    def __init__(self, texts: list[str], owners: np.ndarray):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        whole = np.zeros(int(ends[-1]) + 1, np.int64)
        spots = np.ones(len(whole), bool)
        spots[ends] = False
        letters = np.concatenate(raw).astype(np.int64)
        self.alphabet = np.unique(letters)
        whole[spots] = np.searchsorted(self.alphabet, letters) + 1
        self.codes, self.starts, self.lengths = whole, ends - lengths, lengths
        order = collection_suffix_array(whole, ends)
        bwt = whole[order - 1]
        bwt[order == 0] = 0
        top = len(self.alphabet) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=top))])
        self.n = len(whole)
        self.matrix = WaveletMatrix(bwt, max(1, int(top - 1).bit_length()))
        symbols = np.arange(top)
        self.floor = self.matrix.descend(np.zeros(top, np.int64), symbols)
        owner = np.repeat(owners, lengths + 1)[order]
        self.owner = owner
        # The first later place with another owner; with -1 every place differs from the next.
        change = np.flatnonzero((owner[1:] != owner[:-1]) | (owner[1:] == -1)) + 1
        nxt = np.searchsorted(change, np.arange(self.n), "right")
        self.next_other = np.append(change, self.n)[nxt]

    def extend_left(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.before[symbol] - self.floor[symbol]
        both = self.matrix.descend(np.concatenate([lo, hi]), np.concatenate([symbol, symbol]))
        return base + both[: len(lo)], base + both[len(lo) :]

    def shared(self, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether the interval holds a suffix of another owner."""
        inside = hi > lo
        first = np.where(inside, lo, 0)
        return inside & ((self.owner[first] != owner) | (self.next_other[first] < hi))

    def matched(self, text: np.ndarray, end: np.ndarray, most: int, owner: np.ndarray) -> np.ndarray:
        """For positions ``end`` (exclusive) in texts ``text``, how far to the left another owner's text matches, up to ``most``.

        This is the matching statistic of that position, cut at ``most``: the backward search runs for all
        positions at once and each drops out where no other owner's suffix is left.
        """
        out = np.zeros(len(text), np.int64)
        live = np.arange(len(text))
        lo, hi = np.zeros(len(text), np.int64), np.full(len(text), self.n, np.int64)
        at = self.starts[text] + end - 1
        for _ in range(most):
            lo, hi = self.extend_left(lo, hi, self.codes[at])
            keep = self.shared(lo, hi, owner[live])
            live, lo, hi, at = live[keep], lo[keep], hi[keep], at[keep] - 1
            out[live] += 1
            inside = at >= self.starts[text[live]]
            if not inside.all():
                live, lo, hi, at = live[inside], lo[inside], hi[inside], at[inside]
            if not len(live):
                break
        return out
