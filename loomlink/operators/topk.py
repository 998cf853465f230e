"""Exact top-k by the dot product of n-gram vectors, on numpy arrays: bounds decide which pairs are scored in full. Queries run it in the JVM (TopTexts.java)."""

from __future__ import annotations

import numpy as np

#: Stands between the texts of one key; no gram spans it.
SEP = "\U0010ffff"
_LEVELS, _GROUPS, _CELLS, _LONG, _AGAIN = 24, 1024, 1 << 18, 200, 0.12


def gram_codes(texts: list[str], in_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """``row, code`` of all 3-grams; ``in_words`` pads every word with blanks and stays inside it. A code holds three code points."""
    if in_words:
        texts = [" " + t.replace(SEP, f" {SEP} ") + " " for t in texts]
    c = np.frombuffer(SEP.join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))[: len(c)]
    apart = c == ord(SEP)
    ok = ~(apart[:-2] | apart[1:-1] | apart[2:])
    if in_words:
        ok &= c[1:-1] != 32
    at = np.flatnonzero(ok)
    return row[at], (c[at] << 42) | (c[at + 1] << 21) | c[at + 2]


class Grams:
    """The grams that count, the rarest first, with the weight of each in its part (field)."""

    def __init__(self, part: np.ndarray, code: np.ndarray, idf: np.ndarray):
        order = np.lexsort((code, part, -idf))
        self.part, self.idf, self.n = part[order], idf[order], len(idf)
        code, self.known = code[order], {}
        for p in np.unique(part):
            rank = np.flatnonzero(self.part == p)
            rank = rank[np.argsort(code[rank])]
            self.known[int(p)] = code[rank], rank

    def vectors(self, texts: list[list[str]], in_words: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, rank, w`` in this order, each field's vector of length 1 and of the same share in the whole."""
        keys, fields = [np.empty(0, np.int64)], len(texts)
        for p, (t, inside) in enumerate(zip(texts, in_words)):
            codes, rank = self.known.get(p, (np.empty(0, np.int64),) * 2)
            if len(codes):
                row, code = gram_codes(t, inside)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                keys.append(row[hit] * self.n + rank[at[hit]])
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        row, rank = np.divmod(key, max(self.n, 1))
        w = (1 + np.log(tf)) * self.idf[rank]
        field = row * fields + self.part[rank]
        norm = np.sqrt(np.bincount(field, w * w, len(texts[0]) * fields))
        return row, rank, w / norm[field] * np.sqrt(1 / fields)


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions of the stretches, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


class Index:
    """Rows by gram and grams by row. ``rest[l]`` is the length of each row's vector over the grams from level ``l`` on."""

    def __init__(self, grams: Grams, texts: list[list[str]], in_words: list[bool]):
        self.grams, self.in_words, self.rows = grams, in_words, len(texts[0])
        row, self.rank, self.w = grams.vectors(texts, in_words)
        self.ptr = np.searchsorted(row, np.arange(self.rows + 1))
        order = np.argsort(self.rank, kind="stable")
        self.post_row, self.post_w = row[order], self.w[order].astype(np.float32)
        self.post_ptr = np.searchsorted(self.rank[order], np.arange(grams.n + 1))
        # Levels hold the more grams, the rarer these are: each has the same share of the postings, weighed by their length.
        lens = np.diff(self.post_ptr).astype(np.float64)
        cost = np.cumsum(lens * lens)
        self.level_at = np.unique(np.concatenate(([0], np.searchsorted(cost, cost[-1] * np.arange(1, _LEVELS) / _LEVELS, "left"), [grams.n]))) if grams.n else np.array([0])
        self.groups = min(_GROUPS, self.rows)
        self.wide = -(-self.rows // self.groups)
        self.rest = np.zeros((len(self.level_at), self.groups * self.wide), np.float32)
        self.rest[:, : self.rows] = self._lengths(row, self.rank, self.w, self.rows).T

    def _lengths(self, row: np.ndarray, rank: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        """For each row and level, the length of its vector over the grams from that level on."""
        levels = len(self.level_at)
        level = np.searchsorted(self.level_at, np.arange(self.grams.n), "right") - 1
        squares = np.bincount(row * levels + level[rank], w * w, rows * levels).reshape(rows, levels)
        return np.sqrt(squares[:, ::-1].cumsum(axis=1)[:, ::-1])

    def _add(self, acc: np.ndarray, q: np.ndarray, rank: np.ndarray, w: np.ndarray) -> None:
        """Adds the products of the postings of ``rank`` with ``w`` to the rows ``q`` of ``acc``."""
        starts, lens = self.post_ptr[rank], self.post_ptr[rank + 1] - self.post_ptr[rank]
        w = w.astype(np.float32)
        long = lens >= _LONG
        for j in np.flatnonzero(long):
            own = slice(starts[j], starts[j] + lens[j])
            np.add.at(acc[q[j]], self.post_row[own], self.post_w[own] * w[j])
        short = ~long
        if short.any():
            lens = lens[short]
            at = _spread(starts[short], lens)
            np.add.at(acc.reshape(-1), np.repeat(q[short] * acc.shape[1], lens) + self.post_row[at], self.post_w[at] * np.repeat(w[short], lens))

    def _likely(self, acc: np.ndarray, level: np.ndarray | None, length: np.ndarray, k: int, floor: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its ``k`` best and reach its ``floor``."""
        slack = self.slack
        best = acc.reshape(len(acc), self.wide, self.groups).max(axis=1)
        least = np.partition(best, self.groups - k, axis=1)[:, self.groups - k] if k <= self.groups else np.zeros(len(acc), np.float32)
        if k > self.groups and k < self.rows:  # the k-th best lies below the group maxima
            least = np.partition(acc, acc.shape[1] - k, axis=1)[:, acc.shape[1] - k]
        found, most = [], np.empty_like(acc[0])
        for j, a in enumerate(acc):
            if level is not None:
                np.multiply(self.rest[level[j]], length[j], out=most)
                a = np.add(most, a, out=most)
            found.append(np.flatnonzero(a >= np.float32(max(max(least[j], floor[j]) - slack, 1e-9))))
        return found

    def top(self, row: np.ndarray, rank: np.ndarray, w: np.ndarray, floor: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, row, score``: the ``k`` best rows of each query by rounded score, then by row; only positive scores, of its ``floor`` at least."""
        n = len(floor)
        self.slack = 10.0**-digits + 2e-5
        levels = len(self.level_at)
        ptr = np.searchsorted(row, np.arange(n + 1))
        length = self._lengths(row, rank, w, n)
        batch, out, skip = max(1, min(256, _CELLS // self.rest.shape[1])), [], 0.3
        many = 256 + 5 * k
        for first in range(0, n, batch):
            last = min(n, first + batch)
            own = slice(ptr[first], ptr[last])
            q, g, v = row[own] - first, rank[own], w[own]
            level = (length[first:last] > skip).sum(axis=1).clip(max=levels - 1)
            tail = length[np.arange(first, last), level].astype(np.float32)
            acc = np.zeros((last - first, self.rest.shape[1]), np.float32)
            early = g < self.level_at[level][q]
            self._add(acc, q[early], g[early], v[early])
            found = self._likely(acc, level, tail + np.float32(1e-6), k, floor[first:last])
            open_ = np.array([len(x) > many for x in found])
            if open_.any():  # the bound leaves too many: the other grams are added, too
                again = open_ & (tail > 0)
                if again.any():
                    to = np.cumsum(again) - 1
                    more = again[q] & ~early
                    part = acc[again]
                    self._add(part, to[q[more]], g[more], v[more])
                    for j, x in zip(np.flatnonzero(again), self._likely(part, None, tail, k, floor[first:last][again])):
                        found[j] = x
            mean = np.mean([min(len(x), many) for x in found])
            skip = max(0.02, skip * 0.9) if open_.mean() > _AGAIN or mean > many / 2 else min(0.8, skip * 1.05) if mean < many / 4 else skip
            out.append(self._scored(first, q, g, v, found, k, digits))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _scored(self, first: int, q: np.ndarray, g: np.ndarray, v: np.ndarray, found: list[np.ndarray], k: int, digits: int) -> tuple[np.ndarray, ...]:
        """The likely rows in full: ``query, row, score`` of the best ``k``."""
        sizes = np.array([len(x) for x in found])
        row = np.concatenate(found)
        own = np.repeat(np.arange(len(found)), sizes)
        full = np.zeros((len(found), self.grams.n))
        full[q, g] = v
        lens = self.ptr[row + 1] - self.ptr[row]
        at = _spread(self.ptr[row], lens)
        pair = np.repeat(np.arange(len(row)), lens)
        score = np.bincount(pair, full.reshape(-1)[own[pair] * self.grams.n + self.rank[at]] * self.w[at], len(row))
        score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
        keep = score > 0
        own, row, score, _ = _best(own[keep], row[keep], score[keep], k)
        return own + first, row, score


def _best(q: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((row, -score, q))
    q, row, score = q[order], row[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    keep = rank <= k
    return q[keep], row[keep], score[keep], rank[keep]


def top(grams: Grams, queries: list[list[str]], index: list[list[str]], in_words: list[bool], k: int, digits: int, rows_at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``query, row, score, rank``: the ``k`` rows of the index most like each query. Of later rows, only those that beat the ``k`` best so far are scored."""
    row, rank, w = grams.vectors(queries, in_words)
    n, rows = len(queries[0]), len(index[0])
    step = -(-rows // max(1, -(-rows // rows_at_once)))
    best, floor = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), np.zeros(n)
    for first in range(0, rows, max(1, step)):
        q, i, score = Index(grams, [t[first : first + step] for t in index], in_words).top(row, rank, w, floor, k, digits)
        best = _best(np.concatenate((best[0], q)), np.concatenate((best[1], i + first)), np.concatenate((best[2], score)), k)
        last = best[3] == k
        floor[best[0][last]] = best[2][last]
    return best
