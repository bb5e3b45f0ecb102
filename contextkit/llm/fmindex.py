"""An FM-index over integer words: suffix array, wavelet-tree ranks, sampled positions.  No Spark here."""

from __future__ import annotations

import numpy as np

from contextkit.llm.windows import spread


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` by prefix doubling.

    Zeros are separators: each is smaller than all words and than later
    separators, so no comparison goes past one.  The last entry is zero.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    in_order = s[order]
    head = np.flatnonzero(np.concatenate(([True], (in_order[1:] != in_order[:-1]) | (in_order[1:] == 0))))
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    sa = order
    live = order[np.repeat(size > 1, size)]
    step = 1
    while len(live):
        key = rank[live] * n + rank[live + step]
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old = rank[live]
        first = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        slot = np.arange(len(live)) - np.repeat(first, np.diff(np.append(first, len(live)))) + old
        sa[slot] = live
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(live)))
        rank[live] = np.repeat(slot[new], size)
        live = live[np.repeat(size > 1, size)]
        step *= 2
    return sa


class FMIndex:
    """Backward search and location of phrases in ``s``, whose words are 1..words-1 and separators 0."""

    SAMPLE = 16

    def __init__(self, s: np.ndarray, words: int):
        if not len(s) or s[-1]:
            s = np.append(s, 0)
        sa = suffix_array(s)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=words))))
        bwt = s[sa - 1]
        # positions after a separator are sampled too, so no walk crosses one
        self.sampled = (bwt == 0) | (sa % self.SAMPLE == 0)
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.bwt = bwt
        self.levels = []
        x = bwt
        for level in range(max(1, int(words - 1).bit_length()) - 1, -1, -1):
            bit = (x >> level) & 1
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            on = bit.astype(bool)
            self.levels.append((level, ones, len(x) - int(ones[-1])))
            x = np.concatenate((x[~on], x[on]))

    def rank(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each word occurs in the first i entries of the transform."""
        at, i = np.zeros_like(i), i.copy()
        for level, ones, zeros in self.levels:
            on = ((word >> level) & 1).astype(bool)
            a, b = ones[at], ones[i]
            at = np.where(on, zeros + a, at - a)
            i = np.where(on, zeros + b, i - b)
        return i - at

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and position of each occurrence; ``phrases`` is a matrix of words."""
        alive = np.arange(len(phrases))
        last = phrases[:, -1]
        lo, hi = self.start[last], self.start[last + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            ok = lo < hi
            alive, lo, hi = alive[ok], lo[ok], hi[ok]
            if not len(alive):
                break
            word = phrases[alive, column]
            lo, hi = self.start[word] + self.rank(word, lo), self.start[word] + self.rank(word, hi)
        n = np.maximum(hi - lo, 0)
        return np.repeat(alive, n), self.locate(spread(lo, n))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of rows of the suffix array, by walks to the next sampled row."""
        row, out, steps, todo = row.copy(), np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            there = self.sampled[row]
            out[todo[there]] = self.samples[self.sample_no[row[there]]] + steps
            todo, row = todo[~there], row[~there]
            word = self.bwt[row]
            row = self.start[word] + self.rank(word, row)
            steps += 1
        return out
