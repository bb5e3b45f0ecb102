"""Array kernels for repeated fixed-length windows: no Spark in this module.

A chunk is several documents laid end to end.  Every window of ``width``
tokens is keyed by its *anchor*, the least hash among the ``anchor``-token
grams inside it.  Equal windows have equal anchors, so a window whose anchor
occurs in one document only can be dismissed without being compared.
Neighbouring windows with one anchor form a run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit name for each ordered pair of names."""
    x = b * _A
    x ^= x >> U(29)
    x += a
    x *= _B
    x ^= x >> U(32)
    return x


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _C
    return x ^ (x >> U(32))


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i:i+n] for each i that has n values."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == n else np.minimum(x[: len(x) - (n - have)], x[n - have :])


def doubled(base: np.ndarray, length: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Names of all substrings of each width, from names of substrings of ``length``.

    Prefix doubling: the name of a substring of 2n is made of the names of its
    halves; a width between two powers takes two overlapping names.
    """
    ladder, n = {length: base}, length
    while n * 2 <= max(widths):
        x = ladder[n]
        ladder[n * 2] = mix(x[:-n], x[n:])
        n *= 2
    out = []
    for w in widths:
        n = max(k for k in ladder if k <= w)
        x = ladder[n]
        out.append(x if n == w else mix(x[: len(x) - (w - n)], x[w - n :]))
    return out


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2^64, finished by a mixer) of each window of ``width`` tokens."""
    n = len(tokens) - width + 1
    h = tokens[:n].copy()
    for j in range(1, width):
        h *= _C
        h += tokens[j : j + n]
    return finish(h)


@dataclass(frozen=True)
class Words:
    """White-space separated words; windows are named by Rabin-Karp hashes."""

    width: int = 13
    anchor: int = 6

    def tokens(self, text: str | None) -> list[bytes]:
        return (text or "").encode().split()

    def names(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        flat = [w for d in docs for w in d]
        tok = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), U, len(flat))
        return rolling(tok, self.anchor), rolling(tok, self.width)


@dataclass(frozen=True)
class Bytes:
    """UTF-8 bytes; windows are named by prefix doubling from 8-byte strings."""

    width: int = 50
    anchor: int = 20

    def tokens(self, text: str | None) -> bytes:
        return (text or "").encode()

    def names(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(docs), np.uint8)
        first = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).astype(U)
        return tuple(doubled(first, 8, (self.anchor, self.width)))


@dataclass
class Runs:
    """Runs of windows with one anchor: document ordinal, first window, count, anchor, context."""

    doc: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    context: np.ndarray
    window: np.ndarray  # names of all windows of the chunk, by start
    at: np.ndarray  # first token of each document


def runs(unit: Words | Bytes, docs: list) -> Runs | None:
    """The runs of one chunk; None if no document has a whole window.

    A run has at most ``width`` windows, so the names of its first and last
    window and its length name the whole stretch of text that it covers.
    """
    size = np.array([len(d) for d in docs], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    if size.max(initial=0) < unit.width:
        return None
    gram, window = unit.names(docs)
    anchor = finish(slide_min(gram, unit.width - unit.anchor + 1))  # least hashes crowd near zero; names are to fill all buckets alike
    n = len(window)
    of = np.repeat(np.arange(len(docs)), np.maximum(0, size - unit.width + 1))
    where = np.arange(len(of)) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(np.maximum(0, size - unit.width + 1))))[:-1], np.maximum(0, size - unit.width + 1))
    assert n >= len(of)
    a = anchor[where]
    new = np.ones(len(of), bool)
    new[1:] = (a[1:] != a[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(of)))
    if length.max() > unit.width:
        since = np.arange(len(of)) - np.repeat(first, length)
        first = np.flatnonzero(since % unit.width == 0)
        length = np.diff(np.append(first, len(of)))
    start = where[first]
    context = mix(mix(window[start], window[start + length - 1]), length.astype(U))
    return Runs(of[first], start, length, a[first], context, window, at)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... n[i] values each, end to end."""
    skip = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(n) else np.zeros(0, np.int64)
    return np.arange(n.sum()) + skip


def covered(start: np.ndarray, width: int, length: int) -> np.ndarray:
    """Which of ``length`` tokens lie in a window that begins at one of ``start``."""
    edge = np.bincount(start, minlength=length + 1) - np.bincount(start + width, minlength=length + 1)
    return np.cumsum(edge[:-1]) > 0
