"""Joins on Hamming distance between fingerprints: those that share a key of bits meet in one task, which compares them in numpy.

Prints of similar texts crowd together, so the pairs to be compared grow with
the square of the prints.  Rows do not: a print is sent once for each key, and
only what the caller asks for comes back (pairs, a sum or the best row).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KEYS = 64
#: Bits of a key beyond those that would tell all prints apart if they were even.
SPARE_BITS = 10
#: Key groups with so many pairs are compared as matrices, the others together.
DENSE = 1024
#: Pairs that are compared at once.
CELLS = 1 << 19
#: Rows of the right side in a task.
TASK_ROWS = 250_000
NONE = np.iinfo(np.int64).max


def segments_for(threshold: int, prints: int) -> int:
    """Into how many segments to cut prints that match within ``threshold`` bits.

    Of n segments, n - threshold agree at least, and each choice of so many
    makes a key.  More segments make longer keys, which fewer prints share by
    chance, and more of them.  The fewest segments whose keys have as many
    bits as ``prints`` calls for, and SPARE_BITS more, are taken, within
    MOST_KEYS keys.
    """
    n = max(4, threshold + 1)
    while 64 * (n - threshold) / n < math.log2(max(2, prints)) + SPARE_BITS and math.comb(n + 1, threshold) <= MOST_KEYS:
        n += 1
    return n


def match_keys(threshold: int, recall: str = "exact", prints: int = 0) -> list[list[tuple[int, int]]]:
    """The keys by which prints meet, each a list of segments (shift, width): prints within ``threshold`` agree in one key at least.

    Four bands of 16 bits suffice up to 3 bits and for few prints.  ``bands``
    keeps to these four and may miss pairs beyond 3 bits.
    """
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    if threshold >= 64:
        return [[]]  # any two are near
    if threshold == 0:
        return [[(0, 64)]]
    n = 4 if recall == "bands" else min(64, segments_for(threshold, prints))
    edge = [64 * i // n for i in range(n + 1)]
    cut = [(64 - b, b - a) for a, b in zip(edge, edge[1:], strict=False)]
    return [list(c) for c in itertools.combinations(cut, max(1, n - threshold))]


def _groups(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the keys that both sorted arrays hold begin, and how often they occur: first and number on the left, on the right."""
    a, fa, na = np.unique(left, return_index=True, return_counts=True)
    b, fb, nb = np.unique(right, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return fa[ia], na[ia], fb[ib], nb[ib]


def _near(left: np.ndarray, right: np.ndarray, mask: np.uint64, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and distances of the near pairs whose key is the same, some at a time.  Both sides are sorted by key."""
    groups = _groups(left & mask, right & mask)
    size = groups[1] * groups[3]
    for fa, na, fb, nb in zip(*(g[size >= DENSE].tolist() for g in groups), strict=True):
        for b in range(fb, fb + nb, CELLS):
            y = right[b : min(b + CELLS, fb + nb)]
            rows = max(1, CELLS // len(y))
            for a in range(fa, fa + na, rows):
                d = np.bitwise_count(left[a : min(a + rows, fa + na), None] ^ y).ravel()
                at = np.flatnonzero(d <= threshold)
                if len(at):
                    i, j = np.divmod(at, len(y))
                    yield a + i, b + j, d[at]
    fa, na, fb, nb = (g[size < DENSE] for g in groups)
    size = na * nb
    end = np.cumsum(size)
    first = 0
    while first < len(size):
        done = end[first] - size[first]
        last = max(first + 1, int(np.searchsorted(end, done + CELLS, "right")))
        g = np.repeat(np.arange(first, last), size[first:last])
        k = np.arange(done, end[last - 1]) - (end - size)[g]
        i, j = fa[g] + k // nb[g], fb[g] + k % nb[g]
        d = np.bitwise_count(left[i] ^ right[j])
        at = np.flatnonzero(d <= threshold)
        if len(at):
            yield i[at], j[at], d[at]
        first = last


def _first(masks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs agree in none of the keys ``masks``, the ones before the present: each pair is kept at its first key."""
    differ, ok = left ^ right, np.ones(len(left), bool)
    for mask in masks:
        ok &= (differ & mask) != 0
    return ok


def _meet(left: DataFrame, right: DataFrame, threshold: int, recall: str, work: Callable, schema: str) -> DataFrame:
    """The rows of ``work`` over prints that share a key: ``left`` (l) and ``right`` (r, w), prints distinct and not null.

    ``work`` gets the keys before the present one, both sides sorted by it, the
    weights of the right and the near pairs, and gives columns.
    """
    count = right.count()
    keys = match_keys(threshold, recall, count if 0 < threshold < 64 and recall == "exact" else 0)
    masks = [sum(((1 << width) - 1) << shift for shift, width in k) for k in keys]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    types = pa.schema([(name, pa.int32() if kind == "int" else pa.int64()) for name, kind in map(str.split, schema.split(", "))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy(zero_copy_only=False) for c in range(3)] for b in batches if b.num_rows]
        if not got:
            return
        number, prints, weight = (np.concatenate(c) for c in zip(*got, strict=True))
        got.clear()
        prints = prints.view(np.uint64)
        wholes = np.array(masks, np.uint64)
        for key_no, mask in enumerate(wholes):
            l, at = prints[number == key_no], np.flatnonzero(number == -1 - key_no)
            r, w = prints[at], weight[at]
            if not len(l) or not len(r):
                continue
            l, order = l[np.argsort(l & mask)], np.argsort(r & mask)
            r, w = r[order], w[order]
            for columns in work(wholes[:key_no], l, r, w, _near(l, r, mask, threshold)):
                if len(columns[0]):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    numbers = lambda sign: F.explode(F.array(*(F.lit(i if sign > 0 else -1 - i) for i in range(len(keys))))).alias("k")
    rows = left.select(numbers(1), F.col("l").alias("p"), F.lit(0).cast("long").alias("w")).unionByName(right.select(numbers(-1), F.col("r").alias("p"), "w"))
    number = F.when(F.col("k") < 0, -1 - F.col("k")).otherwise(F.col("k"))
    key = F.col("p").bitwiseAND(F.element_at(F.array(*(F.lit(m).cast("long") for m in signed)), number + 1))
    tasks = max(8, math.ceil(len(keys) * count / TASK_ROWS))
    return rows.repartition(tasks, number, key).mapInArrow(compare, schema)


def _distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def hamming_join(left: DataFrame, right: DataFrame, threshold: int, recall: str = "exact", ordered: bool = False) -> DataFrame:
    """Pairs (l, r, distance) of distinct fingerprints, columns ``l`` of ``left`` and ``r`` of ``right``; if ``ordered``, only those with l < r.

    Prints meet at equal keys; a pair that agrees in several is kept at the
    first of them only, so no shuffle is needed to drop repeats.  The number
    of prints on the right is counted to choose keys by which few of them
    meet by chance; the result does not depend on it.  Nulls match nothing.
    """

    def work(before, l, r, w, near):
        for i, j, d in near:
            a, b = l[i], r[j]
            keep = _first(before, a, b)
            a, b = a.view(np.int64), b.view(np.int64)
            if ordered:
                keep &= a < b
            yield a[keep], b[keep], d[keep].astype(np.int32)

    rows = _distinct(right, "r").select("r", F.lit(0).cast("long").alias("w"))
    return _meet(_distinct(left, "l"), rows, threshold, recall, work, "l long, r long, distance int")


def hamming_sums(left: DataFrame, right: DataFrame, threshold: int, recall: str = "exact") -> DataFrame:
    """(l, n): for each fingerprint ``l`` of ``left`` the sum of ``w`` over the near ones ``r`` of ``right`` (r, w), whose prints are distinct.

    Prints without a near one have no row.  Pairs are added up where they meet.
    """

    def work(before, l, r, w, near):
        total = np.zeros(len(l), np.int64)
        met = np.zeros(len(l), bool)
        for i, j, _ in near:
            keep = _first(before, l[i], r[j])
            i, j = i[keep], j[keep]
            np.add.at(total, i, w[j])
            met[i] = True
        yield l[met].view(np.int64), total[met]

    rows = right.where("r IS NOT NULL").select("r", F.col("w").cast("long").alias("w"))
    return _meet(_distinct(left, "l"), rows, threshold, recall, work, "l long, n long").groupBy("l").agg(F.sum("n").alias("n"))


def hamming_best(left: DataFrame, right: DataFrame, threshold: int, pick: str = "first", recall: str = "exact") -> DataFrame:
    """(l, w): for each fingerprint ``l`` of ``left`` the ``w`` of a near one of ``right`` (r, w), whose prints are distinct.

    ``pick`` "first" takes the least w, "closest" that of the least distance,
    then the least.  Prints without a near one have no row.
    """
    closest = pick == "closest"

    def work(before, l, r, w, near):
        best = np.full((threshold + 1 if closest else 1) * len(l), NONE)
        for i, j, d in near:
            np.minimum.at(best, d.astype(np.int64) * len(l) + i if closest else i, w[j])
        for d, row in enumerate(best.reshape(-1, len(l))):
            found = row < NONE
            yield l[found].view(np.int64), np.full(found.sum(), d, np.int32), row[found]

    rows = right.where("r IS NOT NULL").select("r", F.col("w").cast("long").alias("w"))
    met = _meet(_distinct(left, "l"), rows, threshold, recall, work, "l long, distance int, w long")
    return met.groupBy("l").agg(F.min(F.struct("distance", "w")).alias("best")).select("l", F.col("best.w").alias("w"))
