"""Operator 10, SimHash near-dedup: binary trie self-join within a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.llm._common import parts_for, settle, table
from contextkit.llm.components import components
from contextkit.llm.windows import U, spread

SPLIT = 64  # node pairs of at most so many comparisons are compared outright
FRONT = 1 << 19  # node pairs in work at a time
HOT = 200_000  # a bucket of more fingerprints is linked by its one-bit neighbours instead


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words, repeats included; fewer words are one shingle, none have none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        start, end = [0], [len(line)]
    else:
        start, end = np.concatenate(([0], end[:-shingle] + 1)).tolist(), end[shingle - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(line[a:b], 42) for a, b in zip(start, end, strict=True)), U, len(start))


def print_of_hashes(h: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed 64-bit integer; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def print_of(text: str | None, shingle: int) -> int:
    return print_of_hashes(shingle_hashes(text, shingle))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def prints(s: pd.Series) -> pd.Series:
        return pd.Series([print_of(x, shingle) for x in s], dtype="int64")

    return prints(text)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = parent[x]
        if (y == x).all():
            return x
        x = y


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_links(key: np.ndarray, head: np.ndarray, size: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """A root for each of the sorted distinct keys, equal for keys linked within their bucket.

    A bucket is a range of keys that agree in the first ``depth`` bits.  A trie
    node is a range that agrees in more.  Pairs of nodes of one bucket go down
    together, one bit a step; the bits in which they differ add up, and a pair
    beyond ``budget`` is dropped with all that is below it.
    """
    parent = np.arange(len(key))
    work = [tuple(np.concatenate(x) for x in ([head], [size], [head], [size], [np.full(len(head), depth)], [np.zeros(len(head), np.int64)]))]
    while work:
        a, na, b, nb, d, e = work.pop()
        if len(a) > FRONT:
            work.append(tuple(x[FRONT:] for x in (a, na, b, nb, d, e)))
            a, na, b, nb, d, e = (x[:FRONT] for x in (a, na, b, nb, d, e))
        small = na * nb <= SPLIT
        if small.any():
            sa, sna, sb, snb = a[small], na[small], b[small], nb[small]
            left = spread(sa, sna)
            times = np.repeat(snb, sna)
            right = spread(np.repeat(sb, sna), times)
            left = np.repeat(left, times)
            near = np.bitwise_count(key[left] ^ key[right]) <= budget
            near &= left < right
            _unite(parent, left[near], right[near])
        a, na, b, nb, d, e = (x[~small] for x in (a, na, b, nb, d, e))
        if not len(a):
            continue
        bit = U(1) << (U(63) - d.astype(U))
        low = (bit << U(1)) - U(1)
        split = lambda lo, n: np.clip(np.searchsorted(key, (key[lo] & ~low) | bit), lo, lo + n)
        ma, mb = split(a, na), split(b, nb)
        same = a == b
        kids = []
        for x, nx, y, ny, cost, keep in (
            (a, ma - a, b, mb - b, 0, None),
            (ma, a + na - ma, mb, b + nb - mb, 0, None),
            (a, ma - a, mb, b + nb - mb, 1, None),
            (ma, a + na - ma, b, mb - b, 1, ~same),  # of a node with itself, the other order is the same pair
        ):
            ok = (nx > 0) & (ny > 0) & (e + cost <= budget) & ~((x == y) & (nx == 1))
            if keep is not None:
                ok &= keep
            kids.append((x[ok], nx[ok], y[ok], ny[ok], d[ok] + 1, e[ok] + cost))
        work.append(tuple(np.concatenate(x) for x in zip(*kids, strict=True)))
    return _find(parent, parent)


def _segments(budget: int) -> list[tuple[int, int]]:
    """First bit and width of the budget+1 segments; two prints within the budget agree in one of them."""
    edge = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def links(prints: DataFrame, budget: int) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints in column fp whenever a chain of links does.

    Each print goes to one bucket for each segment, with its bits turned so
    that the segment comes first.  A bucket's links come back as a star for
    each of its classes: at most one edge a print, however dense the bucket.
    """
    segments = _segments(budget)
    turned = F.array(*(F.struct(F.lit(i).alias("segment"), (F.col("fp") if not at else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at))).alias("turned")) for i, (at, _) in enumerate(segments)))
    rows = prints.select(F.explode(turned).alias("x")).select("x.*")
    width = F.element_at(F.array(*(F.lit(w) for _, w in segments)), F.col("segment") + 1)
    rows = rows.withColumn("bucket", F.call_function("shiftrightunsigned", F.col("turned"), F.lit(64) - width))
    hot = rows.groupBy("segment", "bucket").count().where(F.col("count") > HOT).select("segment", "bucket")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["segment"].to_numpy(), b["turned"].to_numpy()) for b in batches]
        for i, (at, wide) in enumerate(segments):
            key = np.sort(np.concatenate([np.zeros(0, np.int64), *(t[s == i] for s, t in got)]).view(U))
            if len(key) < 2:
                continue
            prefix = key >> U(64 - wide)
            head = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            size = np.diff(np.append(head, len(key)))
            root = trie_links(key, head[size > 1], size[size > 1], wide, budget)
            member = np.flatnonzero(root != np.arange(len(key)))
            back = lambda x: (x if not at else (x >> U(at)) | (x << U(64 - at))).view(np.int64)
            for k in range(0, len(member), 1 << 16):
                m = member[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(back(key[m])), pa.array(back(key[root[m]]))], ["a", "b"])

    n = parts_for(prints, 4 << 20)
    edges = rows.join(hot, ["segment", "bucket"], "left_anti").select("segment", "bucket", "turned").repartition(n, "segment", "bucket").mapInArrow(join, "a long, b long")
    return edges.unionByName(_neighbour_links(rows.join(hot, ["segment", "bucket"], "left_semi"), segments, budget))


def _neighbour_links(rows: DataFrame, segments: list[tuple[int, int]], budget: int) -> DataFrame:
    """Edges among prints of crowded buckets, without listing pairs.

    Prints within an even budget of 2r have a common neighbour within r flips
    of each.  Prints that share such a neighbour are within 2r.  So each print
    meets the least print at each of its neighbours.  Of an odd budget, the
    neighbours one flip further are met by the one side only.
    """
    at = F.element_at(F.array(*(F.lit(a) for a, _ in segments)), F.col("segment") + 1)
    fp = F.when(at == 0, F.col("turned")).otherwise(F.call_function("shiftrightunsigned", F.col("turned"), at).bitwiseOR(F.call_function("shiftleft", F.col("turned"), F.lit(64) - at)))
    prints = rows.select(fp.alias("fp")).distinct()
    flips = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    far = prints.select("fp", F.col("fp").alias("near"))
    for _ in range(budget // 2):
        far = far.select("fp", F.explode(F.array_append(flips(F.col("near")), F.col("near"))).alias("near")).distinct()
    met = far.groupBy("near").agg(F.min("fp").alias("b"))
    edges = far.join(met, "near").where("fp <> b").select(F.col("fp").alias("a"), "b")
    if budget % 2:
        # one side goes a flip further: every print there is within the budget of all at the neighbour
        further = far.select("fp", F.explode(flips(F.col("near"))).alias("near"))
        edges = edges.unionByName(further.join(met, "near").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return edges.distinct()


def classes(prints: DataFrame, budget: int = 2) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp).

    component_id is the smallest doc_id that links reach.
    """
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(distinct.select("fp"), budget))
    joined = settle(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    smallest = settle(joined.groupBy("label").agg(F.min("least").alias("component_id")))
    return joined.join(smallest, "label").select("fp", "component_id")


def simhash_classes(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other.  Rows
    without doc_id take no part: their component_id is null.  Repeated rows
    are in one class.
    """
    prints = settle(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    found = classes(prints.where("doc_id IS NOT NULL"), budget)
    known = prints.where("doc_id IS NOT NULL").join(found, "fp").select("doc_id", "fp", "component_id")
    return known.unionByName(prints.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of each of ``documents``; texts without words have fingerprint zero and link like any other."""
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
