"""Operator 3, benchmark decontamination: an FM-index for each shard of documents, searched for benchmark phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.llm._common import settle, table, whole_row
from contextkit.llm.fmindex import FMIndex
from contextkit.llm.windows import covered

SHARD_WORDS = 1_000_000
PASS_BYTES = 4 << 20  # benchmark text that goes to the executors at once; more takes further passes
_FOLD = bytes(32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class Phrases:
    """Windows of some benchmark items as matrices of word numbers, one for each length."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(tuple(w[i : i + width]), set()).add(item)
        self.number = {w: i for i, w in enumerate(sorted({w for p in found for w in p}), 1)}
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(p) for p in found}):
            own = sorted(p for p in found if len(p) == n)
            self.by_length[n] = np.array([[self.number[w] for w in p] for p in own], np.int64), [sorted(found[p]) for p in own]


def search_shard(phrases: Phrases, docs: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str], int]]:
    """Of each document: words, merged spans of hit words (first, end), items that occur, and words of the longest phrase that does.

    Words that no phrase has count as separators; a run of them is one entry of the index.
    """
    word_lists = [words_of(d) for d in docs]
    size = np.array([len(w) for w in word_lists], np.int64)
    at = np.concatenate(([0], np.cumsum(size + 1)))  # a separator after each document
    s = np.zeros(at[-1], np.int64)
    for a, w in zip(at, word_lists, strict=False):
        s[a : a + len(w)] = np.fromiter(map(phrases.number.get, w, repeat(0)), np.int64, len(w))
    keep = np.flatnonzero((s != 0) | np.concatenate(([True], s[:-1] != 0)))
    hit, items, longest = np.zeros(len(s), bool), [set() for _ in docs], [0] * len(docs)
    if phrases.number:
        index = FMIndex(s[keep], len(phrases.number) + 1)
        for n, (matrix, own) in phrases.by_length.items():
            phrase, position = index.search(matrix)
            where = keep[position]
            hit |= covered(where, n, len(s))
            pairs = np.unique(np.stack((np.searchsorted(at, where, "right") - 1, phrase)), axis=1)
            for d, p in zip(*pairs.tolist(), strict=True):
                items[d].update(own[p])
                longest[d] = max(longest[d], n)
    out = []
    for k, n in enumerate(size.tolist()):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[at[k] : at[k] + n].view(np.int8), [0]))))
        out.append((n, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), items[k], longest[k]))
    return out


def _passes(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    """The benchmark in parts of bounded size, one at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PASS_BYTES) or 1
    part = lambda i: items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
    for i in range(n):
        yield Phrases([(r[0], r[1]) for r in part(i).toLocalIterator()], width)


FOUND = "n_words long, spans array<struct<first: long, end: long>>, items array<string>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, merged spans of hit words and the item_ids that occur.

    A window is ``width`` consecutive words of an item; a shorter item is one
    window.  Null texts have no words; items without item_id or text take no
    part; items of one item_id count as one.  Each row of ``docs`` is judged
    by itself.  A benchmark beyond PASS_BYTES takes several passes, each of
    which adds its findings to those before, and is written before the next:
    driver and tasks hold one part of the benchmark at a time.
    """
    base = docs.select("doc_id", "text")
    out = base.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<first: long, end: long>>)"), "items": F.expr("cast(array() as array<string>)")})
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for number, phrases in enumerate(_passes(benchmark, width)):
        out = settle(out) if number else out

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            def shard(got: list[dict]) -> pa.RecordBatch:
                found = search_shard(phrases, [r["text"] for r in got])
                merged = [_merge([(x["first"], x["end"]) for x in r["spans"]] + spans) for r, (_, spans, _, _) in zip(got, found, strict=True)]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["doc_id"] for r in got], pa.int64()),
                        pa.array([r["text"] for r in got], pa.string()),
                        pa.array([n for n, *_ in found], pa.int64()),
                        pa.array([[{"first": a, "end": b} for a, b in m] for m in merged], spans_type),
                        pa.array([sorted(items.union(r["items"])) for r, (_, _, items, _) in zip(got, found, strict=True)], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text", "n_words", "spans", "items"],
                )

            got, n = [], 0
            for b in batches:
                for r in b.to_pylist():
                    got.append(r)
                    n += len(r["text"] or "") // 6
                    if n >= SHARD_WORDS:
                        yield shard(got)
                        got, n = [], 0
            if got:
                yield shard(got)

        out = out.mapInArrow(search, "doc_id long, text string, " + FOUND)
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_LEAK = "items array<string>, longest int"


def _leaks_of(phrases: Phrases):
    """A UDF that adds what ``phrases`` find in a column of texts to a column of _LEAK."""

    @F.pandas_udf(_LEAK)
    def search(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out, got, n = [], [], 0
        for i, t in enumerate(texts):
            got.append(t)
            n += len(t or "") // 6
            if n >= SHARD_WORDS or i == len(texts) - 1:
                out += search_shard(phrases, got)
                got, n = [], 0
        items = [sorted({*old, *new}) for old, (_, _, new, _) in zip(before["items"], out, strict=True)]
        return pd.DataFrame({"items": items, "longest": [max(old, new) for old, (*_, new) in zip(before["longest"], out, strict=True)]})

    return search


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8) -> DataFrame:
    """``docs`` without those in which ``width`` words of a benchmark item, or two items, occur; with their own columns.

    A lone item of fewer words is no leak, however often it occurs.  Each row
    is judged by its text alone and stays where it is: nothing is shuffled.
    Null and empty texts stay.
    """
    found = F.expr("named_struct('items', cast(array() as array<string>), 'longest', 0)")
    marked = docs.select(whole_row(docs), "text", found.alias("leak"))
    for number, phrases in enumerate(_passes(benchmark, width)):
        marked = settle(marked) if number else marked
        marked = marked.withColumn("leak", _leaks_of(phrases)(F.col("text"), F.col("leak")))
    return marked.where((F.col("leak.longest") < width) & (F.size("leak.items") < 2)).select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` in 8-word windows of ``benchmark`` items; null texts have no words, an empty benchmark hits none."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n.alias("n_items"), digest.alias("items_sha256"), (n >= 2).alias("contaminated"))
