"""TextRank: PageRank over sentences that share terms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextkit.functions.text import terms

DAMPING, ITERATIONS, TOLERANCE = 0.85, 100, 1e-4
#: Contexts that are Python objects at once, and terms of a matrix.
ROWS, COLUMNS = 32, 4096


def similarity_edges(sentences: DataFrame) -> DataFrame:
    """(ctx, i, j, w) for i < j: shared terms over the sum of the sets' decimal logarithms and one."""
    sets = sentences.select("ctx", "idx", F.array_distinct(terms(F.col("sentence"))).alias("terms")).withColumn("size", F.size("terms")).where("size > 0")
    rows = sets.select("ctx", "idx", "size", F.explode("terms").alias("term"))
    a = rows.select("ctx", "term", F.col("idx").alias("i"), F.col("size").alias("ni"))
    b = rows.select("ctx", "term", F.col("idx").alias("j"), F.col("size").alias("nj"))
    shared = a.join(b, ["ctx", "term"]).where("i < j").groupBy("ctx", "i", "j", "ni", "nj").agg(F.count("*").alias("shared"))
    return shared.select("ctx", "i", "j", (F.col("shared") / (F.log10(F.col("ni").cast("double")) + F.log10(F.col("nj").cast("double")) + 1.0)).alias("w"))


def similarity_graph(sentences: DataFrame) -> DataFrame:
    """(ctx, i, j, w) in both directions."""
    half = similarity_edges(sentences)
    return half.unionByName(half.select("ctx", F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def normalised_graph(sentences: DataFrame) -> DataFrame:
    """The graph with each row's weights brought to a sum of 1."""
    total = F.sum("w").over(Window.partitionBy("ctx", "i"))
    return similarity_graph(sentences).select("ctx", "i", "j", (F.col("w") / total).alias("w"))


def rank_of(term_sets: list[list[str]]) -> np.ndarray:
    """PageRank of sentences given by their terms; the mass of a sentence without neighbours is lost."""
    n = len(term_sets)
    if n < 2:
        return np.ones(n)
    sets = [set(t) for t in term_sets]
    holders: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    common = [h for h in holders.values() if len(h) > 1]  # the others join no sentences
    shared = np.zeros((n, n))
    for c in range(0, len(common), COLUMNS):
        some = common[c : c + COLUMNS]
        has = np.zeros((n, len(some)))
        has[np.concatenate(some), np.repeat(np.arange(len(some)), [len(h) for h in some])] = 1
        shared += has @ has.T
    size = np.array([len(s) for s in sets], float)
    log = np.log10(np.maximum(size, 1))
    w = shared / (log[:, None] + log[None, :] + 1)
    np.fill_diagonal(w, 0)
    total = w.sum(1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    rank = np.full(n, 1 / n)
    for _ in range(ITERATIONS):
        new = (1 - DAMPING) / n + DAMPING * (rank @ w)
        diff = np.abs(new - rank).sum()
        rank = new
        if diff < TOLERANCE:
            break
    return rank


def collected(sentences: DataFrame) -> DataFrame:
    """One row for each context, with its sentences as an array of (idx, sentence, terms) in order.

    A context's sentences are capped before, so the array has a bound.
    """
    return sentences.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("s")).select("ctx", F.transform("s", lambda x: F.struct(x["idx"].alias("idx"), x["sentence"].alias("sentence"), terms(x["sentence"]).alias("terms"))).alias("s"))


def by_rows(work: Callable, kind: pa.DataType, column: pa.Array) -> pa.Array:
    """``work`` of each value of ``column``; few are Python objects at once."""
    parts = [pa.array([work(v) for v in column.slice(a, ROWS).to_pylist()], kind) for a in range(0, len(column), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def ranks(term_arrays: Column) -> Column:
    """``rank_of`` the sentences of each context, whose terms are given."""

    @F.arrow_udf("array<double>")
    def rank(sentence_terms: pa.Array) -> pa.Array:
        return by_rows(lambda rows: rank_of(rows).tolist(), pa.list_(pa.float64()), sentence_terms)

    return rank(term_arrays)


def textrank(sentences: DataFrame) -> DataFrame:
    """``sentences`` (ctx, idx, sentence) with their score."""
    scored = collected(sentences).withColumn("score", ranks(F.col("s.terms")))
    return scored.select("ctx", F.explode(F.arrays_zip("s", "score")).alias("x")).select("ctx", "x.s.idx", "x.s.sentence", "x.score")
