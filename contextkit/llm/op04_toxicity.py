"""Operator 4, toxicity: misspelled lexicon terms by Levenshtein automata over a trie, scored in context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.llm._common import table
from contextkit.llm.lexicon import WORD, Scorer, chosen_terms, fit_logistic

SAMPLE = 20_000  # labelled documents, at most, that lexicon and coefficients are learned from
THRESHOLD = 0.3


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    coefficients: list[float] | None  # None: nothing to learn from, and every score is 0

    def scores(self, texts: pd.Series, scorer: Scorer) -> pd.Series:
        if self.coefficients is None:
            return pd.Series(np.zeros(len(texts)))
        b = np.array(self.coefficients)
        z = np.array([b[0] + scorer.features(t) @ b[1:] for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and coefficients, from at most SAMPLE labelled documents that are not held out.

    The sample is the labelled documents with the least hash of doc_id.  A
    document labelled more than once counts as toxic if one label says so.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # SAMPLE rows at most
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                for w in set(WORD.findall((text or "").lower())):
                    found.setdefault(w, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_pydict({"term": list(found), "toxic": [v[0] for v in found.values()], "clean": [v[1] for v in found.values()]})

    rows = rows.persist()
    try:
        totals = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        toxic, clean = totals.get(True, 0), totals.get(False, 0)
        if not toxic:
            return Model([], [], None)
        counted = rows.mapInArrow(words, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # every kept term is in 5 toxic documents of the sample, so their number has a bound too
        counts = [tuple(r) for r in counted.where("toxic >= 5 AND toxic * {} > clean * {}".format(clean + 1, 2 * (toxic + 1))).collect()]
        terms, weights = chosen_terms(counts, toxic, clean)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(terms, weights)
            for b in batches:
                yield pa.RecordBatch.from_pydict({"x": [scorer.features(t).tolist() for t in b["text"].to_pylist()], "y": b["toxic"].cast(pa.float64())})

        # SAMPLE rows of seven numbers
        got = rows.mapInArrow(features, "x array<double>, y double").collect()
        got.sort(key=lambda r: (r["x"], r["y"]))  # whichever task was first
        b = fit_logistic(np.array([r["x"] for r in got]), (np.array([r["y"] for r in got]) > 0).astype(float))
        return Model(terms, weights, b.tolist())
    finally:
        rows.unpersist()


def score_of(text: Column, model: Model) -> Column:
    """The score of a text from 0 to 1; null and empty texts have that of a text without hits."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.terms, model.weights)
        for t in texts:
            yield model.scores(t, scorer)

    return score(text)


def toxicity(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with their score in ``column``, which takes the place of a column of that name."""
    return docs.withColumn(column, score_of(F.col("text"), model))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score is below ``threshold``, with their own columns.

    Null and empty texts stay, as do all rows where no label is known.
    Repeated rows are judged each.
    """
    return docs.where(score_of(F.col("text"), train(docs, labels)) < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each of ``documents``; null and empty texts have that of a text without hits, all 0 where no label is known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
