"""Packing: the best sentences of a context within a budget of bytes, without redundant ones."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextkit.functions.text import SEGMENTERS, long_enough, trim_unicode, word_set
from contextkit.operators.textrank import by_rows, collected, rank_of
from contextkit.operators.tfidf import cap_sentences

OVERLAP = 0.8


def cut_sentences(docs: DataFrame, segmenter: str = "uax29") -> DataFrame:
    """(ctx, pos, n, sentence) of ``docs`` (ctx, pos, text): trimmed, over five bytes, with their places n in the text."""
    parts = docs.select("ctx", "pos", F.posexplode(SEGMENTERS[segmenter](F.col("text"))).alias("n", "raw"))
    return parts.select("ctx", "pos", "n", trim_unicode(F.col("raw")).alias("sentence")).where(long_enough(F.col("sentence")))


def numbered_sentences(docs: DataFrame, segmenter: str = "uax29") -> DataFrame:
    """(ctx, idx, sentence, total): the sentences of ``docs`` (ctx, pos, text), numbered through the context by pos, place and text; total is their number in the context.

    Sentences are sorted within their pos; what comes before a pos in its
    context is found from a count for each, so no task holds a context.
    """
    key = F.struct("ctx", "pos")  # not null, and equal where its fields are null both
    whole = cut_sentences(docs, segmenter).groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("s"))
    before = F.sum("n").over(Window.partitionBy("of.ctx").orderBy("of.pos").rowsBetween(Window.unboundedPreceding, -1))
    counts = whole.select(F.col("key").alias("of"), F.size("s").cast("long").alias("n")).select("of", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("of.ctx")).alias("total"))
    placed = whole.join(counts, F.col("key") == F.col("of")).select("key.ctx", "before", "total", F.posexplode("s").alias("at", "x"))
    return placed.select("ctx", (F.col("before") + F.col("at")).alias("idx"), F.col("x.sentence").alias("sentence"), "total")


def split_sentences(docs: DataFrame, segmenter: str = "uax29") -> DataFrame:
    """(ctx, idx, sentence) of ``docs`` (ctx, pos, text): trimmed, over five bytes, numbered through the context."""
    return numbered_sentences(docs, segmenter).drop("total")


def overlap(a: Column, b: Column) -> Column:
    """Common words of two word sets over the smaller set; null if one is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0))


def overlap_pairs(sentences: DataFrame) -> DataFrame:
    """(ctx, i, j) for i < j whose word sets overlap by more than 0.8.

    Such pairs share a word, so they meet at the words of the smaller set.
    """
    sets = sentences.select("ctx", "idx", word_set(F.col("sentence")).alias("words")).where(F.size("words") > 0)
    rows = sets.select("ctx", "idx", F.size("words").alias("size"), F.explode("words").alias("word"))
    a = rows.select("ctx", "word", F.col("idx").alias("i"), F.col("size").alias("ni"))
    b = rows.select("ctx", "word", F.col("idx").alias("j"), F.col("size").alias("nj"))
    common = a.join(b, ["ctx", "word"]).where("i < j").groupBy("ctx", "i", "j", "ni", "nj").agg(F.count("*").alias("common"))
    return common.where(F.col("common") / F.least("ni", "nj") > OVERLAP).select("ctx", "i", "j")


def select_within(sentences: list[str], order: list[int], budget: int) -> list[int]:
    """Sentences in the given order that fit the budget and repeat none taken before; one too long is passed over."""
    taken, sets, used = [], [], 0
    for i in order:
        size = len(sentences[i].encode())
        if used + size > budget:
            continue
        words = set(sentences[i].split())
        if any(words and s and len(words & s) / min(len(words), len(s)) > OVERLAP for s in sets):
            continue
        taken.append(i)
        sets.append(words)
        used += size
    return taken


def u_shaped(items: Column) -> Column:
    """Ranked items with the best at both ends: 1 3 5 4 2."""
    n = F.size(items)
    front = F.filter(items, lambda _, i: i % 2 == 0)
    back = F.filter(items, lambda _, i: i % 2 == 1)
    return F.when(n > 2, F.concat(front, F.reverse(back))).otherwise(items)


def parse_strategy(strategy: str | None) -> str:
    if strategy in (None, "ranked"):
        return "ranked"
    if strategy == "u_shaped":
        return "u_shaped"
    raise ValueError(f"Unknown strategy: {strategy}")


def selected(sentences: DataFrame, budget: int) -> DataFrame:
    """(ctx, picks): each context's selected sentences, best first.  Scores that agree to nine places tie."""

    def picks_of(rows: list[dict]) -> list[str]:
        score = rank_of([r["terms"] for r in rows]).tolist()
        texts = [r["sentence"] for r in rows]
        order = sorted(range(len(texts)), key=lambda i: (-round(score[i], 9), i))
        return [texts[i] for i in select_within(texts, order, budget)]

    @F.arrow_udf("array<string>")
    def pick(contexts: pa.Array) -> pa.Array:
        return by_rows(picks_of, pa.list_(pa.string()), contexts)

    return collected(sentences).select("ctx", pick(F.col("s")).alias("picks"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is worked out once; without a shared folder, ``df`` itself."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df
    path = f"{base.rstrip('/')}/contextkit-stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(docs: DataFrame, max_chars: int, strategy: str | None = None, segmenter: str = "uax29") -> DataFrame:
    """(ctx, packed) for each context of ``docs`` (ctx, pos, text); ``max_chars`` counts UTF-8 bytes of sentences."""
    order = u_shaped if parse_strategy(strategy) == "u_shaped" else lambda x: x
    picks = selected(cap_sentences(stored(numbered_sentences(docs, segmenter))), max_chars)
    packed = picks.select("ctx", F.array_join(order(F.col("picks")), "\n").alias("packed"))
    return docs.select("ctx").distinct().join(packed, "ctx", "left").select("ctx", F.coalesce("packed", F.lit("")).alias("packed"))


class ContextPacker:
    """Packs lists of documents; ``pack_df`` takes a frame (ctx, pos, text) of many contexts."""

    def __init__(self, max_chars: int, strategy: str | None = None, segmenter: str = "uax29", spark: SparkSession | None = None):
        if max_chars < 0:
            raise ValueError("max_chars must not be negative")
        self.max_chars, self.strategy, self.segmenter = max_chars, parse_strategy(strategy), segmenter
        self._spark = spark

    def pack_df(self, docs: DataFrame) -> DataFrame:
        return pack(docs, self.max_chars, self.strategy, self.segmenter)

    def pack(self, documents: list[str]) -> str:
        return self.pack_batch([documents])[0]

    def pack_batch(self, document_sets: list[list[str]]) -> list[str]:
        rows = [(c, p, t) for c, docs in enumerate(document_sets) for p, t in enumerate(docs)]
        if not rows:
            return [""] * len(document_sets)
        spark = self._spark or SparkSession.builder.getOrCreate()
        found = {r["ctx"]: r["packed"] for r in self.pack_df(spark.createDataFrame(rows, "ctx long, pos long, text string")).collect()}
        return [found.get(c, "") for c in range(len(document_sets))]
