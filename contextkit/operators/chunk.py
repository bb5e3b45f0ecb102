"""Markdown chunking on block boundaries, within a number of bytes or tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.functions.markdown import chunk_by_bytes, chunk_by_tokens, top_level_blocks
from contextkit.sources.tokenizers import Tokenizer, tokenizer_from_file, tokenizer_named


def blocks(md: Column) -> Column:
    """Byte ranges of the top-level blocks, as an array of (start, end)."""

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in top_level_blocks(t)])

    return find(md)


class MarkdownChunker:
    """Chunks Markdown; ``chunk_df`` takes a frame with a text column."""

    def __init__(self, tokenizer_name: str | None = None, tokenizer_path: str | None = None, max_tokens: int | None = None, max_characters: int | None = None, counter: Callable[[str], int] | None = None, spark: SparkSession | None = None):
        self._spark, self.tokenizer, self.limit = spark, None, 0
        if max_characters is not None:
            self.limit = max_characters
        elif max_tokens is None:
            raise ValueError("Must provide max_tokens or max_characters")
        else:
            self.limit = max_tokens
            if tokenizer_name is not None:
                self.tokenizer = tokenizer_named(tokenizer_name)
            elif tokenizer_path is not None:
                self.tokenizer = tokenizer_from_file(tokenizer_path)
            elif counter is not None:
                self.tokenizer = Tokenizer("own", counter)
            else:
                raise ValueError("Must provide tokenizer_name, tokenizer_path, or max_characters")
        if self.limit < 0:
            raise ValueError("limits must not be negative")

    def _split(self, text: str) -> list[str]:
        return chunk_by_bytes(text, self.limit) if self.tokenizer is None else chunk_by_tokens(text, self.limit, self.tokenizer.count)

    def chunks(self, md: Column) -> Column:
        """The chunks of each text, as an array; null of null."""
        limit, tokenizer = self.limit, self.tokenizer

        @F.pandas_udf("array<string>")
        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: None if t is None else chunk_by_bytes(t, limit) if tokenizer is None else chunk_by_tokens(t, limit, tokenizer.count))

        return split(md)

    def chunk_df(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """A row for each chunk: the columns of ``docs`` but the text, chunk_pos and chunk."""
        rest = [c for c in docs.columns if c != text]
        return docs.select(*rest, F.posexplode(self.chunks(F.col(text))).alias("chunk_pos", "chunk"))

    def chunk(self, md: str) -> list[str]:
        return self._split(md)

    def chunk_batch(self, docs: list[str]) -> list[list[str]]:
        if not docs:
            return []
        spark = self._spark or SparkSession.builder.getOrCreate()
        df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
        found = {r["id"]: r["c"] for r in df.select("id", self.chunks(F.col("text")).alias("c")).collect()}
        return [found[i] for i in range(len(docs))]
