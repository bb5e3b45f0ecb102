"""Operator 1, substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contextkit.llm._common import table
from contextkit.llm.repeats import remove_repeats
from contextkit.llm.windows import Words


def substring_dedup(docs: DataFrame, width: int = 13, keep_text: bool = False) -> DataFrame:
    """Words in windows of ``width`` words that an earlier document has go; see ``remove_repeats``."""
    return remove_repeats(docs, Words(width, max(1, width // 2)), keep_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` in 13-word windows that an earlier document has; null and empty texts have no words."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_tokens AS n_words", "n_removed", "kept_sha256", "n_spans")
