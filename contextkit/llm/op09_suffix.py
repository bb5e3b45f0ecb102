"""Operator 9, suffix-array dedup: names of byte strings by prefix doubling, up to the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contextkit.llm._common import table
from contextkit.llm.repeats import remove_repeats
from contextkit.llm.windows import Bytes


def suffix_dedup(docs: DataFrame, width: int = 50, keep_text: bool = False) -> DataFrame:
    """Bytes in strings of ``width`` bytes that an earlier document has go; see ``remove_repeats``."""
    return remove_repeats(docs, Bytes(width, max(8, width * 2 // 5)), keep_text)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` in 50-byte strings that an earlier document has; null and empty texts have no bytes."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_tokens AS n_bytes", "n_removed", "n_spans", "kept_sha256")
