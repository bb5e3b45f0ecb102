"""The corpus pipeline: five stages over documents, each written and read again before the next.

1. toxicity: documents that score 0.3 or more go (operator 4)
2. near_dedup: of documents whose 5-word shingles are similar by 0.8 or more, the one with the smallest doc_id
   stays (operator 10's trie join and least hashes find the pairs; see contextkit/llm/similar.py)
3. decontamination: documents in which 8 words of a benchmark item occur, or two items, go (operator 3)
4. mixing: sources are brought to their target weights (operator 6)
5. token_output: documents become packed rows of token ids (operator 8)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contextkit.llm._common import settle, table
from contextkit.llm.op03_decontaminate import drop_leaks
from contextkit.llm.op04_toxicity import drop_toxic
from contextkit.llm.op06_mix import mixed_documents
from contextkit.llm.op08_pack import pack_tokens
from contextkit.llm.similar import drop_near_copies


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; null and empty texts stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones; rows without doc_id all stay, texts without words are one class."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaks; null and empty texts stay, and all if the benchmark is empty."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their sources, each as often as it is taken: 0, 1 or 2 times."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids; null texts are left out."""
    return pack_tokens(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
#: Tokenising has no SQL; tests hold each stage against planted cases, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
