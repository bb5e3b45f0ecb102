"""Queries of the driver contract over the whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.functions.simhash import bands, fingerprint, hash_shingle, shingle_rows, shingles
from contextkit.functions.text import SEGMENTERS, terms
from contextkit.operators import pack as packing
from contextkit.operators import textrank as tr
from contextkit.operators import tfidf as ti
from contextkit.operators.chunk import MarkdownChunker, blocks
from contextkit.operators.hamming import hamming_join, hamming_sums
from contextkit.sources import cache as c
from contextkit.sources.tokenizers import FOLDER, count_tokens, token_offsets, tokenizer_from_file, tokenizer_named

THRESHOLD = 3
BUDGET = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _lines(spark: SparkSession, sf_dir: str, ctx: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col(ctx).alias("ctx"), F.col("doc_id").alias("pos"), "text")
    return packing.numbered_sentences(docs, "lines")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fp"))


def _stored_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.stored(_prints(spark, sf_dir))


def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other documents are within three bits of each.  Prints meet with their counts, and sums come back, not pairs."""
    prints = _stored_prints(spark, sf_dir)
    sizes = prints.groupBy("fp").agg(F.count("*").alias("n"))
    near = hamming_sums(sizes.select(F.col("fp").alias("l")), sizes.select(F.col("fp").alias("r"), F.col("n").alias("w")), THRESHOLD)
    counted = near.select("l", (F.col("n") - 1).alias("n_near"))
    return prints.join(counted.withColumnRenamed("l", "fp"), "fp").select("doc_id", F.col("fp").alias("fingerprint"), "n_near")


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each source, not numbered."""
    return packing.cut_sentences(_documents(spark, sf_dir).select(F.col("source").alias("ctx"), F.col("doc_id").alias("pos"), "text"), "lines")


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.document_frequency(_cut(spark, sf_dir)).select(F.col("ctx").alias("source"), "term", "df")


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ti.idf(_cut(spark, sf_dir)).select(F.col("ctx").alias("source"), "term", F.round("idf", 6).alias("idf"))


def sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "doc_id").select(F.col("ctx").alias("doc_id"), F.col("idx").cast("long").alias("idx"), "sentence")


def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ti.scores(_lines(spark, sf_dir, "source"))
    return scored.select(F.col("ctx").alias("source"), F.col("idx").cast("long").alias("idx"), F.round("score", 6).alias("score"))


def tfidf_top300(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ti.cap_sentences(_lines(spark, sf_dir, "source"))
    return kept.select(F.col("ctx").alias("source"), F.col("idx").cast("long").alias("idx"), "sentence")


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.col("ctx").alias("doc_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("w", 6).alias("w"))


def sentence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(tr.similarity_graph(_lines(spark, sf_dir, "doc_id")))


def similarity_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(tr.normalised_graph(_lines(spark, sf_dir, "doc_id")))


def textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = tr.textrank(ti.cap_sentences(_lines(spark, sf_dir, "doc_id")))
    return ranked.select(F.col("ctx").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.round("score", 6).alias("score"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.overlap_pairs(_lines(spark, sf_dir, "doc_id"))
    return found.select(F.col("ctx").alias("doc_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def _pack(spark: SparkSession, sf_dir: str, strategy: str, segmenter: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("ctx"), F.lit(0).alias("pos"), "text")
    return packing.pack(docs, BUDGET, strategy, segmenter).select(F.col("ctx").alias("doc_id"), "packed")


def pack_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir, "ranked", "lines")


def pack_u_shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir, "u_shaped", "lines")


def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir, "ranked", "uax29")


def sentences_uax29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(SEGMENTERS["uax29"](F.col("text"))).alias("idx", "sentence"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_rows(_documents(spark, sf_dir).select("doc_id", "text"))


def shingle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    distinct = docs.select(F.explode(F.array_distinct(shingles(F.col("text")))).alias("shingle")).distinct()
    return distinct.select("shingle", hash_shingle(F.col("shingle")).alias("hash"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).select("doc_id", F.col("fp").alias("fingerprint"))


def bands_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).select("doc_id", *(b.alias(f"band_{n}") for n, b in zip("abcd", bands(F.col("fp")), strict=True)))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = _stored_prints(spark, sf_dir)
    pairs = hamming_join(prints.select(F.col("fp").alias("l")), prints.select(F.col("fp").alias("r")), THRESHOLD, ordered=True)
    return pairs.select("l", "r", "distance")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, numbered by doc_id, with their source as payload."""
    docs = _documents(spark, sf_dir)
    return c.entries(docs.select(F.col("doc_id").alias("key"), "text", F.concat_ws(":", "source", "doc_id").alias("data")))


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, conversation turns and documents without their last character."""
    items = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("key"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("key"), "text")
    docs = _documents(spark, sf_dir)
    edited = docs.select(F.concat(F.lit("d"), "doc_id").alias("key"), F.expr("left(text, length(text) - 1)").alias("text"))
    same = docs.select(F.concat(F.lit("s"), "doc_id").alias("key"), "text")
    texts = items.unionByName(turns).unionByName(edited).unionByName(same)
    return texts.select("key", fingerprint(F.col("text")).alias("fingerprint"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lookup reads of the cache."""
    return packing.stored(_cache(spark, sf_dir).select("fingerprint", "id", "data"))


def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir).select("id", "fingerprint", "band_a", "band_b", "band_c", "band_d", "input_text", "data")


def cache_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.find_exact(_lookups(spark, sf_dir), _cache(spark, sf_dir)).select("key", "data")


def cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.misses(_lookups(spark, sf_dir), _cache(spark, sf_dir)).select("key")


def cache_near_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.find_near(packing.stored(_lookups(spark, sf_dir)), _known(spark, sf_dir), THRESHOLD, "first").select("key", "data")


def cache_near_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.find_near(packing.stored(_lookups(spark, sf_dir)), _known(spark, sf_dir), THRESHOLD, "closest").select("key", "data")


def cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.get(packing.stored(_lookups(spark, sf_dir)), _known(spark, sf_dir), THRESHOLD, "first").select("key", "data")


def cache_get_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.get(packing.stored(_lookups(spark, sf_dir)), _known(spark, sf_dir), THRESHOLD, "closest").select("key", "data")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one Markdown text, turns apart by a blank line."""
    turns = _table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), "\n\n").alias("text"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _markdown(spark, sf_dir).select("conv_id", F.posexplode(blocks(F.col("text"))).alias("pos", "b"))
    return found.select("conv_id", "pos", F.col("b.start").alias("first_byte"), F.col("b.end").alias("end_byte"))


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text of each document, with a block of each kind; its text is in the fence."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    lit = F.lit
    parts = (
        F.concat(lit("# "), "source", lit("\n## "), "lang"),
        F.concat(lit("- "), "doc_id", lit("\n- "), "lang", lit("\n\n  more")),
        F.concat(lit("```text\n"), F.replace("text", lit("`")), lit("\n```")),
        F.concat(lit("> # "), "source", lit("\n> words\nlazy")),
        lit("---"),
        F.concat(lit("<div>\n# "), "doc_id", lit("\n</div>")),
        F.concat("source", lit("\n===")),
        F.concat(lit("    code "), "doc_id", lit("\n\n    # more")),
        F.concat("lang", lit("\nlast")),
    )
    return docs.select("doc_id", F.concat_ws("\n\n", *parts).alias("text"))


def markdown_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _structured(spark, sf_dir).select("doc_id", F.posexplode(blocks(F.col("text"))).alias("pos", "b"))
    return found.select("doc_id", "pos", F.col("b.start").alias("first_byte"), F.col("b.end").alias("end_byte"))


def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MarkdownChunker(max_characters=BUDGET).chunk_df(_markdown(spark, sf_dir))


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MarkdownChunker(max_tokens=150, counter=lambda t: len(t.split())).chunk_df(_markdown(spark, sf_dir))


def chunk_tokens_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MarkdownChunker("byte_bpe_50k", max_tokens=256).chunk_df(_markdown(spark, sf_dir))


def token_count_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", count_tokens(F.col("text"), tokenizer_named("byte_bpe_50k")).alias("n_tokens"))


def token_count_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", count_tokens(F.col("text"), tokenizer_from_file(f"{FOLDER}/byte_bpe_50k.json")).alias("n_tokens"))


def token_offsets_hf(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    return items.select("item_id", token_offsets(F.col("text"), tokenizer_from_file(f"{FOLDER}/byte_bpe_50k.json")).alias("offsets"))


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    near_dup_documents, tokenize_terms, doc_frequency, idf, sentence_lines, tfidf_scores, tfidf_top300, sentence_similarity, similarity_normalized,
    textrank, overlap_pairs, pack_ranked, pack_u_shaped, pack_sentences, sentences_uax29, shingle_counts, shingle_hash, simhash, bands_of_documents,
    hamming_pairs, cache_put, cache_exact, cache_miss, cache_near_first, cache_near_closest, cache_get, cache_get_batch, markdown_blocks, markdown_structured, chunk_bytes,
    chunk_tokens, chunk_tokens_bpe, token_count_bpe, token_count_hf, token_offsets_hf,
)
QUERIES = {f.__name__: f for f in _ALL}
