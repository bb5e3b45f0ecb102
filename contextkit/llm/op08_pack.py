"""Operator 8, token-ID output: best-fit-decreasing packing of tokenised documents into id matrices."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.llm._common import batch_of, table

TOKENIZER = os.environ.get("CONTEXTKIT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES = 12_000_000  # text of a shard, whose ids and bins one task holds

ROWS = "shard int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each in the open bin with the least room that holds it.

    A segment tree over room 0..capacity counts the open bins, so the least
    sufficient room is found in logarithmic time.  Ties keep the order given.
    """
    width = 1 << capacity.bit_length()
    count = [0] * (2 * width)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []

    def change(room: int, by: int) -> None:
        i = room + width
        while i:
            count[i] += by
            i >>= 1

    def least(room: int) -> int:
        """The smallest room >= ``room`` with an open bin, or -1."""
        i = room + width
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        return i - width

    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        room = least(size)
        if room < 0:
            bins.append([])
            at, left = len(bins) - 1, capacity - size
        else:
            at, left = open_bins[room].pop(), room - size
            change(room, -1)
        bins[at].append(item)
        if left:
            open_bins[left].append(at)
            change(left, 1)
    return bins


def encoder(ranks: bytes) -> tiktoken.Encoding:
    table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("contextkit", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})


def pack_shard(shard: int, docs: list[tuple[int | None, str]], encoding: tiktoken.Encoding, length: int, end_id: int) -> pa.Table:
    """Packed rows of a shard's documents, which are taken by doc_id, then text."""
    dtype = np.uint16 if max(end_id, encoding.max_token_value) < 1 << 16 else np.uint32
    ids: list[np.ndarray] = []
    pieces: list[tuple[int, int]] = []
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    for k, (_, text) in enumerate(docs):
        ids.append(np.array([*encoding.encode_ordinary(text), end_id], dtype))
        pieces += [(k, at) for at in range(0, len(ids[k]), length)]
    sizes = [min(length, len(ids[k]) - at) for k, at in pieces]
    out: dict[str, list] = {c.split()[0]: [] for c in ROWS.split(", ")}
    for row, members in enumerate(best_fit_decreasing(sizes, length)):
        line = np.full(length, end_id, dtype)
        edge = np.concatenate(([0], np.cumsum([sizes[i] for i in members])))
        for i, a in zip(members, edge.tolist(), strict=False):
            k, at = pieces[i]
            line[a : a + sizes[i]] = ids[k][at : at + sizes[i]]
        values = (shard, row, int(edge[-1]), line.astype(line.dtype.newbyteorder("<")).tobytes(), edge.tolist(), edge[:-1].tolist(), [docs[pieces[i][0]][0] for i in members], [pieces[i][1] for i in members])
        for c, v in zip(out, values, strict=True):
            out[c].append(v)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def pack_tokens(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER, end_id: int = 50256) -> DataFrame:
    """Rows of ``length`` token ids, little-endian (16 bits, or 32 if the vocabulary is larger), filled up with ``end_id``.

    Each document's ids, and ``end_id`` after them, are in the result exactly
    once: in one segment, or if there are more than ``length`` in segments of
    ``length`` and a rest.  cu_seqlens are the cumulative segment lengths from
    0, position_resets where positions restart, doc_ids and doc_offsets whose
    tokens a segment holds and from which token on.  An empty text is its
    ``end_id``; a null text is left out.  Repeated rows are packed each.
    Documents are dealt into shards by doc_id, as many as the text's bytes
    call for; a shard is packed by itself.
    """
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // SHARD_BYTES))

    def pack(key, t):
        return pack_shard(key[0].as_py(), list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)), encoder(ranks), length, end_id)

    return texts.withColumn("shard", batch_of(n)).repartitionById(n, F.col("shard")).groupBy("shard").applyInArrow(pack, ROWS)


def position_ids(row: dict, length: int = 2048) -> np.ndarray:
    """Positions of a packed row's tokens: from 0 in each segment, and in the filling."""
    at = np.arange(length)
    starts = np.array([*row["position_resets"], row["n_tokens"]])
    return at - starts[np.searchsorted(starts, at, "right") - 1]


def op8_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as packed rows of 2,048 token ids; see ``pack_tokens``."""
    return pack_tokens(table(spark, sf_dir, "documents"))
