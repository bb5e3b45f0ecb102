"""SimHash of character shingles: 64-bit fingerprints, bands and Hamming distances."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
#: Characters whose shingles are counted together, and cells of a table of codes or counts.
CHARS, TABLE = 1 << 18, 1 << 22
_C1, _C2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _fmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def murmur3(rows: np.ndarray) -> np.ndarray:
    """First word of MurmurHash3 x64-128, seed 0, of each row of a byte matrix."""
    n, length = rows.shape
    blocks = length // 16
    padded = np.zeros((n, (blocks + 1) * 16), np.uint8)
    padded[:, :length] = rows
    words = padded.view("<u8").astype(U)
    h1, h2 = np.zeros(n, U), np.zeros(n, U)
    for b in range(blocks):
        h1 ^= _rotl(words[:, 2 * b] * _C1, 31) * _C2
        h1 = (_rotl(h1, 27) + h2) * U(5) + U(0x52DCE729)
        h2 ^= _rotl(words[:, 2 * b + 1] * _C2, 33) * _C1
        h2 = (_rotl(h2, 31) + h1) * U(5) + U(0x38495AB5)
    h2 ^= _rotl(words[:, 2 * blocks + 1] * _C2, 33) * _C1
    h1 ^= _rotl(words[:, 2 * blocks] * _C1, 31) * _C2
    h1, h2 = h1 ^ U(length), h2 ^ U(length)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _fmix(h1), _fmix(h2)
    return h1 + h2


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Hash of each shingle of ``k`` characters; of the whole text if it has fewer."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(text) < k:
        return murmur3(raw.reshape(1, -1))
    if len(raw) == len(text):
        start = np.arange(len(raw) + 1)
    else:
        start = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    size = start[k:] - start[:-k]
    out = np.empty(len(size), U)
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        out[some] = murmur3(raw[start[some][:, None] + np.arange(n)])
    return out


def fingerprint_of(text: str, k: int = 3) -> int:
    """SimHash as an unsigned integer: bit i is set if over half of the shingles' hashes have it."""
    if k < 1:
        raise ValueError("shingle_size must be at least 1")
    h = shingle_hashes(text, k)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def _distinct_hashes(chars: np.ndarray) -> np.ndarray:
    """Hash of each row of a matrix of code points."""
    k = chars.shape[1]
    raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    start = np.append(np.flatnonzero((raw & 0xC0) != 0x80)[::k], len(raw))
    size = np.diff(start)
    out = np.empty(len(chars), U)
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        out[some] = murmur3(raw[start[some][:, None] + np.arange(n)])
    return out


def _votes(texts: list[str], k: int) -> np.ndarray:
    """SimHash of texts of ``k`` characters at least: each distinct shingle is hashed once and counted for each text."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    most = len(alphabet)
    if most**k >= 1 << 62:
        return np.array([fingerprint_of(t, k) for t in texts], U)
    code_of = np.zeros(len(seen), np.int64)
    code_of[alphabet] = np.arange(most)
    own = code_of[chars]
    code = own[: len(own) - k + 1].copy()
    for j in range(1, k):
        code *= most
        code += own[j : len(own) - k + 1 + j]
    sizes = np.array([len(t) for t in texts])
    inside = np.ones(len(code), bool)
    inside[(np.cumsum(sizes)[:-1, None] - np.arange(1, k)).ravel()] = False  # these run into the next text
    code = code[inside]
    if most**k <= TABLE:
        seen = np.zeros(most**k, bool)
        seen[code] = True
        distinct = np.flatnonzero(seen)
        place = np.empty(most**k, np.int32)
        place[distinct] = np.arange(len(distinct))
        code = place[code]
    else:
        distinct, code = np.unique(code, return_inverse=True)
    rows = np.stack([distinct // most ** (k - 1 - j) % most for j in range(k)], axis=1)
    kind = np.float32 if len(code) < 1 << 24 else np.float64  # counts are exact
    bits = np.unpackbits(_distinct_hashes(alphabet[rows]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(kind)
    n = sizes - k + 1
    end = np.cumsum(n)
    ones = np.empty((len(texts), 64), kind)
    step = max(1, TABLE // len(distinct))
    for a in range(0, len(texts), step):
        b = min(a + step, len(texts))
        own = code[end[a] - n[a] : end[b - 1]] + np.repeat(np.arange(b - a) * len(distinct), n[a:b])
        ones[a:b] = np.bincount(own, minlength=(b - a) * len(distinct)).reshape(b - a, -1).astype(kind) @ bits
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(U)


def fingerprints_of(texts: list[str], k: int = 3) -> np.ndarray:
    """``fingerprint_of`` each text, as unsigned integers.  Texts are taken together, about CHARS characters at a time."""
    if k < 1:
        raise ValueError("shingle_size must be at least 1")
    out = np.empty(len(texts), U)
    some, held = [], 0
    for i, t in enumerate(texts):
        if len(t) < k:
            out[i] = fingerprint_of(t, k)
            continue
        some.append(i)
        held += len(t)
        if held >= CHARS:
            out[some] = _votes([texts[j] for j in some], k)
            some, held = [], 0
    if some:
        out[some] = _votes([texts[j] for j in some], k)
    return out


def fingerprint(text: Column, k: int = 3) -> Column:
    """The SimHash as a BIGINT with the same bits; null of null."""
    if k < 1:
        raise ValueError("shingle_size must be at least 1")

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        known = texts[texts.notna()]
        return pd.Series(fingerprints_of(known.tolist(), k).view(np.int64), index=known.index, dtype="Int64").reindex(texts.index)

    return prints(text)


def hash_shingle(shingle: Column) -> Column:
    """MurmurHash3 x64-128 (first word, as a BIGINT) of a string's UTF-8 bytes."""

    @F.pandas_udf("long")
    def hashes(texts: pd.Series) -> pd.Series:
        raw = [None if t is None else t.encode() for t in texts]
        out = pd.Series([None] * len(raw), dtype="Int64")
        for n in {len(r) for r in raw if r is not None}:
            at = [i for i, r in enumerate(raw) if r is not None and len(r) == n]
            rows = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
            out.iloc[at] = murmur3(rows).astype(np.int64)
        return out

    return hashes(shingle)


def shingles(text: Column, k: int = 3) -> Column:
    """All runs of ``k`` characters, in order and with repeats; the whole text if it has fewer."""
    if k < 1:
        raise ValueError("shingle_size must be at least 1")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    # the one-element array binds the characters, which are then split off once and not for each shingle
    runs = F.transform(F.array(chars), lambda c: F.transform(starts, lambda i: F.concat(*(F.get(c, i + (j - 1)) for j in range(k)))))
    return F.when(n < k, F.array(text)).otherwise(F.element_at(runs, 1))


def _counted(texts: list[str], k: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of texts of ``k`` characters at least: for each text and shingle of it, the text's place, the shingle and its number."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    alphabet, own = np.unique(chars, return_inverse=True)
    sizes = np.array([len(t) for t in texts])
    inside = np.ones(len(own) - k + 1, bool)
    inside[(np.cumsum(sizes)[:-1, None] - np.arange(1, k)).ravel()] = False  # these run into the next text
    place = np.zeros(int(inside.sum()), np.int64)
    for j in range(k):  # ranked after each character, so that no code grows beyond the texts
        _, place = np.unique(place * len(alphabet) + own[j : len(own) - k + 1 + j][inside], return_inverse=True)
    first = np.unique(place, return_index=True)[1]
    at = np.flatnonzero(inside)[first]
    whole = "".join(texts)
    distinct = [whole[i : i + k] for i in at.tolist()]
    pair, n = np.unique(np.repeat(np.arange(len(texts)), sizes - k + 1) * len(distinct) + place, return_counts=True)
    return pair // len(distinct), distinct, np.stack([pair % len(distinct), n])


def shingle_rows(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, shingle, n): how often each shingle of ``docs`` (doc_id, text) occurs; rows that share a doc_id count as one.

    Texts are brought together by doc_id and counted there, so shingles are
    not shuffled.
    """
    if k < 1:
        raise ValueError("shingle_size must be at least 1")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, some, held = [], [], 0
            for row in range(batch.num_rows):
                texts = batch.column("texts")[row].as_py()
                if len(texts) > 1 or len(texts[0]) < k:  # as a rule, a doc_id has one text
                    found = Counter(s for t in texts for s in ([t] if len(t) < k else (t[i : i + k] for i in range(len(t) - k + 1))))
                    yield rows(batch, [row] * len(found), pa.array(found.keys(), pa.string()), np.array(list(found.values()), np.int64))
                    continue
                at.append(row)
                some.append(texts[0])
                held += len(texts[0])
                if held >= CHARS:
                    yield counted(batch, at, some)
                    at, some, held = [], [], 0
            if some:
                yield counted(batch, at, some)

    def counted(batch, at, some):
        text, distinct, (place, n) = _counted(some, k)
        return rows(batch, np.array(at)[text], pa.array(distinct, pa.string()).take(pa.array(place)), n)

    def rows(batch, at, shingle, n):
        return pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "shingle": shingle, "n": pa.array(n, pa.int64())})

    together = docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    return together.mapInArrow(count, f"doc_id {kind}, shingle string, n long")


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def bands(fp: Column) -> list[Column]:
    """The four 16-bit bands, the most significant first."""
    return [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(65535)).cast("int") for shift in (48, 32, 16, 0)]
