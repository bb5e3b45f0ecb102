import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextkit.functions import simhash as sh
from contextkit.operators import hamming as h
from contextkit.operators.hamming import hamming_join, match_keys


def one_hash(text):
    return int(sh.murmur3(np.frombuffer(text.encode(), np.uint8).reshape(1, -1))[0])


@pytest.mark.parametrize(
    "text, word",
    [("hello", 0xCBD8A7B341BD9B02), ("abc", 13012657714217449575), ("12345678", 4272337174398058908), ("é€😀x", 1061561511230299695), ("😀😁😂", 12998074940706053669)],
)
def test_murmur(text, word):
    assert one_hash(text) == word


def test_fingerprint_goldens():
    assert sh.fingerprint_of("") == 0
    assert sh.fingerprint_of("ab") == 10631611042442844974
    a, b = sh.fingerprint_of("What is the capital of France?"), sh.fingerprint_of("What's the capital of France?")
    assert (a, b) == (153459905644084784, 735550174733975058)
    assert (a ^ b).bit_count() == 10


@given(st.text(max_size=40), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_fingerprint_is_a_majority(text, k):
    parts = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
    hashes = [one_hash(p) for p in parts]
    assert sh.fingerprint_of(text, k) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_columns(spark):
    texts = ["", "ab", "abc", "a😀é b", "x" * 50_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    row = {r.i: r for r in df.select("i", sh.fingerprint(F.col("t")).alias("fp"), sh.shingles(F.col("t")).alias("s"), *(b.alias(f"b{n}") for n, b in enumerate(sh.bands(sh.fingerprint(F.col("t")))))).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert row[i].fp is None
            continue
        fp = sh.fingerprint_of(t)
        assert row[i].fp % 2**64 == fp
        assert [row[i][f"b{n}"] for n in range(4)] == [fp >> s & 65535 for s in (48, 32, 16, 0)]
        assert row[i].s == ([t[j : j + 3] for j in range(len(t) - 2)] if len(t) >= 3 else [t])
    for bad in (sh.fingerprint, sh.shingles):
        with pytest.raises(ValueError):
            bad(F.col("t"), 0)


def brute(prints, threshold):
    known = sorted({p for p in prints if p is not None})
    return sorted((a, b, d) for a in known for b in known if (d := ((a ^ b) % 2**64).bit_count()) <= threshold)


@pytest.mark.parametrize("threshold,many", [(0, 1), (1, 1 << 40), (3, 1), (3, 1 << 30), (4, 1), (7, 1 << 20), (64, 1)])
def test_hamming_join_misses_nothing(spark, monkeypatch, threshold, many):
    """With as many keys as ``many`` prints would call for."""
    own = h.segments_for
    monkeypatch.setattr(h, "segments_for", lambda t, n: own(t, max(n, many)))
    rng = np.random.default_rng(threshold)
    base = rng.integers(-(2**63), 2**63, 12)
    prints = [int(p) for p in base]
    for p in base:
        for flips in (1, 2, 3, 4, 7, 8):
            bits = rng.choice(64, flips, replace=False)
            prints.append(int(np.int64(p) ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)).astype(np.int64)))
    prints += [None, -1, 0, prints[0]]
    df = spark.createDataFrame([(p,) for p in prints], "p long")
    got = hamming_join(df.select(F.col("p").alias("l")), df.select(F.col("p").alias("r")), threshold).collect()
    assert sorted(map(tuple, got)) == brute(prints, threshold)


def test_keys():
    for threshold in range(1, 64):
        keys = match_keys(threshold, prints=1000)
        cut = {s for k in keys for s in k}
        assert sum(w for _, w in cut) == 64 and len(cut) > threshold and len(keys) <= max(h.MOST_KEYS, len(cut))
    assert [sum(w for _, w in k) for k in match_keys(3)] == [16] * 4
    assert min(sum(w for _, w in k) for k in match_keys(3, prints=1 << 28)) >= 28
    assert len(match_keys(9, "bands")) == 4
    with pytest.raises(ValueError):
        match_keys(-1)


def crowded():
    """Prints of which many share most of their bits, so that key groups are large, and some that stand alone."""
    rng = np.random.default_rng(5)
    few = rng.choice(64, 10, replace=False).astype(np.uint64)
    near = [np.bitwise_or.reduce(np.uint64(1) << few[rng.random(10) < 0.4], initial=np.uint64(1 << 40)) for _ in range(400)]
    return sorted({int(np.uint64(p).astype(np.int64)) for p in (*near, *rng.integers(0, 2**63, 50))})


@pytest.mark.parametrize("cells", [7, h.CELLS])
@pytest.mark.parametrize("threshold", [0, 1, 3, 5, 64])
def test_crowded_prints(spark, monkeypatch, threshold, cells):
    """Pairs, sums and best rows; pairs are compared where keys meet and do not come out of a join."""
    monkeypatch.setattr(h, "CELLS", cells)
    monkeypatch.setattr(h, "DENSE", 20)
    prints = crowded()
    weight = {p: (7 * i) % 1000 + 1 for i, p in enumerate(prints)}
    df = spark.createDataFrame([(p, p, weight[p]) for p in prints], "l long, r long, w long")
    pairs = brute(prints, threshold)
    found = hamming_join(df, df, threshold)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == pairs
    assert sorted(map(tuple, hamming_join(df, df, threshold, ordered=True).collect())) == [p for p in pairs if p[0] < p[1]]
    sums, first, closest = {}, {}, {}
    for a, b, d in pairs:
        sums[a] = sums.get(a, 0) + weight[b]
        first[a] = min(first.get(a, 10**6), weight[b])
        closest[a] = min(closest.get(a, (99, 0)), (d, weight[b]))
    assert dict(map(tuple, h.hamming_sums(df, df, threshold).collect())) == sums
    assert dict(map(tuple, h.hamming_best(df, df, threshold, "first").collect())) == first
    assert dict(map(tuple, h.hamming_best(df, df, threshold, "closest").collect())) == {a: w for a, (_, w) in closest.items()}


def test_texts_taken_together(monkeypatch):
    """As each text alone: short, long, of wide alphabets, over the bounds of a batch and of its tables; and no text is hashed by itself."""
    rng = np.random.default_rng(2)
    wide = ["".join(map(chr, rng.integers(low, high, 2000).tolist())) for low, high in ((32, 0xD7FF), (0x10000, 0x10FFFF))]
    texts = ["", "a", "ab", "abc", "x" * 5000, "a😀é b", "é€😀x", *wide, *("".join(rng.choice(list("abc é😀"), n)) for n in range(3, 60))]
    for k in (1, 2, 3, 5, 17):
        expected = [sh.fingerprint_of(t, k) for t in texts]
        for chars, table in ((1, 1), (50, 3000), (sh.CHARS, sh.TABLE)):
            monkeypatch.setattr(sh, "CHARS", chars)
            monkeypatch.setattr(sh, "TABLE", table)
            assert sh.fingerprints_of(texts, k).tolist() == expected
        monkeypatch.undo()
    monkeypatch.setattr(sh, "fingerprint_of", None)
    assert len(sh.fingerprints_of(["abcd", "bcde"])) == 2
    assert len(sh.fingerprints_of([])) == 0


def test_shingle_rows(spark, monkeypatch):
    """As counted one by one: rows that share a doc_id, short, empty and null texts; shingles are not shuffled."""
    monkeypatch.setattr(sh, "CHARS", 40)
    texts = [(1, "banana"), (2, "a😀é a😀é"), (3, ""), (4, "ab"), (5, None), (6, "xyz"), (6, "xyzxyz"), (6, "xy"), (None, "of none"), *((i, f"some text {i} and {i % 3}") for i in range(10, 30))]
    expected = {}
    for d, t in texts:
        for s in [] if t is None else [t] if len(t) < 3 else [t[i : i + 3] for i in range(len(t) - 2)]:
            expected[d, s] = expected.get((d, s), 0) + 1
    got = sh.shingle_rows(spark.createDataFrame(texts, "doc_id long, text string")).repartition(2)
    rows = got.collect()
    assert len(rows) == len(expected) and {(r.doc_id, r.shingle): r.n for r in rows} == expected
    plan = sh.shingle_rows(spark.createDataFrame(texts, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "explode" not in plan
