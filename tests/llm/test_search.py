"""Decontamination and exact search against brute force."""

import hashlib
import re

import numpy as np
import pytest

from contextkit.llm import op03_decontaminate as op3
from contextkit.llm import op07_topk as op7
from contextkit.llm.fmindex import FMIndex, suffix_array
from tests.llm import cases

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


ITEMS = [(1, "Quick BROWN fox jumps over the lazy dog and"), (2, "lazy dog"), (10, "over the lazy dog and then runs far away"), (3, None), (4, "?!"), (None, "the quick"), (2, "lazy dog"), (5, "é ü"), (6, "never there at all")]


def brute(text):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, t in ITEMS:
        iw = words(t)
        if item is None or not iw:
            continue
        for a in range(max(1, len(iw) - 7)):
            p = iw[a : a + 8]
            for b in range(len(w) - len(p) + 1):
                if w[b : b + len(p)] == p:
                    found.add(str(item))
                    hit[b : b + len(p)] = [True] * len(p)
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("limit", [1 << 20, 30])
def test_leaks(spark, monkeypatch, limit):
    monkeypatch.setattr(op3, "PASS_BYTES", limit)  # a small limit takes several passes
    got = op3.find_leaks(cases.documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string"))
    seen = sorted(((r.doc_id, r.n_words, sum(s.end - s.first for s in r.spans), list(r["items"])) for r in got.collect()), key=str)
    assert seen == sorted(((i, *brute(t)) for i, t, *_ in cases.rows()), key=str)


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op3.find_leaks(cases.no_documents(spark), none).collect() == []
    assert all(not r["items"] for r in op3.find_leaks(cases.documents(spark), none).collect())


def test_leaky_documents_go(spark):
    docs = cases.documents(spark)
    kept = op3.drop_leaks(docs, spark.createDataFrame(ITEMS[2:3], "item_id long, text string"))
    assert kept.columns == docs.columns
    want = [i for i, t, *_ in cases.rows() if "over the lazy dog" not in (t or "").lower()]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_fm_index():
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(0, 4, 400), 0)
    sa = suffix_array(s)
    assert sorted(sa.tolist()) == list(range(len(s)))
    index = FMIndex(s, 4)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    number, at = index.search(phrases)
    got = sorted(zip(number.tolist(), at.tolist(), strict=True))
    assert got == sorted((k, i) for k, p in enumerate(phrases.tolist()) for i in range(len(s) - 2) if s[i : i + 3].tolist() == p)
    assert len(FMIndex(np.zeros(0, np.int64), 2).search(np.array([[1]]))[0]) == 0


@pytest.mark.parametrize("block,first,order", [(7, 1, 1 << 20), (64, 4, 8)])
def test_top_k(spark, monkeypatch, block, first, order):
    monkeypatch.setattr(op7, "BLOCK", block)
    monkeypatch.setattr(op7, "QUERY_BLOCK", 3)
    monkeypatch.setattr(op7, "FIRST", first)
    monkeypatch.setattr(op7, "ORDER_BYTES", order)  # 8: one query in a block
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(120)]
    rows += [(20, rows[20][1]), (33, rows[33][1]), (40, [1.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(60, None, "x"), (61, [1.0, None], "x"), (80, [float("inf")] * 5, "x"), (None, [1.0] * 5, "x")], "vec_id long, embedding array<float>, score string")
    v = op7.quantised(df)
    got = sorted(map(tuple, op7.top_k(v, v.where("vec_id % 20 = 0"), 6).collect()))
    want = []
    for q, (i, x) in enumerate(rows):
        if i % 20 == 0:
            s = sorted((-int(np.dot(np.floor(64 * np.array(x)), np.floor(64 * np.array(y)))), j) for c, (j, y) in enumerate(rows) if c != q)[:6]
            want += [(i, r, j, -n) for r, (n, j) in enumerate(s, 1)]
    assert got == sorted(want)


def test_most_blocks_are_skipped(spark, monkeypatch):
    """30 clusters and a vector that 300 rows repeat, in 40 blocks: bounds settle most pairs, ties do not keep blocks open."""
    monkeypatch.setattr(op7, "BLOCK", 32)
    monkeypatch.setattr(op7, "FIRST", 2)
    rng = np.random.default_rng(6)
    centres = rng.choice([-1.0, 1.0], (30, 16))
    m = np.concatenate((np.repeat(centres, 32, axis=0) + rng.normal(0, 0.05, (960, 16)), np.ones((300, 16))))
    m = m[rng.permutation(len(m))]
    v = op7.quantised(spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>"))
    seen = {}
    op7.search(v, v.where("vec_id % 20 = 0"), 5, seen)
    assert seen["pairs"] >= 63 * 39 and seen["scored"] < 0.4 * seen["pairs"]
    x = np.floor(64 * m)
    got = sorted(map(tuple, op7.top_k(v, v.where("vec_id % 20 = 0"), 5).collect()))
    want = []
    for i in range(0, len(x), 20):
        s = sorted((-int(n), j) for j, n in enumerate(x @ x[i]) if j != i)[:5]
        want += [(i, r, j, -n) for r, (n, j) in enumerate(s, 1)]
    assert got == sorted(want)


def test_top_k_of_nothing(spark):
    v = op7.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert op7.top_k(v, v, 3).collect() == []


def test_digest_columns(spark, tmp_path):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op3.op3_decontaminate(spark, str(tmp_path)).collect()}
    want = set()
    for i, t, *_ in cases.rows():
        n, hit, items = brute(t)
        want.add((i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(items) >= 2))
    assert got == want


@pytest.mark.parametrize("most", [op3.PASS_BYTES, 40])
def test_short_items_alone_are_no_leak(spark, monkeypatch, most):
    monkeypatch.setattr(op3, "PASS_BYTES", most)  # 40: a pass for every few items
    items = [(1, "one two three four five six seven eight nine ten"), (2, "red green"), (3, "blue black white"), (4, None), (None, "nothing at all here")]
    texts = {1: "so One two, three four five six seven eight it is", 2: "one two three four five six seven", 3: "red green and red green", 4: "red green or blue black white", 5: None, 6: "", 7: "nothing at all here", 8: "red green " * 4}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, items string, leak long")
    kept = op3.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8]
