import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contextkit.llm import op10_simhash as op
from contextkit.llm.components import components
from tests.llm import cases


def brute_print(text):
    w = (text or "").encode()
    w = w.lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(prints, budget):
    """Index of the first print that each reaches."""
    root = list(range(len(prints)))
    while True:
        new = [min([root[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= budget]) for i in range(len(prints))]
        if new == root:
            return root
        root = new


def test_odd_documents(spark):
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in op.simhash_classes(cases.documents(spark)).collect() if r.doc_id is not None)
    docs = sorted((i, t) for i, t, *_ in cases.rows() if i is not None and t is not None)
    docs = sorted([*docs, (5, None)], key=lambda d: d[0])
    prints = [brute_print(t) for _, t in docs]
    root = classes(prints, 2)
    least = {k: min(docs[i][0] for i in range(len(docs)) if root[i] == k) for k in set(root)}
    assert got == sorted((docs[i][0], prints[i], least[root[i]]) for i in range(len(docs)))


def test_no_documents(spark):
    assert op.simhash_classes(cases.no_documents(spark)).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("hot", [10**6, 2])
def test_links_are_complete(spark, monkeypatch, budget, hot):
    monkeypatch.setattr(op, "HOT", hot)
    rng = np.random.default_rng(budget)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)}
    for p in list(prints):
        for _ in range(6):
            p = p & (2**64 - 1)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                p ^= 1 << int(bit)
            p -= (p >> 63) << 64
            prints.add(p)
    prints = sorted(prints)
    if budget == 5 and hot == 2:
        pytest.skip("every neighbour within two bits of each print: too many here")
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in op.classes(df, budget).collect()}
    assert [got[p] for p in prints] == classes([p & (2**64 - 1) for p in prints], budget)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges)
    assert got.where("label = 0").count() == got.count() == n + 1
