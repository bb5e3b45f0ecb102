import random
import zlib

import numpy as np

from contextkit.llm import op04_toxicity as op
from contextkit.llm.lexicon import Automaton, Scorer, edits_for, fit_logistic
from tests.llm import cases


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_what_edit_distance_says():
    terms = ["moron", "idiots", "pathetic", "worthless", "bad"]
    rng = random.Random(4)
    automaton = Automaton(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "s"])
        word = "".join(w)
        near = [(distance(word, t), n) for n, t in enumerate(terms) if distance(word, t) <= edits_for(t)]
        found = automaton.find(word)
        assert (found is None) == (not near)
        if near:
            assert (found[1], found[0]) == min(near)


def test_quotation_counts_less():
    scorer = Scorer(["moron"], [3.0])
    bare, quoted, aimed = (scorer.features(t) for t in ("this one is a moron indeed", 'they said "moron" again now', "see you are a moron here"))
    assert quoted[0] < bare[0] < aimed[0] and quoted[5] == 1 and bare[5] == 0
    assert scorer.features("a m0ron")[3] > 0 and not scorer.features("")[:6].any() and not scorer.features(None)[:6].any()


def test_logistic():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    b = fit_logistic(x, np.array([0, 0, 1, 1]), ridge=0.1)
    p = 1 / (1 + np.exp(-(b[0] + x[:, 0] * b[1])))
    assert (p[:2] < 0.5).all() and (p[2:] > 0.5).all()


def corpus(spark, n=600):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=30)
        if i % 4 == 0:
            text[rng.randrange(30)] = rng.choice(["moron", "idiot", "m0ron", "idiott"] if i % 8 else ["moron", "idiot"])
        docs.append((i, " ".join(text), "x", "y", 0, *"abcdef"))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(docs, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = op.train(docs, labels)
    scored = op.toxicity(docs, model, "p").join(labels, "doc_id").collect()
    held = [(r.p >= 0.3) == (r.toxic == 1) for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert all(0 <= r.p <= 1 for r in scored)


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", op.F.when(op.held_out(op.F.col("doc_id")), 1 - op.F.col("toxic")).otherwise(op.F.col("toxic")))
    a, b = op.train(docs, labels), op.train(docs, turned)
    assert (a.terms, a.weights) == (b.terms, b.weights) and np.allclose(a.coefficients, b.coefficients)


def test_toxic_documents_go(spark):
    docs, labels = corpus(spark)
    kept = op.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 4 == 0 for i in ids) < 8 and sum(i % 4 != 0 for i in ids) == 450


def test_odd_documents(spark):
    docs, labels = cases.documents(spark), spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (15, 0)], "doc_id long, toxic int")
    assert op.drop_toxic(docs, labels).count() <= docs.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert op.drop_toxic(docs, none).count() == docs.count()
    assert op.toxicity(cases.no_documents(spark), op.train(cases.no_documents(spark), none)).collect() == []
