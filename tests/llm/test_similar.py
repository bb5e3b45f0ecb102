"""The near_dedup stage against every pair of shingle sets."""

import numpy as np

from contextkit.llm import similar
from tests.llm import cases


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(docs, least=0.8):
    own = [sets(t) for _, t in docs]
    near = lambda a, b: a == b or len(a & b) >= least * len(a | b)
    root = list(range(len(docs)))
    links = [(i, j) for i in range(len(docs)) for j in range(i) if near(own[i], own[j])]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                moved = True
    return [min(docs[j][0] for j in range(len(docs)) if root[j] == r) for r in root]


def edited(rng, words, text, changes):
    w = text.split()
    for i in rng.choice(len(w), changes, replace=False):
        w[i] = str(rng.choice(words))
    return " ".join(w)


def test_classes_of_similar_documents(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for n in (20, 60, 200, 700) * 6:
        text = " ".join(rng.choice(words, n))
        docs.append(text)
        docs += [edited(rng, words, text, int(n * share)) for share in (0, 0.01, 0.02, 0.025, 0.05, 0.3)]
    docs = list(zip(rng.permutation(len(docs)).tolist(), docs, strict=True))
    rows, found = similar.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in rows.join(found, "set").collect()}
    assert [got[i] for i, _ in docs] == brute_classes(docs)


def test_many_near_copies_of_one_document(spark):
    """More copies than a cell holds, each nearer to the original than to the others."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    text = " ".join(rng.choice(words, 400))
    docs = [(200, text), *((i, edited(rng, words, text, 4)) for i in range(120)), (300, " ".join(rng.choice(words, 400)))]
    kept = similar.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 300]


def test_star_of_copies_unlike_each_other(spark):
    """Each copy is similar to the original only: 0.82 to it, about 0.68 to other copies."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(rng.choice(words, 400))
    docs = [(900, text), *((i, edited(rng, words, text, 8)) for i in range(500)), (901, " ".join(rng.choice(words, 400)))]
    rows, found = similar.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in rows.join(found, "set").collect()}
    assert sum(got[i] == 0 for i in (*range(500), 900)) == 501 and got[901] == 901


def test_groups_are_exhausted(spark, monkeypatch):
    """No cells, so that leaders alone come first, and blocks of few: what leaders leave is found across blocks."""
    monkeypatch.setattr(similar, "CELL", 1)
    monkeypatch.setattr(similar, "BLOCK", 3)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(3):
        text = " ".join(rng.choice(words, 200))
        for share in (0.02, 0.045):  # edits of edits, too
            docs += [edited(rng, words, text, int(200 * share)) for _ in range(20)]
            text = docs[-1]
    docs = list(zip(rng.permutation(len(docs)).tolist(), docs, strict=True))
    rows, found = similar.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in rows.join(found, "set").collect()}
    assert [got[i] for i, _ in docs] == brute_classes(docs)


def test_pairs_within_a_class_of_prints(spark):
    """B and C are similar and within the budget; the root of their class of prints, A, is similar to neither."""
    rng = np.random.default_rng(10)
    one, other = (np.unique(rng.integers(0, 1 << 63, 300, np.uint64)) for _ in range(2))
    nearly = np.sort(np.append(one[1:], np.uint64(7)))
    # bands that no two share: only the prints make candidates
    rows = [(i, i, 0, i, fp, similar.sketch(h), [3 * i + 1000]) for i, fp, h in ((1, 0, other), (2, 1, one), (3, 2, nearly))]
    reps = spark.createDataFrame(rows, "set long, doc_id long, text_hash long, least long, fp long, sketch binary, bands array<long>")
    pairs, groups = similar.candidates(reps, 3)
    first = similar.estimated(pairs, reps).where("similarity >= 0.72")
    none = spark.createDataFrame([], "node long, label long")
    more = similar.across(groups, reps, none, 0.72)
    assert {(r.a, r.b) for r in first.union(more).collect()} == {(2, 3)}
    # prints 2 bits apart are beyond a budget of 1, though their class is the same
    assert similar.across(similar.candidates(reps, 1)[1], reps, none, 0.72).isEmpty()


def one_group(spark, hashes):
    """(key, reach, set) of one group of all of ``hashes``, a row of ``reps`` and of (set, shingles) for each, and no classes."""
    sets = [np.unique(h) for h in hashes]
    reps = [(i, 0, similar.sketch(h)) for i, h in enumerate(sets)]
    own = [(i, bytearray(np.unique(h.astype(np.uint32)).tobytes())) for i, h in enumerate(sets)]
    groups = [(7, 64, i) for i in range(len(sets))]
    frame = spark.createDataFrame
    none = frame([], "node long, label long")
    return frame(groups, "key long, reach int, set long"), frame(reps, "set long, fp long, sketch binary"), frame(own, "set long, shingles binary"), none


def half_new(rng, base, keep):
    return np.append(rng.choice(base, keep, replace=False), rng.integers(0, 1 << 63, len(base) - keep, np.uint64))


def test_links_of_a_group_grow_with_its_members(spark):
    """200 sets of which all 19,900 pairs are similar (about 0.9 to each other): two links a member, at most, join them."""
    rng = np.random.default_rng(20)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    groups, reps, _, none = one_group(spark, [half_new(rng, base, 390) for _ in range(200)])
    found = similar.across(groups, reps, none, 0.8).collect()
    assert len(found) < 400
    root = list(range(200))
    for r in found:
        root = [root[r.a] if x == root[r.b] else x for x in root]
    assert len(set(root)) == 1


def test_doubts_of_a_group_grow_with_its_members(spark, monkeypatch):
    """200 sets, pairs about 0.75, so that sketches leave thousands in doubt; two are planted that are 0.8 or more to one other."""
    monkeypatch.setattr(similar, "BLOCK", 64)
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    hashes = [half_new(rng, base, 368) for _ in range(200)]
    hashes += [np.append(hashes[i][: 400 - n], rng.integers(0, 1 << 63, n, np.uint64)) for i, n in ((5, 40), (150, 41))]
    jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {(i, j) for j in range(len(hashes)) for i in range(j) if jaccard(hashes[i], hashes[j]) >= 0.8}
    assert {(5, 200), (150, 201)} <= want
    groups, reps, own, none = one_group(spark, hashes)
    doubts = similar.across(groups, reps, none, 0.72, 0.88).collect()
    assert 0 < len(doubts) <= 2 * len(hashes) and {i for p in want for i in p} <= {x for r in doubts for x in (r.a, r.b)}
    for each in (similar.BLOCK_BYTES, 20_000):  # blocks of few sets, too, where these are large
        monkeypatch.setattr(similar, "BLOCK_BYTES", each)
        found = {(r.a, r.b) for r in similar.across(groups, reps, none, 0.72, 0.88, own, 0.8).collect()}
        assert {(5, 200), (150, 201)} <= found <= want


def test_pairs_near_the_threshold_of_large_groups(spark, monkeypatch):
    """Copies about 0.7 to 0.85 to each other: which are linked is settled by shingles, within blocks."""
    monkeypatch.setattr(similar, "CELL", 1)
    monkeypatch.setattr(similar, "BLOCK", 4)
    monkeypatch.setattr(similar, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(22)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for n, changes in ((200, 3), (300, 4), (150, 2)):
        text = " ".join(rng.choice(words, n))
        docs += [edited(rng, words, text, changes) for _ in range(30)]
    docs = list(zip(rng.permutation(len(docs)).tolist(), docs, strict=True))
    rows, found = similar.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in rows.join(found, "set").collect()}
    assert [got[i] for i, _ in docs] == brute_classes(docs)


def test_odd_documents(spark):
    docs = cases.documents(spark)
    kept = similar.drop_near_copies(docs)
    assert kept.columns == docs.columns
    known = [(i, t) for i, t, *_ in cases.rows() if i is not None]
    want = sorted({c for c in brute_classes(known)})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id IS NULL").count() == 2


def test_no_documents(spark):
    assert similar.drop_near_copies(cases.no_documents(spark)).collect() == []


def test_estimates():
    rng = np.random.default_rng(1)
    for n in (5, 50, 500, 5000):
        x = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        for share in (0.0, 0.5, 0.8, 1.0):
            same = round(2 * n * share / (1 + share))
            y = np.concatenate((x[:same], rng.integers(0, 1 << 63, n - same, np.uint64) * np.uint64(2) + np.uint64(1)))
            true = same / (2 * n - same)
            assert abs(similar.estimates([similar.sketch(np.unique(x))], [similar.sketch(np.unique(y))])[0] - true) < similar.DOUBT
