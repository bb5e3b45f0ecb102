"""Mixing, packing and the whole pipeline."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from contextkit.llm import op06_mix as mix
from contextkit.llm import op08_pack as pack
from tests.llm import cases

ENCODING = pack.encoder(open(pack.TOKENIZER, "rb").read())


def share(budget, children):
    """Budgets of (weight, room) children, a full one leaving its rest to the others."""
    out, todo = {}, dict(enumerate(children))
    budget = min(budget, sum(r for _, r in children))
    while todo:
        total = sum(w for w, _ in todo.values())
        full = [i for i, (w, r) in todo.items() if r * total <= budget * w]
        if not full:
            return [out[i] if i in out else budget * children[i][0] // total for i in range(len(children))]
        i = min(full, key=lambda i: children[i][1] / children[i][0])
        out[i] = todo.pop(i)[1]
        budget -= out[i]
    return [out[i] for i in range(len(children))]


def brute_copies(rows, epochs=2, seed=17):
    leaf_of, size, leaves = {}, {}, defaultdict(int)
    for k, (i, text, lang, source, *_) in enumerate(rows):
        name = source or ""
        leaf_of[k] = (f"d{int(hashlib.md5(name.encode()).hexdigest()[0], 16) % 4}", lang or "", name)
        size[k] = (len((text or "").encode()) + 3) // 4
        leaves[leaf_of[k]] += size[k]

    def divide(budget, depth, inside):
        if depth == 3:
            return {inside[0]: budget}
        groups = defaultdict(list)
        for leaf in inside:
            groups[leaf[depth]].append(leaf)
        names = sorted(groups)
        weights = [mix.LANGUAGE_WEIGHTS.get(n, 1) if depth == 1 else 1 for n in names]
        given = share(budget, [(w, epochs * sum(leaves[x] for x in groups[n])) for n, w in zip(names, weights, strict=True)])
        return {k: v for n, b in zip(names, given, strict=True) for k, v in divide(b, depth + 1, groups[n]).items()}

    out = {}
    for leaf, budget in divide(sum(size.values()), 0, sorted(leaves)).items():
        own = [k for k in leaf_of if leaf_of[k] == leaf]
        whole = budget // leaves[leaf] if leaves[leaf] else 1
        rest = budget - whole * leaves[leaf]
        order = lambda k: (int(hashlib.md5(f"{seed}|{whole}|{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:15], 16), -(2**63) if rows[k][0] is None else rows[k][0], size[k])  # noqa: B023, E731
        used = 0
        for place in sorted({order(k) for k in own}):
            same = [k for k in own if order(k) == place]
            used += sum(size[k] for k in same)
            for k in same:
                out[k] = whole + (used <= rest and whole < epochs)
    return out


@pytest.mark.parametrize("bucket", [4096, 1])
def test_mixing(spark, monkeypatch, bucket):
    monkeypatch.setattr(mix, "BUCKET", bucket)  # 1: many buckets in a leaf
    rng = np.random.default_rng(2)
    rows = cases.rows() + [(100 + i, "t" * int(rng.integers(0, 60)), ["en", "de", "fr", None][i % 4], f"src{i % 7}", None, *"abcdef") for i in range(150)]
    got = mix.mix_sources(spark.createDataFrame(rows, cases.SCHEMA))
    want = Counter((r[0], r[1], r[3], n) for r, n in zip(rows, (lambda d: [d[k] for k in range(len(rows))])(brute_copies(rows)), strict=True))
    assert Counter((r.doc_id, r.text, r.source, r.copies) for r in got.collect()) == want


def test_mixing_nothing(spark):
    assert mix.mix_sources(cases.no_documents(spark)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_decreasing(sizes):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            b = room.index(min(fits))
            room[b] -= sizes[i]
        else:
            room.append(50 - sizes[i])
    got = pack.best_fit_decreasing(sizes, 50)
    bins = [sum(sizes[i] for i in b) for b in got]
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert sorted(50 - b for b in bins) == sorted(room)


def unpacked(rows, length):
    """Token ids of each (doc_id, number of the copy), put together again."""
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        positions = pack.position_ids(r.asDict(), length)
        for k, doc in enumerate(r.doc_ids):
            a, b = r.cu_seqlens[k : k + 2]
            assert positions[a:b].tolist() == list(range(b - a))
            parts[doc].append((r.doc_offsets[k], ids[a:b].tolist()))
    return parts


@pytest.mark.parametrize("length", [8, 2048])
def test_packing_is_lossless(spark, length):
    rows = pack.pack_tokens(cases.documents(spark), length).collect()
    parts = unpacked(rows, length)
    texts = defaultdict(list)
    for i, t, *_ in cases.rows():
        if t is not None:
            texts[i].append(t)
    for i, own in texts.items():
        ids = [x for _, x in sorted(parts[i], key=lambda p: p[0])] if len(own) == 1 else None
        if ids is not None:
            assert ENCODING.decode([x for p in ids for x in p][:-1]) == own[0] and ids[-1][-1] == 50256
    assert sum(len(p) for v in parts.values() for _, p in v) == sum(len(ENCODING.encode_ordinary(t)) + 1 for v in texts.values() for t in v)


def test_packing_nothing(spark):
    assert pack.pack_tokens(cases.no_documents(spark)).collect() == []


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    text = lambda: " ".join(rng.choice(words, 60))
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(i, text()) for i in range(200)]
    labels = []
    for i in range(0, 120, 3):
        docs[i] = (i, docs[i][1] + " moron")
        labels.append((i, 5, 1))
    labels += [(i, 5, 0) for i in range(1, 120, 3)]
    docs += [(300, docs[1][1]), (301, docs[1][1]), (302, f"{text()} {item} {text()}"), (303, None), (304, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        if name != "token_output":
            assert d.columns == columns
        d.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = d
    ids = lambda name: Counter(r.doc_id for r in seen[name].collect())
    toxic = {i for i, *_ in labels if _[1]}
    assert set(ids("toxicity")) == {i for i, _ in docs} - toxic
    assert set(ids("near_dedup")) == set(ids("toxicity")) - {300, 301, 304}  # 303 and 304 are both without words
    assert set(ids("decontamination")) == set(ids("near_dedup")) - {302}
    assert set(ids("mixing")) <= set(ids("decontamination")) and max(ids("mixing").values()) <= 2
    whole = sum(len(ENCODING.encode_ordinary(r.text)) + 1 for r in seen["mixing"].collect() if r.text is not None)
    assert sum(r.n_tokens for r in seen["token_output"].collect()) == whole
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, run.collect())) == Counter(map(str, seen["token_output"].collect()))


CLASHES = "size domain language source_name copies copy rest whole bits last place u col row toxicity_score score leak spans items id_ hash times set label component_id n_words shard word count".split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(*r[:5], *(f"{c} of {k}" for c in CLASHES)) for k, r in enumerate(cases.rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    spark.createDataFrame([(1, 0), (15, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = set(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = list(map(str, out.collect()))
        assert kept and set(kept) <= given, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
