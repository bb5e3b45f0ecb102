import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contextkit.llm.op01_substring import substring_dedup
from contextkit.llm.op09_suffix import suffix_dedup
from contextkit.llm.windows import Bytes, Words, covered, doubled, runs, slide_min
from tests.llm import cases

UNITS = [
    (substring_dedup, cases.words13, 13, b" ".join),
    (suffix_dedup, cases.as_bytes, 50, bytes),
]


@pytest.mark.parametrize("operator,tokens,width,joined", UNITS)
def test_odd_documents(spark, operator, tokens, width, joined):
    got = [tuple(r) for r in operator(cases.documents(spark)).collect()]
    assert sorted(got, key=str) == cases.removed([r[:2] for r in cases.rows()], tokens, width, joined)


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_no_documents(spark, operator):
    assert operator(cases.no_documents(spark)).collect() == []


@pytest.mark.parametrize("operator,tokens,width,joined", [(substring_dedup, cases.words13, 3, b" ".join), (suffix_dedup, cases.as_bytes, 10, bytes)])
def test_short_windows_and_many_repeats(spark, operator, tokens, width, joined):
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(rng.choice(["ab", "cd", "ef", "gh"], size=rng.integers(0, 30)))) for i in rng.integers(-50, 200, 120)]
    got = [tuple(r) for r in operator(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()]
    assert sorted(got, key=str) == cases.removed(docs, tokens, width, joined)


def test_kept_text(spark):
    docs = [(1, "a b c d e"), (2, "x a b c d y")]
    got = substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 3, keep_text=True)
    assert {r.doc_id: r.kept_text for r in got.collect()} == {1: "a b c d e", 2: "x y"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=5))
def test_runs_hold_every_window_once(texts):
    unit = Bytes(12, 8)
    docs = [t.encode() for t in texts]
    r = runs(unit, docs)
    want = [(k, a) for k, d in enumerate(docs) for a in range(len(d) - 11)]
    got = [] if r is None else [(int(k), int(s + i - r.at[k])) for k, s, n in zip(r.doc, r.start, r.n, strict=True) for i in range(n)]
    assert sorted(got) == want


def test_kernels():
    x = np.array([5, 3, 4, 1, 2], np.uint64)
    assert slide_min(x, 3).tolist() == [3, 1, 1]
    assert covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]
    text = np.frombuffer(b"abcabcabc" * 4, np.uint8).astype(np.uint64)
    (names,) = doubled(text, 1, (5,))
    assert len(set(names.tolist())) == 3
    assert runs(Words(13, 6), [[b"a"] * 5]) is None
