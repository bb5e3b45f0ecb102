import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contextkit import ContextPacker
from contextkit.functions.text import sentences_of, terms, trim_unicode, word_set
from contextkit.operators import pack as pk
from contextkit.operators import textrank as tr
from contextkit.operators import tfidf as ti


@pytest.mark.parametrize(
    "text, n",
    [
        ("It costs 3.14 euros. That is all.", 2),
        ("First one here! Is it so? Yes, it is.", 3),
        ("Wait... what is that? Nothing at all.", 2),
        ("See www.example.com for more. Then stop.", 2),
        ("One line\nanother line", 2),
        ("... !!! ???", 0),
        ("Mr. Smith went. He left.", 3),
        ("", 0),
    ],
)
def test_sentences(text, n):
    assert len(sentences_of(text)) == n


@given(st.text(alphabet="aB1 .!?,\n\r é́'\")", max_size=40))
@settings(max_examples=200, deadline=None)
def test_sentences_are_cut_from_the_text(text):
    at = 0
    for s in sentences_of(text):
        at = text.index(s, at) + len(s)


def test_text_columns(spark):
    row = spark.createDataFrame([("  Ça va: éa é is 日 the-END  ",)], "t string").select(trim_unicode(F.col("t")).alias("trim"), terms(F.col("t")).alias("terms"), word_set(F.col("t")).alias("words")).first()
    assert row.trim == "Ça va: éa é is 日 the-END"
    assert row.terms == ["ça", "éa", "日", "the", "end"]
    assert row.words == ["Ça", "va:", "éa", "é", "is", "日", "the-END"]


LINES = ["apple banana cherry", "apple the", "banana cherry date elder fig", "the apple fig grape melon kiwi", "of it is"]


def frame(spark, lines, ctx="c"):
    return spark.createDataFrame([(ctx, i, s) for i, s in enumerate(lines)], "ctx string, idx int, sentence string")


def brute_tfidf(lines):
    split = [[w for w in s.lower().split() if len(w.encode()) > 2] for s in lines]
    df = {w: sum(w in s for s in split) for s in split for w in s}
    return [sum(math.log(len(lines) / (1 + df[w])) for w in s) / max(math.log(len(s)), 1) if s else 0.0 for s in split]


def test_tfidf(spark):
    got = [r.score for r in ti.tfidf_scores(frame(spark, LINES)).orderBy("idx").collect()]
    assert got == pytest.approx(brute_tfidf(LINES))


def test_cap_keeps_the_best_in_order(spark):
    lines = [f"word{i % 37} other{i % 11} thing{i} {'and more' * (i % 3)}" for i in range(60)]
    both = frame(spark, lines).union(frame(spark, lines[:20], "small"))
    kept = ti.cap_sentences(both, 25).collect()
    best = sorted(range(60), key=lambda i: (-round(brute_tfidf(lines)[i], 9), i))[:25]
    assert sorted(r.idx for r in kept if r.ctx == "c") == sorted(best)
    assert sorted(r.idx for r in kept if r.ctx == "small") == list(range(20))


def brute_rank(lines):
    sets = [{w for w in s.lower().split() if len(w.encode()) > 2} for s in lines]
    n = len(sets)
    w = [[len(a & b) / (math.log10(len(a)) + math.log10(len(b)) + 1) if a and b and i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    w = [[x / sum(r) if sum(r) else 0 for x in r] for r in w]
    rank = [1 / n] * n
    for _ in range(100):
        new = [(1 - 0.85) / n + 0.85 * sum(rank[i] * w[i][j] for i in range(n)) for j in range(n)]
        diff, rank = sum(abs(a - b) for a, b in zip(rank, new, strict=True)), new
        if diff < 1e-4:
            return rank
    return rank


def test_textrank(spark):
    got = [r.score for r in tr.textrank(frame(spark, LINES)).orderBy("idx").collect()]
    assert got == pytest.approx(brute_rank(LINES), abs=1e-9)
    assert tr.rank_of([]).tolist() == [] and tr.rank_of([["one"]]).tolist() == [1.0]
    rows = tr.normalised_graph(frame(spark, LINES)).groupBy("i").agg(F.sum("w").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in rows)


def test_selection():
    items = ["aaaa", "bbbbbbbb", "cc", "aaaa"]
    assert pk.select_within(items, [0, 1, 2, 3], 6) == [0, 2]  # too long is passed over, not an end
    five, four = "a b c d e", "a b c d x"
    assert pk.select_within([five, four], [0, 1], 100) == [0, 1]  # exactly 0.8 is not redundant
    assert pk.select_within([five, "a b c d e f"], [0, 1], 100) == [0]
    assert pk.select_within(["éé", "a"], [0, 1], 4) == [0]  # bytes count
    assert pk.select_within(items, [0], 0) == []


def test_u_shape(spark):
    for n, expected in ((5, [1, 3, 5, 4, 2]), (4, [1, 3, 4, 2]), (3, [1, 3, 2]), (2, [1, 2]), (1, [1])):
        assert spark.createDataFrame([(list(range(1, n + 1)),)], "x array<int>").select(pk.u_shaped(F.col("x"))).first()[0] == expected


def test_split_numbers_through_a_context(spark):
    docs = spark.createDataFrame([("a", 1, "second one\ntiny\nthird one"), ("a", 0, " first one "), ("b", 0, None), ("c", 0, "")], "ctx string, pos int, text string")
    assert [(r.ctx, r.idx, r.sentence) for r in pk.split_sentences(docs, "lines").orderBy("idx").collect()] == [("a", 0, "first one"), ("a", 1, "second one"), ("a", 2, "third one")]


def test_packer_object(spark):
    texts = ["Rust gives memory safety and speed to its users. Python gives ease of use.", "Both languages meet in one package of memory tools. Speed and ease of use come together."]
    packer = ContextPacker(1000, spark=spark)
    got = packer.pack(texts).split("\n")
    assert sorted(got) == sorted(s.strip() for t in texts for s in sentences_of(t))
    u = ContextPacker(1000, "u_shaped", spark=spark).pack(texts).split("\n")
    assert u == [got[0], got[2], got[3], got[1]]
    assert packer.pack_batch([[], texts, [""]]) == ["", "\n".join(got), ""]
    assert packer.pack([]) == "" and packer.pack_batch([]) == []
    assert sum(len(s.encode()) for s in ContextPacker(90, spark=spark).pack(texts).split("\n")) <= 90
    with pytest.raises(ValueError, match="Unknown strategy: other"):
        ContextPacker(10, "other")


def test_overlap_pairs(spark):
    lines = ["a b c d e", "a b c d x", "a b c d e f", "A b c d e", "e d c b a"]
    sets = [set(s.split()) for s in lines]
    expected = [(i, j) for i in range(5) for j in range(i + 1, 5) if len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) > 0.8]
    assert sorted((r.i, r.j) for r in pk.overlap_pairs(frame(spark, lines)).collect()) == expected


def test_batches_of_sentences(spark, monkeypatch):
    """Scores and the cap do not depend on the batches in which sentences are scored."""
    monkeypatch.setattr(ti, "BATCH", 7)
    lines = [f"word{i % 37} other{i % 11} thing{i} {'and more' * (i % 3)}" if i % 9 else "of it" for i in range(60)]
    own = frame(spark, lines).union(frame(spark, lines[:5], None))
    got = {(r.ctx, r.idx): r.score for r in ti.scores(own).collect()}
    assert [got["c", i] for i in range(60)] == pytest.approx(brute_tfidf(lines))
    assert [got[None, i] for i in range(5)] == pytest.approx(brute_tfidf(lines[:5]))
    best = sorted(range(60), key=lambda i: (-round(brute_tfidf(lines)[i], 9), i))[:25]
    kept = ti.cap_sentences(own, 25).collect()
    assert sorted(r.idx for r in kept if r.ctx == "c") == sorted(best) and sum(r.ctx is None for r in kept) == 5


def test_numbers_of_odd_contexts(spark):
    """Rows of one pos are numbered by place and text; a null context or pos is one as any other."""
    rows = [("a", 1, "second\nfourth"), ("a", 1, "another\nfifth one"), (None, 2, "after it"), (None, None, "before"), ("a", 0, "x\nthe first"), (None, 3, "and also"), ("a", None, "zeroth")]
    got = pk.split_sentences(spark.createDataFrame(rows, "ctx string, pos int, text string"), "lines")
    assert sorted((r.ctx or "", r.idx, r.sentence) for r in got.collect()) == [
        ("", 0, "before"), ("", 1, "after it"), ("", 2, "and also"),
        ("a", 0, "zeroth"), ("a", 1, "the first"), ("a", 2, "another"), ("a", 3, "second"), ("a", 4, "fifth one"), ("a", 5, "fourth"),
    ]


def test_no_window_over_sentences(spark):
    """Only counts of sentences are sorted through a context, not the sentences."""
    docs = spark.createDataFrame([("a", 0, "one line\nsecond line")], "ctx string, pos int, text string")
    plan = pk.split_sentences(docs, "lines")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("sentence" in line for line in windows) and "row_number" not in plan
    assert "Window" not in ti.scores(frame(spark, LINES))._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_contexts(spark, monkeypatch):
    """Ranks and picks of few contexts at a time, and of few terms at a time, are those of each alone."""
    monkeypatch.setattr(tr, "ROWS", 2)
    many = [[f"word{(i * k) % 13} other{(i + k) % 7} thing{i}" for i in range(k + 2)] for k in range(5)]
    own = frame(spark, many[0], 0)
    for k in range(1, 5):
        own = own.union(frame(spark, many[k], k))
    got = {(r.ctx, r.idx): r.score for r in tr.textrank(own).collect()}
    for k, lines in enumerate(many):
        assert [got[str(k), i] for i in range(len(lines))] == pytest.approx(brute_rank(lines), abs=1e-9)
    whole = [tr.rank_of([s.split() for s in lines]).tolist() for lines in many]
    monkeypatch.setattr(tr, "COLUMNS", 3)
    assert [tr.rank_of([s.split() for s in lines]).tolist() for lines in many] == whole
    seen = []
    tr.by_rows(lambda v: seen.append(v) or [v], pa.list_(pa.int64()), pa.array(range(5)))
    assert seen == [0, 1, 2, 3, 4]


def test_total_spares_the_join(spark):
    lines = [f"word{i % 7} other{i % 5} thing{i}" for i in range(40)]
    docs = spark.createDataFrame([("c", i, s) for i, s in enumerate(lines)] + [("d", 0, "only one"), (None, 0, "of none")], "ctx string, pos int, text string")
    own = pk.numbered_sentences(docs, "lines")
    assert {(r.ctx, r.total) for r in own.collect()} == {("c", 40), ("d", 1), (None, 1)}
    rows = [sorted(map(tuple, ti.cap_sentences(x, 9).collect()), key=repr) for x in (own, own.drop("total"))]
    assert rows[0] == rows[1] and len(rows[0]) == 11
