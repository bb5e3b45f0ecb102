"""Each stage of the pipeline against a brute-force version of it, over what the stages before it keep."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from contextkit.llm.lexicon import WORD, Scorer, chosen_terms, edits_for, fit_logistic
from tests.llm.test_pipeline import ENCODING, brute_copies, unpacked
from tests.llm.test_search import words
from tests.llm.test_similar import brute_classes, edited
from tests.llm.test_toxicity import distance

RUDE = ["moron", "pathetic", "idiot"]
SPELT = ["moron", "m0ron", "pathetic", "pathetik", "idiot", "idiots", "IDIOT"]


class BruteScorer(Scorer):
    """Finds terms by their edit distance to the word, one after another."""

    def find(self, word):
        near = [(distance(word, t), n) for n, t in enumerate(self.terms) if abs(len(word) - len(t)) <= edits_for(t)]
        near = [(d, n) for d, n in near if d <= edits_for(self.terms[n])]
        return min(near)[::-1] if near else None


def brute_clean(rows, labels, threshold=0.3):
    text_of = {r[0]: r[1] for r in rows if r[0] is not None}
    toxic_of = {}
    for i, t in labels:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2 and i in text_of:
            toxic_of[i] = max(toxic_of.get(i, 0), t)
    n = Counter(t > 0 for t in toxic_of.values())
    seen = [Counter(w for i, t in toxic_of.items() if (t > 0) == side for w in set(WORD.findall((text_of[i] or "").lower()))) for side in (True, False)]
    counts = [(w, k, seen[1][w]) for w, k in seen[0].items() if k >= 5 and k * (n[False] + 1) > seen[1][w] * 2 * (n[True] + 1)]
    scorer = BruteScorer(*chosen_terms(counts, n[True], n[False]))
    assert set(RUDE) & set(scorer.terms)
    known = sorted((scorer.features(text_of[i]).tolist(), float(t > 0)) for i, t in toxic_of.items())
    b = fit_logistic(np.array([x for x, _ in known]), np.array([y for _, y in known]))
    score = lambda t: 1 / (1 + np.exp(-np.clip(b[0] + scorer.features(t) @ b[1:], -30, 30)))
    return [r for r in rows if score(r[1]) < threshold]


def brute_distinct(rows):
    known = list({r[:2]: r for r in rows if r[0] is not None}.values())
    least = brute_classes([r[:2] for r in known])
    return [r for r, i in zip(known, least, strict=True) if r[0] == i] + [r for r in rows if r[0] is None]


def brute_unleaked(rows, items):
    def stays(text):
        w, found, long = words(text), set(), False
        for item, t in items:
            iw = words(t)
            for a in range(max(1, len(iw) - 7) if iw else 0):
                p = iw[a : a + 8]
                if any(w[b : b + len(p)] == p for b in range(len(w) - len(p) + 1)):
                    found.add(item)
                    long |= len(p) == 8
        return not long and len(found) < 2

    return [r for r in rows if stays(r[1])]


def brute_mixed(rows):
    copies = brute_copies(rows)
    return [r for k, r in enumerate(rows) for _ in range(copies[k])]


def brute_packed(rows, length=2048):
    """The pieces of documents, and how full the rows are that best-fit-decreasing makes of them."""
    pieces, room = [], []
    for r in rows:
        if r[1] is not None:
            ids = [*ENCODING.encode_ordinary(r[1]), 50256]
            pieces += [(r[0], a, tuple(ids[a : a + length])) for a in range(0, len(ids), length)]
    for size in sorted((len(ids) for *_, ids in pieces), reverse=True):
        fits = [x for x in room if x >= size]
        if fits:
            room.remove(min(fits))
        room.append(min(fits, default=length) - size)
    return Counter(pieces), Counter(length - x for x in room)


def corpus():
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Blue whale, seven"), (3, "far away lands"), (4, None), (5, "?!"), (6, " ".join(f"q{i}" for i in range(5, 12)))]
    texts, toxic = [], []
    for i in range(160):
        t = text(int(rng.integers(3, 150)))
        if i % 4 == 0:
            w = t.split()
            w.insert(int(rng.integers(len(w))), f'they said "{SPELT[i % 7]}"' if i % 16 == 0 else SPELT[i % 7])
            t = " ".join(w)
        toxic.append(int(i % 4 == 0))
        texts.append(t)
    for n in (30, 120, 300):
        first = text(n)
        texts += [first, *(edited(rng, vocabulary, first, int(n * share)) for share in (0, 0.01, 0.02, 0.03, 0.05, 0.3))]
        texts += [first.upper(), f"{first} {text(n // 2)}"]
    q = items[0][1].split()
    texts += [f"{text(30)} {' '.join(q[a : a + k])} {text(30)}" for a, k in ((0, 7), (0, 8), (5, 7), (9, 8), (12, 8), (13, 7))]
    texts += [f"{text(9)} blue WHALE seven {text(9)}", f"{text(9)} blue whale seven, far away lands", "far away lands " * 5]
    texts += ["", None, " \n\t ", "one", "é ü 😀 " * 40, "long " * 9_000 + text(2_000)]
    rows = [(i, t, ["en", "de", None, "fr"][i % 4], [None, "src1", "src2", "src3", "", "src2"][i % 6], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, texts[2], "en", "src1", 0), (None, None, None, None, None)]
    return rows, [*enumerate(toxic), (3, None), (None, 1), (99_999, 1)], items


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    brute = {"toxicity": lambda r: brute_clean(r, labels), "near_dedup": brute_distinct, "decontamination": lambda r: brute_unleaked(r, items), "mixing": brute_mixed}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = brute[name](rows)
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        assert Counter(map(tuple, d.collect())) == Counter(want), name
        assert 0 < len(want) != len(rows), name  # the stage has something to do
        rows = want
    packed = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    pieces, fills = brute_packed(rows)
    got = Counter((i, at, tuple(ids)) for i, own in unpacked(packed, 2048).items() for at, ids in own)
    assert got == pieces and Counter(r.n_tokens for r in packed) == fills
