"""Documents with every odd case at once, and brute-force versions of the operators."""

import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch string, fp string, score string, size string, copies string, rank string"
_LINE = "the quick brown fox jumps over the lazy dog and then runs far away from here at once"


def rows():
    texts = [
        (1, _LINE),
        (2, _LINE),
        (2, _LINE),  # a repeated row
        (3, f"something else before. {_LINE} and something after it"),
        (4, ""),
        (5, None),
        (6, "   \t\n "),
        (7, "one"),
        (8, "é ü 😀 " * 40),
        (9, "é ü 😀 " * 40),
        (10, "word " * 60_000),  # very long
        (11, "word " * 60_000 + "end"),
        (12, "a" * 200),
        (13, "a" * 120 + "b"),
        (14, _LINE.upper()),
        (15, " ".join(f"w{i}" for i in range(400))),
        (16, " ".join(f"w{i}" if i != 200 else "changed" for i in range(400))),
        (None, _LINE),
        (None, None),
        (-7, f"{_LINE} first of all"),
    ]
    return [(i, t, None if i == 3 else "en", None if i == 4 else f"src{(i or 0) % 3}", None, *"abcdef") for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(docs, tokens, width, joined):
    """(doc_id, tokens, removed, spans, sha256) of each row, by looking at every window."""
    least = {}
    for i, text in docs:
        if i is not None:
            t = tokens(text)
            for a in range(len(t) - width + 1):
                key = bytes(t[a : a + width]) if isinstance(t, bytes) else tuple(t[a : a + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, text in docs:
        t = tokens(text)
        gone = [False] * len(t)
        if i is not None:
            for a in range(len(t) - width + 1):
                key = bytes(t[a : a + width]) if isinstance(t, bytes) else tuple(t[a : a + width])
                if least[key] < i:
                    gone[a : a + width] = [True] * width
        kept = joined([x for x, g in zip(t, gone, strict=True) if not g])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words13(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def as_bytes(text):
    return (text or "").encode()
