import hashlib
import re
import time

from contextkit.llm import op05_pii as op
from tests.llm import cases

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "a@b.c_d@e.f x@y.z.w@q.r -@-.- a@@b.c é@x.y a@b",
    "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1.2.3 256.0.0.1 00.00.00.00",
    "😀 +1 234 567-8901 +1-2 ++49 (0) 30 12345678- 😀a@b.co +12345678901234567 +1 2345678",
    "4111 1111 1111 1111 4111-1111-1111-1111 4 1  4111111111111111 4111 1111 1111 1112",
    "1" * 60_000 + " " + "a" * 60_000 + "@",
    ("x@y.zz 10.0.0.1 " * 300),
]


def test_base_spans(spark):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + [r[:2] for r in cases.rows()]
    found = op.find_pii(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")).collect()
    got = sorted(([r.doc_id, [(op.KINDS[m.kind], m.start, m.end) for m in r.base]] for r in found), key=str)
    assert got == sorted(([i, brute(t)] for i, t in rows), key=str)
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found)


def test_contexts_discover(spark):
    rows = [(i, f"word{i} telephone +1 {200 + i} 555-{1000 + i} number {i}") for i in range(120)]
    rows += [(i, f"word{i} telephone 0{200 + i} 555 {1000 + i} thanks") for i in range(120, 140)]
    rows += [(i, f"{'the ' * 12}0{200 + i} 555 {1000 + i}, the +1 {200 + i} 555-{1000 + i}") for i in range(140, 160)]
    # numbers that telephone made known induce the pattern ring, which discovers one that no seed stands beside
    rows += [(i, f"word{i} ring 0{160 + i} 555 {960 + i}") for i in range(160, 180)]
    rows += [(180, "word ring 0999 555 9999"), (182, "mail jo@site.org or jo (at) site (dot) org")]
    found = {r.doc_id: r for r in op.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[i].spans) == len(found[i].base) == 1 for i in range(120))
    assert all(len(found[i].spans) == 1 and not found[i].base for i in range(120, 140))
    assert all(found[i].spans == found[i].base for i in range(140, 160))  # an ordinary word discovers nothing
    assert all(len(found[i].spans) == 1 and not found[i].base for i in range(160, 181))
    assert len(found[182].base) == 1 and len(found[182].spans) == 2


def test_long_texts(spark):
    """50,000 candidates and 50,000 base spans in texts of about a megabyte; places are exact past the first chunk."""
    loose = " ".join(f"0{200 + i % 700} 555 {10000 + i}x" for i in range(50_000))
    base = " ".join(f"u{i}@site{i % 9}.org" for i in range(50_000))
    df = spark.createDataFrame([(1, loose), (2, base), (3, f"é {base[:20_000]} {loose[:20_000]}")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in op.find_pii(df).collect()}
    assert time.perf_counter() - start < 60
    assert got[1].spans == [] and len(got[2].base) == len(got[2].spans) == 50_000
    assert [(op.KINDS[m.kind], m.start, m.end) for m in got[2].base] == brute(base)
    assert [(op.KINDS[m.kind], m.start, m.end) for m in got[3].base] == brute(f"é {base[:20_000]} {loose[:20_000]}")


def test_query(spark, tmp_path):
    rows = [(1, TEXTS[3]), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.op5_find_pii(spark, str(tmp_path)).collect()}
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(TEXTS[3]))
    assert got[1].spans == text and got[1].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].n_card == len(brute(TEXTS[3]))
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].n_email == 0


def test_no_documents(spark):
    assert op.find_pii(cases.no_documents(spark)).collect() == []
