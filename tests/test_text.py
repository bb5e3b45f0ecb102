from pyspark.sql import functions as F

from contextkit.functions import text
from contextkit.functions.text import in_parts
from contextkit.sources import tokenizers
from contextkit.sources.tokenizers import FOLDER, tokenizer_from_file


def test_texts_in_parts():
    assert list(in_parts(["ab", "c", "", "defg", "h"], 3)) == [["ab", "c"], ["", "defg"], ["h"]]
    assert list(in_parts([], 3)) == []


def test_few_encodings_at_once(monkeypatch):
    """Long batches are encoded some texts at a time, with the same counts."""
    made = tokenizer_from_file(f"{FOLDER}/byte_bpe_50k.json")
    texts = ["one two", "", "three " * 40, "é😀", "four"] * 5
    whole = [len(made._make().encode(t, add_special_tokens=False).ids) for t in texts]
    most = []

    class Watched:
        def encode_batch_fast(self, some, **kw):
            most.append(sum(map(len, some[:-1])))
            return tok.encode_batch_fast(some, **kw)

    tok = made._make()
    monkeypatch.setattr(made, "_made", Watched())
    monkeypatch.setattr(tokenizers, "ENCODED", 50)
    assert made.count(texts) == whole
    assert len(most) > 1 and max(most) < 50


def test_sentences_some_rows_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "ROWS", 2)
    rows = [(i, t) for i, t in enumerate(["One. Two! Three é? Four.", None, "", "Ünd. Äh…", "a.b 3.4 c"])]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.s for r in df.select("i", text.sentences(F.col("t")).alias("s")).collect()}
    assert got == {i: None if t is None else text.sentences_of(t) for i, t in rows}
    assert got[0] == ["One. ", "Two! ", "Three é? ", "Four."]
