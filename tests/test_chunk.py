import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from contextkit import MarkdownChunker
from contextkit.functions.markdown import chunk_by_bytes, chunk_by_tokens, top_level_blocks
from contextkit.sources.tokenizers import FOLDER, GPT2, O200K, ranks_named, tokenizer_from_file, tokenizer_named

WORDS = lambda texts: [len(t.split()) for t in texts]


def blocks(md):
    return [md.encode()[a:b].decode() for a, b in top_level_blocks(md)]


@pytest.mark.parametrize(
    "md, expected",
    [
        ("", []),
        ("one\n\ntwo\n", ["one\n", "two\n"]),
        ("# head\ntext\nmore", ["# head\n", "text\nmore"]),
        ("head\n===\ntext", ["head\n===\n", "text"]),
        ("a\n\n---\n\nb", ["a\n", "b"]),
        ("***\n___\n", []),
        ("```py\nx\n\ny\n```\nafter", ["```py\nx\n\ny\n```\n", "after"]),
        ("~~~\nnever closed\n\nx", ["~~~\nnever closed\n\nx"]),
        ("    code\n\n    more\n\ntext", ["    code\n\n    more\n", "text"]),
        ("> quote\nlazy\n\ntext", ["> quote\nlazy\n", "text"]),
        ("- a\n- b\n\n  still b\n\ntext", ["- a\n- b\n\n  still b\n", "text"]),
        ("1. a\n2. b\n\n* other", ["1. a\n2. b\n", "* other"]),
        ("<div>\nhtml\n\ntext", ["<div>\nhtml\n", "text"]),
        ("<!-- a\n\nb -->\ntext", ["<!-- a\n\nb -->\n", "text"]),
        ("[x]: /url 'title'\n\ntext", ["text"]),
        ("é\r\n\r\n日本\r\n", ["é\r\n", "日本\r\n"]),
        ("text\n# head", ["text\n", "# head"]),
    ],
)
def test_blocks(md, expected):
    assert [b.rstrip() for b in blocks(md)] == [e.rstrip() for e in expected]


@given(st.lists(st.sampled_from(["# h", "para é", "- item", "> q", "```", "---", "", "    code", "<div>", "😀"]), max_size=14), st.integers(0, 30))
@settings(max_examples=150, deadline=None)
def test_bytes_lose_nothing_and_tokens_cut_from_the_text(lines, limit):
    md = "\n".join(lines)
    assert "".join(chunk_by_bytes(md, limit)) == md
    assert all(t in md for t in chunk_by_tokens(md, limit, WORDS))


def test_bytes():
    assert chunk_by_bytes("", 5) == []
    assert chunk_by_bytes("---\n\n***\n", 2) == ["---\n\n***\n"]
    md = "aa\n\nbb\n\ncccccccccccccccc\n\nd"
    got = chunk_by_bytes(md, 8)
    assert "".join(got) == md and got[0] == "aa\n\nbb\n"


def test_tokens_keep_their_gaps():
    assert chunk_by_tokens("a b\n\nc d\n\ne f", 4, WORDS) == ["a b\n\nc d\n", "e f"]
    long = "w " * 9 + "w"
    assert chunk_by_tokens(f"a\n\n{long}\n\nb\n\nc", 3, WORDS) == ["a\n", f"{long}\n", "\nb\n\nc"]  # the gap after a long block leads the next chunk
    assert chunk_by_tokens("a\n\nb", 0, WORDS) == ["a\n", "b"]
    assert chunk_by_tokens("---\n\n***", 5, WORDS) == []


def test_chunker_object(spark):
    docs = ["one two\n\nthree four\n\nfive", "", "# x"]
    chunker = MarkdownChunker(max_tokens=4, counter=lambda t: len(t.split()), spark=spark)
    assert chunker.chunk_batch(docs) == [chunker.chunk(d) for d in docs] == [["one two\n\nthree four\n", "five"], [], ["# x"]]
    assert MarkdownChunker("byte_bpe_50k", max_tokens=1, max_characters=100, spark=spark).chunk_batch(docs)[0] == [docs[0]]  # the limit of bytes wins
    frame = spark.createDataFrame([(1, docs[0], "x"), (2, None, "y"), (3, "", "z")], "id long, text string, chunk_id string")
    assert [(r.id, r.chunk_pos) for r in chunker.chunk_df(frame).orderBy("id", "chunk_pos").collect()] == [(1, 0), (1, 1)]


@pytest.mark.parametrize(
    "arguments, message",
    [
        ({}, "Must provide max_tokens or max_characters"),
        ({"tokenizer_name": "byte_bpe_50k"}, "Must provide max_tokens or max_characters"),
        ({"tokenizer_name": "none such", "max_tokens": 5}, "Unknown tokenizer name: none such"),
        ({"tokenizer_name": "gpt-4", "max_tokens": 5}, "Unknown tokenizer name: gpt-4"),
        ({"tokenizer_path": "/none/such.json", "max_tokens": 5}, "Failed to load tokenizer from file"),
        ({"max_tokens": 5}, "Must provide tokenizer_name, tokenizer_path, or max_characters"),
    ],
)
def test_chunker_errors(arguments, message):
    with pytest.raises(ValueError, match=message):
        MarkdownChunker(**arguments)


def test_tokenizers_agree_and_offsets_join():
    named, filed = tokenizer_named("byte_bpe_50k"), tokenizer_from_file(f"{FOLDER}/byte_bpe_50k.json")
    texts = ["Hello, world", "naïve café 12", "", "a\n\nb"]
    assert named.count(texts) == filed.count(texts)
    assert named.count(["a<|endoftext|>b"]) == [3]
    for tokenizer in (named, filed):
        at = tokenizer.offsets("Hello, world")
        assert at[0][0] == 0 and at[-1][1] == 12 and all(a[1] == b[0] for a, b in zip(at, at[1:], strict=False))


def test_deep_and_long_texts():
    """Nesting is held on a stack, and no line makes those before it be read again."""
    deep = ">" * 5000 + " a\nlazy\n\nb"
    start = time.perf_counter()
    assert top_level_blocks(deep) == [(0, 5008), (5009, 5010)]
    lazy = "> a\nb\n" * 20_000
    assert top_level_blocks(lazy) == [(0, len(lazy))]
    items = "".join(" " * (2 * i) + "- a\n" for i in range(300)) + "lazy\n"
    assert top_level_blocks(items) == [(0, len(items))]
    definitions = "[a]: b\n" * 20_000
    assert top_level_blocks(definitions) == []
    assert time.perf_counter() - start < 20


def test_lazy_lines():
    for text, blocks in (
        ("> - a\nlazy\n", ["> - a\nlazy\n"]),
        ("> ```\n> a\nno\n", ["> ```\n> a\n", "no\n"]),
        ("> # a\nno\n", ["> # a\n", "no\n"]),
        ("> a\n===\n", ["> a\n===\n"]),
        ("> a\n>\nno\n", ["> a\n>\n", "no\n"]),
        ("- > a\nlazy\n- b\n", ["- > a\nlazy\n- b\n"]),
        ("> <div>\nno\n", ["> <div>\n", "no\n"]),
        ("> a\n> ---\nno\n", ["> a\n> ---\n", "no\n"]),
    ):
        assert [text[a:b] for a, b in top_level_blocks(text)] == blocks, text


@pytest.mark.parametrize(
    "model, encoding, pattern",
    [("gpt-4o", "o200k_base", O200K), ("gpt-4-turbo", "cl100k_base", None), ("text-embedding-3-large", "cl100k_base", None), ("text-davinci-003", "p50k_base", GPT2), ("davinci", "r50k_base", GPT2)],
)
def test_model_names(model, encoding, pattern):
    ranks = ranks_named(model)
    assert ranks == ranks_named(encoding) and ranks.path.endswith(f"{encoding}.tiktoken")
    assert pattern is None or ranks.pattern == pattern


def test_unknown_model_name():
    assert ranks_named("none such") is None


def test_pattern_of_cased_words():
    found = regex.findall(O200K, "HelloWorld don't 12345\n\n x/")
    assert found == ["Hello", "World", " don't", " ", "123", "45", "\n\n", " x", "/"]
