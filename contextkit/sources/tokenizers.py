"""Token counters: byte-pair ranks by name, tokenizer.json files by path, or a function of one's own.

The driver reads the vocabulary and sends it along, so executors need no
file; each Python worker builds a tokenizer once for a batch iterator.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from contextkit.functions.text import in_parts

GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CL100K = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
_CASED = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
O200K = "|".join(
    (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+" + _CASED,
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*" + _CASED,
        r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
    )
)
#: Characters that are encoded at once.
ENCODED = 1 << 17
FOLDER = os.environ.get("CONTEXTKIT_TOKENIZERS", "/opt/tokenizers")


@dataclass(frozen=True)
class Ranks:
    """A vocabulary of ranks: file, splitting pattern and special tokens."""

    path: str
    pattern: str
    special: tuple[tuple[str, int], ...] = ()


_END = (("<|endoftext|>", 50256),)
_CL_SPECIAL = (("<|endoftext|>", 100257), ("<|fim_prefix|>", 100258), ("<|fim_middle|>", 100259), ("<|fim_suffix|>", 100260), ("<|endofprompt|>", 100276))
REGISTRY: dict[str, Ranks] = {
    "byte_bpe_50k": Ranks(f"{FOLDER}/byte_bpe_50k.tiktoken", GPT2, _END),
    "byte_bpe_multi_50k": Ranks(f"{FOLDER}/byte_bpe_multi_50k.tiktoken", GPT2, _END),
    "cl100k_base": Ranks(f"{FOLDER}/cl100k_base.tiktoken", CL100K, _CL_SPECIAL),
    "o200k_base": Ranks(f"{FOLDER}/o200k_base.tiktoken", O200K, (("<|endoftext|>", 199999), ("<|endofprompt|>", 200018))),
    "p50k_base": Ranks(f"{FOLDER}/p50k_base.tiktoken", GPT2, _END),
    "p50k_edit": Ranks(f"{FOLDER}/p50k_base.tiktoken", GPT2, (*_END, ("<|fim_prefix|>", 50281), ("<|fim_middle|>", 50282), ("<|fim_suffix|>", 50283))),
    "r50k_base": Ranks(f"{FOLDER}/r50k_base.tiktoken", GPT2, _END),
    "gpt2": Ranks(f"{FOLDER}/r50k_base.tiktoken", GPT2, _END),
}


def register_tokenizer(name: str, ranks: Ranks) -> None:
    REGISTRY[name] = ranks


def ranks_named(name: str) -> Ranks | None:
    """The ranks registered under ``name``, else those of the OpenAI model of that name, as tiktoken lists them."""
    if name in REGISTRY:
        return REGISTRY[name]
    from tiktoken.model import encoding_name_for_model

    try:
        return REGISTRY.get(encoding_name_for_model(name))
    except KeyError:
        return None


class Tokenizer:
    """Counts tokens of texts, and gives their byte offsets."""

    def __init__(self, kind: str, data: bytes | Callable, ranks: Ranks | None = None):
        self.kind, self.data, self.ranks, self._made = kind, data, ranks, None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def _make(self):
        if self._made is None:
            if self.kind == "ranks":
                import tiktoken

                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
                self._made = tiktoken.Encoding("contextkit", pat_str=self.ranks.pattern, mergeable_ranks=table, special_tokens=dict(self.ranks.special))
            elif self.kind == "file":
                import tokenizers

                self._made = tokenizers.Tokenizer.from_str(self.data.decode())
            else:
                self._made = self.data
        return self._made

    def count(self, texts: list[str]) -> list[int]:
        made = self._make()
        if self.kind == "ranks":
            return [len(made.encode(t, allowed_special="all")) for t in texts]
        if self.kind == "file":  # an encoding takes some hundred bytes a token, so few are held at once
            return [len(e) for some in in_parts(texts, ENCODED) for e in made.encode_batch_fast(some, add_special_tokens=False)]
        return [made(t) for t in texts]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each token in bytes."""
        made = self._make()
        if self.kind == "ranks":
            sizes = [len(made.decode_single_token_bytes(i)) for i in made.encode(text, allowed_special="all")]
            ends = pd.Series(sizes, dtype="int64").cumsum().tolist()
            return [(e - n, e) for e, n in zip(ends, sizes, strict=True)]
        if self.kind == "file":
            at = [0]
            for c in text:
                at.append(at[-1] + len(c.encode()))
            return [(at[a], at[b]) for a, b in made.encode(text, add_special_tokens=False).offsets]
        raise ValueError("A function of one's own has no offsets")


def tokenizer_named(name: str) -> Tokenizer:
    ranks = ranks_named(name)
    if ranks is None:
        raise ValueError(f"Unknown tokenizer name: {name}")
    try:
        with open(ranks.path, "rb") as f:
            return Tokenizer("ranks", f.read(), ranks)
    except OSError as e:
        raise ValueError(f"Unknown tokenizer name: {name} (its vocabulary is not at {ranks.path})") from e


def tokenizer_from_file(path: str) -> Tokenizer:
    try:
        with open(path, "rb") as f:
            made = Tokenizer("file", f.read())
        made._make()
    except Exception as e:
        raise ValueError(f"Failed to load tokenizer from file: {e}") from e
    return made


def count_tokens(text: Column, tokenizer: Tokenizer) -> Column:
    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts[texts.notna()]
            yield pd.Series(tokenizer.count(known.tolist()), index=known.index, dtype="Int32").reindex(texts.index)

    return count(text)


def token_offsets(text: Column, tokenizer: Tokenizer) -> Column:
    @F.pandas_udf("array<struct<start: int, end: int>>")
    def offsets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in tokenizer.offsets(t)])

    return offsets(text)
