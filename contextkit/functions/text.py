"""Text functions on columns: trimming, terms, sentence segmentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_BYTES = 5  # sentences and fragments of at most so many bytes are left out
TERM_BYTES = 2  # likewise terms
ROWS = 64  # texts that are Python objects at once


def in_parts(texts: list[str], most: int) -> Iterator[list[str]]:
    """``texts`` in order, some at a time: at least one, and no further one once they have ``most`` characters."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def trim_unicode(s: Column) -> Column:
    """``s`` without white space, of any script, at its ends."""
    return F.regexp_replace(s, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")


def long_enough(s: Column, least: int = MIN_BYTES) -> Column:
    return F.octet_length(s) > least


def terms(s: Column) -> Column:
    """Lower-cased runs of letters and digits of more than two bytes, in order and with repeats."""
    return F.filter(F.split(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: F.octet_length(w) > TERM_BYTES)


def word_set(s: Column) -> Column:
    """Distinct words between white space; case and punctuation count."""
    return F.array_distinct(F.filter(F.split(s, r"[\s\p{Z}\x85]+"), lambda w: w != ""))


def lines(s: Column) -> Column:
    return F.split(s, "\n")


# Sentence_Break classes of UAX #29, one letter for each
_CLASSES = (
    ("CR", "c"), ("LF", "l"), ("Sep", "p"), ("Extend", "x"), ("Format", "x"), ("Sp", "s"), ("Lower", "w"),
    ("Upper", "u"), ("OLetter", "o"), ("Numeric", "n"), ("ATerm", "a"), ("STerm", "t"), ("Close", "e"), ("SContinue", "k"),
)
_BREAK = regex.compile("|".join(rf"(?P<{letter}{i}>\p{{Sentence_Break={name}}})" for i, (name, letter) in enumerate(_CLASSES)))
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")


class _Classes(dict):
    """The class of each code point, looked up once."""

    def __missing__(self, c: int) -> str:
        m = _BREAK.match(chr(c))
        self[c] = m.lastgroup[0] if m else "."
        return self[c]


_CLASS_OF = _Classes()
# Each ends at a boundary.  Extend and Format characters (x) attach to what is before them.
_SENTENCE = regex.compile(
    r"(?:"
    r"(?:[^claptx]x*|x)++"  # no terminator and no separator
    r"|a x* (?= n )"  # SB6: a full stop before a digit
    r"|(?<= [uw] x*) a x* (?= u )"  # SB7: initials
    r"|a x* (?:e x*)* (?:s x*)* (?= [^ouwclpat]* w )"  # SB8: a lower-case word follows
    r"|[at] x* (?:e x*)* (?:s x*)* (?= [kat] )"  # SB8a
    r")*+"
    r"(?: [at] x* (?:e x*)* (?:s x*)* (?: c l | [clp] )? | c l | [clp] | $ )".replace(" ", "")
)


def sentences_of(text: str) -> list[str]:
    """Sentences by the rules of UAX #29 that hold a letter or a digit."""
    classes = text.translate(_CLASS_OF)
    out, at = [], 0
    while at < len(text):
        m = _SENTENCE.match(classes, at)
        end = m.end() if m and m.end() > at else at + 1
        if _ALNUM.search(text, at, end):
            out.append(text[at:end])
        at = end
    return out


def sentences(s: Column) -> Column:
    """``sentences_of`` each text, as an array."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([None if t is None else sentences_of(t) for t in texts.slice(a, ROWS).to_pylist()], kind) for a in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return split(s)


SEGMENTERS = {"uax29": sentences, "lines": lines}
