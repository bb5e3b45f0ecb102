"""Operator 5, PII: patterns of known kinds, and contexts that these induce to find further identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextkit.llm._common import settle, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats cannot backtrack.  A match begins at the start of a run of
#: its characters or where the one before ended, as the leftmost match does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier if its context says so; parts of an address have 64 characters at most.
LOOSE = {
    "email": r"(?<![\w@])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64}+)*+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){4,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}+\)?[\x20./-]?[0-9]{2,4}[\x20./-][0-9]{3,5}+(?![0-9.])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ROUNDS = 4  # at most; fewer if a round discovers nothing
SUPPORT = 5  # distinct known identifiers that a pattern needs
CONFIDENT = 0.7  # score from which a pattern discovers
CONTEXT = 64  # characters looked at on either side of an identifier, up to the next match of its kind
CHUNK = 256  # matches that are folded at a time

_W, _N = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_WORD = rf"\p{{L}}{_W}+"
_BEFORE = rf"(?<={_N})({_WORD}){_N}{{0,4}}$"
_TWO_BEFORE = rf"(?<={_N})({_WORD}{_N}{{1,4}}{_WORD}){_N}{{0,4}}$"
_AFTER = rf"^{_N}{{0,4}}({_WORD})(?={_N})"
_MATCH = "array<struct<start: int, end: int, hit: string, before: string, after: string>>"


def matches(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches that are valid, in code points, with the text between neighbouring matches.

    The gaps between matches come from a split by the same pattern; running
    sums of the lengths give the places.  A list grows by being copied, so
    matches are folded CHUNK at a time, from 0 each, and the chunks are then
    moved to where the lengths before them end: the work is in proportion to
    the matches, however many a text has.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as {_MATCH})")

    def add(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(m["before"])
        end = at + F.length(m["hit"])
        more = F.array_append(acc["found"], F.struct(at.alias("start"), end.alias("end"), m["hit"].alias("hit"), F.right(m["before"], F.lit(CONTEXT + 1)).alias("before"), F.left(m["after"], F.lit(CONTEXT + 1)).alias("after")))
        return F.struct(end.alias("at"), F.when(valid(m["hit"]), more).otherwise(acc["found"]).alias("found"))

    def chunk(of: Column, number: Column) -> Column:
        part = lambda name, skip: F.slice(of[name], number * CHUNK + 1 + skip, F.lit(CHUNK))
        # the gap after the last match of the text is a chunk's spare one
        zipped = F.filter(F.arrays_zip(part("hits", 0).alias("hit"), part("gaps", 0).alias("before"), part("gaps", 1).alias("after")), lambda m: m["hit"].isNotNull())
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("found")), add)

    def place(acc: Column, c: Column) -> Column:
        return F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    def moved(c: Column, by: Column) -> Column:
        return F.transform(c["found"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after")))

    def whole(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts")), place, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(chunks, starts, moved))

    def of_text(of: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(of["hits"]) / CHUNK).cast("int") - 1, F.lit(0)))
        return _bound(F.transform(numbers, lambda n: chunk(of, n)), whole)

    return _bound(F.struct(hits.alias("hits"), gaps.alias("gaps")), of_text)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {
        "email": F.lit(True),
        "ip": s.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", _digits(s)),
        "phone": n.between(8, 15),
    }[kind]


_SLOT = "struct<kind: int, start: int, end: int, name: string, patterns: array<string>>"


def _name(kind: str, hit: Column) -> Column:
    """What an identifier is known by, in whichever way it is written."""
    if kind in ("card", "phone"):
        return _digits(hit)
    out = F.lower(hit)
    for written, sign in ((r" ?(?:\(at\)|\[at\]) ?", "@"), (r" ?(?:\(dot\)|\[dot\]) ?", ".")) if kind == "email" else ():
        out = F.regexp_replace(out, written, sign)
    return F.regexp_replace(out, " ", "")


def _patterns(kind: str, before: Column, after: Column) -> Column:
    """The lexical patterns of a slot: the word before it, two words before it, and the words on both sides.

    A word that the ends of the context cut is no word.
    """
    before, after = F.lower(F.right(F.concat(F.lit(" "), before), F.lit(CONTEXT + 1))), F.lower(F.left(F.concat(after, F.lit(" ")), F.lit(CONTEXT + 1)))
    word, last = F.regexp_extract(before, _BEFORE, 1), F.regexp_extract(after, _AFTER, 1)
    two = F.regexp_replace(F.regexp_extract(before, _TWO_BEFORE, 1), rf"{_N}+", " ")
    parts = F.array(F.when(word != "", F.concat(F.lit(f"{kind}: "), word)), F.when(two != "", F.concat(F.lit(f"{kind}: "), two)), F.when((word != "") & (last != ""), F.concat(F.lit(f"{kind}: "), word, F.lit(" _ "), last)))
    return F.filter(parts, lambda x: x.isNotNull())


def _spans(text: Column, patterns: dict[str, str], check: bool) -> Column:
    """Slots of all kinds by kind, then start; a kind's pattern runs only on texts with a character that it needs."""
    needs = {"email": text.contains("@") | text.contains("at"), "ip": text.rlike("[.:]"), "card": text.rlike("[0-9]"), "phone": text.rlike("[0-9]")}
    if check:
        needs |= {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]")}
    none = F.expr(f"cast(array() as array<{_SLOT}>)")

    def part(number: int, kind: str) -> Column:
        found = matches(text, patterns[kind], lambda hit: _valid(kind, hit) if check else F.lit(True))
        found = F.transform(found, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _name(kind, m["hit"]).alias("name"), _patterns(kind, m["before"], m["after"]).alias("patterns")))
        return F.when(needs[kind], found).otherwise(none)

    return F.flatten(F.array(*(part(n, k) for n, k in enumerate(KINDS))))


def found_spans(docs: DataFrame) -> DataFrame:
    """Each row of ``docs``: doc_id, a hash of the text, base slots and further candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _spans(text, BASE, True).alias("base"), _spans(text, LOOSE, False).alias("loose"))


def candidates(spans: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, name, patterns) of the further candidates that overlap no base span of their text.

    A text's slots meet in the order of their starts: a candidate is held
    against the furthest end of the base spans that begin before it, and the
    next start of those that do not.
    """
    some = spans.where(F.size("loose") > 0)
    slot = lambda name, base: some.select("doc_id", "text_hash", F.explode(name).alias("m"), F.lit(base).alias("base")).select("doc_id", "text_hash", "m.*", "base")
    rows = slot("base", True).unionByName(slot("loose", False))
    text = Window.partitionBy("doc_id", "text_hash")
    furthest = F.max(F.when(F.col("base"), F.col("end"))).over(text.orderBy("start"))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(text.orderBy(F.desc("start")))
    rows = rows.withColumns({"furthest": furthest, "following": following}).where("NOT base AND coalesce(furthest <= start, true) AND coalesce(following >= end, true)")
    return rows.drop("base", "furthest", "following").dropDuplicates(["doc_id", "text_hash", "kind", "start"])


def known_names(spans: DataFrame, more: DataFrame) -> DataFrame:
    """(kind, name, confidence) of all identifiers that are known in the end: seeds with 1, others with what their best pattern scores.

    Identifiers and patterns form a graph with an edge where a pattern holds an
    identifier.  In each round, a pattern's score is the summed confidence of
    the known identifiers that it holds by the number of all that it holds,
    with one doubtful one added; it needs SUPPORT known ones.  An identifier
    becomes known with the score of its best pattern from CONFIDENT on, and
    lends its confidence to its other patterns in the next round.
    """
    edge = lambda df: df.select("kind", "name", F.explode("patterns").alias("pattern"))
    base = spans.select(F.explode("base").alias("m")).select("m.*")
    edges = settle(edge(base).unionByName(edge(more)).distinct())
    known = settle(base.select("kind", "name", F.lit(1.0).alias("confidence")).distinct())
    for _ in range(ROUNDS):
        held = edges.join(known, ["kind", "name"], "left").groupBy("pattern").agg(F.count("*").alias("all"), F.count("confidence").alias("known"), F.sum("confidence").alias("sum"))
        good = settle(held.where(F.col("known") >= SUPPORT).select("pattern", (F.col("sum") / (F.col("all") + 1)).alias("score")).where(F.col("score") >= CONFIDENT))
        best = edges.join(good, "pattern").groupBy("kind", "name").agg(F.max("score").alias("confidence"))
        new = settle(best.join(known, ["kind", "name"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def find_pii(docs: DataFrame) -> DataFrame:
    """Each row's base spans and all spans, as arrays of (kind, start, end) by kind, then start.

    Beyond the base, a candidate that looks like an identifier is a span if it
    overlaps no base span and is known: in another writing, or by its contexts.
    A null text is an empty one; an empty table has an empty result.  Repeated
    rows are counted each, and have the same spans.  Texts may be of any
    length: the work is in proportion to their matches.
    """
    spans = settle(found_spans(docs))
    more = settle(candidates(spans))
    place = F.struct("kind", "start", "end")
    more = more.join(known_names(spans, more), ["kind", "name"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_list(place).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    out = spans.join(more, spans.doc_id.eqNullSafe(more.id) & (spans.text_hash == more.hash), "left")
    base = F.transform("base", lambda m: F.struct(m["kind"], m["start"], m["end"]))
    return out.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<kind: int, start: int, end: int>>")))).alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def op5_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of personal data of each of ``documents``; see ``find_pii``."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("base", lambda m: m["kind"] == n)).cast("long")
    return found.select("doc_id", *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
