"""Removal of token windows that an earlier document has already: operators 1 and 9.

Documents are dealt into batches once.  Three exchanges then settle every
window, and each carries packed arrays instead of a row for each window:

1. *anchors*: each batch sends the distinct anchors of its windows; the reply
   says which anchors occur in another batch.
2. *contexts*: for runs with a shared anchor, (anchor, context, least doc_id);
   the reply says whether an earlier document has the same run, and whether
   the anchor occurs in more than one context.
3. *windows*: single windows, only for runs that are first of their context
   while their anchor has several contexts.

A batch names an anchor, context or window once however many of its documents
hold it, so a passage that a third of all documents share costs one entry a
batch, and no task ever gathers the documents of a group.  Replies are bit
arrays in the order of the request.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contextkit.llm._common import batch_of, parts_for
from contextkit.llm.windows import Bytes, U, Words, covered, mix, runs, spread

REQUEST = "bucket int, batch int, size int, one binary, two binary, doc binary"
REPLY = "batch int, round int, bucket int, size int, first binary, second binary"
CHUNK = {Words: 30_000, Bytes: 200_000}  # tokens; a chunk's arrays stay in the processor's cache
BATCH_BYTES = 4_000_000


def _arrow(schema: str, rows: dict[str, list]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(rows[n], kinds[k]) for n, k in fields})


def _chunks(unit: Words | Bytes, t: pa.Table) -> Iterator[tuple[np.ndarray, list]]:
    """Row numbers and tokens of some of a batch's documents at a time; rows without doc_id stay apart."""
    rows, docs, n = [], [], 0
    for i in np.flatnonzero(t["doc_id"].is_valid().to_numpy()).tolist():
        d = unit.tokens(t["text"][i].as_py())
        rows.append(i)
        docs.append(d)
        n += len(d)
        if n >= CHUNK[type(unit)]:
            yield np.array(rows), docs
            rows, docs, n = [], [], 0
    if rows:
        yield np.array(rows), docs


def _ids(t: pa.Table) -> np.ndarray:
    return t["doc_id"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(key: np.ndarray, buckets: int) -> np.ndarray:
    """Edges of the buckets in a sorted array of 64-bit names."""
    edge = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(key, np.array(edge, U)), [len(key)]))


def _requests(batch: int, buckets: int, one, two=None, doc=None) -> pa.Table:
    """One row for each bucket that has names; ``one`` is sorted."""
    at = _cut(one, buckets)
    rows: dict[str, list] = {n: [] for n in ("bucket", "batch", "size", "one", "two", "doc")}
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        for name, v in zip(rows, (b, batch, at[b + 1] - at[b], one[s].tobytes() if two is not None else one[s].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(), None if two is None else two[s].tobytes(), None if doc is None else doc[s].tobytes()), strict=True):
            rows[name].append(v)
    return _arrow(REQUEST, rows)


def _six(b: bytes) -> np.ndarray:
    """Names of which the upper 48 bits were sent."""
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def _answers(t: pa.Table, round_: int, first: np.ndarray, second: np.ndarray | None) -> pa.Table:
    size = t["size"].to_numpy()
    at = np.concatenate(([0], np.cumsum(size)))
    bits = lambda x: [np.packbits(x[a:b]).tobytes() for a, b in zip(at, at[1:])]
    return _arrow(REPLY, {"batch": t["batch"].to_pylist(), "round": [round_] * len(size), "bucket": t["bucket"].to_pylist(), "size": list(size), "first": bits(first), "second": [None] * len(size) if second is None else bits(second)})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order, and in that order the group number of each entry."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Least value of each group; groups are numbered from 0 in order."""
    return np.minimum.reduceat(value, np.flatnonzero(np.diff(group, prepend=-1)))


def _join(t: pa.Table, name: str, dtype=None) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), dtype)


def _serve_anchors(t: pa.Table) -> pa.Table:
    key = np.concatenate([_six(b) for b in t["one"].to_pylist()])
    order, group = _groups(key)
    shared = np.zeros(len(key), bool)
    shared[order] = np.bincount(group)[group] > 1
    return _answers(t, 1, shared, None)


def _serve_contexts(t: pa.Table) -> pa.Table:
    one, two, doc = _join(t, "one", U), _join(t, "two", U), _join(t, "doc", np.int64)
    order, group = _groups(one, two)
    earlier, several = np.zeros(len(one), bool), np.zeros(len(one), bool)
    earlier[order] = _least(group, doc[order])[group] < doc[order]
    s = one[order]
    anchor = np.cumsum(np.concatenate(([False], s[1:] != s[:-1])))
    head = np.flatnonzero(np.diff(group, prepend=-1))
    several[order] = np.bincount(anchor[head])[anchor] > 1
    return _answers(t, 2, earlier, several)


def _serve_windows(t: pa.Table) -> pa.Table:
    one, doc = _join(t, "one", U), _join(t, "doc", np.int64)
    order, group = _groups(one)
    earlier = np.zeros(len(one), bool)
    earlier[order] = _least(group, doc[order])[group] < doc[order]
    return _answers(t, 3, earlier, None)


class _Replies:
    """The bits of each round, in the order of the names that the batch has sent."""

    def __init__(self, t: pa.Table):
        self.rows: dict[int, list] = {1: [], 2: [], 3: []}
        for r in t.to_pylist():
            self.rows[r["round"]].append(r)
        for v in self.rows.values():
            v.sort(key=lambda r: r["bucket"])

    def bits(self, round_: int, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r[name], np.uint8), count=r["size"]).astype(bool) for r in self.rows[round_])])


def _within(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``key`` are in the sorted array ``some``."""
    if not len(some):
        return np.zeros(len(key), bool)
    i = np.minimum(np.searchsorted(some, key), len(some) - 1)
    return some[i] == key


class _Batch:
    """A batch's runs, and what the replies so far say of them.

    Runs are made from the text anew in each round.  Names of single windows
    are made again only for chunks that have open runs.
    """

    def __init__(self, unit, t: pa.Table, replies: pa.Table | None = None, rounds: int = 0):
        self.unit, self.t, self.ids = unit, t.combine_chunks(), _ids(t)
        self.chunks = []
        for rows, docs in _chunks(unit, self.t):
            if r := runs(unit, docs):
                r.window = None
            self.chunks.append((rows, r, np.array([len(d) for d in docs], np.int64)))
        got = None if replies is None else _Replies(replies)
        if rounds > 0:
            anchor, many = self.anchors()
            self.shared = anchor[got.bits(1, "first") | many]
        if rounds > 1:
            one, two, doc = self.contexts()
            self.name, order = np.unique(mix(one, two), return_index=True)
            self.doc, self.earlier, self.several = doc[order], got.bits(2, "first")[order], got.bits(2, "second")[order]
        if rounds > 2:
            self.window, doc = self.windows()
            self.window_doc = np.where(got.bits(3, "first"), np.iinfo(np.int64).min, doc)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors of the batch, and which of them two of its documents hold."""
        found = [(r.anchor, self.ids[rows[r.doc]]) for rows, r, _ in self.chunks if r]
        if not found:
            return np.zeros(0, U), np.zeros(0, bool)
        anchor, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        return anchor[head], np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)

    def runs(self):
        """Of each chunk: rows, runs, sizes and the runs with a shared anchor."""
        for rows, r, size in self.chunks:
            yield rows, r, size, np.flatnonzero(_within(r.anchor, self.shared)) if r else np.zeros(0, np.int64)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (anchor, context) with the least doc_id of this batch, by anchor."""
        found = [(r.anchor[s], r.context[s], self.ids[rows[r.doc[s]]]) for rows, r, _, s in self.runs() if len(s)]
        if not found:
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        one, two, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order, group = _groups(one, two)
        head = np.flatnonzero(np.diff(group, prepend=-1))
        return one[order][head], two[order][head], _least(group, doc[order])

    def settled(self, rows, r, s) -> tuple[np.ndarray, np.ndarray]:
        """For the runs ``s``: wholly present in an earlier document; still open."""
        i = np.searchsorted(self.name, mix(r.anchor[s], r.context[s]))
        gone = self.earlier[i] | (self.doc[i] < self.ids[rows[r.doc[s]]])
        return gone, ~gone & self.several[i]

    def open_windows(self, rows, r, s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, name and doc_id of each window of the runs ``s``."""
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        names = self.unit.names([self.unit.tokens(self.t["text"][i].as_py()) for i in rows.tolist()])[1]
        start = spread(r.start[s], r.n[s])
        return start, mix(names[start], np.repeat(r.anchor[s], r.n[s])), np.repeat(self.ids[rows[r.doc[s]]], r.n[s])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows of open runs with the least doc_id of this batch."""
        found = [self.open_windows(rows, r, s[self.settled(rows, r, s)[1]])[1:] for rows, r, _, s in self.runs() if len(s)]
        if not found:
            return np.zeros(0, U), np.zeros(0, np.int64)
        name, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order, group = _groups(name)
        return name[order][np.flatnonzero(np.diff(group, prepend=-1))], _least(group, doc[order])

    def removed(self) -> Iterator[tuple[int, np.ndarray]]:
        """Row and removed tokens of each document."""
        for rows, r, size, s in self.runs():
            mask = np.zeros(size.sum(), bool)
            if len(s):
                gone, still = self.settled(rows, r, s)
                starts = [spread(r.start[s[gone]], r.n[s[gone]])]
                at, name, doc = self.open_windows(rows, r, s[still])
                if len(at):
                    starts.append(at[self.window_doc[np.searchsorted(self.window, name)] < doc])
                mask = covered(np.concatenate(starts), self.unit.width, len(mask))
            yield from zip(rows.tolist(), np.split(mask, np.cumsum(size)[:-1]), strict=True)


def _digest(unit, tokens, gone: np.ndarray | None) -> tuple[int, int, int, bytes]:
    gone = np.zeros(len(tokens), bool) if gone is None else gone
    n = int(gone.sum())
    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    if isinstance(unit, Bytes):
        kept = tokens if not n else np.frombuffer(tokens, np.uint8)[~gone].tobytes()
    else:
        kept = b" ".join(tokens if not n else [w for w, g in zip(tokens, gone.tolist(), strict=True) if not g])
    return len(tokens), n, spans, kept


RESULT = "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, unit: Words | Bytes, keep_text: bool = False) -> DataFrame:
    """For each row of ``docs`` what is left when repeated windows go.

    A token goes if it lies in a window of ``unit.width`` tokens that also
    starts in a document with a smaller doc_id.  Null text has no tokens.  A
    row without doc_id loses nothing and takes nothing from others.  Rows with
    one doc_id are not earlier than each other.  Other columns are not read.
    With ``keep_text``, a column kept_text holds the remaining text.
    """
    docs = docs.select("doc_id", "text")
    n = parts_for(docs, BATCH_BYTES)
    dealt = docs.withColumn("batch", batch_of(n)).repartition(n, "batch")

    out_schema = RESULT + ", kept_text string" * keep_text
    none = {k.split()[0]: [] for k in REQUEST.split(", ")}

    def anchors(key, t):
        return _requests(key[0].as_py(), n, _Batch(unit, t).anchors()[0])

    def contexts(key, t, replies):
        return _requests(key[0].as_py(), n, *_Batch(unit, t, replies, 1).contexts()) if len(t) else _arrow(REQUEST, none)

    def windows(key, t, replies):
        if not len(t):
            return _arrow(REQUEST, none)
        name, doc = _Batch(unit, t, replies, 2).windows()
        return _requests(key[0].as_py(), n, name, np.zeros(0, U), doc)

    def results(key, t, replies):
        names = [c.split()[0] for c in out_schema.split(", ")]
        out: dict[str, list] = {c: [] for c in names}
        if len(t):
            batch = _Batch(unit, t, replies, 3)
            left = ((int(i), None) for i in np.flatnonzero(batch.t["doc_id"].is_null().to_numpy()))
            for row, gone in itertools.chain(batch.removed(), left):
                total, removed, spans, kept = _digest(unit, unit.tokens(batch.t["text"][row].as_py()), gone)
                values = [batch.t["doc_id"][row].as_py(), total, removed, spans, hashlib.sha256(kept).hexdigest(), *[kept.decode(errors="ignore")] * keep_text]
                for c, v in zip(names, values, strict=True):
                    out[c].append(v)
        return _arrow(out_schema, out)

    def both(replies: DataFrame, make, schema: str) -> DataFrame:
        return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(make, schema)

    one = dealt.groupBy("batch").applyInArrow(anchors, REQUEST).groupBy("bucket").applyInArrow(_serve_anchors, REPLY)
    two = both(one, contexts, REQUEST).groupBy("bucket").applyInArrow(_serve_contexts, REPLY)
    known = one.unionByName(two)
    three = both(known, windows, REQUEST).groupBy("bucket").applyInArrow(_serve_windows, REPLY)
    return both(known.unionByName(three), results, out_schema)
