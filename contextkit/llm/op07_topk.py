"""Operator 7, exact top-k search: blocks of vectors in descending order of their bounds, until they fall below the kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextkit.llm._common import settle, table

BLOCK = 1024  # candidate vectors in a block
QUERY_BLOCK = 1024  # query vectors that go through the blocks together, at most
ORDER_BYTES = 64 << 20  # bounds of a query block for all blocks: more blocks, fewer queries in it
FIRST, MOST = 4, 256  # blocks that a query scores in the first round, and in a later one at most; in between they double
MARKS = 256  # blocks whose bounds are worked out together
SIGNS = 16  # components whose signs put vectors in order, so that neighbours in a block are alike

_BLOCK = "block long, n int, dim int, least long, ids binary, copies binary, vectors binary, top binary, low binary"
_NO_ID, _NO_SCORE = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def quantised(table_: DataFrame, scale: int = 64) -> DataFrame:
    """Distinct (vec_id, v) with their number of copies; v is floor(scale * x) for each component x.

    Vectors that are null, or hold a null or non-finite component, and rows
    without vec_id are left out.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    ok = table_.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(finite)
    return ok.select("vec_id", v.alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows, held to 64 bits; vectors of different length meet in their common part."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if n == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(np.dot(exact(a), exact(b).T), -(2**63), 2**63 - 1).astype(np.int64)


def _small(m: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all; eight bytes are floating point."""
    most = np.abs(m).max(initial=0)
    return m.astype(next((k for k in (np.int8, np.int16, np.int32) if most <= np.iinfo(k).max), np.float64)).tobytes()


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32}.get(len(data) // max(1, n * dim), np.float64)
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _pack(rows: list[dict]) -> dict:
    dim = max(len(r["v"]) for r in rows)
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r["v"])] = r["v"]
    pack = lambda key: np.array([r[key] for r in rows], np.int64).tobytes()
    least = min(r["vec_id"] for r in rows)
    return {"block": 0, "n": len(rows), "dim": dim, "least": least, "ids": pack("vec_id"), "copies": pack("copies"), "vectors": _small(m), "top": m.max(0).tobytes(), "low": m.min(0).tobytes()}


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packed blocks of at most ``size`` neighbours in the order of the signs of their first components, then vec_id."""
    n = max(1, -(-rows.count() // size))
    kinds = {"block": pa.int64(), "n": pa.int32(), "dim": pa.int32(), "least": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in _BLOCK.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            rows += b.to_pylist()
            while len(rows) >= size:
                yield pa.RecordBatch.from_pylist([_pack(rows[:size])], schema)
                rows = rows[size:]
        if rows:
            yield pa.RecordBatch.from_pylist([_pack(rows)], schema)

    signs = F.aggregate(F.transform(F.slice("v", 1, SIGNS), lambda x: (x >= 0).cast("int")), F.lit(0), lambda code, x: code * 2 + x)
    ordered = rows.withColumn("signs", signs).repartitionByRange(n, "signs", "vec_id").sortWithinPartitions("signs", "vec_id")
    return ordered.select("vec_id", "v", "copies").mapInArrow(pack, _BLOCK).withColumn("block", F.monotonically_increasing_id())


def _score(q: dict, b: dict, rows: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a block, with ``least`` points each, for the query rows: row, vec_id, score; a row is no candidate of its own."""
    qm, bm = _matrix(q["vectors"], q["n"], q["dim"]), _matrix(b["vectors"], b["n"], b["dim"])
    qid, bid, copies = _ids(q["ids"]), _ids(b["ids"]), _ids(b["copies"])
    dots = _dot(qm[rows], bm)
    times = np.broadcast_to(np.minimum(copies, k + 1), dots.shape).copy()
    width = max(qm.shape[1], bm.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    qw, bw = wide(qm[rows]), wide(bm)
    for i, j in zip(*np.nonzero(qid[rows][:, None] == bid[None, :]), strict=True):
        times[i, j] -= (qw[i] == bw[j]).all()
    some = (times > 0) & (dots >= least[:, None])
    if dots.shape[1] > k:  # what the kth of the block outdoes is not sorted
        some &= dots >= np.partition(np.where(some, dots, _NO_SCORE), -k, axis=1)[:, [-k]]
    row, col = np.nonzero(some)
    order = np.lexsort((bid[col], -dots[row, col], row))
    row, col = row[order], col[order]
    row, col = (np.repeat(x, times[row, col]) for x in (row, col))
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[rank < k], col[rank < k]
    return rows[row], bid[col], dots[row, col]


def _best(row: np.ndarray, vec_id: np.ndarray, score: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores, n by k, of the best candidates of each row: highest score, then smallest id."""
    order = np.lexsort((vec_id, -score, row))
    row, vec_id, score = row[order], vec_id[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    ids, scores = np.full((n, k), _NO_ID), np.full((n, k), _NO_SCORE)
    keep = rank < k
    ids[row[keep], rank[keep]], scores[row[keep], rank[keep]] = vec_id[keep], score[keep]
    return ids, scores


def _bounds(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q_block, block, least, bounds): the most that each query of a block can score in a block of candidates.

    That is the sum of the term maxima: of each component, the product with
    the largest or the smallest value in the block, whichever is more.  The
    extremes of MARKS blocks travel in one row.
    """

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            rows += b.to_pylist()
            while len(rows) >= MARKS:
                yield pa.RecordBatch.from_pylist([{"marks": rows[:MARKS]}], schema)
                rows = rows[MARKS:]
        if rows:
            yield pa.RecordBatch.from_pylist([{"marks": rows}], schema)

    mark = pa.struct([("block", pa.int64()), ("dim", pa.int32()), ("least", pa.int64()), ("top", pa.binary()), ("low", pa.binary())])
    schema = pa.schema([("marks", pa.list_(mark))])
    marks = settle(blocks.select("block", "dim", "least", "top", "low").mapInArrow(lay, "marks array<struct<block: long, dim: int, least: long, top: binary, low: binary>>"))
    parts = max(1, min(64, marks.count()))
    marks = marks.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    grid = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(marks, "part")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = _matrix(r["vectors"], r["n"], r["dim"])
                out: dict[str, list] = {"q_block": [], "block": [], "least": [], "bounds": []}
                for m in r["marks"]:
                    n = min(r["dim"], m["dim"])
                    top, low = np.frombuffer(m["top"])[:n], np.frombuffer(m["low"])[:n]
                    x = np.maximum(q[:, :n], 0) @ top + np.minimum(q[:, :n], 0) @ low
                    if np.abs(q).max(initial=0) * max(np.abs(top).max(initial=0), np.abs(low).max(initial=0)) * n >= 2.0**53:
                        x = np.full(len(q), np.inf)  # sums that doubles do not hold exactly say nothing
                    for c, v in zip(out, (r["q_block"], m["block"], m["least"], x.tobytes()), strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("q_block", pa.int64()), ("block", pa.int64()), ("least", pa.int64()), ("bounds", pa.binary())]))

    return grid.select("q_block", "n", "dim", "vectors", "marks").mapInArrow(bound, "q_block long, block long, least long, bounds binary")


_ORDER = "q_block long, round int, block long, least long, rows binary, bounds binary"


def _ordered(bounds: DataFrame) -> DataFrame:
    """For each query block, round and block of candidates: the queries in whose order the block comes in that round, with their bounds.

    A query takes blocks by descending bound, then by their least vec_id.  All
    bounds of a query block take ORDER_BYTES at most.
    """

    def order(key, t):
        block, least = t["block"].to_numpy(), t["least"].to_numpy()
        x = np.stack([np.frombuffer(b) for b in t["bounds"].to_pylist()])
        by = np.lexsort((np.broadcast_to(block[:, None], x.shape), np.broadcast_to(least[:, None], x.shape), -x), axis=0)
        edges, size = [FIRST], FIRST
        while edges[-1] < len(block):
            size = min(2 * size, MOST)
            edges.append(edges[-1] + size)
        round_of = np.empty(x.shape, np.int32)
        np.put_along_axis(round_of, by, np.searchsorted(edges, np.arange(len(block)), "right").astype(np.int32)[:, None], 0)
        out: dict[str, list] = {c.split()[0]: [] for c in _ORDER.split(", ")}
        for i in range(len(block)):
            for r in np.unique(round_of[i]).tolist():
                rows = np.flatnonzero(round_of[i] == r)
                for c, v in zip(out, (key[0].as_py(), r, block[i], least[i], rows.astype(np.int32).tobytes(), x[i, rows].tobytes()), strict=True):
                    out[c].append(v)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    return bounds.groupBy("q_block").applyInArrow(order, _ORDER)


_STATE = "q_block long, ids binary, scores binary"


def search(vectors: DataFrame, queries: DataFrame, k: int, seen: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed query blocks, and (q_block, ids, scores) of their k best candidates, in rounds; see ``top_k``.

    ``seen`` takes how many pairs of a query and a block there are, and how
    many of them were scored.
    """
    blocks = settle(_blocks(vectors, BLOCK))
    size = max(1, min(QUERY_BLOCK, ORDER_BYTES // (8 * max(1, blocks.count()))))
    asked = settle(_blocks(queries, size).withColumnRenamed("block", "q_block").select("q_block", "n", "dim", "ids", "copies", "vectors"))
    order = settle(_ordered(_bounds(asked, blocks)))
    candidates = blocks.select("block", *(F.col(c).alias("b_" + c) for c in ("n", "dim", "ids", "copies", "vectors")))
    kinds = [pa.int64(), pa.binary(), pa.binary()]

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"q_block": [], "block": [], "rows": [], "kth": []}
            for r in b.to_pylist():
                rows, bound = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["bounds"])
                kth = np.full(len(rows), _NO_SCORE)
                if r["scores"] is not None:
                    kth, last = _ids(r["scores"]).reshape(-1, k)[rows, -1], _ids(r["ids"]).reshape(-1, k)[rows, -1]
                    due = (bound > kth) | ((bound == kth) & (r["least"] < last))
                    rows, kth = rows[due], kth[due]
                if len(rows):
                    for c, v in zip(out, (r["q_block"], r["block"], rows.tobytes(), kth.tobytes()), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("q_block", pa.int64()), ("block", pa.int64()), ("rows", pa.binary()), ("kth", pa.binary())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.frombuffer(r["rows"], np.int32).astype(np.int64)
                row, ids, scores = _score(r, {c[2:]: v for c, v in r.items() if c.startswith("b_")}, rows, _ids(r["kth"]), k)
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), *(pa.array([x.tobytes()], pa.binary()) for x in (row, ids, scores))], ["q_block", "rows", "ids", "scores"])

    def merge(key, t):
        """All that a query block has found; the number of its queries is in a row without rows."""
        own, row, ids, scores = 0, [], [], []
        for r in t.to_pylist():
            own = max(own, r["n"] or 0)
            found = _ids(r["ids"]) if r["ids"] else np.zeros(0, np.int64)
            ids.append(found)
            scores.append(_ids(r["scores"]) if r["scores"] else found)
            row.append(_ids(r["rows"]) if r["rows"] is not None else np.repeat(np.arange(len(found) // k), k))
        row, ids, scores = (np.concatenate(x) for x in (row, ids, scores))
        some = ids != _NO_ID
        ids, scores = _best(row[some], ids[some], scores[some], own, k)
        return pa.table([pa.array([x], kind) for x, kind in zip((key[0].as_py(), ids.tobytes(), scores.tobytes()), kinds, strict=True)], ["q_block", "ids", "scores"])

    none = F.lit(None).cast("binary")
    state = settle(asked.select("q_block", none.alias("ids"), none.alias("scores")))
    round_ = 0
    while True:
        due = order.where(F.col("round") == round_).join(state, "q_block").mapInArrow(needed, "q_block long, block long, rows binary, kth binary")
        due = settle(due)
        scored = due.agg(F.sum(F.octet_length("rows") / 4)).first()[0]
        if not scored:
            break
        if seen is not None:
            seen["scored"] = seen.get("scored", 0) + int(scored)
        found = due.join(asked, "q_block").join(candidates, "block").mapInArrow(score, "q_block long, rows binary, ids binary, scores binary")
        before = state.join(asked.select("q_block", "n"), "q_block").select("q_block", "n", none.alias("rows"), "ids", "scores")
        new = found.select("q_block", F.lit(None).cast("int").alias("n"), "rows", "ids", "scores")
        state = settle(before.unionByName(new).groupBy("q_block").applyInArrow(merge, _STATE))
        round_ += 1
    if seen is not None:
        seen["pairs"] = int(order.agg(F.sum(F.octet_length("rows") / 4)).first()[0] or 0)
    return asked, state


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates with the highest inner product.

    ``vectors`` and ``queries`` are as ``quantised`` gives them.  Ties go to
    the smaller vec_id.  A query row is no candidate of its own; a further
    copy of it is.  Copies of a query row each have a result.  Vectors of
    different length meet in their common part.  Without candidates or
    queries there are no rows.

    Candidates are packed in blocks, each with the largest and the smallest
    value of each component.  A query takes the blocks in the order of its
    bounds for them, a few in the first round and twice as many in each later
    one, and scores their vectors.  It stops at the first block whose bound is
    below its kth score, or equals that score while all ids in the block are
    larger than the kth candidate's; no later block can do better.
    """
    asked, state = search(vectors, queries, k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["found"] is None:
                    continue
                ids, scores = (_ids(r[c]).reshape(-1, k) for c in ("found", "scores"))
                row, rank = np.nonzero(ids != _NO_ID)
                row, rank = (np.repeat(x, _ids(r["copies"])[row]) for x in (row, rank))
                out = _ids(r["ids"])[row], (rank + 1).astype(np.int32), ids[row, rank], scores[row, rank]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "rank", "vec_id", "score"])

    both = asked.select("q_block", "ids", "copies").join(state.select("q_block", F.col("ids").alias("found"), "scores"), "q_block")
    return both.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for those whose vec_id is divisible by 20; vectors that are not finite take no part."""
    vectors = settle(quantised(table(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)
