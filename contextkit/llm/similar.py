"""Documents whose sets of word shingles have a Jaccard similarity of a threshold or more.

SimHash links are not enough here: at a similarity of 0.8 two 64-bit prints
differ in about ten bits, far beyond what a trie join can prune.  So candidate
pairs come from two sides, the trie join over SimHash prints and least hashes
in bands, and every pair is then held against the threshold: by sketches, and
where these leave a doubt by the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextkit.llm._common import settle, whole_row
from contextkit.llm.components import components
from contextkit.llm.op10_simhash import links, print_of_hashes, shingle_hashes
from contextkit.llm.windows import U, mix, spread

BANDS, DEEP = 20, 5  # a pair of similarity 0.8 shares none of the bands with a chance of 0.0004
BINS = 512
DOUBT = 0.08  # sketches tell similarity within this, at 4.5 standard deviations
CELL = 8  # members of a band key that are compared with each other at first, on average
BLOCK = 512  # members of a band key on each side of a later comparison, on average
BLOCK_BYTES = 4 << 20  # and of shingles that come with them
_TIMES = np.random.default_rng(5).integers(0, 1 << 31, BANDS * DEEP, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_SKETCHED = "doc_id long, text_hash long, row long, set long, fp long, sketch binary, bands array<long>"


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * DEEP permutations of the hashes ``h``."""
    x = (h ^ (h >> U(32))).astype(np.uint32)
    least = np.full(BANDS * DEEP, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[None, i : i + 1024] * _TIMES
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x9E3779B1)
        np.minimum(least, y.min(1), out=least)
    return least


def band_keys(h: np.ndarray) -> np.ndarray:
    v = least_hashes(h).astype(U).reshape(BANDS, DEEP)
    key = np.arange(1, BANDS + 1, dtype=U)
    for i in range(DEEP):
        key = mix(key, v[:, i])
    return key.view(np.int64)


def sketch(h: np.ndarray) -> bytes:
    """Which of BINS equal ranges of hashes are in use, and a byte of the least hash in each; ``h`` is sorted."""
    at, first = np.unique((h >> U(64 - 9)).astype(np.int64), return_index=True)
    used, byte = np.zeros(BINS, np.uint8), np.zeros(BINS, np.uint8)
    used[at] = 1
    byte[at] = (h[first] & U(255)).astype(np.uint8)
    return np.packbits(used).tobytes() + byte.tobytes()


def opened(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.unpackbits(raw[:, : BINS // 8], axis=1).astype(bool), raw[:, BINS // 8 :]


def compared(ua: np.ndarray, va: np.ndarray, ub: np.ndarray, vb: np.ndarray) -> np.ndarray:
    same, any_ = (ua & ub & (va == vb)).sum(1), np.maximum(1, (ua | ub).sum(1))
    return np.maximum(0, (same / any_ - 1 / 256) / (1 - 1 / 256))


def estimates(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Jaccard similarity of pairs of sets, from their sketches."""
    return compared(*opened(a), *opened(b))


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, row, set, fp, sketch and bands of each row of ``docs`` with a doc_id; ``set`` names its set of shingles."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("set", "fp", "sketch", "bands")}
            for text in b["text"].to_pylist():
                h = shingle_hashes(text, shingle)
                out["fp"].append(print_of_hashes(h))
                h = np.unique(h)
                out["set"].append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                out["sketch"].append(sketch(h))
                out["bands"].append(band_keys(h))
            rest = [pa.array(out["set"], pa.int64()), pa.array(out["fp"], pa.int64()), pa.array(out["sketch"], pa.binary()), pa.array(out["bands"], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], b["row"], *rest], [c.split()[0] for c in _SKETCHED.split(", ")])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(make, _SKETCHED)


def candidates(reps: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of sets that may be similar; and (key, reach, set) of the groups that these do not exhaust.

    Sets that share a band key: small groups as pairs, larger ones in cells of
    about CELL members, each with one leader of all cells besides: the member
    that shares most keys, as an original does among its copies.  And sets
    that the trie join over their SimHash prints links: its edges are a star
    for each class, so each class is a group too, of pairs whose prints differ
    in ``reach`` bits at most.
    """
    keys = reps.select(F.explode("bands").alias("key"), "set")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(keys.join(shared, "key").withColumn("cell", F.expr(f"pmod(xxhash64(set, key), cast(ceil(n / {CELL}) as bigint))")))
    left, right = members.select("key", "cell", F.col("set").alias("a")), members.select("key", "cell", F.col("set").alias("b"))
    pairs = left.join(right, ["key", "cell"]).where("a < b").select("a", "b")
    large = members.where(f"n > {CELL}").select("key", "set", "n")
    weight = large.groupBy("set").agg(F.sum("n").alias("weight"))
    leads = settle(large.join(weight, "set").groupBy("key").agg(F.max(F.struct("weight", "set")).alias("most")).select("key", F.col("most.set").alias("lead")))
    led = large.join(leads, "key").where("set <> lead")
    pairs = pairs.unionByName(led.select(F.least("lead", "set").alias("a"), F.greatest("lead", "set").alias("b")))

    prints = settle(reps.groupBy("fp").agg(F.min("set").alias("first")))
    named = lambda fp, name: prints.select(F.col("fp").alias(fp), F.col("first").alias(name))
    stars = settle(links(prints.select("fp"), budget))
    near = stars.withColumnsRenamed({"a": "fa", "b": "fb"}).join(named("fa", "a"), "fa").join(named("fb", "b"), "fb").select("a", "b")
    near = near.unionByName(reps.join(prints, "fp").select(F.col("first").alias("a"), F.col("set").alias("b")))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    key = F.coalesce("label", "fp").alias("key")
    chained = settle(reps.join(components(stars).withColumnRenamed("node", "fp"), "fp", "left").select(key, F.lit(budget).alias("reach"), "set"))
    chained = chained.join(chained.groupBy("key").count().where("count > 2").select("key"), "key", "left_semi")
    groups = large.select("key", F.lit(64).alias("reach"), "set").unionByName(chained)
    return pairs.unionByName(near).where("a < b").distinct(), groups


def shared(names: list[bytes], x: int, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the set of shingles ``names[x]`` with each of those at ``y``."""
    one, size = np.frombuffer(names[x], np.uint32), np.array([len(names[k]) // 4 for k in y])
    others = np.frombuffer(b"".join(names[k] for k in y), np.uint32)
    same = np.concatenate(([0], np.cumsum(np.isin(others, one))))
    end = np.cumsum(size)
    n = same[end] - same[end - size]
    return n / np.maximum(1, len(one) + size - n)


def across(groups: DataFrame, reps: DataFrame, label: DataFrame, least: float, sure: float | None = None, own: DataFrame | None = None, similarity: float = 0.0) -> DataFrame:
    """Links (a, b, similarity) that join whatever the pairs in ``groups`` (key, reach, set) join whose sets are not in one class yet.

    A pair of ``sure`` (``least``, if not given) or more, as sketches tell it,
    is a link.  One from ``least`` on is decided by the shingles in ``own``
    (set, shingles): of ``similarity`` or more it is a link.  Without ``own``
    each of its sets, unless links have joined them, is returned as a pair
    with itself, and left to a later call.

    A group's members in its largest class are compared with the rest, and the
    rest among themselves, block against block: both sides are dealt to blocks
    of about BLOCK, so no task holds a group.  Two blocks return a link only
    if it joins classes that none before it joined, so no more rows than they
    have members, and as many again for sets left in doubt.
    """
    sure = least if sure is None else sure
    mine = F.coalesce("label", "set").alias("label")
    members = groups.join(label.withColumnRenamed("node", "set"), "set", "left").select("key", "reach", "set", mine)
    if own is None:
        members = members.withColumn("bytes", F.lit(0).cast("long"))
    else:
        members = members.join(own.select("set", F.octet_length("shingles").cast("long").alias("bytes")), "set")
        reps = reps.join(own, "set")
    carried = [c for c in ("fp", "sketch", "shingles") if c in reps.columns]
    members = settle(members)
    sizes = members.groupBy("key", "reach", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("key", "reach").agg(F.max(F.struct("n", "bytes", "label")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > most.n")
    blocks = lambda n, size: F.expr(f"cast(ceil(greatest(({n}) / {BLOCK}, ({size}) / {BLOCK_BYTES})) as bigint)")
    sizes = settle(sizes.select("key", "reach", F.col("most.label").alias("main"), blocks("most.n", "most.bytes").alias("mains"), blocks("n - most.n", "bytes - most.bytes").alias("rests")))
    deal = "CASE WHEN label = main THEN rests + pmod(xxhash64(set, key), mains) ELSE pmod(xxhash64(set, key), rests) END"
    dealt = settle(members.drop("bytes").join(sizes, ["key", "reach"]).withColumn("block", F.expr(deal)))
    others = "sequence(0L, CASE WHEN label = main THEN rests ELSE rests + mains END - 1)"
    dealt = dealt.join(reps.select("set", *carried), "set").withColumn("other", F.explode(F.expr(others)))
    dealt = dealt.select("key", "reach", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "label", *carried)

    def compare(unit: pa.Table) -> pa.Table:
        block, name, of, fp = (unit[c].to_numpy() for c in ("block", "set", "label", "fp"))
        i, j, reach = (unit[c][0].as_py() for c in ("i", "j", "reach"))
        used, value = opened(unit["sketch"].to_pylist())
        shingles = unit["shingles"].to_pylist() if "shingles" in unit.column_names else None
        of, right = of.copy(), np.flatnonzero(block == j)
        links, doubts = [], []

        def join(x: int, y: np.ndarray, near: np.ndarray) -> None:
            labels, first = np.unique(of[y], return_index=True)
            links.append((np.full(len(first), x), y[first], near[first]))
            of[np.isin(of, labels)] = of[x]

        for x in np.flatnonzero(block == i):
            y = right[of[right] != of[x]]
            y = y[y > x] if i == j else y
            y = y[np.bitwise_count((fp[x] ^ fp[y]).view(U)) <= reach]
            near = compared(used[x][None], value[x][None], used[y], value[y])
            join(x, y[near >= sure], near[near >= sure])
            doubt = (near >= least) & (near < sure) & (of[y] != of[x])
            y, near = y[doubt], near[doubt]
            if shingles is None:
                doubts.append((np.full(len(y), x), y, near))
            elif len(y):
                near = shared(shingles, x, y)
                join(x, y[near >= similarity], near[near >= similarity])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        x, y, near = (np.concatenate(c) for c in zip(none, *links, strict=True))
        left, other, _ = (np.concatenate(c) for c in zip(none, *doubts, strict=True))
        apart = of[left] != of[other]
        alone = name[np.union1d(left[apart], other[apart])]
        a, b = np.minimum(name[x], name[y]), np.maximum(name[x], name[y])
        return pa.table({"a": np.concatenate((a, alone)), "b": np.concatenate((b, alone)), "similarity": np.concatenate((near, np.ones(len(alone))))})

    return dealt.groupBy("key", "reach", "i", "j").applyInArrow(compare, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def both_sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of each side, as x and y."""
    side = lambda key, name: sets.select(F.col("set").alias(key), F.col(column).alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, similarity) as sketches tell it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(estimates(b["x"].to_pylist(), b["y"].to_pylist()))], ["a", "b", "similarity"])

    return both_sides(pairs, reps, "sketch").mapInArrow(measure, "a long, b long, similarity double")


def shingles_of(wanted: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(set, shingles) of the sets in ``wanted``: the first four bytes of each shingle's hash, sorted."""
    places = reps.select("set", "doc_id", "text_hash").join(wanted, "set", "left_semi").withColumnRenamed("text_hash", "hash")
    keyed = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    texts = keyed.join(places, (keyed.doc_id == places.doc_id) & (keyed.text_hash == places.hash)).select("set", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["set"], pa.array(names, pa.binary())], ["set", "shingles"])

    return settle(texts.mapInArrow(shingles, "set long, shingles binary").dropDuplicates(["set"]))


def exact(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(a, b, similarity) by the shingle sets, of which four bytes a shingle travel."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                n = len(np.intersect1d(x, y, assume_unique=True))
                found.append(n / max(1, len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return both_sides(pairs.select("a", "b"), shingles_of(wanted, docs, reps, shingle), "shingles").mapInArrow(measure, "a long, b long, similarity double")


def linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, label) of the classes that ``pairs`` (a, b, similarity as sketches tell it) make."""
    sure = pairs.where(F.col("similarity") >= similarity + DOUBT).select("a", "b")
    label = components(sure)
    apart = pairs.where(F.col("similarity") < similarity + DOUBT).select("a", "b")
    for side in ("a", "b"):
        apart = apart.join(label.select(F.col("node").alias(side), F.col("label").alias(f"of_{side}")), side, "left")
    doubtful = settle(apart.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"))
    found = settle(exact(doubtful, docs, reps, shingle).where(F.col("similarity") >= similarity).select("a", "b"))
    return components(sure.unionByName(found))


def exhausted(groups: DataFrame, label: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, label) of the classes that all similar pairs in ``groups`` (key, reach, set) make of those in ``label``.

    Sets that sketches leave in doubt are compared once more, with their
    shingles beside them: pairs stay within two blocks, only links travel.
    """
    grown = lambda links: components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links.select("a", "b")))
    first = settle(across(groups, reps, label, similarity - DOUBT, similarity + DOUBT))
    if not first.where("a <> b").isEmpty():
        label = grown(first.where("a <> b"))
    doubtful = first.where("a = b").select(F.col("a").alias("set"))
    if not doubtful.isEmpty():
        own = shingles_of(doubtful, docs, reps, shingle)
        found = settle(across(groups.join(doubtful, "set", "left_semi"), reps, label, similarity - DOUBT, similarity + DOUBT, own, similarity))
        if not found.isEmpty():
            label = grown(found)
    return label


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, text_hash and set of each row with a doc_id; set, component_id and label of its class.

    component_id is the smallest doc_id that chains of similar pairs reach.
    Documents with the same set of shingles are in one class, documents
    without words too.
    """
    rows = settle(sketched(docs, shingle))
    least = rows.groupBy("set").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    reps = settle(rows.join(least, ["set", "row"]).select("set", "doc_id", "text_hash", "least", "fp", "sketch", "bands"))
    pairs, groups = candidates(reps, budget)
    pairs = settle(estimated(pairs, reps).where(F.col("similarity") >= similarity - DOUBT))
    label = linked(pairs, docs, reps, shingle, similarity)
    label = exhausted(groups, label, docs, reps, shingle, similarity)
    named = reps.select("set", "least").join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    named = settle(named.select("set", "label", "least"))
    smallest = settle(named.groupBy("label").agg(F.min("least").alias("component_id")))
    return rows.select("doc_id", "text_hash", "set"), named.join(smallest, "label").select("set", "component_id", "label")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each class of ``similar_classes``: that of the smallest doc_id.

    Rows without doc_id all stay.  Null, empty and blank texts are one class.
    Of repeated rows one stays, whichever if they differ in other columns; of
    rows that share a doc_id but not their text, each class keeps its own.
    """
    rows, found = similar_classes(docs, shingle, similarity)
    first = rows.join(found.withColumnRenamed("component_id", "doc_id"), ["set", "doc_id"])
    kept = settle(first.groupBy("label").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("hash"), F.count("*").alias("times")).drop("label"))
    keyed = docs.select(whole_row(docs), "doc_id", "text", F.xxhash64("text").alias("hash"))
    stay = keyed.join(kept, ["doc_id", "hash"])
    repeats = stay.where("times > 1").dropDuplicates(["doc_id", "text"])
    return stay.where("times = 1").unionByName(repeats).select("row.*").unionByName(docs.where("doc_id IS NULL"))
