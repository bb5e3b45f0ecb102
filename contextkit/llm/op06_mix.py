"""Operator 6, mixing sources to target weights: budgets down a domain-language-source tree, prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextkit.llm._common import settle, table, whole_row

LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
LEAF = ("domain", "language", "source_name")
SMALL = 100_000  # a plan of at most so many leaves is broadcast; a larger one is joined by shuffle
BUCKET = 4096  # documents of a bucket in a leaf's order, on average


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in weights.items():
        out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return out.cast("long")


def tree(docs: DataFrame) -> DataFrame:
    """Of each row of ``docs``: the row, doc_id, its leaf and its size in tokens, estimated at four UTF-8 bytes each.

    A source's domain is one of four, by its name.  Null languages and sources
    count as empty names, a null text as no tokens.
    """
    size = F.expr("coalesce((octet_length(text) + 3) div 4, 0L)").alias("size")
    named = docs.select(whole_row(docs), "doc_id", F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("source_name"), size)
    domain = F.concat(F.lit("d"), F.conv(F.substring(F.md5("source_name"), 1, 1), 16, 10).cast("int") % 4)
    return named.withColumn("domain", domain)


def budgets(leaves: DataFrame, budget: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves (domain, language, source_name, size, docs) with their budget in tokens.

    At each node, children share its budget by weight.  A child that cannot
    use its share, being worth at most ``epochs`` times its tokens, leaves the
    rest to its siblings by their weights, over and over; only what a whole
    family cannot use goes to the families beside it.  In order of capacity
    for weight, a child is full if its capacity is within its share of what
    the children before it have left.
    """
    nodes = leaves.withColumn("room", F.col("size") * epochs)
    keys: list[str] = []
    for level in LEAF:
        own = nodes.groupBy(*keys, level).agg(F.sum("room").alias("room")).withColumn("weight", _weight(level, weights.get(level, {})))
        family = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        own = own.join(got, keys) if keys else own.withColumn("given", F.least(F.sum("room").over(family), F.lit(budget)))
        order = family.orderBy(F.col("room").cast("double") / F.col("weight"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        own = own.withColumns({"used": F.coalesce(F.sum("room").over(before), F.lit(0)), "left": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
        own = own.withColumn("full", wide("room") * wide("left") <= (wide("given") - wide("used")) * wide("weight"))
        own = own.withColumns({"taken": F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(family), F.lit(0)), "sharing": F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)})
        share = F.when(F.col("full"), F.col("room")).otherwise(F.expr("cast(((given - taken) * cast(weight as decimal(19,0))) div sharing as bigint)"))
        keys.append(level)
        got = own.select(*keys, share.alias("given"))
    return nodes.join(got, keys).select(*keys, "size", "docs", F.col("given").alias("budget"))


def _order(seed: int, epoch: Column) -> Column:
    """60 bits that put a leaf's documents in the order of an epoch."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def taken(docs: DataFrame, budget: int | None = None, epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, seed: int = 17) -> DataFrame:
    """Of each row of ``docs``: the row, its leaf, size and copies: how often it is taken, 0 if it is left out.

    ``budget`` is in tokens, by default as many as ``docs`` has.  A leaf takes
    all its documents in each whole epoch that its budget holds, then in the
    next epoch's seeded order the longest prefix within the rest.  Rows that
    agree in doc_id and size are taken together or not at all.  Where the
    prefix ends is found by sums over buckets of the order, then in one bucket
    of each leaf; no leaf is sorted as a whole.
    """
    sized = tree(docs)
    leaves = settle(sized.groupBy(*LEAF).agg(F.sum("size").alias("size"), F.count("*").alias("docs")))
    if budget is None:
        budget = leaves.agg(F.sum("size")).first()[0] or 0
    plan = budgets(leaves, budget, epochs, {"language": LANGUAGE_WEIGHTS} if weights is None else weights)
    whole = F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(F.lit(1).cast("long"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(BUCKET)))).cast("int")
    plan = settle(plan.select(*LEAF, whole.alias("whole"), F.when(F.col("size") > 0, F.col("budget") - whole * F.col("size")).otherwise(F.lit(0)).cast("long").alias("rest"), bits.alias("bits")))
    few = plan.count() <= SMALL
    near = lambda df: F.broadcast(df) if few else df

    keyed = sized.select(*LEAF, "size", "doc_id").join(near(plan), [*LEAF]).withColumn("u", _order(seed, F.col("whole")))
    keyed = keyed.withColumn("bucket", F.call_function("shiftright", F.col("u"), F.lit(60) - F.col("bits")))
    sums = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("size").alias("sum"))
    run = Window.partitionBy(*LEAF).orderBy("bucket")
    through = F.sum("sum").over(run)
    last = sums.withColumn("through", through).where("through > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("through") - F.col("sum")).alias("before"))).alias("x"))
    last = settle(last.select(*LEAF, F.col("x.bucket").alias("last"), F.col("x.before").alias("before")))
    ties = F.struct("u", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size")
    edge = keyed.join(near(last), [*LEAF]).where("bucket = last").groupBy(*LEAF, "rest", "before", ties.alias("place")).agg(F.sum("size").alias("sum"))
    edge = edge.withColumn("through", F.col("before") + F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("place"))).where("through <= rest")
    cut = settle(last.join(edge.groupBy(*LEAF).agg(F.max("place").alias("place")), [*LEAF], "left").select(*LEAF, "last", "place"))

    out = sized.join(near(plan), [*LEAF]).join(near(cut), [*LEAF], "left").withColumn("u", _order(seed, F.col("whole")))
    bucket = F.call_function("shiftright", F.col("u"), F.lit(60) - F.col("bits"))
    inside = F.col("last").isNull() | (bucket < F.col("last")) | F.coalesce((bucket == F.col("last")) & (ties <= F.col("place")), F.lit(False))
    copies = F.col("whole") + F.when(inside & (F.col("whole") < epochs), 1).otherwise(0)
    return out.select("row", *LEAF, "size", copies.alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the leaf, size and copies of ``taken``; these take the place of columns of the same names."""
    added = (*LEAF, "size", "copies")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    return taken(docs, **options).select(*own, *added)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are taken, each as often as it is, with the columns of ``docs``."""
    some = taken(docs, **options).where("copies > 0")
    return some.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of ``documents`` is taken; null language, source and text count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_sources(docs).select("doc_id", "domain", "lang", "source", F.col("size").alias("n_tokens"), "copies")
