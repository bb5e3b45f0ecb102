"""A near-duplicate cache: fingerprinted texts with payloads in a Parquet table, looked up by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextkit.functions.simhash import bands, fingerprint, fingerprint_of
from contextkit.operators.hamming import hamming_best

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("fingerprint", T.LongType(), False),
        *(T.StructField(f"band_{b}", T.IntegerType(), False) for b in "abcd"),
        T.StructField("input_text", T.StringType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)


def entries(rows: DataFrame, first_id: int = 1, k: int = 3) -> DataFrame:
    """Cache rows of ``rows`` (key, text, data), numbered from ``first_id`` in the order of key.

    Numbers come from counts of range partitions, not from one sorted task.
    Rows without text or data are left out.
    """
    rows = rows.select("key", "text", "data").where("text IS NOT NULL AND data IS NOT NULL")
    dealt = rows.repartitionByRange("key", "text", "data").withColumn("part", F.spark_partition_id())
    before = dealt.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    number = F.row_number().over(Window.partitionBy("part").orderBy("key", "text", "data"))
    out = dealt.withColumn("n", number).join(F.broadcast(before), "part")  # a row for each partition
    out = out.withColumn("fingerprint", fingerprint(F.col("text"), k))
    named = dict(zip((f"band_{b}" for b in "abcd"), bands(F.col("fingerprint")), strict=True))
    return out.withColumns(named).select((F.col("n") + F.col("before") + F.lit(first_id - 1)).alias("id"), "fingerprint", *named, F.col("text").alias("input_text"), "data", F.current_timestamp().alias("created_at"))


def firsts(cache: DataFrame) -> DataFrame:
    """The first row of each fingerprint: (fingerprint, id, data)."""
    return cache.groupBy("fingerprint").agg(F.min("id").alias("id"), F.min_by("data", "id").alias("data"))


def find_exact(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """``queries`` with the data of the first cache row of their fingerprint, or null."""
    return queries.join(firsts(cache).select("fingerprint", "data"), "fingerprint", "left")


def misses(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """``queries`` whose fingerprint is not in the cache."""
    return queries.join(cache.select("fingerprint").distinct(), "fingerprint", "left_anti")


def find_near(queries: DataFrame, cache: DataFrame, threshold: int, pick: str = "first", recall: str = "exact") -> DataFrame:
    """``queries`` with the data of a cache row within ``threshold`` bits, or null.

    ``pick`` "first" takes the lowest id within the threshold, "closest" the
    least distance, then the lowest id.  Fingerprints are made distinct before
    they meet, and payloads join afterwards for the rows that are picked.
    """
    if pick not in ("first", "closest"):
        raise ValueError(f"Unknown pick: {pick}")
    own = firsts(cache)
    won = hamming_best(queries.select(F.col("fingerprint").alias("l")), own.select(F.col("fingerprint").alias("r"), F.col("id").alias("w")), threshold, pick, recall)
    won = won.join(own.select(F.col("id").alias("w"), "data").dropDuplicates(["w"]), "w").select(F.col("l").alias("fingerprint"), "data")
    return queries.join(won, "fingerprint", "left")


def get(queries: DataFrame, cache: DataFrame, threshold: int, pick: str = "first", recall: str = "exact") -> DataFrame:
    """Exact matches first; only the prints without one look for a near row, each once.

    ``queries`` and ``cache`` are read several times: prints that are worked
    out on the way should be stored before.
    """
    exact = find_exact(queries, cache)
    missed = exact.where("data IS NULL").select("fingerprint").distinct()
    near = find_near(missed, cache, threshold, pick, recall).where("data IS NOT NULL").withColumnRenamed("data", "near")
    return exact.join(near, "fingerprint", "left").withColumn("data", F.coalesce("data", "near")).drop("near")


class FuzzyCache:
    """A cache table at a path; one writer at a time.

    DataFrame methods (``*_df``) are for batches; the others take and return
    Python values.
    """

    def __init__(self, db_path: str, threshold: int = 2, shingle_size: int = 3, spark: SparkSession | None = None):
        if threshold < 0:
            raise ValueError("threshold must not be negative")
        if shingle_size < 1:
            raise ValueError("shingle_size must be at least 1")
        self.path, self.threshold, self.shingle_size = db_path, threshold, shingle_size
        self.spark = spark or SparkSession.builder.getOrCreate()
        try:
            self.table().select("id").head(1)
        except Exception as e:
            raise RuntimeError(f"Failed to open database: {e}") from e

    def table(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def prints(self, texts: DataFrame) -> DataFrame:
        """``texts`` (key, text) with their fingerprint."""
        return texts.withColumn("fingerprint", fingerprint(F.col("text"), self.shingle_size))

    def put_df(self, rows: DataFrame) -> None:
        """Append ``rows`` (key, text, data): all of them or, if the job fails, none."""
        last = self.table().agg(F.max("id")).first()[0] or 0
        entries(rows, last + 1, self.shingle_size).write.mode("append").parquet(self.path)

    def get_df(self, texts: DataFrame) -> DataFrame:
        """``texts`` (key, text) with data: of an exact match, else of the first near row."""
        return get(self.prints(texts), self.table(), self.threshold, "first").drop("fingerprint")

    def get_batch_df(self, texts: DataFrame, recall: str = "exact") -> DataFrame:
        """``texts`` (key, text) with data: of an exact match, else of the closest near row."""
        return get(self.prints(texts), self.table(), self.threshold, "closest", recall).drop("fingerprint")

    def _listed(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "key long, text string")

    def put(self, text: str, data: str) -> None:
        self.put_batch([(text, data)])

    def put_batch(self, items: list[tuple[str, str]]) -> None:
        if items:
            self.put_df(self.spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(items)], "key long, text string, data string"))

    def get(self, text: str) -> str | None:
        return self.get_df(self._listed([text])).first()["data"]

    def get_batch(self, texts: list[str]) -> list[str | None]:
        if not texts:
            return []
        found = {r["key"]: r["data"] for r in self.get_batch_df(self._listed(texts)).collect()}
        return [found[i] for i in range(len(texts))]

    def fingerprint(self, text: str) -> int:
        return fingerprint_of(text, self.shingle_size)
