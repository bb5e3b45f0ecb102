"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_row(docs: DataFrame) -> Column:
    """A row of ``docs`` as one struct column "row": beside it, no column of an operator clashes with one of the user's."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; it sets partition counts only, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, each: int, least: int = 8, most: int = 1 << 17) -> int:
    """How many partitions of about ``each`` bytes ``df`` fills.

    Catalyst's estimate for tables; rows that come from elsewhere have none,
    and are measured.
    """
    size = plan_bytes(df)
    if size >= 1 << 60:
        row = F.lit(16 * len(df.columns)).cast("long")
        for name, kind in df.dtypes:
            if kind == "string":
                row = row + F.coalesce(F.octet_length(name), F.lit(0))
        size = df.agg(F.sum(row)).first()[0] or 0
    return max(least, min(most, math.ceil(size / each)))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        else:
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
    return f"{base.rstrip('/')}/contextkit-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_of(n: int):
    """The batch from 0 to n-1 of a row of documents; rows without doc_id, or that share one, go by their texts too."""
    return F.pmod(F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text")), F.lit(n)).cast("int")
