"""An extension: a stream of texts that looks each batch up in a cache and adds what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contextkit.sources.cache import FuzzyCache


def cached_stream(texts: DataFrame, cache: FuzzyCache, compute: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query over the stream ``texts`` (key, text).

    ``compute`` gives (key, text, data) for texts that the cache does not
    have; these are put.  ``sink`` gets (key, text, data) of the whole batch
    and its number.  One query at a time may write to a cache.
    """

    def step(batch: DataFrame, number: int) -> None:
        found = cache.get_batch_df(batch).persist()
        try:
            new = compute(found.where("data IS NULL").select("key", "text")).persist()
            sink(found.where(F.col("data").isNotNull()).select("key", "text", "data").unionByName(new.select("key", "text", "data")), number)
            cache.put_df(new)
            new.unpersist()
        finally:
            found.unpersist()

    return texts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
