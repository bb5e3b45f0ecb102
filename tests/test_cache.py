import pytest
from pyspark.sql import functions as F

from contextkit import FuzzyCache
from contextkit.sources import cache as c
from contextkit.streaming.cache_stream import cached_stream

ROWS = [(1, 5, "a"), (2, 5, "later"), (3, 7, "b"), (4, -(2**63), "top"), (5, 4, "c"), (6, 0b11111111 << 20, "far")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, fingerprint long, data string").cache()


def asked(spark, *prints):
    return spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "key int, fingerprint long")


def answers(df):
    return [r.data for r in df.orderBy("key").collect()]


def near(target, threshold, closest):
    found = [(((target ^ fp) % 2**64).bit_count() if closest else 0, i, d) for i, fp, d in ROWS if ((target ^ fp) % 2**64).bit_count() <= threshold]
    return min(found)[2] if found else None


def test_exact_takes_the_lowest_id(spark, table):
    queries = asked(spark, 5, 6, -(2**63), None)
    assert answers(c.find_exact(queries, table)) == ["a", None, "top", None]
    assert [r.fingerprint for r in c.misses(queries, table).orderBy("key").collect()] == [6, None]


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 4, 8])
@pytest.mark.parametrize("pick", ["first", "closest"])
def test_near(spark, table, threshold, pick):
    prints = [5, 6, 4, 7, 1, -(2**63) + 1, 0, (0b11111111 << 20) | 1, 2**40 - 1]
    assert answers(c.find_near(asked(spark, *prints), table, threshold, pick)) == [near(p, threshold, pick == "closest") for p in prints]


def test_get_prefers_exact(spark, table):
    assert answers(c.get(asked(spark, 7, 4, 6), table, 2, "first")) == ["b", "c", "a"]
    with pytest.raises(ValueError):
        c.find_near(asked(spark, 1), table, 1, "any")


def test_put_numbers_rows_and_skips_nulls(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i}", None if i == 4 else "d") for i in range(50)], "key long, text string, data string")
    got = c.entries(rows.repartition(7), 11).orderBy("id").collect()
    assert [r.id for r in got] == list(range(11, 59))
    assert [r.input_text for r in got] == [f"text {i}" for i in range(50) if i not in (3, 4)]
    assert c.entries(rows.where("key < 0")).count() == 0


def test_cache_object(spark, tmp_path):
    cache = FuzzyCache(f"file://{tmp_path}/cache", threshold=15, spark=spark)
    assert cache.get("nothing yet") is None and cache.get_batch([]) == []
    cache.put("What is the capital of France?", "Paris")
    cache.put_batch([("What is the capital of France?", "again"), ("An altogether different text of its own", "other")])
    assert cache.get("What is the capital of France?") == "Paris"
    assert cache.get("What's the capital of France?") == "Paris"  # ten bits apart
    assert cache.get_batch(["0123456789", "What's the capital of France?", "An altogether different text of its own"]) == [None, "Paris", "other"]
    assert [r.id for r in cache.table().orderBy("id").collect()] == [1, 2, 3]
    assert FuzzyCache(f"file://{tmp_path}/cache", spark=spark).get("What's the capital of France?") is None  # the default is two bits
    assert cache.fingerprint("ab") == 10631611042442844974
    (tmp_path / "plain").write_text("no table")
    with pytest.raises(RuntimeError, match="Failed to open database"):
        FuzzyCache(f"file://{tmp_path}/plain", spark=spark)


def test_stream_adds_what_is_new(spark, tmp_path):
    cache = FuzzyCache(f"file://{tmp_path}/cache", spark=spark)
    cache.put("known text of the cache", "known")
    spark.createDataFrame([(1, "known text of the cache"), (2, "something entirely new")], "key long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("key long, text string").parquet(f"file://{tmp_path}/in")
    query = cached_stream(stream, cache, lambda df: df.withColumn("data", F.lit("made")), lambda df, n: seen.extend(map(tuple, df.collect())), f"file://{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [(1, "known text of the cache", "known"), (2, "something entirely new", "made")]
    assert cache.get("something entirely new") == "made"
