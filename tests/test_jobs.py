"""Requests, queues and expiry; the stream decides as the batch does."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.streaming import jobs

T0 = datetime(2024, 1, 1)


def requests(spark, *seconds, key="a"):
    return spark.createDataFrame([(key, i, T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)], "key string, event_id long, ts timestamp_ntz")


def plain(times, limit, window):
    """Accepted ones by looking back over all accepted ones."""
    kept, out = [], []
    for t in times:
        ok = sum(1 for k in kept if t - k <= window) < limit
        out.append(ok)
        kept += [t] if ok else []
    return out


@pytest.mark.parametrize(("times", "want"), [((0, 1, 2), [True, True, False]), ((0, 1, 10), [True, True, False]), ((0, 1, 10.5), [True, True, True]), ((0, 0, 0, 10.001, 10.002, 10.003), [True, True, False, True, True, False])])
def test_limiter(spark, times, want):
    got = jobs.limiter(requests(spark, *times), 2, 10.0).orderBy("event_id").collect()
    assert [r.accepted for r in got] == want == plain(times, 2, 10.0)
    assert all(r.retry_after >= 1 for r in got if not r.accepted)


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

    schema = StructType([StructField("key", StringType()), StructField("event_id", LongType()), StructField("ts", TimestampNTZType())])
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 4").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts").orderBy("ts").collect()
    for n in range(3):
        part = rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    done = jobs.limiter_stream(stream, 2, 86400.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    done.awaitTermination(120)
    streamed = {(r.event_id, r.accepted) for r in spark.table("limited").collect()}
    batch = {(r.event_id, r.accepted) for r in jobs.limiter(spark.createDataFrame(rows, schema), 2, 86400.0).collect()}
    assert streamed == batch


def test_silent_keys_leave_the_state(spark, tmp_path):
    """After a window of silence by event time a key's state is gone, and its next request is judged afresh."""
    schema = "key string, event_id long, ts timestamp"
    batches = [[("a", 1, T0), ("b", 2, T0)], [("b", 3, T0 + timedelta(hours=5))], [("b", 4, T0 + timedelta(hours=9))], [("a", 5, T0 + timedelta(hours=9))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = jobs.limiter_stream(stream, 1, 3600.0).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {r.event_id: r.accepted for r in spark.table("silent").collect()} == dict.fromkeys(range(1, 6), True)
    assert min(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["batchId"] >= 2) == 1


def test_queue_and_expiry(spark):
    df = spark.createDataFrame([(1, "a", "queued", T0 + timedelta(seconds=5)), (1, "b", "ocr", T0), (1, "c", "queued", T0 + timedelta(seconds=1)), (2, "d", "queued", T0)], "queue long, job_id string, stage string, enqueued_at timestamp_ntz")
    assert {r.job_id: r.position for r in jobs.queue_positions(df).collect()} == {"a": 1, "b": -1, "c": 0, "d": 0}
    old = df.select("job_id", F.col("enqueued_at").alias("updated_at"))
    assert {r.job_id for r in jobs.expired(old, T0 + timedelta(seconds=63), 60).collect()} == {"b", "c", "d"}


def test_orphans(spark):
    f = spark.createDataFrame([("a",), ("b",)], "job_id string")
    j = spark.createDataFrame([("b",), ("c",)], "job_id string")
    assert {(r.job_id, r.only) for r in jobs.orphans(f, j).collect()} == {("a", "folder"), ("c", "job")}
