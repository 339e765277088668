import os
import uuid

from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.streaming.ledger import blind_write_stream, repeat_stream, session_stream, typed_state, usage_stream, watch

ROWS = [(k, 1_700_000_000 + 700 * i * (1 + k) + (5000 if i % 9 == 8 else 0), 100 * k + i, "wcx"[(i * (k + 2)) % 3], ["a", "a", "b"][(i // 2) % 3], 900) for k in range(3) for i in range(20)]
SCHEMA = "key long, s long, seq long, tool string, signature string, chars long"


def _stream(spark, tmp_path, parts=2):
    rows = sorted(ROWS, key=lambda r: (r[1], r[2]))
    for n in range(parts):
        spark.createDataFrame(rows[n::parts] if parts == 1 else rows[n * len(rows) // parts : (n + 1) * len(rows) // parts], SCHEMA).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def _run(df, mode, tmp_path):
    name = "q" + uuid.uuid4().hex
    with typed_state(df.sparkSession):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _batch(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))


def test_usage(spark, tmp_path):
    found = _run(usage_stream(_stream(spark, tmp_path)), "complete", tmp_path)
    expected = _batch(spark).groupBy("tool").agg(F.count("*"), F.sum("chars"), F.max("chars"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()}


def test_blind_writes(spark, tmp_path):
    found = _run(blind_write_stream(_stream(spark, tmp_path), "w", "c"), "update", tmp_path).groupBy("key").agg(F.max("writes").alias("writes"), F.max("blind").alias("blind"))
    expected = ledger.blind_writes(_batch(spark), F.col("tool") == "w", F.col("tool") == "c")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()}


def test_repeats(spark, tmp_path):
    found = _run(repeat_stream(_stream(spark, tmp_path)), "append", tmp_path)
    expected = ledger.repeats(_batch(spark)).select("key", "seq", "suppressed")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()}


def test_sessions(spark, tmp_path):
    found = {tuple(r) for r in _run(session_stream(_stream(spark, tmp_path)), "append", tmp_path).collect()}
    expected = {tuple(r) for r in ledger.session_rows(_batch(spark)).select("key", "started", "ended", "calls").collect()}
    assert found <= expected and len(found) >= len(expected) - 4  # the last of each key stays open


def test_watch(spark, tmp_path):
    seen = []
    q = watch(_stream(spark, tmp_path), lambda df, _: seen.append(df.count()), str(tmp_path / "cp"), 50)
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == len(ROWS)


LATE = [(1, 100, 1, "c", "a", 900), (1, 130, 3, "w", "a", 900), (1, 160, 5, "w", "b", 900), (2, 100, 6, "w", "a", 900)]
AFTER = [(1, 115, 2, "w", "a", 900), (1, 150, 4, "c", "a", 900), (2, 400, 7, "w", "a", 900)]
THEN = [(2, 900, 9, "c", "z", 900)]
DROPPED = [(1, 120, 8, "w", "a", 900), (3, 2000, 10, "w", "z", 900)]


def _late_stream(spark, tmp_path):
    """Four micro-batches: rows of the second lie before some of the first; of the last, one lies behind the watermark, one waits."""
    for n, rows in enumerate((LATE, AFTER, THEN, DROPPED)):
        spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        os.utime(next((tmp_path / "in" / str(n)).glob("*.parquet")), (1_700_000_000 + n,) * 2)
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_late_rows_are_put_in_order_until_the_watermark(spark, tmp_path):
    reached = spark.createDataFrame(LATE + AFTER + THEN, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))
    stream = _late_stream(spark, tmp_path)
    found = _run(repeat_stream(stream, lateness="60 seconds"), "append", tmp_path)
    expected = ledger.repeats(reached).select("key", "seq", "suppressed")
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in expected.collect())
    writes = _run(blind_write_stream(stream, "w", "c", lateness="60 seconds"), "update", tmp_path).groupBy("key").agg(F.max("writes"), F.max("blind"))
    expected = ledger.blind_writes(reached, F.col("tool") == "w", F.col("tool") == "c")
    assert {tuple(r) for r in writes.collect()} == {tuple(r) for r in expected.collect()}
