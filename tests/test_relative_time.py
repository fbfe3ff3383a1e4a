from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engram.functions.relative_time import parse, resolve

AT = datetime(2025, 3, 31, 15, 30)


@pytest.mark.parametrize("phrase,want", [
    ("now", AT), ("Yesterday ", datetime(2025, 3, 30)), ("last month", datetime(2025, 2, 28)), ("2 years ago", datetime(2023, 3, 31)), ("next year", datetime(2026, 3, 31)),
    ("3 hours ago", datetime(2025, 3, 31, 12, 30)), ("2025-01-02", datetime(2025, 1, 2)), ("soon", None), ("", None), (None, None)])
def test_parse(phrase, want):
    assert parse(phrase, AT) == want


def test_resolve(spark):
    df = spark.createDataFrame([("we met yesterday", AT), ("3 hours ago", AT), ("in last month's mail", AT), ("never", AT), (None, AT)], "t string, at timestamp")
    assert [r[0] for r in df.select(resolve(F.col("t"), F.col("at"))).collect()] == [datetime(2025, 3, 30), datetime(2025, 3, 31, 12, 30), datetime(2025, 2, 28), None, None]


def test_stream_equals_batch(spark, tmp_path):
    from engram.streaming.streams import rate_windows

    rows = [(i % 3, datetime(2025, 3, 1, i % 24, 5)) for i in range(60)]
    spark.createDataFrame(rows, "user_id int, ts timestamp").write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in rate_windows(spark.read.parquet(str(tmp_path / "in"))).collect()}
    stream = rate_windows(spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("rates").collect()} == batch
