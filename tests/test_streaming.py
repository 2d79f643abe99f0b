"""The streamed daily sums over the layouts that Spark writes, with rows that have no time."""

import pytest
from pyspark.sql import functions as F

from boxlake.plans.queries import QUERIES


@pytest.mark.parametrize("layout", ["file", "parts", "partitioned"])
def test_streamed_daily(spark, tmp_path, layout):
    ts = F.when(F.col("id") % 7 > 0, F.timestamp_seconds(1_700_000_000 + F.col("id") * 5000))
    events = spark.range(300, numPartitions=5).select(F.col("id").alias("event_id"), ts.alias("ts"), F.concat(F.lit("e"), F.col("id") % 3).alias("event_type"), (F.col("id") / 2).alias("value"))
    path = tmp_path / "events.parquet"
    if layout == "file":
        events.coalesce(1).write.parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("part-*")).rename(path)
    else:
        events.write.partitionBy(*["event_type"] * (layout == "partitioned")).parquet(str(path))
    got = {(r.day, r.event_type): (r.n, r.total) for r in QUERIES["streamed_daily"](spark, str(tmp_path)).collect()}
    want = {(r.day, r.event_type): (r.n, r.total) for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert sum(n for n, _ in got.values()) == 300 and got == want
