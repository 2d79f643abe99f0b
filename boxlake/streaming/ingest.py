"""Incremental ingest: a file stream of events to daily sums, with late rows inside a correction window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_daily(spark: SparkSession, source_dir: str, pattern: str, schema, shared: str, late: str = "3 days") -> DataFrame:
    """Daily count and sum by event type, read as a stream until the source is exhausted; the state's last output per key is the result.

    ``pattern`` names files of ``source_dir`` or directories of part files, partitioned or not. Rows without a time have the day null;
    they are summed by a query of their own, since a watermark would drop them. Each micro-batch is written under its own number, so a
    batch that runs again after a failure overwrites itself.
    """
    run = f"{shared}/stream-{uuid.uuid4().hex}"
    # A glob, as the file source takes no single file by its plain path; basePath keeps the columns of partition folders.
    rows = spark.readStream.schema(schema).option("basePath", source_dir).parquet(f"{source_dir}/{{{pattern}}}").withColumn("at", F.col("ts").cast("timestamp"))
    day = F.window("at", "1 day").getField("start").cast("date").alias("day")
    sums = F.count("*").alias("n"), F.sum("value").alias("total")
    dated = rows.withWatermark("at", late).groupBy(day, "event_type").agg(*sums)
    undated = rows.where("at is null").groupBy(F.lit(None).cast("date").alias("day"), "event_type").agg(*sums)
    for name, daily in (("dated", dated), ("undated", undated)):

        def write(batch: DataFrame, number: int, name: str = name) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{run}/out/{name}/batch={number}")

        daily.writeStream.outputMode("update").option("checkpointLocation", f"{run}/state-{name}").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{run}/out")
    last = out.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("day", "event_type", "v.n", "v.total")
