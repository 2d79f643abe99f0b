"""Snapshots of raw payloads by the hash of their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def payload_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """source (the file's folder), fetched_at (when it was written), path, size and sha256 of every file under ``path``; only the hash leaves the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    source = F.element_at(F.split("path", "/"), -2)
    return files.select(source.alias("source"), F.col("modificationTime").alias("fetched_at"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def new_snapshots(fetches: DataFrame, stored: DataFrame, at: list[str]) -> DataFrame:
    """The fetches whose content their source does not hold yet, the first of each by ``at``: a repeated payload adds nothing."""
    rest = [c for c in fetches.columns if c not in ("source", "sha256")]
    first = fetches.groupBy("source", "sha256").agg(F.min_by(F.struct(*rest), F.struct(*at)).alias("__f")).select("source", "sha256", "__f.*").select(*fetches.columns)
    known = stored.select(F.col("source").alias("__source"), F.col("sha256").alias("__sha")).distinct()
    return first.join(known, F.col("source").eqNullSafe(F.col("__source")) & F.col("sha256").eqNullSafe(F.col("__sha")), "left_anti")


def last_kept(snapshots: DataFrame, keep: int, at: list[str]) -> DataFrame:
    """The ``keep`` newest snapshots of each source, with ``age`` (0 is the newest)."""
    newest = Window.partitionBy("source").orderBy(*(F.desc(c) for c in at))
    return snapshots.withColumn("age", F.row_number().over(newest) - 1).where(F.col("age") < keep)


def review_queue(rows: DataFrame, snapshots: DataFrame, names: DataFrame, at: list[str]) -> DataFrame:
    """source, name, rows: the names in each source's newest snapshot that ``names`` (name) does not know; older snapshots no longer count. ``rows``: source, sha256, name."""
    newest = last_kept(snapshots, 1, at).select("source", "sha256")
    return rows.join(newest, ["source", "sha256"], "left_semi").join(names.select("name").distinct(), "name", "left_anti").groupBy("source", "name").agg(F.count("*").alias("rows"))
