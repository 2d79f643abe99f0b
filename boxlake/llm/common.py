"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BATCH_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
ROW_GROUP_BYTES = 16 << 20  # a Parquet writer holds a row group in memory


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own (tests); a cluster is an error, as its executors could not see one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 500):
    """Within it, plans that run hand Python workers batches of at most ``rows`` rows and about BATCH_BYTES bytes (one text may be longer), so what a worker holds follows its longest text. The session's settings are put back."""
    before = {k: spark.conf.get(k) for k in (BATCH_ROWS_SETTING, BATCH_BYTES_SETTING)}
    spark.conf.set(BATCH_ROWS_SETTING, str(rows))
    spark.conf.set(BATCH_BYTES_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Tables:
    """Intermediate Parquet tables of one run in the shared folder: lineage ends there, and a lost executor costs only a reread.

    ``keep`` deletes all but the tables it is given, once the results that need them are written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def keep(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if not any(t is k for k in tables)]:
            del self.paths[path]
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder that stays until the folder is cleared."""
    return Tables(df.sparkSession).write(df)


def gapless_index(df: DataFrame, keys: list[str], order: list[str], blocks: int, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each combination of ``keys``, without one task per combination.

    Rows of a key are dealt into ``blocks`` by the hash of ``order``; each block numbers its own rows, and the counts of
    the blocks before it (keys x blocks rows at most) are added. Rows that agree in all of ``order`` are numbered in any order.
    """
    block = "__block"
    df = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = df.groupBy(*keys, block).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, block, F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order))
    return df.withColumn("__within", within).join(sizes, [*keys, block]).withColumn(name, (F.col("__before") + F.col("__within") - 1).cast("long")).drop(block, "__within", "__before")


def ranked(df: DataFrame, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A table of df with ``name``: 0, 1, 2, ... in ``order`` within each combination of ``by``, which must lead ``order``.

    Rows are dealt by ranges of ``order`` and sorted within; a row's place in its range and the counts of the ranges before it
    give its number. Rows that agree in all of ``order`` are parted by a salt, so no task holds all copies of one row; they are
    numbered in any order. df must be a table that is written already (the ranges are sampled from it). Null is a value of its own.
    """
    n, low = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << 33) - 1
    dealt = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *order, F.col("__salt")).sortWithinPartitions(*order, "__salt").drop("__salt")
    # the lower 33 bits of this id are the place in the partition, the upper ones the partition
    placed = written(dealt.withColumn("__id", F.monotonically_increasing_id()).select(*df.columns, F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND(F.lit(low)).alias("__within")))
    runs = placed.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__within").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    keys = [f"__{i}" for i in range(len(by))]
    runs = written(runs.select(F.col("__part").alias("__of"), *[F.col(b).alias(k) for b, k in zip(by, keys)], (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__before")))
    same = F.col("__part") == F.col("__of")
    for b, k in zip(by, keys):
        same &= F.col(b).eqNullSafe(F.col(k))
    return placed.join(runs, same).select(*df.columns, (F.col("__within") + F.col("__before")).cast("long").alias(name))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
