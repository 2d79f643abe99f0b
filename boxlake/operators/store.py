"""Keyed tables in partitions: merges that rewrite only the partitions they change.

A merge is staged whole in the shared folder and then written over the changed partitions by dynamic partition overwrite, which
renames their new files into place when all tasks have committed. A run that stops before leaves the table as it was, and
a run that is repeated finds nothing to change.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.operators.merge import coerced, merged
from boxlake.sources.shared import file_system, shared_dir


def staged(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BITS = 32768  # of a map of bitmap_construct_agg


def bit_of(bits: str, at: str) -> Column:
    """Whether the bit ``at`` of a map is set."""
    return F.expr(f"getbit(cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) = 1")


def sifted(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """rows with ``__may``: false where no row of ``wanted`` has their keys; true for all that have one and for some 6 % of the others.

    The keys of ``wanted`` reach the tasks as maps of hashes, 16 bits a key, so rows are not shuffled.
    """
    size = BITS * max(1, -(-16 * wanted.count() // BITS))
    place = F.pmod(F.xxhash64(*keys), F.lit(size))
    at = lambda df: df.withColumn("__place", place).withColumn("__part", F.expr(f"__place div {BITS}")).withColumn("__bit", F.col("__place") % BITS)
    maps = at(wanted).groupBy("__part").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bits"))
    return at(rows).join(F.broadcast(maps), "__part", "left").select(*rows.columns, F.coalesce(bit_of("__bits", "__bit"), F.lit(False)).alias("__may"))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session's settings for as long as the block runs; then what they were."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table at ``path`` whose ``keys`` are unique; ``partition`` are those of them that name its folders."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    partition: tuple[str, ...]

    def read(self) -> DataFrame:
        at, files = file_system(self.spark, self.path)
        if not files.exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def within(self, parts: list[tuple]) -> DataFrame:
        """The rows of some partitions, which the scan's filter names."""
        return self.read().where(self._among(parts))

    def _among(self, parts: list[tuple]) -> Column:
        return F.array_contains(F.array(*(self._key(p) for p in parts)), F.concat_ws("/", *map(self._text, map(F.col, self.partition)))) & self._first(parts) if parts else F.lit(False)

    def _first(self, parts: list[tuple]) -> Column:
        """A filter on the outer folders, which prunes the listing."""
        known, column = {p[0] for p in parts}, F.col(self.partition[0])
        found = column.isin(sorted(known - {None}))
        return found | column.isNull() if None in known else found

    @staticmethod
    def _text(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))

    def _key(self, part: tuple) -> Column:
        return F.concat_ws("/", *(self._text(F.lit(v)) for v in part))

    def merge(self, rows: DataFrame, scope: DataFrame | list[tuple] | None = None, unique: bool = False) -> list[Row]:
        """Insert and update ``rows`` by key; stored rows of ``scope`` whose key they lack are deleted. Returns a row a partition and change: (partition columns, change, n).

        ``scope`` is a table of some of the key columns, the partition's among them, or a list of whole partitions; without it nothing is deleted. Columns that
        ``rows`` lack are left alone (null in new rows); columns that the table lacks are dropped; whole numbers are rounded half to even.
        Of rows that repeat a key the greatest by all columns counts (``unique``: none do). Only partitions with an insert, update or
        deletion are written; a partition left without rows is removed. Partitions are named on the driver, so they must be few enough to be folders.
        """
        new, parts = coerced(rows, self.schema), list(self.partition)
        values = [c for c in new.columns if c not in self.keys]
        if not unique:
            new = new.groupBy(*self.keys).agg(F.max(F.struct(*values)).alias("__v")).select(*self.keys, "__v.*") if values else new.distinct()
        new = staged(new)
        reach = new.select(parts)
        if isinstance(scope, DataFrame):
            scope = staged(scope.distinct())
            reach = reach.unionByName(scope.select(parts))
        reached = {tuple(r) for r in reach.distinct().collect()} | set(scope if isinstance(scope, list) else [])
        both = merged(self.within(list(reached)), new, list(self.keys))
        stale = F.lit(isinstance(scope, list))
        if isinstance(scope, DataFrame):
            both = both.join(scope.withColumn("__in", F.lit(True)), scope.columns, "left")
            stale = F.col("__in").isNotNull()
        done = staged(both.withColumn("change", F.when((F.col("change") == "stale") & ~stale, "same").otherwise(F.col("change"))).select(*self.schema.names, "change"))
        report = done.groupBy(*parts, "change").agg(F.count("*").alias("n")).collect()
        moved = {tuple(r[c] for c in parts) for r in report if r["change"] != "same"}
        left = moved & {tuple(r[c] for c in parts) for r in report if r["change"] != "stale"}
        if left:
            kept = done.where(F.col("change") != "stale")
            if left != {tuple(r[c] for c in parts) for r in report}:  # the test of a row's partition is slow
                kept = kept.where(self._among(list(left)))
            kept = kept.select(*self.schema.names)
            files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(left))  # as many a partition as keep all tasks busy
            dealt = kept.repartition(*parts, F.pmod(F.xxhash64(*self.keys), F.lit(files)))
            self._write(dealt)
        self._drop(moved - left)
        return report

    def replace(self, rows: DataFrame, scope: DataFrame, told: bool = True) -> list[Row]:
        """What is stored of ``scope``, distinct values of some of the key columns with the partition's, gives way to ``rows``, which lie within it, have all columns and repeat no key.

        Returns the same as ``merge`` does, but that rows outside the scope are not counted, and writes only partitions with a change; if not ``told`` nothing is compared: all partitions
        of the scope are written. Rows outside the scope are not shuffled: a sieve of the scope's keys leaves few of them to be told apart by a join.
        """
        parts, keys = list(self.partition), scope.columns
        moved = reached = {tuple(r) for r in scope.select(parts).distinct().collect()}
        stored = sifted(self.within(list(reached)), keys, scope)
        near = staged(stored.where("__may").drop("__may").join(scope.withColumn("__in", F.lit(True)), keys, "left").select(*self.schema.names, F.col("__in").isNotNull().alias("__in")))
        report = []
        if told:
            old = near.where("__in").drop("__in")
            split = sifted(rows, keys, old.select(keys).distinct())
            both = merged(old, split.where("__may").drop("__may"), list(self.keys)).select(*parts, "change").unionByName(split.where("not __may").select(*parts, F.lit("insert").alias("change")))
            report = both.groupBy(*parts, "change").agg(F.count("*").alias("n")).collect()
            moved = {tuple(r[c] for c in parts) for r in report if r["change"] != "same"}
        if not moved:
            return report
        among = self._among(list(moved)) if moved != reached else F.lit(True)  # the test of a row's partition is slow
        kept = stored.where(among & ~F.col("__may")).drop("__may").unionByName(near.where(among & ~F.col("__in")).drop("__in")).unionByName(rows.where(among).select(*self.schema.names))
        left = {tuple(r[c] for c in parts) for r in report if r["change"] != "stale"} if told else moved
        if gone := moved - left:
            left |= {tuple(r) for r in kept.where(self._among(list(gone))).select(parts).distinct().collect()}
        with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": "64"}):  # files of several partitions at once, instead of a sort by them
            self._write(kept)
        self._drop(moved - left)
        return report

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*self.partition).parquet(self.path)

    def _drop(self, parts: set[tuple]) -> None:
        named = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for part in parts:
            at, files = file_system(self.spark, "/".join([self.path, *(named(c, None if v is None else str(v)) for c, v in zip(self.partition, part))]))
            files.delete(at, True)
