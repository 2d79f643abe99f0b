"""Keyed merges and what has to be computed anew after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-9


def differs(old: Column, new: Column, kind: T.DataType) -> Column:
    """Whether a proposed value is another one: null against value is, floats within TOLERANCE are not."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return ~old.eqNullSafe(new) & ~F.coalesce(F.abs(old - new) <= TOLERANCE, F.lit(False))
    return ~old.eqNullSafe(new)


def coerced(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with the columns of ``schema`` that they have, cast to its kinds: to whole numbers by rounding half to even; what is of its kind stays as it is."""
    whole = lambda c: F.bround(c.cast("double"))
    kept = [f for f in schema if f.name in rows.columns]
    rounds = lambda f: isinstance(f.dataType, T.IntegralType) and rows.schema[f.name].dataType != f.dataType
    return rows.select(*((whole(F.col(f.name)) if rounds(f) else F.col(f.name)).cast(f.dataType).alias(f.name) for f in kept))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side with ``change``: insert, update, same, or stale (held but not regenerated); new values win, unchanged ones stay.

    Keys are unique on each side and null keys meet each other. Columns that ``new`` lacks are left alone (null in new rows). A
    scope's stale rows are those to delete; write the rest over the scope's partition.
    """
    values = [f for f in old.schema if f.name not in keys]
    given = [f for f in values if f.name in new.columns]
    a = old.select(*(F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)), F.struct(F.lit(0), *(f.name for f in values)).alias("__old"))
    b = new.select(*(F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)), F.struct(F.lit(0), *(f.name for f in given)).alias("__new"))
    same = F.lit(True)
    for i in range(len(keys)):
        same &= F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))
    both = a.join(b, same, "full").select(*(F.coalesce(f"__a{i}", f"__b{i}").alias(k) for i, k in enumerate(keys)), "__old", "__new")
    changed = F.lit(False)
    for f in given:
        changed = changed | differs(F.col(f"__old.{f.name}"), F.col(f"__new.{f.name}"), f.dataType)
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "stale").when(changed, "update").otherwise("same")
    known = {f.name for f in given}
    pick = lambda name: (F.when(F.col("change").isin("insert", "update"), F.col(f"__new.{name}")).otherwise(F.col(f"__old.{name}")) if name in known else F.col(f"__old.{name}")).alias(name)
    return both.withColumn("change", change).select(*keys, "change", *(pick(f.name) for f in values))


def data_through(rows: DataFrame, day: str, final: str) -> DataFrame:
    """One row, ``through``: the last day that is complete, with every day before it complete."""
    days = rows.groupBy(day).agg(F.min(F.col(final).cast("int")).alias("done"))
    gap = days.where("done = 0").agg(F.min(day).alias("gap"))  # one row
    early = days.where("done = 1").crossJoin(F.broadcast(gap)).where(F.col("gap").isNull() | (F.col(day) < F.col("gap")))
    return early.agg(F.max(day).alias("through"))
