"""Join operators: as-of, leave-one-out, tiered matching."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], strict: bool = True) -> DataFrame:
    """left with the newest right row's ``values`` of the same key before (or, not strict, at or before) ``at``.

    Both sides are merged into one ordered stream per key and the last right values are carried forward: one shuffle, no range join.
    """
    left_first = 0 if strict else 1
    carried = F.struct(*values)
    none = F.lit(None).cast(right.select(carried.alias("v")).schema["v"].dataType)
    stream = left.select(key, at, F.lit(left_first).alias("__o"), F.struct(*left.columns).alias("__l"), none.alias("__r")).unionByName(
        right.select(key, at, F.lit(1 - left_first).alias("__o"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("__l"), carried.alias("__r"))
    )
    by = Window.partitionBy(key).orderBy(at, "__o").rowsBetween(Window.unboundedPreceding, 0)
    out = stream.withColumn("__v", F.last("__r", ignorenulls=True).over(by)).where(F.col("__l").isNotNull())
    return out.select("__l.*", *(F.col(f"__v.{v}").alias(f"asof_{v}") for v in values))


def leave_one_out_mean(df: DataFrame, value: str, keys: list[str], least: int) -> DataFrame:
    """df with the mean of the other rows of its key; null with fewer than ``least`` others."""
    by = Window.partitionBy(*keys)
    n, total = F.count(value).over(by), F.sum(value).over(by)
    return df.withColumn("others_mean", F.when(n - 1 >= least, (total - F.col(value)) / (n - 1)))


def tiered_match(left: DataFrame, right: DataFrame, tiers: list[tuple[list[str], float]], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id, confidence: the first tier of columns on which exactly one right row matches; none gives nulls."""
    found = None
    for number, (columns, confidence) in enumerate(tiers):
        unique = right.groupBy(*columns).agg(F.count("*").alias("__n"), F.min(right_id).alias(right_id)).where("__n = 1").drop("__n")
        hit = left.join(unique, columns).select(left_id, right_id, F.lit(confidence).alias("confidence"), F.lit(number).alias("__tier"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(left_id).agg(F.min_by(F.struct(right_id, "confidence"), "__tier").alias("m")).select(left_id, f"m.{right_id}", "m.confidence")
    return left.select(left_id).join(best, left_id, "left")
