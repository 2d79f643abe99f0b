"""Window operators: ranks, percentiles, rolling and exponentially weighted means, lags."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.operators.store import staged


def dense_rank_by(value: str, scope: list[str], best_high: bool = True) -> Column:
    """Dense rank, best first; nulls have none."""
    order = F.desc_nulls_last(value) if best_high else F.asc_nulls_last(value)
    return F.when(F.col(value).isNotNull(), F.dense_rank().over(Window.partitionBy(*scope).orderBy(order)))


def midrank_percentile(value: str, scope: list[str], best_high: bool = True) -> Column:
    """(worse + half of the equal) / n, in [0, 1], higher is better."""
    order = F.asc_nulls_last(value) if best_high else F.desc_nulls_last(value)
    worse = F.rank().over(Window.partitionBy(*scope).orderBy(order)) - 1
    equal = F.count("*").over(Window.partitionBy(*scope, value))
    n = F.count(value).over(Window.partitionBy(*scope))
    return F.when(F.col(value).isNotNull(), (worse + 0.5 * equal) / n)


def value_places(df: DataFrame, value: str, scope: list[str], best_high: bool = True, blocks: int = 64) -> DataFrame:
    """scope, value, dense, worse, equal, n of every distinct value: its dense rank (best first), how many rows are worse and equal, and how many there are.

    The values of a scope are cut into blocks at approximate quantiles; a window holds one block's distinct values, and the sums of the
    other blocks (a row each) are added, so no task holds a whole scope. Nulls have no place. df is read twice: stage what is dear.
    The blocks are staged, as approximate quantiles depend on the order in which parts arrive: made twice they can differ, and with them the sums.
    """
    known = df.where(F.col(value).isNotNull())
    cuts = known.groupBy(*scope).agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 1000).alias("__cuts"))
    block = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    values = known.groupBy(*scope, value).agg(F.count("*").alias("equal")).join(cuts, scope).withColumn("__block", block).drop("__cuts")
    if not best_high:
        values = values.withColumn("__block", -F.col("__block"))
    values = staged(values)
    whole = Window.partitionBy(*scope)
    low = whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    high = whole.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy(*scope, "__block").agg(F.count("*").alias("__d"), F.sum("equal").alias("__r"))
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*scope, "__block", none(F.sum("__d").over(high)).alias("__better"), none(F.sum("__r").over(low)).alias("__worse"), F.sum("__r").over(whole).alias("n"))
    within = Window.partitionBy(*scope, "__block")
    best, worst = (F.desc(value), F.asc(value)) if best_high else (F.asc(value), F.desc(value))
    placed = values.withColumns({"__i": F.row_number().over(within.orderBy(best)), "__under": none(F.sum("equal").over(within.orderBy(worst).rowsBetween(Window.unboundedPreceding, -1)))})
    return placed.join(sums, [*scope, "__block"]).select(*scope, value, (F.col("__better") + F.col("__i")).cast("long").alias("dense"), (F.col("__worse") + F.col("__under")).alias("worse"), "equal", "n")


def quantiles(places: DataFrame, value: str, scope: list[str], shares: dict[str, float]) -> DataFrame:
    """scope and a column a share: the linear quantile, from ``value_places`` by low values first (``best_high``): the rows on both sides of the place are looked up by their counts."""
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    held = lambda place: F.max(F.when((F.col("worse") <= place) & (place < F.col("worse") + F.col("equal")), F.col(value)))
    found = places.groupBy(*scope).agg(F.max("n").alias("n"), *(held(F.floor(at(p))).alias(f"__{k}0") for k, p in shares.items()), *(held(F.ceil(at(p))).alias(f"__{k}1") for k, p in shares.items()))
    part = lambda p: at(p) - F.floor(at(p))
    return found.select(*scope, *(((1 - part(p)) * F.col(f"__{k}0") + part(p) * F.col(f"__{k}1")).alias(k) for k, p in shares.items()))


def rolling_mean(value: str, keys: list[str], order: list[str], width: int) -> Column:
    """Mean of the last ``width`` rows, null until there are so many rows; null values inside are skipped."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return F.when(F.row_number().over(by) >= width, F.avg(value).over(by.rowsBetween(-(width - 1), 0)))


def ewma_by(df: DataFrame, value: str, keys: list[str], order: list[str], halflife: float) -> DataFrame:
    """keys and ewma: weights halve every ``halflife`` rows back from the newest; null values still count as rows."""
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])) - 1
    weight = F.when(F.col(value).isNotNull(), F.pow(F.lit(0.5), F.col("__age") / halflife))
    aged = df.withColumn("__age", age)
    return aged.groupBy(*keys).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("ewma"))


def rest_days(date: str, keys: list[str], order: list[str]) -> Column:
    """Days off since the row before, at least 0; null on the first."""
    gap = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(*keys).orderBy(*order)))
    return F.when(gap.isNotNull(), F.greatest(gap - 1, F.lit(0)))
