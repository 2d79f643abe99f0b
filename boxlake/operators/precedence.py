"""Merges in which the rank of a source decides who may write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_merge(held: DataFrame, offers: DataFrame, keys: list[str], value: str, source: str, at: str, ranks: dict[str, int], seeds: tuple[str, ...], usable: Column) -> DataFrame:
    """One row a key: keys, value, source, at and outcome (inserted, kept, unchanged, updated; untouched without an offer).

    Of several offers of a key the best source's counts, then a usable one, then the newest, then the greatest value. It is kept out by a row of a
    seed source, by one of a better source, and, if it is not usable, by one that is; ``usable`` is a condition on the value column. ``ranks`` has small numbers for good
    sources; unknown ones come last. Keys are unique in ``held``, and null keys meet each other.
    """
    rank = lambda s: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), s), F.lit(len(ranks) + 99))
    order = F.struct(-rank(F.col(source)), F.coalesce(usable, F.lit(False)), F.col(at), F.col(value))
    best = offers.groupBy(*keys).agg(F.max_by(F.struct(value, source, at, F.coalesce(usable, F.lit(False)).alias("__fit")), order).alias("__n"))
    old = held.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(value, source, at, F.coalesce(usable, F.lit(False)).alias("__fit")).alias("__o"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = best.join(old, same, "full")
    n, o = F.col("__n"), F.col("__o")
    barred = o[source].isin(*seeds) | (rank(n[source]) > rank(o[source])) | (~n["__fit"] & o["__fit"])
    outcome = F.when(n.isNull(), "untouched").when(o.isNull(), "inserted").when(F.coalesce(barred, F.lit(False)), "kept").when(n[value].eqNullSafe(o[value]) & n[source].eqNullSafe(o[source]), "unchanged").otherwise("updated")
    both = both.withColumn("outcome", outcome)
    taken = F.when(F.col("outcome").isin("inserted", "updated"), n).otherwise(o)
    return both.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), taken[value].alias(value), taken[source].alias(source), taken[at].alias(at), "outcome")


def ensured(held: DataFrame, offers: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """held with the offers' missing keys inserted, and only the blanks of ``fill`` filled in the others (null or ''). Of several offers the greatest by its columns counts."""
    rest = [c for c in held.columns if c not in keys]
    best = offers.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__n"))
    both = held.select(*keys, F.struct(F.lit(0), *rest).alias("__o")).join(best, keys, "full")
    pick = lambda c: F.when(F.col("__o").isNull(), F.col(f"__n.{c}")).otherwise(F.coalesce(F.when(F.col(f"__o.{c}").cast("string") != "", F.col(f"__o.{c}")), F.col(f"__n.{c}"), F.col(f"__o.{c}")) if c in fill else F.col(f"__o.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in rest))
