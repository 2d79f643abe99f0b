"""Checks of box lines by game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from boxlake.operators.store import KeyedTable, staged


def checked_games(lines: DataFrame) -> DataFrame:
    """game_id, counts of broken rules, and ``accepted`` (no hard rule broken). Missing minutes are a soft rule; null figures break none."""
    values = ["pts", "fgm", "fga", "fg3m", "ftm", "min"]
    once = lines.groupBy("game_id", "team_id", "player_id").agg(F.count("*").alias("copies"), *(F.max(v).alias(v) for v in values))
    rules = {"duplicates": "copies > 1", "points_wrong": "pts != 2 * (fgm - fg3m) + 3 * fg3m + ftm", "makes_over": "fgm > fga", "no_minutes": "min is null"}
    found = once.groupBy("game_id").agg(*(F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()))
    return found.withColumn("accepted", F.expr("duplicates + points_wrong + makes_over = 0"))


class ConstraintError(ValueError):
    """A batch breaks rules of its table; ``counts`` has how many rows break each."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(counts.items()) if v))
        self.counts = counts


def gated_load(table: KeyedTable, rows: DataFrame, rules: dict[str, Column], rejects: KeyedTable | None = None, size: int | None = None) -> dict[str, int]:
    """Merge ``rows`` into ``table`` if all keep the ``rules`` (conditions; null counts as kept); how many rows broke each rule.

    The rules are counted while the batch is staged, before anything is written. Rows that break one stop the batch with a
    ConstraintError and leave the table as it was; with a ``rejects`` table (the table's columns and ``broken``) they go there and the rest is
    merged. ``size``: the number of rows that a batch must have (1 for a table of one row), else it is stopped in any case.
    """
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    seen = Observation()
    counted = [F.count_if(F.array_contains("broken", name)).alias(name) for name in rules]
    batch = staged(rows.withColumn("broken", broken).observe(seen, F.count("*").alias("__rows"), *counted))
    counts = dict(seen.get)
    if size is not None and counts["__rows"] != size:
        raise ConstraintError({"size": counts["__rows"]})
    del counts["__rows"]
    if any(counts.values()):
        if rejects is None:
            raise ConstraintError(counts)
        rejects.merge(batch.where(F.size("broken") > 0).withColumn("broken", F.array_join("broken", ",")))
    table.merge(batch.where(F.size("broken") == 0).drop("broken"))
    return counts
