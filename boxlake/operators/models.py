"""Models over box scores: projections, dispersion, valuation, and the sequential rating fold."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions.nullsafe import sdiv

# The two-sided 80 % normal quantile, and defaults of the models.
Z80 = 1.2816
PADDING = 400.0
PRIOR_ROWS = 60.0


def nb_variance(mean: Column, alpha: Column) -> Column:
    """Variance of a negative binomial with dispersion alpha (Poisson at 0)."""
    return mean + alpha * mean * mean


def regressed_rate(season_total: Column, season_minutes: Column, career_total: Column, career_minutes: Column) -> Column:
    """Per-minute rate: the season's padded by the career's over PADDING minutes."""
    career = sdiv(career_total, career_minutes)
    return (season_total + PADDING * career) / (season_minutes + PADDING)


def fit_dispersion(y: str, mu: str) -> Column:
    """Moment estimate of alpha, at least 0; an aggregate."""
    square = F.col(mu) * F.col(mu)
    return F.greatest(F.sum((F.pow(F.col(y) - F.col(mu), 2) - F.col(mu)) * square) / F.sum(square * square), F.lit(0.0))


def shrunk_multiplier(mean_square: Column, n: Column) -> Column:
    return (n * mean_square + PRIOR_ROWS) / (n + PRIOR_ROWS)


def value_pool(lines: DataFrame, size: int, cats: list[str], points: str, key: str) -> DataFrame:
    """z of each category from the moments of the ``size`` best by points; all are then ranked by total z."""
    pool = lines.orderBy(F.desc(points), key).limit(size)
    moments = pool.agg(*(F.avg(c).alias(f"m_{c}") for c in cats), *(F.stddev_pop(c).alias(f"s_{c}") for c in cats))
    z = lines.crossJoin(F.broadcast(moments))  # one row of moments
    z = z.select(key, *(F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(f"z_{c}") for c in cats))
    return z.withColumn("total_z", sum((F.col(f"z_{c}") for c in cats), F.lit(0.0)))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where("__i = 1").drop("__i")


def season_composites(rows: DataFrame, scope: list[str], team_minutes: float = 240.0) -> DataFrame:
    """rows with per, bpm, obpm, dbpm, ws, ows, dws, ws48 and vorp, by two passes over the league.

    Production a minute is scaled so that the league's mean by minutes is 15; box plus-minus is that scale's distance from 15, shifted so that its mean by
    minutes is 0; a team's wins are shared by minutes and rating above a floor. Scopes and teams are few and broadcast. ``rows``: scope, team_id, a player's season sums (min and the box
    statistics), usg (a fraction), team_games, team_wins. Nothing is rounded. Null or no minutes count as one minute of production without weight.
    """
    held = lambda v, low, high: F.greatest(F.lit(low), F.least(v, F.lit(high)))
    weight = F.coalesce(F.col("min"), F.lit(0)).cast("double")
    minutes = F.when(weight > 0, weight).otherwise(1.0)
    production = F.expr("pts + 0.7D * ast + 0.7D * oreb + 0.3D * dreb + stl + 0.7D * blk - 0.72D * (fga - fgm) - 0.42D * (fta - ftm) - tov - 0.28D * pf")
    rated = rows.withColumn("__w", weight).withColumn("__m", minutes).withColumn("__raw", production / minutes)
    league = rated.groupBy(*scope).agg((F.sum(F.col("__raw") * F.col("__w")) / F.when(F.sum("__w") > 0, F.sum("__w")).otherwise(1.0)).alias("__mean"))
    rated = rated.join(F.broadcast(league), scope).withColumn("per", held(F.col("__raw") * F.when(F.col("__mean") != 0, 15.0 / F.col("__mean")).otherwise(1.0), 0.0, 35.0)).withColumn("__bpm", (F.col("per") - 15.0) / 2.2)
    centre = rated.groupBy(*scope).agg((F.sum(F.col("__bpm") * F.col("__w")) / F.when(F.sum("__w") > 0, F.sum("__w")).otherwise(1.0)).alias("__centre"))
    share = F.greatest(F.lit(0.05), F.col("per") - 5.0) * F.col("__w")
    teams = rated.groupBy(*scope, "team_id").agg(F.sum(share).alias("__shares"))
    full = rated.join(F.broadcast(centre), scope).join(F.broadcast(teams), [*scope, "team_id"])
    usg = F.coalesce("usg", F.lit(0.2)) - 0.2
    games = F.greatest(F.lit(1), F.col("team_games"))
    full = full.withColumn("bpm", held(F.col("__bpm") - F.col("__centre"), -8.0, 14.0)).withColumn("ws", F.col("team_wins") * share / F.when(F.col("__shares") != 0, F.col("__shares")).otherwise(1.0))
    attack, wins = held(0.62 + 0.25 * usg, 0.35, 0.85), held(0.5 + 0.9 * usg, 0.25, 0.82)
    found = {"per": F.col("per"), "bpm": F.col("bpm"), "obpm": F.col("bpm") * attack, "dbpm": F.col("bpm") * (1 - attack), "ws": F.col("ws"), "ows": F.col("ws") * wins, "dws": F.col("ws") * (1 - wins), "ws48": held(48 * F.col("ws") / F.col("__m"), -0.05, 0.32), "vorp": (F.col("bpm") + 2) * F.col("__w") / (games * team_minutes) * games / 82}
    return full.select(*rows.columns, *(v.alias(k) for k, v in found.items()))
