"""Team projection: ratings, match scores, and the fold that moves ratings day by day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.nullsafe import sdiv

# Regression of last season, weight of a prior in games, weight of last season's level in team games, home points, games that fit them, least games of a prior.
REGRESSION, PRIOR_GAMES, LEVEL_WEIGHT, HOME_POINTS, HOME_FIT_GAMES, PRIOR_MIN_GAMES = 0.3, 10.0, 150.0, 2.5, 300, 10
Z80 = 1.2816


def rating(prior, level, adjustment, regression: float = REGRESSION):
    """A team's points for (or against): last season's, regressed to the level, plus what this season taught."""
    return level + (prior - level) * (1 - regression) + adjustment


def blended_level(current, games, previous, weight: float = LEVEL_WEIGHT) -> Column:
    """This season's mean, with last season's as ``weight`` team games; whichever exists where one is missing."""
    both = (games * current + weight * previous) / (games + weight)
    return F.coalesce(F.when(games > 0, both), F.when(games > 0, current), previous)


def match_scores(level, home_for, home_against, away_for, away_against, edge):
    """(home, away) points: level x attack x defence, the home edge split."""
    return home_for * away_against / level + edge / 2, away_for * home_against / level - edge / 2


def home_edge(override: Column, neutral: Column, default: float = HOME_POINTS) -> Column:
    return F.when(neutral, 0.0).otherwise(F.coalesce(override, F.lit(default)))


def interval80(centre: Column, sd: Column) -> tuple[Column, Column]:
    return centre - Z80 * sd, centre + Z80 * sd


def summary(margin: Column, home: Column, away: Column) -> Column:
    """The winner and by how much, or a toss-up within half a point."""
    return F.when(F.abs(margin) < 0.5, "Toss-up").otherwise(F.concat(F.when(margin > 0, home).otherwise(away), F.lit(" by "), F.format_number(F.abs(margin), 1)))


def season_means(sides: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope and team: games, mean points for and against (null under PRIOR_MIN_GAMES), and the scope's level, home margin sum and count."""
    teams = sides.groupBy(*scope, "team_id").agg(F.count("*").alias("n"), F.sum("tm_pts").alias("f"), F.sum("opp_pts").alias("a"), F.sum(F.when(F.col("is_home"), F.col("tm_pts") - F.col("opp_pts"))).alias("m"), F.count_if("is_home").alias("h"))
    whole = teams.groupBy(*scope).agg((F.sum("f") / F.sum("n")).alias("level"), F.sum("m").cast("double").alias("margin_sum"), F.sum("h").cast("long").alias("margin_n"))
    mean = lambda c: F.when(F.col("n") >= PRIOR_MIN_GAMES, F.col(c) / F.col("n"))
    return teams.select(*scope, "team_id", mean("f").alias("pf"), mean("a").alias("pa")).join(F.broadcast(whole), scope)  # a row a season


def rating_fold(sides: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """season, season_type, game_date, home_id, away_id, games, level, projected_home, projected_away of every pairing of a day.

    ``sides`` has a row per game and side (season, season_type, game_date, team_id, opp_team_id, is_home, tm_pts, opp_pts; points at
    regulation length). A day is projected from the state before it, then all its teams are updated: by the mean miss of the
    team's games of that day, with weight 1 / (day number + PRIOR_GAMES). ``factors`` (season, season_type, team_id, game_date, factor) scale a
    side's attack by what its availability leaves as of the day, 1 where there is none. Games are aggregated to pairings of a day on
    Spark, so the sequential step of a season holds days x pairings of teams, whatever the number of games.
    """
    scope = ["season", "season_type"]
    pairs = sides.where("is_home").groupBy(*scope, "game_date", F.col("team_id").alias("home_id"), F.col("opp_team_id").alias("away_id")).agg(F.count("*").alias("games"), F.avg("tm_pts").alias("home"), F.avg("opp_pts").alias("away"))
    prior = season_means(sides, scope).withColumn("season", F.col("season") + 1)
    last = prior.select(*scope, "level", "margin_sum", "margin_n").distinct().withColumnsRenamed({"level": "level0", "margin_sum": "margin_sum0", "margin_n": "margin_n0"})
    of = lambda side: prior.select(*scope, F.col("team_id").alias(f"{side}_id"), F.col("pf").alias(f"{side}_pf0"), F.col("pa").alias(f"{side}_pa0"))
    full = pairs.join(last, scope, "left").join(of("home"), [*scope, "home_id"], "left").join(of("away"), [*scope, "away_id"], "left")
    for side in ("home", "away"):
        factor = factors.select(*scope, "game_date", F.col("team_id").alias(f"{side}_id"), F.col("factor").alias(f"{side}_factor")) if factors else None
        full = full.join(factor, [*scope, "game_date", f"{side}_id"], "left").fillna(1.0, [f"{side}_factor"]) if factors else full.withColumn(f"{side}_factor", F.lit(1.0))
    fields = "season long, season_type string, game_date date, home_id long, away_id long, games long, level double, projected_home double, projected_away double"
    return full.groupBy(*scope).applyInPandas(fold_season, fields)


def fold_season(rows: pd.DataFrame) -> pd.DataFrame:
    """One season's days in order, a day's pairings at once."""
    rows = rows.sort_values(["game_date", "home_id", "away_id"], kind="stable").reset_index(drop=True)
    ids, place = np.unique(np.concatenate([rows["home_id"], rows["away_id"]]), return_inverse=True)
    home, away = np.split(place, 2)
    n, scored, allowed = (rows[c].to_numpy(np.float64) for c in ("games", "home", "away"))
    home_factor, away_factor = (rows[c].to_numpy(np.float64) for c in ("home_factor", "away_factor"))
    level0, margin_sum, margin_n = (float(rows[c].iat[0]) for c in ("level0", "margin_sum0", "margin_n0"))
    margin_sum, margin_n = (0.0, 0.0) if np.isnan(level0) else (margin_sum, margin_n)
    prior = {c: rows[c].to_numpy(np.float64) for c in ("home_pf0", "home_pa0", "away_pf0", "away_pa0")}
    up, down, days = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
    total = games = 0.0
    out = np.full((len(rows), 3), np.nan)
    for day in np.split(np.arange(len(rows)), np.flatnonzero(rows["game_date"].to_numpy()[1:] != rows["game_date"].to_numpy()[:-1]) + 1):
        h, a, w = home[day], away[day], n[day]
        level = level0 if not games else total / games if np.isnan(level0) else (total + LEVEL_WEIGHT * level0) / (games + LEVEL_WEIGHT)
        known = level > 0
        if known:
            edge = margin_sum / margin_n if margin_n >= HOME_FIT_GAMES else HOME_POINTS
            start = {c: np.where(np.isnan(v[day]), level, v[day] * level / level0) for c, v in prior.items()}
            h_for, h_against = rating(start["home_pf0"], level, up[h]), rating(start["home_pa0"], level, down[h])
            a_for, a_against = rating(start["away_pf0"], level, up[a]), rating(start["away_pa0"], level, down[a])
            ours, theirs = match_scores(level, h_for * home_factor[day], h_against, a_for * away_factor[day], a_against, edge)
            out[day] = np.stack([np.full(len(day), level), ours, theirs], axis=1)
        total += float((w * (scored[day] + allowed[day])).sum())
        games += 2 * float(w.sum())
        margin_sum += float((w * (scored[day] - allowed[day])).sum())
        margin_n += float(w.sum())
        sums = lambda x, y: np.bincount(h, x, len(ids)) + np.bincount(a, y, len(ids))  # noqa: B023, E731
        played = sums(w, w)
        met = played > 0
        days[met] += 1
        if known:
            weight = 1 / (days[met] + PRIOR_GAMES) / played[met]
            up[met] += weight * sums(w * (scored[day] - ours), w * (allowed[day] - theirs))[met]
            down[met] += weight * sums(w * (allowed[day] - theirs), w * (scored[day] - ours))[met]
    found = rows[["season", "season_type", "game_date", "home_id", "away_id", "games"]].copy()
    found[["level", "projected_home", "projected_away"]] = out
    return found


def match_projections(games: DataFrame, prior: DataFrame) -> DataFrame:
    """Each game (home_id, away_id, season, season_type, absent_home) projected from last season's means alone: points, margin, winner in words, and what absences cost."""
    scope = ["season", "season_type"]
    last = prior.withColumn("season", F.col("season") + 1)
    of = lambda side: last.select(*scope, F.col("team_id").alias(f"{side}_id"), F.col("pf").alias(f"{side}_f"), F.col("pa").alias(f"{side}_a"), *(["level"] if side == "home" else []))
    g = games.join(F.broadcast(of("home")), [*scope, "home_id"]).join(F.broadcast(of("away")), [*scope, "away_id"])  # teams x seasons rows
    level = F.col("level")
    sides = {f"{s}_{k}": rating(F.coalesce(f"{s}_{k}", level), level, F.lit(0.0)) for s in ("home", "away") for k in "fa"}
    edge = home_edge(F.lit(None).cast("double"), F.col("neutral"))
    home, away = match_scores(level, sides["home_f"] * F.col("factor"), sides["home_a"], sides["away_f"], sides["away_a"], edge)
    full, _ = match_scores(level, sides["home_f"], sides["home_a"], sides["away_f"], sides["away_a"], edge)
    low, high = interval80(home - away, F.lit(11.5))
    words = summary(home - away, F.col("home_id").cast("string"), F.col("away_id").cast("string"))
    return g.select(*scope, "game_id", home.alias("home_points"), away.alias("away_points"), (home - away).alias("margin"), low.alias("margin_low"), high.alias("margin_high"), (home - full).alias("absence_effect"), sdiv(sides["home_f"], level).alias("attack_index"), words.alias("summary"))


def fitted_spreads(residuals: DataFrame, least: int = HOME_FIT_GAMES) -> DataFrame:
    """season, source, games, team_sd, margin_sd: root mean square misses of a season's locked projections, else of all of last season's; null on under ``least`` games.

    ``residuals`` has season, locked, home and away (actual less projected).
    """
    h, a, locked = F.col("home"), F.col("away"), F.col("locked")
    rms = lambda kept: (F.count_if(kept), F.sqrt(F.sum(F.when(kept, h * h + a * a)) / (2 * F.count_if(kept))), F.sqrt(F.avg(F.when(kept, (h - a) * (h - a)))))
    names = ("n", "team", "margin")
    found = residuals.groupBy("season").agg(*(c.alias(f"now_{n}") for n, c in zip(names, rms(F.coalesce(locked, F.lit(False))))), *(c.alias(f"all_{n}") for n, c in zip(names, rms(h.isNotNull() & a.isNotNull()))))
    last = found.select((F.col("season") + 1).alias("season"), *(F.col(f"all_{n}").alias(f"last_{n}") for n in names))
    own, other = F.col("now_n") >= least, F.col("last_n") >= least
    pick = lambda c: F.when(own, F.col(f"now_{c}")).when(other, F.col(f"last_{c}"))
    source = F.when(own, "fittedLedger").when(other, "fittedPrevSeason")
    return found.drop("all_n", "all_team", "all_margin").join(last, "season", "left").select("season", source.alias("source"), F.when(own, F.col("now_n")).otherwise(F.coalesce("last_n", F.lit(0))).alias("games"), pick("team").alias("team_sd"), pick("margin").alias("margin_sd"))
