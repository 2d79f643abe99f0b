"""The second league: ratings that move round by round, player states as of a round, and scorers of a slate."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions.nullsafe import sdiv
from boxlake.operators.ratings import match_scores, rating
from boxlake.operators.squads import normalised_minutes

# Weight of a club's first two games, offset of the rule beyond, regulation and overtime minutes, minutes of a rate, rounds that implied minutes count more, last games of form and their weight.
WEIGHTS, OFFSET = {1: 0.10, 2: 0.09}, 9
REGULATION, OVERTIME = 40.0, 5.0
PER, MINUTES_OFFSET = 40.0, 3
FORM_GAMES, FORM_WEIGHT = 10, 0.25


def regulation_points(points: Column, overtimes: Column) -> Column:
    """Points as if the game had ended after regulation; an unknown number of overtimes counts none."""
    return F.when(overtimes > 0, points * REGULATION / (REGULATION + OVERTIME * overtimes)).otherwise(points.cast("double"))


def update_weight(n: Column) -> Column:
    out = F.lit(1.0) / (n + OFFSET)
    for k, w in WEIGHTS.items():
        out = F.when(n == k, F.lit(w)).otherwise(out)
    return out


def numbered_games(sides: DataFrame) -> DataFrame:
    """sides (season, team_id, round, game_date, game_id, ...) with ``n``: the club's games of the season in order of round, day and id.

    A day's games are numbered by themselves and moved by those before, so that no task takes a club's whole season.
    """
    at = ["season", "team_id", "round", "game_date"]
    days = sides.groupBy(*at).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("season", "team_id").orderBy("round", "game_date").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*at, F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*at).orderBy("game_id"))
    return sides.withColumn("__within", within).join(days, at).withColumn("n", F.col("__within") + F.col("__before")).drop("__within", "__before")


def complete_rounds(games: DataFrame) -> DataFrame:
    """season, round of those where every game that is not postponed is scored, and one is at least."""
    kept = games.groupBy("season", "round").agg(F.bool_and(F.col("scored") | F.col("postponed")).alias("__all"), F.bool_or(F.col("scored")).alias("__any"))
    return kept.where("__all and __any").select("season", "round")


def round_fold(sides: DataFrame, base: DataFrame, home_points: float) -> DataFrame:
    """season, round, team_id, attack_adj, defence_adj, games of every rated club after every round in which the season has games.

    ``sides`` has a row per scored game and club: season, round, game_date, game_id, team_id, opp_team_id, is_home, scored, allowed (at
    regulation length) and, where a projection was locked before the game, locked_scored and locked_allowed. ``base`` has season, team_id,
    pf, pa (priors; one row a club). A game moves both clubs by their update weight times the miss; all games of a round are
    measured against the state before it, so the moves of a round add up: Spark sums them by pairing, and the sequential step of a season
    holds rounds x pairings of clubs. Games with an unrated club, and seasons without priors, move nothing.
    """
    weight = update_weight(F.col("n"))
    rated = numbered_games(sides).join(F.broadcast(base.select("season", "team_id").distinct()), ["season", "team_id"], "left_semi")
    rated = rated.join(F.broadcast(base.select("season", F.col("team_id").alias("opp_team_id")).distinct()), ["season", "opp_team_id"], "left_semi")  # clubs x seasons rows
    open_ = F.col("locked_scored").isNull()
    pairs = rated.withColumn("w", weight).groupBy("season", "round", "team_id", "opp_team_id", "is_home").agg(
        F.count("*").alias("games"), F.sum("w").alias("all_w"), F.coalesce(F.sum(F.when(open_, F.col("w"))), F.lit(0.0)).alias("w"),
        F.sum(F.col("w") * (F.col("scored") - F.coalesce("locked_scored", F.lit(0.0)))).alias("up"), F.sum(F.col("w") * (F.col("allowed") - F.coalesce("locked_allowed", F.lit(0.0)))).alias("down"),
    )
    clubs = base.select("season", F.lit(0).alias("round"), "team_id", F.lit(None).cast("long").alias("opp_team_id"), F.lit(False).alias("is_home"), F.lit(0).cast("long").alias("games"), F.lit(0.0).alias("w"), F.col("pf").alias("up"), F.col("pa").alias("down"))
    rows = clubs.unionByName(pairs.drop("all_w").withColumn("round", F.col("round").cast("int")))

    def fold(season: pd.DataFrame) -> pd.DataFrame:
        start = season[season["opp_team_id"].isna()].sort_values("team_id")
        played = season[season["opp_team_id"].notna()]
        ids = start["team_id"].to_numpy(np.int64)
        if not len(ids):
            return pd.DataFrame(columns=["season", "round", "team_id", "attack_adj", "defence_adj", "games"])
        pf, pa = start["up"].to_numpy(float), start["down"].to_numpy(float)
        level = pf.mean()
        attack, defence, games = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        out = []
        for number, part in played.sort_values(["round", "team_id", "opp_team_id", "is_home"]).groupby("round"):
            own, other = (np.searchsorted(ids, part[c].to_numpy(np.int64)) for c in ("team_id", "opp_team_id"))
            f, a = rating(pf, level, attack), rating(pa, level, defence)
            edge = np.where(part["is_home"].to_numpy(bool), home_points, -home_points)
            ours, theirs = match_scores(level, f[own], a[own], f[other], a[other], edge)
            w = part["w"].to_numpy(float)
            attack = attack + np.bincount(own, part["up"].to_numpy(float) - w * ours, len(ids))
            defence = defence + np.bincount(own, part["down"].to_numpy(float) - w * theirs, len(ids))
            games = games + np.bincount(own, part["games"].to_numpy(float), len(ids)).astype(np.int64)
            out.append(pd.DataFrame({"season": season["season"].iat[0], "round": number, "team_id": ids, "attack_adj": attack, "defence_adj": defence, "games": games}))
        return pd.concat(out) if out else pd.DataFrame(columns=["season", "round", "team_id", "attack_adj", "defence_adj", "games"])

    return rows.groupBy("season").applyInPandas(fold, "season long, round int, team_id long, attack_adj double, defence_adj double, games long")


def blend_rate(prior: Column, prior_minutes: Column, total: Column, minutes: Column) -> Column:
    """A rate per PER minutes whose prior counts ``prior_minutes``."""
    return (prior * prior_minutes + PER * total) / (prior_minutes + minutes)


def player_states(bases: DataFrame, lines: DataFrame, club_games: DataFrame, excused: DataFrame, counts: list[str], shares: dict[str, tuple[str, str]], as_of: int) -> DataFrame:
    """season, team_id, player_id, minutes, <stat> (per 40) and <share>, games_after, club_games: each player's state after round ``as_of``.

    ``bases``: season, team_id, player_id, base_round, base_minutes, prior_minutes, prior_<stat>, prior_<share> (unique players). ``lines``: season, team_id,
    player_id, game_id, round, seconds and the statistics; ``club_games``: season, team_id, game_id, round; ``excused``: player_id, game_id.
    ``shares`` names makes and attempts, both in counts. Games after the base round count: without recorded time a line is no evidence,
    a missed game counts as zero minutes unless it is excused. A null statistic or prior changes nothing of its own rate. Clubs with a counted
    game are scaled to 200 minutes, nobody over 40.
    """
    at, person = ["season", "team_id"], ["season", "team_id", "player_id"]
    based = bases.select(*person, "base_round")
    window = lambda df: df.where((F.col("round") > F.col("base_round")) & (F.col("round") <= as_of))
    played = window(lines.join(based, person))
    timed, minutes = F.col("seconds") > 0, F.col("seconds") / 60.0

    def over(*stats: str) -> list[Column]:
        """Sums of statistics and of minutes over the timed lines that record all of them."""
        recorded = reduce(and_, (F.col(x).isNotNull() for x in stats), timed)
        return [F.coalesce(F.sum(F.when(recorded, v)), F.lit(0.0)) for v in (*map(F.col, stats), minutes)]

    named = [x for s in counts for x in zip((f"t_{s}", f"m_{s}"), over(s))] + [x for k, (made, tried) in shares.items() for x in zip((f"t_{k}", f"__{k}", f"m_{k}"), over(made, tried))]
    sums = played.groupBy(*person).agg(F.count("*").alias("__lines"), F.count("seconds").alias("__known"), F.coalesce(F.sum(minutes), F.lit(0.0)).alias("observed"), F.count_if(timed).alias("games_after"), *(v.alias(k) for k, v in named))
    # games of the club in the window: a count for each base round, so that nobody meets each game of the club
    rounds = club_games.groupBy(*at, "round").agg(F.count("*").alias("__g"))
    whole = window(based.select(*at, "base_round").distinct().join(rounds, at)).groupBy(*at, "base_round").agg(F.sum("__g").alias("__games"))
    away = window(excused.select("player_id", "game_id").distinct().join(club_games, "game_id").join(based, person)).join(lines.select("season", "team_id", "player_id", "game_id"), [*person, "game_id"], "left_anti")
    away = away.groupBy(*person).agg(F.count("*").alias("__excused"))
    full = bases.join(whole, [*at, "base_round"], "left").join(sums, person, "left").join(away, person, "left")
    none = F.lit(0)
    counted = F.coalesce("__games", none) - F.coalesce("__lines", none) + F.coalesce("__known", none) - F.coalesce("__excused", none)
    k = F.col("base_round") + MINUTES_OFFSET
    blended = (k * F.col("base_minutes") + F.coalesce("observed", F.lit(0.0))) / (k + counted)
    rate = lambda s: F.when(F.col(f"m_{s}") > 0, blend_rate(F.col(f"prior_{s}"), F.col("prior_minutes"), F.col(f"t_{s}"), F.col(f"m_{s}"))).otherwise(F.col(f"prior_{s}"))
    out = full.withColumn("club_games", counted.cast("long")).withColumn("minutes", F.when(F.col("__games") > 0, blended).otherwise(F.col("base_minutes")))
    out = out.withColumns({s: rate(s) for s in counts}).withColumn("games_after", F.coalesce("games_after", none).cast("long"))
    share = {}
    for name, (_, tried) in shares.items():
        prior = F.when(F.col(f"prior_{tried}") == 0, F.coalesce(F.col(f"prior_{name}"), F.lit(0.0)) * 0.0).otherwise(F.col(f"prior_{name}") * F.col(f"prior_{tried}"))
        makes = F.when(F.col(f"m_{name}") > 0, blend_rate(prior, F.col("prior_minutes"), F.col(f"t_{name}"), F.col(f"m_{name}"))).otherwise(prior)
        fresh = F.when(F.col(tried) > 0, F.least(F.greatest(makes / F.col(tried), F.lit(0.0)), F.lit(1.0)))
        share[name] = F.when((F.col("games_after") > 0) & prior.isNotNull(), fresh).otherwise(F.col(f"prior_{name}"))
    out = out.withColumns(share).withColumn("__active", F.max(F.col("club_games") > 0).over(Window.partitionBy(*at)))
    scaled = normalised_minutes(out.where("minutes is not null"), at, "player_id", "minutes").withColumn("minutes", F.when(F.col("__active"), F.col("normalised")).otherwise(F.col("minutes")))
    columns = [*person, "minutes", *counts, *shares, "games_after", "club_games"]
    return scaled.select(*columns).unionByName(out.where("minutes is null").select(*columns))


def context_factor(opponent_defence: Column, side: Column, home_points: float, own_for: Column) -> Column:
    return opponent_defence + side * home_points / (2 * own_for)


def scorers(squad: DataFrame, form: DataFrame, per_club: int) -> DataFrame:
    """The ``per_club`` best of each (game_id, team_id): model points in context, mixed with form and its chance; nobody scores who cannot play.

    ``squad``: game_id, team_id, player_id, points, chance, factor; ``form``: game_id, player_id, form (null or no row: the model alone).
    """
    return best_scorers(squad.join(form, ["game_id", "player_id"], "left"), per_club)


def mixed_points(model: Column) -> Column:
    """Projected points of rows of chance and form from the model's points."""
    return F.when(F.col("chance") == 0, 0.0).when(F.col("form").isNull(), model).otherwise((1 - FORM_WEIGHT) * model + FORM_WEIGHT * F.col("form") * F.col("chance"))


def best_scorers(squad: DataFrame, per_club: int) -> DataFrame:
    """``scorers`` of rows that have their form."""
    rows = squad.withColumn("model_points", F.col("points") * F.col("factor")).withColumn("projected_points", mixed_points(F.col("model_points")))
    best = Window.partitionBy("game_id", "team_id").orderBy(F.desc("projected_points"), "player_id")  # a squad
    return rows.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= per_club).select("game_id", "team_id", "player_id", "chance", "model_points", "form", "projected_points", "place")


def slate_scorers(slate: DataFrame, players: DataFrame, per_club: int) -> DataFrame:
    """``scorers`` of whole squads in many games: only players who can be among the best at some factor of their club meet its games.

    ``slate``: game_id, season, team_id, factor; ``players``: season, team_id, player_id, points, chance, form (null: the model alone). A player's
    points lie between those at the lowest and at the highest factor of the club; who cannot reach the ``per_club``-th of the lower bounds is beaten in every game.
    """
    at = ["season", "team_id"]
    ends = slate.groupBy(*at).agg(F.min("factor").alias("__low"), F.max("factor").alias("__high"))
    able = players.join(F.broadcast(ends), at)  # clubs x seasons rows
    bounds = [mixed_points(F.col("points") * F.col(c)) for c in ("__low", "__high")]
    able = able.withColumns({"__least": F.least(*bounds), "__most": F.greatest(*bounds)})
    best = able.withColumn("__i", F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("__least"), "player_id"))).where(F.col("__i") <= per_club)
    bars = best.groupBy(*at).agg(F.min(F.when(F.col("__i") == per_club, F.col("__least"))).alias("__bar"))
    near = able.join(F.broadcast(bars), at).where(F.coalesce(F.col("__most") >= F.col("__bar"), F.lit(True)))
    return best_scorers(slate.join(near.drop("__low", "__high", "__least", "__most", "__bar"), at), per_club)


def form_points(lines: DataFrame, starts: DataFrame, games: int = FORM_GAMES) -> DataFrame:
    """game_id, player_id, form: mean points of a player's last ``games`` lines with time and points on days before the game's.

    ``starts`` has (game_id, player_id, start), one row of each; lines have player_id, game_id, game_date, seconds and pts.
    """
    asked = starts.select("player_id", "start").distinct()
    return starts.join(form_before(lines, asked, games), ["player_id", "start"]).select("game_id", "player_id", "form")


def form_before(lines: DataFrame, starts: DataFrame, games: int = FORM_GAMES) -> DataFrame:
    """player_id, start, form of every distinct (player_id, start) that has a line before it; see ``form_points``.

    A line carries the mean of the lines up to it; starts and lines are one timeline a player, on which a start takes the last line's, so that no start meets all lines.
    """
    usable = lines.where("seconds > 0 and pts is not null and player_id is not null and game_date is not null")
    recent = Window.partitionBy("player_id").orderBy("game_date", "game_id").rowsBetween(1 - games, 0)
    scored = usable.select("player_id", F.col("game_date").alias("__at"), F.lit(1).alias("__kind"), F.col("game_id").alias("__line"), sdiv(F.sum("pts").over(recent), F.count("*").over(recent)).alias("form"))
    asked = starts.where("player_id is not null and start is not null").select("player_id", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__line"), F.lit(None).cast("double").alias("form"))
    before = Window.partitionBy("player_id").orderBy("__at", "__kind", "__line").rowsBetween(Window.unboundedPreceding, 0)
    told = scored.unionByName(asked).withColumn("form", F.last("form", ignorenulls=True).over(before))
    return told.where("__kind = 0 and form is not null").select("player_id", F.col("__at").alias("start"), "form")
