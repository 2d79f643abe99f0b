"""Squads: the injury layer, minutes that add up, ledgers, and defence by position."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from boxlake.functions.nullsafe import sdiv

# Chances of playing by reported status; one without a report plays.
CHANCES = {"out": 0.0, "doubtful": 0.25, "questionable": 0.5, "probable": 0.85, "available": 1.0}


def model_chance(status: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in CHANCES.items() for v in kv))
    return F.coalesce(F.try_element_at(table, status), F.lit(1.0))


def injury_totals(players: DataFrame, squad: list[str], replacement: float = 0.225, absorb: float = 0.6, cap: float = 1.15, consistent: bool = True) -> DataFrame:
    """One row per squad from rows of minutes, points and chance: what absences cost, what team-mates recover, the boost and the availability factor.

    Where the cap on the boost binds, the consistent policy credits the rest at replacement level, the other leaves it unassigned.
    """
    return injury_layer(players.groupBy(*squad).agg(*(F.sum(v).alias(name) for name, v in contributions().items())), replacement, absorb, cap, consistent)


def contributions() -> dict[str, Column]:
    """What a player (minutes, points, chance) adds to the sums of a squad that the layer runs on."""
    m, p, c = F.col("minutes"), F.col("points"), F.col("chance")
    return {"full": p, "avail": p * c, "lost": p * (1 - c), "lost_min": m * (1 - c), "avail_min": m * c}


def injury_layer(sums: DataFrame, replacement: float = 0.225, absorb: float = 0.6, cap: float = 1.15, consistent: bool = True) -> DataFrame:
    """The layer on squads' sums; see ``injury_totals``."""
    repl = F.col("lost_min") * replacement
    out = sums.withColumn("absorbed", F.when(F.col("lost") >= repl, repl + absorb * (F.col("lost") - repl)).otherwise(F.col("lost")))
    wanted = 1 + sdiv(F.col("absorbed"), F.col("avail"))
    out = out.withColumn("boost", F.when(wanted.isNotNull(), F.least(wanted, F.lit(cap))).otherwise(1.0))
    out = out.withColumn("cap_binding", F.coalesce(wanted > cap, F.col("absorbed") > 0))
    given = (F.col("boost") - 1) * F.col("avail")
    if consistent:
        out = out.withColumn("effective", F.least("absorbed", (cap - 1) * F.col("avail") + repl)).withColumn("unassigned", F.lit(0.0))
    else:
        out = out.withColumn("effective", F.col("absorbed")).withColumn("unassigned", F.col("absorbed") - given)
    out = out.withColumn("squad_points", F.col("avail") + F.col("effective"))
    return out.withColumn("factor", F.coalesce(sdiv(F.col("squad_points"), F.col("full")), F.lit(1.0)))


def injury_players(players: DataFrame, totals: DataFrame, squad: list[str], rotation: float = 0.7, cap: float = 1.15) -> DataFrame:
    """players with projected points and minutes after the layer; squads are few and broadcast."""
    share = F.least(1 + rotation * F.col("lost_min") / F.greatest(F.col("avail_min"), F.lit(1)), F.lit(cap))
    both = players.join(F.broadcast(totals.select(*squad, "boost", "lost_min", "avail_min")), squad)
    played = F.col("chance")
    return both.withColumn("projected_points", F.col("points") * played * F.col("boost")).withColumn("projected_minutes", F.col("minutes") * played * share).drop("boost", "lost_min", "avail_min")


def scaled_to_total(value: Column, target: Column | float, squad: list[str]) -> Column:
    """Values scaled to add up to target; a squad of zeros stays as it is."""
    return F.coalesce(sdiv(value * target, F.sum(value).over(Window.partitionBy(*squad))), value)


def normalised_minutes(df: DataFrame, squad: list[str], key: str, minutes: str, total: float = 200.0, cap: float = 40.0) -> DataFrame:
    """df with ``normalised``: minutes scaled to ``total`` with nobody over ``cap``, the rest filling up what is left.

    With minutes in falling order, the players at the cap are the first ones; player i is over if the factor that is right with the i before held takes
    them past the cap. The first who is not over sets the factor of all the rest.
    """
    by, back = Window.partitionBy(*squad).orderBy(F.desc(minutes), key), Window.partitionBy(*squad).orderBy(F.asc(minutes), F.desc(key))
    m = F.col(minutes).cast("double")
    # the rest's minutes as a running sum from the last: a frame that ends with the squad is summed anew for every row
    out = df.withColumn("__i", F.row_number().over(by) - 1).withColumn("__mass", F.sum(m).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    left = total - cap * F.col("__i")
    out = out.withColumn("__f", F.when((left > 0) & (F.col("__mass") > 0), left / F.col("__mass")))
    out = out.withColumn("__over", F.coalesce(m * F.col("__f") > cap + 1e-12, F.lit(False)))
    whole = Window.partitionBy(*squad)
    first = F.min(F.when(~F.col("__over"), F.struct("__i", "__f"))).over(whole)
    out = out.withColumn("__first", first)
    held = F.col("__first").isNull() | (F.col("__i") < F.col("__first.__i"))
    value = F.when(held, F.lit(cap)).otherwise(F.coalesce(m * F.col("__first.__f"), m))
    return out.withColumn("normalised", value).drop("__i", "__mass", "__f", "__over", "__first")


def changed_only(ledger: DataFrame, keys: list[str], at: list[str], digest: str) -> DataFrame:
    """The rows that a ledger keeps: those whose digest differs from that of the row before."""
    before = F.lag(digest).over(Window.partitionBy(*keys).orderBy(*at))
    return ledger.withColumn("__before", before).where(~F.col(digest).eqNullSafe(F.col("__before"))).drop("__before")


def restamped(ledger: DataFrame, keys: list[str], at: list[str], digest: str) -> DataFrame:
    """keys, digest, first and stamped (struct of ``at``), runs: the rows that a ledger holds after all of its computations, one a key and digest.

    A computation with the newest row's digest leaves no trace; one with an older row's digest stamps that row again, so that it
    becomes the newest, and one with a new digest is appended. A row's stamp is thus the start of its digest's last run. A null digest is one of its own.
    """
    order = Window.partitionBy(*keys).orderBy(*at)
    when = F.struct(*at)
    starts = ledger.withColumn("__first", F.row_number().over(order) == 1).withColumn("__before", F.lag(digest).over(order)).where(F.col("__first") | ~F.col(digest).eqNullSafe(F.col("__before")))
    return starts.groupBy(*keys, digest).agg(F.min(when).alias("first"), F.max(when).alias("stamped"), F.count("*").alias("runs"))


def locked(ledger: DataFrame, keys: list[str], computed: str, deadline: str, tie: str) -> DataFrame:
    """Of each key the newest row computed before its deadline; at the deadline is too late."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(computed), F.desc(tie))
    return ledger.where(F.col(computed) < F.col(deadline)).withColumn("__i", F.row_number().over(newest)).where("__i = 1").drop("__i")


def allocated(lines: DataFrame, weights: str, keys: list[str]) -> DataFrame:
    """keys, bucket, points, minutes: opponents' lines dealt out by their map of position weights; no position is bucket ``unknown``."""
    known = F.coalesce(F.col(weights), F.create_map(F.lit("unknown"), F.lit(1.0)))
    dealt = lines.select(*keys, "points", "minutes", F.explode(known).alias("bucket", "w"))
    return dealt.groupBy(*keys, "bucket").agg(F.sum(F.col("points") * F.col("w")).alias("points"), F.sum(F.col("minutes") * F.col("w")).alias("minutes"))


@F.pandas_udf(DoubleType())
def bonferroni_z(family: pd.Series) -> pd.Series:
    """The one-sided 5 % normal quantile shared by so many tests; Spark has no inverse normal."""
    return family.map(lambda k: NormalDist().inv_cdf(1 - 0.05 / k) if k > 0 else None)


def defence_by_position(games: DataFrame, scope: list[str], team: str, least: int = 10, provisional: int = 25, gate: float = 0.2) -> DataFrame:
    """Per team and bucket: points allowed a game, the index against the league, shrunk by empirical Bayes, and a band.

    ``games`` has a row for each (scope, team, game, bucket) with points, games without points in a bucket included as 0. Bands are null
    for provisional teams and where the between-team variance is too small a part of the whole.
    """
    per = games.groupBy(*scope, team, "bucket").agg(F.count("*").alias("n"), F.avg("points").alias("allowed"), F.stddev_samp("points").alias("sd"), F.sum("points").alias("__sum"), F.count("points").alias("__n"))
    league = per.groupBy(*scope, "bucket").agg(sdiv(F.sum("__sum"), F.sum("__n")).alias("mu"))
    per = per.where((F.col("n") >= least) & (F.col("n") >= 2)).drop("__sum", "__n").join(league, [*scope, "bucket"])
    per = per.withColumn("raw_index", sdiv(F.col("allowed"), F.col("mu"))).withColumn("se", sdiv(F.col("sd") / F.sqrt("n"), F.col("mu")))
    across = Window.partitionBy(*scope, "bucket")
    noise = F.avg(F.col("se") * F.col("se")).over(across)
    per = per.withColumn("tau2", F.greatest(F.var_samp("raw_index").over(across) - noise, F.lit(0.0))).withColumn("reliability", F.coalesce(sdiv(F.col("tau2"), F.col("tau2") + noise), F.lit(0.0)))
    se2, both = F.col("se") * F.col("se"), F.col("tau2") + F.col("se") * F.col("se")
    per = per.withColumn("index", 1 + F.coalesce(sdiv(F.col("tau2"), both), F.lit(0.0)) * (F.col("raw_index") - 1)).withColumn("spread", F.coalesce(F.sqrt(sdiv(F.col("tau2") * se2, both)), F.lit(0.0)))
    family = per.groupBy(*scope).agg(F.count("*").alias("k")).select(*scope, bonferroni_z("k").alias("z"))
    per = per.join(family, scope)
    reach = F.col("z") * F.col("spread")
    band = F.when(F.col("index") + reach < 1, "better").when(F.col("index") - reach > 1, "worse").otherwise("typical")
    return per.withColumn("band", F.when((F.col("n") >= provisional) & (F.col("reliability") >= gate), band)).drop("sd", "z")


PRIOR_GAMES = 10  # fixed value: games that last season counts in a blend


def squad_stats(lines: DataFrame, key: str) -> DataFrame:
    """season, team_id, key, n, minutes, points: a season's squads (each player with the team of their newest game) and what to expect of them.

    Means of the season, with last season's as PRIOR_GAMES games; whichever exists where one is missing. ``lines``: season, team_id, game_date, game_id, min, pts.
    """
    newest = F.max_by("team_id", F.struct("game_date", "game_id"))
    now = lines.groupBy("season", key).agg(F.count("*").alias("n"), F.avg("min").alias("__minutes"), F.avg("pts").alias("__points"), newest.alias("team_id"))
    last = now.select((F.col("season") + 1).alias("season"), key, F.col("__minutes").alias("__minutes0"), F.col("__points").alias("__points0"))
    blend = lambda c: F.coalesce((F.col("n") * F.col(c) + PRIOR_GAMES * F.col(f"{c}0")) / (F.col("n") + PRIOR_GAMES), F.col(c), F.col(f"{c}0"))
    return now.join(last, ["season", key], "left").select("season", "team_id", key, "n", blend("__minutes").alias("minutes"), blend("__points").alias("points"))


def daily_factors(lines: DataFrame, entries: DataFrame, scope: list[str]) -> DataFrame:
    """scope, team_id, game_date, factor: how much of a squad's points its availability leaves, as of every day on which the team plays.

    A squad as of a day are the players whose newest line before it, in the scope's season, was the team's; what to expect of them is blended from the lines before
    that day and last season's, and their chance is that of the newest entry before it (1 without one). ``lines``: scope, player_id, team_id,
    game_date, game_id, min, pts, those with minutes count; ``entries``: scope, player_id, game_date (published), chance, one a day.

    Lines and entries are events of one timeline a player; each moves what the player adds to a team's sums, so running sums over a team's
    days give every day's squad without a join of days and players. Squads are counted in whole numbers, so that one that has emptied has no remainder.
    """
    player = [*scope, "player_id"]
    days = lines.where("min > 0").groupBy(*player, "game_date").agg(F.count("*").alias("n"), F.sum("min").alias("m"), F.sum("pts").alias("p"), F.max_by("team_id", "game_id").alias("team_id"))
    last = days.groupBy(*player).agg(F.sum("n").alias("__n"), *((F.sum(c) / F.sum("n")).alias(f"__{c}0") for c in "mp")).drop("__n").withColumn("season", F.col("season") + 1)
    both = days.join(entries.select(*player, "game_date", "chance"), [*player, "game_date"], "full").join(last, player, "left")
    past = Window.partitionBy(*player).orderBy("game_date").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.coalesce("n", F.lit(0))).over(past)
    blend = lambda c: F.coalesce((F.sum(c).over(past) + PRIOR_GAMES * F.col(f"__{c}0")) / (n + PRIOR_GAMES), F.sum(c).over(past) / n)
    known = both.select(*player, "game_date", F.last("team_id", True).over(past).alias("team_id"), blend("m").alias("minutes"), blend("p").alias("points"), F.coalesce(F.last("chance", True).over(past), F.lit(1.0)).alias("chance"))
    after = known.where("team_id is not null").select(*player, "game_date", "team_id", F.lit(1).alias("members"), F.when(F.col("chance") < 1, 1).otherwise(0).alias("doubtful"), *(v.alias(name) for name, v in contributions().items()))
    sums = ["members", "doubtful", *contributions()]
    before = Window.partitionBy(*player).orderBy("game_date")
    gone = after.select(*scope, F.lag("team_id").over(before).alias("team_id"), "game_date", *((-F.lag(s).over(before)).alias(s) for s in sums)).where("team_id is not null")
    moves = after.select(*scope, "team_id", "game_date", *sums).unionByName(gone).groupBy(*scope, "team_id", "game_date").agg(*(F.sum(s).alias(s) for s in sums))
    played = lines.select(*scope, "team_id", "game_date").distinct().withColumn("__plays", F.lit(True))
    run = Window.partitionBy(*scope, "team_id").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    as_of = moves.join(played, [*scope, "team_id", "game_date"], "full").select(*scope, "team_id", "game_date", "__plays", *(F.sum(s).over(run).alias(s) for s in sums)).where("__plays")
    held = (F.col("members") > 0) & (F.col("doubtful") > 0)  # without a doubt in force the factor is 1
    return injury_layer(as_of).select(*scope, "team_id", "game_date", F.when(held, F.col("factor")).otherwise(1.0).alias("factor"))
