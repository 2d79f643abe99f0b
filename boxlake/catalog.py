"""The metric catalogue: what each metric is, since when it was recorded, and the column expression that computes it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.functions import boxscore as b
from boxlake.functions.nullsafe import finite, sdiv


class Metric(NamedTuple):
    key: str
    category: str
    format: str
    higher_is_better: bool
    scope: str
    season_from: str
    game_from: str
    season_only: bool
    estimated_early: bool


# Key, category, display format, higher is better, scope, first season, first season of single games, only for seasons, estimated before 1996-97.
METRICS = tuple(
    Metric(*row)
    for row in (
        ("min", "volume", "minutes", True, "player+team", "1951-52", "1951-52", False, False),
        ("pts", "volume", "decimal1", True, "player+team", "1946-47", "1946-47", False, False),
        ("reb", "volume", "decimal1", True, "player+team", "1950-51", "1950-51", False, False),
        ("oreb", "volume", "decimal1", True, "player+team", "1973-74", "1973-74", False, False),
        ("dreb", "volume", "decimal1", True, "player+team", "1973-74", "1973-74", False, False),
        ("ast", "volume", "decimal1", True, "player+team", "1946-47", "1946-47", False, False),
        ("stl", "volume", "decimal1", True, "player+team", "1973-74", "1973-74", False, False),
        ("blk", "volume", "decimal1", True, "player+team", "1973-74", "1973-74", False, False),
        ("tov", "volume", "decimal1", False, "player+team", "1977-78", "1977-78", False, False),
        ("pf", "volume", "decimal1", False, "player+team", "1946-47", "1946-47", False, False),
        ("fgm", "volume", "decimal1", True, "player+team", "1946-47", "1946-47", False, False),
        ("fga", "volume", "decimal1", True, "player+team", "1946-47", "1946-47", False, False),
        ("fg3m", "volume", "decimal1", True, "player+team", "1979-80", "1979-80", False, False),
        ("fg3a", "volume", "decimal1", True, "player+team", "1979-80", "1979-80", False, False),
        ("ftm", "volume", "decimal1", True, "player+team", "1946-47", "1946-47", False, False),
        ("fta", "volume", "decimal1", True, "player+team", "1946-47", "1946-47", False, False),
        ("plus_minus", "impact", "plusMinus1", True, "player+team", "1996-97", "1996-97", False, False),
        ("gp", "volume", "integer", True, "player+team", "1946-47", "1946-47", False, False),
        ("gs", "volume", "integer", True, "player+team", "1970-71", "1970-71", False, False),
        ("fantasy_pts", "volume", "decimal1", True, "player", "1977-78", "1977-78", False, False),
        ("fg_pct", "shooting", "percent1", True, "player+team", "1946-47", "1946-47", False, False),
        ("fg3_pct", "shooting", "percent1", True, "player+team", "1979-80", "1979-80", False, False),
        ("ft_pct", "shooting", "percent1", True, "player+team", "1946-47", "1946-47", False, False),
        ("efg_pct", "shooting", "percent1", True, "player+team", "1946-47", "1996-97", False, False),
        ("ts_pct", "shooting", "percent1", True, "player+team", "1946-47", "1996-97", False, False),
        ("fg3a_rate", "shooting", "percent1", True, "player+team", "1979-80", "1979-80", False, False),
        ("ftr", "shooting", "percent1", True, "player+team", "1946-47", "1946-47", False, False),
        ("pps", "shooting", "decimal2", True, "player+team", "1946-47", "1946-47", False, False),
        ("off_rtg", "efficiency", "rating1", True, "player+team", "1996-97", "1996-97", False, True),
        ("def_rtg", "efficiency", "rating1", False, "player+team", "1996-97", "1996-97", False, True),
        ("net_rtg", "efficiency", "rating1", True, "player+team", "1996-97", "1996-97", False, False),
        ("usg_pct", "usage", "percent1", True, "player+team", "1977-78", "1996-97", False, True),
        ("ast_pct", "playmaking", "percent1", True, "player+team", "1946-47", "1996-97", False, True),
        ("ast_tov", "playmaking", "decimal2", True, "player+team", "1977-78", "1996-97", False, False),
        ("ast_ratio", "playmaking", "decimal1", True, "player+team", "1977-78", "1996-97", False, False),
        ("oreb_pct", "rebounding", "percent1", True, "player+team", "1973-74", "1996-97", False, True),
        ("dreb_pct", "rebounding", "percent1", True, "player+team", "1973-74", "1996-97", False, True),
        ("reb_pct", "rebounding", "percent1", True, "player+team", "1973-74", "1996-97", False, True),
        ("tov_pct", "usage", "percent1", False, "player+team", "1977-78", "1996-97", False, True),
        ("stl_pct", "defense", "percent1", True, "player+team", "1977-78", "1977-78", False, True),
        ("blk_pct", "defense", "percent1", True, "player+team", "1973-74", "1973-74", False, True),
        ("pace", "efficiency", "decimal1", True, "player+team", "1996-97", "1996-97", False, False),
        ("poss", "efficiency", "decimal1", True, "player+team", "1996-97", "1996-97", False, False),
        ("pie", "impact", "percent1", True, "player", "1996-97", "1996-97", False, False),
        ("game_score", "impact", "decimal1", True, "player", "1973-74", "1973-74", False, False),
        ("per", "impact", "decimal1", True, "player", "1951-52", "1951-52", True, True),
        ("ws", "impact", "decimal1", True, "player", "1951-52", "1951-52", True, True),
        ("ows", "impact", "decimal1", True, "player", "1951-52", "1951-52", True, True),
        ("dws", "impact", "decimal1", True, "player", "1951-52", "1951-52", True, True),
        ("ws48", "impact", "decimal2", True, "player", "1951-52", "1951-52", True, True),
        ("bpm", "impact", "plusMinus1", True, "player", "1973-74", "1973-74", True, True),
        ("obpm", "impact", "plusMinus1", True, "player", "1973-74", "1973-74", True, True),
        ("dbpm", "impact", "plusMinus1", True, "player", "1973-74", "1973-74", True, True),
        ("vorp", "impact", "decimal1", True, "player", "1973-74", "1973-74", True, True),
        ("opp_efg_pct", "defense", "percent1", False, "team", "1996-97", "1996-97", False, False),
        ("opp_tov_pct", "defense", "percent1", True, "team", "1996-97", "1996-97", False, False),
        ("opp_oreb_pct", "defense", "percent1", False, "team", "1996-97", "1996-97", False, False),
        ("opp_ftr", "defense", "percent1", False, "team", "1996-97", "1996-97", False, False),
        ("opp_pts", "scoring", "decimal1", False, "team", "1946-47", "1946-47", False, False),
        ("wins", "volume", "integer", True, "team", "1946-47", "1946-47", True, False),
        ("losses", "volume", "integer", False, "team", "1946-47", "1946-47", True, False),
        ("win_pct", "efficiency", "percent1", True, "team", "1946-47", "1946-47", True, False),
    )
)
BY_KEY = {m.key: m for m in METRICS}
# Fixed value: possessions, and what needs them, were recorded from this season.
TRACKED_FROM = "1996-97"

F100 = 100.0
#: What can be computed from the box columns (own, tm_, opp_); the others are only ever stored.
COMPUTED: dict[str, Callable[[], Column]] = {
    "reb": lambda: F.col("oreb") + F.col("dreb"),
    "fantasy_pts": b.fantasy_points,
    "fg_pct": lambda: sdiv(F.col("fgm"), F.col("fga")),
    "fg3_pct": lambda: sdiv(F.col("fg3m"), F.col("fg3a")),
    "ft_pct": lambda: sdiv(F.col("ftm"), F.col("fta")),
    "efg_pct": b.effective_fg_pct,
    "ts_pct": b.true_shooting_pct,
    "fg3a_rate": b.three_point_attempt_rate,
    "ftr": b.free_throw_rate,
    "pps": b.points_per_shot,
    "off_rtg": lambda: F.coalesce(b.offensive_rating(), F100 * sdiv(F.col("tm_pts"), b.possessions("tm_"))),
    "def_rtg": lambda: F.coalesce(b.defensive_rating(), b.team_defensive_rating()),
    "net_rtg": b.net_rating,
    "usg_pct": lambda: b.usage_pct() / F100,
    "ast_pct": lambda: b.assist_pct() / F100,
    "ast_tov": lambda: sdiv(F.col("ast"), F.col("tov")),
    "ast_ratio": b.assist_ratio,
    "oreb_pct": lambda: b.offensive_rebound_pct() / F100,
    "dreb_pct": lambda: b.defensive_rebound_pct() / F100,
    "reb_pct": lambda: b.rebound_pct() / F100,
    "tov_pct": lambda: b.turnover_pct() / F100,
    "stl_pct": lambda: b.steal_pct() / F100,
    "blk_pct": lambda: b.block_pct() / F100,
    "pace": b.pace,
    "poss": lambda: F.when(F.col("min") == 0, F.lit(0.0)).otherwise(sdiv(b.possessions("tm_") * F.col("min"), F.col("tm_min") / 5)),
    "pie": b.pie,
    "game_score": b.game_score,
    "opp_efg_pct": lambda: b.effective_fg_pct("opp_"),
    "opp_tov_pct": lambda: b.turnover_pct("opp_") / F100,
    "opp_oreb_pct": lambda: sdiv(F.col("opp_oreb"), F.col("opp_oreb") + F.col("tm_dreb")),
    "opp_ftr": lambda: b.free_throw_rate("opp_"),
    "opp_pts": lambda: F.col("opp_pts"),
}


def start_year(season: str) -> int:
    return int(season[:4])


def resolve(key: str, columns: list[str]) -> Column:
    """The metric: computed where it can be, else the stored column of its name; null without either. A KeyError for unknown keys."""
    metric = BY_KEY[key]
    stored = finite(F.col(key)) if key in columns else F.lit(None).cast("double")
    if metric.key not in COMPUTED:
        return stored.alias(key)
    return F.coalesce(finite(COMPUTED[key]()), stored).alias(key)


def availability(key: str, year: Column, per_game: bool = False) -> Column:
    """full, estimated or unavailable in the season that starts in ``year``."""
    m = BY_KEY[key]
    if per_game and m.season_only:
        return F.lit("unavailable")
    first = start_year(m.game_from if per_game else m.season_from)
    early = (year < start_year(TRACKED_FROM)) & F.lit(m.estimated_early)
    return F.when(year < first, "unavailable").when(early, "estimated").otherwise("full")


def era_masked(df: DataFrame, keys: list[str], year: str) -> DataFrame:
    """df with the metrics nulled in seasons that did not record them, and ``is_estimated`` where any is an estimate."""
    states = {k: availability(k, F.col(year)) for k in keys}
    estimated = F.lit(False)
    for state in states.values():
        estimated = estimated | (state == "estimated")
    return df.withColumns({k: F.when(s != "unavailable", F.col(k)) for k, s in states.items()} | {"is_estimated": estimated})


def dimension(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    return spark.createDataFrame(METRICS, "key string, category string, format string, higher_is_better boolean, scope string, season_from string, game_from string, season_only boolean, estimated_early boolean")
