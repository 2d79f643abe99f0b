"""Box-score formulas as column expressions.

Own columns have plain names (pts, fga, min, ...), the team's have the prefix tm_, the opponent's opp_. Percentages in
the name's _pct form are on the 0-100 scale where the function says so and fractions elsewhere. Nulls propagate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.nullsafe import positive, sdiv, zero_if

# Weights of the published formulas.
FT = 0.44
OLIVER_FT = 0.4
FOUR_FACTORS = (("efg_pct", 0.40), ("tov_pct", 0.25), ("oreb_pct", 0.20), ("ft_rate", 0.15))


Known = dict[str, Column] | None


def c(name: str) -> Column:
    return F.col(name)


def of(formula: Callable[[Known], Column], known: Known) -> Column:
    """The formula's column where it is computed already, else its expression."""
    return known[formula.__name__] if known and formula.__name__ in known else formula(known)


def staged(df: DataFrame, steps: list[list[Callable[[Known], Column]]]) -> DataFrame:
    """df with a column for every formula, each step built on the columns of those before it, so that no expression is repeated."""
    known: dict[str, Column] = {}
    for step in steps:
        df = df.withColumns({f.__name__: f(known) for f in step})
        known |= {f.__name__: c(f.__name__) for f in step}
    return df


def possessions(p: str = "") -> Column:
    return c(p + "fga") + FT * c(p + "fta") - c(p + "oreb") + c(p + "tov")


def effective_fg_pct(p: str = "") -> Column:
    return sdiv(c(p + "fgm") + 0.5 * F.coalesce(c(p + "fg3m"), F.lit(0)), c(p + "fga"))


def true_shooting_pct(p: str = "") -> Column:
    return sdiv(c(p + "pts"), 2 * (c(p + "fga") + FT * c(p + "fta")))


def three_point_attempt_rate(p: str = "") -> Column:
    return sdiv(c(p + "fg3a"), c(p + "fga"))


def free_throw_rate(p: str = "") -> Column:
    return sdiv(c(p + "fta"), c(p + "fga"))


def points_per_shot(p: str = "") -> Column:
    return sdiv(c(p + "pts"), c(p + "fga"))


def turnover_pct(p: str = "") -> Column:
    """0-100."""
    return 100 * sdiv(c(p + "tov"), c(p + "fga") + FT * c(p + "fta") + c(p + "tov"))


def assist_ratio(p: str = "") -> Column:
    """0-100."""
    return 100 * sdiv(c(p + "ast"), c(p + "fga") + FT * c(p + "fta") + c(p + "ast") + c(p + "tov"))


def _share(own: Column, whole: Column) -> Column:
    """100 * own per minute over the whole per team minute."""
    return 100 * sdiv(own * positive(c("tm_min")) / 5, positive(c("min")) * whole)


def usage_pct() -> Column:
    return _share(c("fga") + FT * c("fta") + c("tov"), c("tm_fga") + FT * c("tm_fta") + c("tm_tov"))


def assist_pct() -> Column:
    made = positive(sdiv(positive(c("min")), positive(c("tm_min")) / 5) * c("tm_fgm") - c("fgm"))
    return 100 * sdiv(c("ast"), made)


def rebound_pct() -> Column:
    return _share(c("oreb") + c("dreb"), c("tm_oreb") + c("tm_dreb") + c("opp_oreb") + c("opp_dreb"))


def offensive_rebound_pct() -> Column:
    return _share(c("oreb"), c("tm_oreb") + c("opp_dreb"))


def defensive_rebound_pct() -> Column:
    return _share(c("dreb"), c("tm_dreb") + c("opp_oreb"))


def steal_pct() -> Column:
    return _share(c("stl"), possessions("opp_"))


def block_pct() -> Column:
    return _share(c("blk"), positive(c("opp_fga") - F.coalesce(c("opp_fg3a"), F.lit(0))))


def pace() -> Column:
    return 48 * sdiv(possessions("tm_") + possessions("opp_"), 2 * positive(c("tm_min")) / 5)


def game_score() -> Column:
    return (
        c("pts") + 0.4 * c("fgm") - 0.7 * c("fga") - 0.4 * (c("fta") - c("ftm")) + 0.7 * c("oreb") + 0.3 * c("dreb")
        + c("stl") + 0.7 * c("ast") + 0.7 * c("blk") - 0.4 * c("pf") - c("tov")
    )


def fantasy_points() -> Column:
    return c("pts") + 1.2 * (c("oreb") + c("dreb")) + 1.5 * c("ast") + 3 * c("stl") + 3 * c("blk") - c("tov")


# Offensive rating: the chain of individual possessions and points produced.


def _missed_both(made: Column, tried: Column) -> Column:
    """Share of free-throw trips that score at least once."""
    return 1 - (1 - sdiv(made, tried)) * (1 - sdiv(made, tried))


def q_assist(known: Known = None) -> Column:
    share = sdiv(positive(c("min")), positive(c("tm_min")) / 5)
    with_him = share * (1.14 * sdiv(c("tm_ast") - c("ast"), c("tm_fgm")))
    per = lambda x: sdiv(x, c("tm_min")) * c("min") * 5
    without = sdiv(per(c("tm_ast")) - c("ast"), per(c("tm_fgm")) - c("fgm")) * (1 - share)
    return with_him + without


def fg_part(known: Known = None) -> Column:
    return zero_if(c("fga") == 0, c("fgm") * (1 - 0.5 * sdiv(c("pts") - c("ftm"), 2 * c("fga")) * of(q_assist, known)))


def assist_part(known: Known = None) -> Column:
    return 0.5 * sdiv((c("tm_pts") - c("tm_ftm")) - (c("pts") - c("ftm")), 2 * (c("tm_fga") - c("fga"))) * c("ast")


def ft_part(known: Known = None) -> Column:
    return zero_if(c("fta") == 0, _missed_both(c("ftm"), c("fta")) * OLIVER_FT * c("fta"))


def team_scoring_possessions(known: Known = None) -> Column:
    return c("tm_fgm") + zero_if(c("tm_fta") == 0, _missed_both(c("tm_ftm"), c("tm_fta")) * c("tm_fta") * OLIVER_FT)


def team_oreb_pct(known: Known = None) -> Column:
    return sdiv(c("tm_oreb"), c("tm_oreb") + c("opp_dreb"))


def team_play_pct(known: Known = None) -> Column:
    return sdiv(of(team_scoring_possessions, known), c("tm_fga") + OLIVER_FT * c("tm_fta") + c("tm_tov"))


def team_oreb_weight(known: Known = None) -> Column:
    o, play = of(team_oreb_pct, known), of(team_play_pct, known)
    return sdiv((1 - o) * play, (1 - o) * play + o * (1 - play))


def oreb_part(known: Known = None) -> Column:
    return c("oreb") * of(team_oreb_weight, known) * of(team_play_pct, known)


def _team_discount(known: Known = None) -> Column:
    return 1 - sdiv(c("tm_oreb"), of(team_scoring_possessions, known)) * of(team_oreb_weight, known) * of(team_play_pct, known)


def scoring_possessions(known: Known = None) -> Column:
    return (of(fg_part, known) + of(assist_part, known) + of(ft_part, known)) * of(_team_discount, known) + of(oreb_part, known)


def missed_fg_possessions(known: Known = None) -> Column:
    return (c("fga") - c("fgm")) * (1 - 1.07 * of(team_oreb_pct, known))


def missed_ft_possessions(known: Known = None) -> Column:
    miss = 1 - sdiv(c("ftm"), c("fta"))
    return zero_if(c("fta") == 0, miss * miss * OLIVER_FT * c("fta"))


def total_possessions(known: Known = None) -> Column:
    return of(scoring_possessions, known) + of(missed_fg_possessions, known) + of(missed_ft_possessions, known) + c("tov")


def floor_pct(known: Known = None) -> Column:
    return sdiv(of(scoring_possessions, known), of(total_possessions, known))


def points_produced(known: Known = None) -> Column:
    three = lambda p: F.coalesce(c(p + "fg3m"), F.lit(0))
    field = zero_if(c("fga") == 0, 2 * (c("fgm") + 0.5 * three("")) * (1 - 0.5 * sdiv(c("pts") - c("ftm"), 2 * c("fga")) * of(q_assist, known)))
    others = c("tm_fgm") - c("fgm")
    passed = 2 * sdiv(others + 0.5 * (three("tm_") - three("")), others) * of(assist_part, known)
    boards = c("oreb") * of(team_oreb_weight, known) * of(team_play_pct, known) * sdiv(c("tm_pts"), of(team_scoring_possessions, known))
    return (field + passed + c("ftm")) * of(_team_discount, known) + boards


def offensive_rating(known: Known = None) -> Column:
    return 100 * sdiv(of(points_produced, known), of(total_possessions, known))


OFFENCE = [[team_scoring_possessions, team_oreb_pct, q_assist, assist_part, ft_part], [team_play_pct, fg_part, missed_fg_possessions, missed_ft_possessions], [team_oreb_weight], [_team_discount, oreb_part], [scoring_possessions, points_produced], [total_possessions]]

# Defensive rating: stops and the points a scoring possession costs.


def defensive_fg_pct(known: Known = None) -> Column:
    return sdiv(c("opp_fgm"), c("opp_fga"))


def defensive_oreb_pct(known: Known = None) -> Column:
    return sdiv(c("opp_oreb"), c("opp_oreb") + c("tm_dreb"))


def missed_fg_weight(known: Known = None) -> Column:
    shot, board = of(defensive_fg_pct, known), of(defensive_oreb_pct, known)
    return sdiv(shot * (1 - board), shot * (1 - board) + (1 - shot) * board)


def stops1(known: Known = None) -> Column:
    return c("stl") + c("blk") * of(missed_fg_weight, known) * (1 - 1.07 * of(defensive_oreb_pct, known)) + c("dreb") * (1 - of(missed_fg_weight, known))


def stops2(known: Known = None) -> Column:
    per = lambda x: sdiv(x, positive(c("tm_min")))
    shots = per(c("opp_fga") - c("opp_fgm") - c("tm_blk")) * of(missed_fg_weight, known) * (1 - 1.07 * of(defensive_oreb_pct, known))
    lost = per(c("opp_tov") - c("tm_stl"))
    miss = 1 - sdiv(c("opp_ftm"), c("opp_fta"))
    fouls = zero_if(c("opp_fta") == 0, sdiv(c("pf"), c("tm_pf")) * OLIVER_FT * c("opp_fta") * miss * miss)
    return (shots + lost) * positive(c("min")) + fouls


def stops(known: Known = None) -> Column:
    return of(stops1, known) + of(stops2, known)


def stop_pct(known: Known = None) -> Column:
    return sdiv(of(stops, known) * c("opp_min"), possessions("tm_") * positive(c("min")))


def points_per_scoring_possession_allowed(known: Known = None) -> Column:
    return sdiv(c("opp_pts"), c("opp_fgm") + zero_if(c("opp_fta") == 0, _missed_both(c("opp_ftm"), c("opp_fta")) * c("opp_fta") * OLIVER_FT))


def team_defensive_rating(known: Known = None) -> Column:
    return 100 * sdiv(c("opp_pts"), possessions("tm_"))


def defensive_rating(known: Known = None) -> Column:
    team = of(team_defensive_rating, known)
    return team + 0.2 * (100 * of(points_per_scoring_possession_allowed, known) * (1 - of(stop_pct, known)) - team)


DEFENCE = [[defensive_fg_pct, defensive_oreb_pct, points_per_scoring_possession_allowed, team_defensive_rating], [missed_fg_weight], [stops1, stops2], [stops], [stop_pct]]


def net_rating(known: Known = None) -> Column:
    return of(offensive_rating, known) - of(defensive_rating, known)


def _pie_terms(p: str) -> Column:
    return (
        c(p + "pts") + c(p + "fgm") + c(p + "ftm") - c(p + "fga") - c(p + "fta") + c(p + "dreb") + 0.5 * c(p + "oreb")
        + c(p + "ast") + c(p + "stl") + 0.5 * c(p + "blk") - c(p + "pf") - c(p + "tov")
    )


def pie() -> Column:
    return sdiv(_pie_terms(""), _pie_terms("tm_") + _pie_terms("opp_"))


def vorp(bpm: Column, team_games: Column) -> Column:
    return (bpm + 2) * sdiv(c("min"), positive(c("tm_min")) / 5) * team_games / 82


def four_factors(p: str = "tm_", o: str = "opp_") -> dict[str, Column]:
    return {"efg_pct": effective_fg_pct(p), "tov_pct": turnover_pct(p) / 100, "oreb_pct": sdiv(c(p + "oreb"), c(p + "oreb") + c(o + "dreb")), "ft_rate": free_throw_rate(p)}


def per_mode(value: Column, mode: str, games: Column, minutes: Column, poss: Column, pace_: Column) -> Column:
    """A total as Totals, PerGame, Per36 or Per100 (stored possessions, else those that pace and minutes imply)."""
    if mode == "Totals":
        return value
    if mode == "PerGame":
        return sdiv(value, games)
    if mode == "Per36":
        return sdiv(36 * value, positive(minutes))
    if mode == "Per100":
        return sdiv(100 * value, F.coalesce(positive(poss), positive(pace_ * minutes / 48)))
    raise ValueError(f"unknown mode: {mode}")


def shrunk_pct(makes: Column, attempts: Column, league: Column, k: float) -> Column:
    return sdiv(makes + k * league, attempts + k)
