"""Parsers, catalogue, projection and squad operators against small worked cases and brute force."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from boxlake import catalog
from boxlake.functions import parsing as p
from boxlake.operators import projection, squads, valuation


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "parser, text, want",
    [
        (p.parse_int, "2.5", 2), (p.parse_int, " 3.5 ", 4), (p.parse_int, "--", None), (p.parse_int, "x", None), (p.parse_float, "NaN", None), (p.parse_float, "1e3", 1000.0),
        (p.parse_bool, "Yes", True), (p.parse_bool, "f", False), (p.parse_bool, "2", None), (p.parse_minutes, "34:12", 34.2), (p.parse_minutes, "PT34M12.00S", 34.2), (p.parse_minutes, "7.5", 7.5),
        (p.parse_minutes, None, None), (p.parse_date, "2025-10-21T00:00:00", date(2025, 10, 21)), (p.parse_date, "Oct 21, 2025", date(2025, 10, 21)), (p.parse_date, "10/21/2025", date(2025, 10, 21)),
        (p.parse_date, "20251021", date(2025, 10, 21)), (p.parse_date, "soon", None), (p.season_from_game_id, "0022500001", "2025-26"), (p.season_from_game_id, "0029900001", "1999-00"),
        (p.season_type_from_game_id, "0042500001", "Playoffs"), (p.season_type_from_game_id, "0092500001", None), (p.opponent_from_matchup, "LAL vs. BOS", "BOS"), (p.opponent_from_matchup, "LAL @ BOS", "BOS"),
        (p.is_home_from_matchup, "LAL @ BOS", False), (p.position_weights, "Guard - Forward", {"G": 0.5, "F": 0.5}), (p.position_weights, "Centre", {"C": 1.0}), (p.position_weights, "PG-SG", None), (p.fold_name, "Dončić  Łuka-2", "doncic luka 2"), (p.fold_name, None, None),
    ],
)
def test_parsers(spark, parser, text, want):
    assert one(spark, parser, text) == (pytest.approx(want) if isinstance(want, float) else want)


@pytest.mark.parametrize("kind, value, want", [("decimal1", 2.25, "2.3"), ("percent1", 0.4567, "45.7%"), ("plusMinus1", 3.0, "+3.0"), ("plusMinus1", -0.01, "0.0"), ("plusMinus1", -2.0, "-2.0"), ("integer", 2.5, "3"), ("decimal2", None, "—")])
def test_format(spark, kind, value, want):
    assert one(spark, lambda x: p.format_value(kind, x), value, "double") == want


@pytest.mark.parametrize("minutes, want", [(240.0, 0), (265.0, 1), (250.0, None), (230.0, None)])
def test_overtimes(spark, minutes, want):
    assert one(spark, p.overtime_periods, minutes, "double") == want


def test_catalogue(spark):
    assert len(catalog.METRICS) == 62 == len(catalog.BY_KEY) == catalog.dimension(spark).count()
    assert set(catalog.COMPUTED) <= set(catalog.BY_KEY)
    df = spark.createDataFrame([(1970, 3.0, 2.0), (1990, 3.0, 2.0)], "y int, stl double, usg_pct double")
    assert [tuple(x) for x in catalog.era_masked(df, ["stl", "usg_pct"], "y").orderBy("y").collect()] == [(1970, None, None, False), (1990, 3.0, 2.0, True)]
    stored = spark.createDataFrame([(None, 5, 0.4)], "fgm int, fga int, fg_pct double")
    assert stored.select(catalog.resolve("fg_pct", stored.columns)).first()[0] == 0.4


@pytest.mark.parametrize("mean, alpha", [(0.0, 0.1), (0.4, 0.0), (3.5, 0.0), (12.2, 0.08), (30.0, 0.4), (2.5, 1.0), (180.0, 0.01)])
def test_count_interval(spark, mean, alpha):
    got = projection.with_intervals(spark.createDataFrame([(mean, alpha)], "m double, a double"), "m", "a").first()
    low, high = got["low"], got["high"]
    if mean == 0:
        assert (low, high) == (0, 0)
        return
    size = 1 / alpha if alpha else None
    pmf = lambda k: math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if not alpha else math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(size / (size + mean)) + k * math.log(mean / (size + mean)))
    lo = hi = round(mean)
    while sum(map(pmf, range(lo, hi + 1))) < 0.8:
        lo, hi = (lo - 1, hi) if lo and pmf(lo - 1) >= pmf(hi + 1) else (lo, hi + 1)
    assert (low, high) == (lo, hi)


def test_intervals_of_nulls(spark):
    df = spark.createDataFrame([(3.0, 0.1), (None, 0.1), (3.0, None)], "m double, a double")
    got = projection.with_intervals(df, "m", "a").select("low", "high").collect()
    assert got[1]["low"] is None and got[0]["high"] >= got[0]["low"] and got[2]["low"] is not None


def water_filled(minutes, total, cap):
    held, now = set(), dict(minutes)
    while True:
        free = [k for k in now if k not in held]
        room, mass = total - cap * len(held), sum(minutes[k] for k in free)
        if not free or room <= 0 or mass <= 0:
            return now
        over = [k for k in free if minutes[k] * room / mass > cap + 1e-12]
        if not over:
            return now | {k: minutes[k] * room / mass for k in free}
        held |= set(over)
        now |= dict.fromkeys(over, cap)


@pytest.mark.parametrize("minutes", [[30, 30, 20, 10, 5, 5, 1], [48, 48, 2, 1, 1, 0], [10, 10, 10], [0, 0], [40, 39, 38, 37, 36, 35, 2]])
def test_minutes(spark, minutes):
    df = spark.createDataFrame([("a", i, float(m)) for i, m in enumerate(minutes)], "t string, k int, m double")
    got = {r["k"]: r["normalised"] for r in squads.normalised_minutes(df, ["t"], "k", "m").collect()}
    assert got == pytest.approx(water_filled(dict(enumerate(map(float, minutes))), 200.0, 40.0))


def test_injury_cap(spark):
    df = spark.createDataFrame([("a", 30.0, 20.0, 0.0), ("a", 30.0, 20.0, 1.0), ("b", 30.0, 9.0, 0.0)], "t string, minutes double, points double, chance double")
    a, b = squads.injury_totals(df, ["t"], cap=1.1).orderBy("t").collect()
    assert a["boost"] == 1.1 and a["cap_binding"] and a["effective"] == pytest.approx(min(6.75 + 0.6 * 13.25, 2 + 6.75)) and a["factor"] == pytest.approx((20 + a["effective"]) / 40)
    assert b["boost"] == 1.0 and b["cap_binding"] and b["squad_points"] == pytest.approx(6.75)
    w = squads.injury_totals(df, ["t"], cap=1.1, consistent=False).orderBy("t").first()
    assert w["unassigned"] == pytest.approx(w["absorbed"] - 2)


def test_defence_bands(spark):
    rows = [(1, t, g, "G", float(20 + 8 * (t == 1) - 8 * (t == 2) + g % 3)) for t in range(6) for g in range(30)]
    got = {r["team"]: r["band"] for r in squads.defence_by_position(spark.createDataFrame(rows, "s int, team int, game int, bucket string, points double"), ["s"], "team").collect()}
    assert got[1] == "worse" and got[2] == "better" and got[0] == "typical"


@pytest.mark.parametrize("net, want", [(0.5, "fair"), (1.0, "slight win"), (-1.0, "slight loss"), (2.0, "clear win"), (-3.0, "clear loss")])
def test_verdict(spark, net, want):
    assert one(spark, valuation.verdict, net, "double") == want


def test_context(spark):
    known = lambda x: projection.context_multiplier(x * 101, x * 99, x * 100, x * 110, x * 100, x > 0, (x * 5).cast("int"))
    assert one(spark, known, 1.0, "double") == pytest.approx(1.01 * 0.99 * 1.1 * 1.012 * 1.005)
    assert one(spark, known, None, "double") == pytest.approx(0.988)
