"""Projection fits, trade scenarios, pages and the second league against plain loops and edge cases."""

import datetime
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxlake.operators import league, paging, projection, ratings, squads, valuation
from boxlake.plans import outlooks

DAY = datetime.date(2001, 1, 1)


def test_round_fold_equals_a_loop(spark):
    rng = random.Random(5)
    base = {t: (rng.uniform(75, 90), rng.uniform(75, 90)) for t in range(6)}
    played = []
    for rnd in (1, 2, 4):
        for k in range(5):
            h, a = rng.sample(range(7), 2)  # team 6 has no prior
            played.append((rnd, DAY + datetime.timedelta(rnd), 10 * rnd + k, h, a, rng.randint(60, 100), rng.randint(60, 100), rng.random() < 0.3))
    level = sum(f for f, _ in base.values()) / 6
    up, down, n, want = defaultdict(float), defaultdict(float), defaultdict(int), {}
    for rnd in (1, 2, 4):
        start = dict(up), dict(down)
        rated = lambda t, i, start=start: level + 0.7 * (base[t][i] - level) + start[i].get(t, 0)
        for _, _, _, h, a, x, y, lock in sorted((g for g in played if g[0] == rnd), key=lambda g: g[2]):
            n[h], n[a] = n[h] + 1, n[a] + 1
            if 6 in (h, a):
                continue
            home, away = (80.0, 79.0) if lock else (rated(h, 0) * rated(a, 1) / level + 1.5, rated(a, 0) * rated(h, 1) / level - 1.5)
            for t, s, c, p, q in ((h, x, y, home, away), (a, y, x, away, home)):
                w = {1: 0.10, 2: 0.09}.get(n[t], 1 / (n[t] + 9))
                up[t] += w * (s - p)
                down[t] += w * (c - q)
        for t in base:
            want[rnd, t] = (up[t], down[t])
    rows = []
    for rnd, day, g, h, a, x, y, lock in played:
        rows.append((2001, rnd, day, g, h, a, True, float(x), float(y), *((80.0, 79.0) if lock else (None, None))))
        rows.append((2001, rnd, day, g, a, h, False, float(y), float(x), *((79.0, 80.0) if lock else (None, None))))
    schema = "season long, round int, game_date date, game_id long, team_id long, opp_team_id long, is_home boolean, scored double, allowed double, locked_scored double, locked_allowed double"
    priors = spark.createDataFrame([(2001, t, f, a) for t, (f, a) in base.items()], "season long, team_id long, pf double, pa double")
    sides = spark.createDataFrame(rows, schema)
    got = {(r.round, r.team_id): (r.attack_adj, r.defence_adj) for r in league.round_fold(sides, priors, 3.0).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    assert league.round_fold(sides, priors.limit(0), 3.0).count() == 0
    assert league.round_fold(sides.limit(0), priors, 3.0).count() == 0


def test_player_states(spark):
    bases = spark.createDataFrame(
        [(1, 7, 1, 2, 20.0, 100.0, 16.0, 10.0, 0.5), (1, 7, 2, 2, 10.0, 100.0, None, 0.0, None), (1, 8, 3, 2, 15.0, 100.0, 12.0, 8.0, 0.4), (1, 7, 4, 2, None, 100.0, 12.0, 8.0, 0.4)],
        "season long, team_id long, player_id long, base_round int, base_minutes double, prior_minutes double, prior_pts double, prior_fga double, prior_pct double",
    )
    lines = spark.createDataFrame(
        [(1, 7, 1, 50, 3, 1200, 15, 5, 8), (1, 7, 1, 51, 4, None, 9, 3, 6), (1, 7, 1, 49, 2, 2400, 40, 9, 9), (1, 7, 1, 53, 9, 2400, 40, 9, 9), (1, 7, 2, 50, 3, 600, None, 1, None)],
        "season long, team_id long, player_id long, game_id long, round int, seconds long, pts long, fgm long, fga long",
    )
    club = spark.createDataFrame([(1, 7, 49, 2), (1, 7, 50, 3), (1, 7, 51, 4), (1, 7, 52, 5), (1, 7, 53, 9)], "season long, team_id long, game_id long, round int")
    excused = spark.createDataFrame([(2, 51), (2, 51), (2, 50), (2, 53)], "player_id long, game_id long")
    out = {r.player_id: r for r in league.player_states(bases, lines, club, excused, ["pts", "fga"], {"pct": ("fgm", "fga")}, 5).collect()}
    # player 1: games 50 (20 min) and 52 (missed) count, 51 has no time: (5 * 20 + 20) / (5 + 2); player 2: 50 and 52, 51 is excused: (5 * 10 + 10) / (5 + 2)
    one, two = 120 / 7, 60 / 7
    assert (out[1].club_games, out[2].club_games, out[1].games_after) == (2, 2, 1)
    assert (out[1].minutes, out[2].minutes) == (40.0, 40.0) and one + two < 200  # two men cannot fill 200 minutes
    assert out[1].pts == pytest.approx((16 * 100 + 40 * 15) / 120) and out[1].fga == pytest.approx((10 * 100 + 40 * 8) / 120)
    assert out[1].pct == pytest.approx((0.5 * 10 * 100 + 40 * 5) / (10 * 100 + 40 * 8))
    assert out[2].pts is None and out[2].pct is None
    assert (out[3].minutes, out[3].pts, out[3].pct, out[3].club_games) == (15.0, 12.0, 0.4, 0)  # nothing was added
    assert out[4].minutes is None
    assert league.player_states(bases.limit(0), lines, club, excused, ["pts", "fga"], {"pct": ("fgm", "fga")}, 5).count() == 0


def test_scorers_and_form(spark):
    lines = spark.createDataFrame([(1, g, DAY + datetime.timedelta(g), 600 if g != 3 else 0, None if g == 4 else g) for g in range(15)], "player_id long, game_id long, game_date date, seconds long, pts long")
    starts = spark.createDataFrame([(99, 1, DAY + datetime.timedelta(13)), (98, 2, DAY)], "game_id long, player_id long, start date")
    form = league.form_points(lines, starts)
    used = [g for g in range(13) if g not in (3, 4)][-10:]
    assert [(r.game_id, r.form) for r in form.collect()] == [(99, sum(used) / 10)]
    squad = spark.createDataFrame([(99, 5, 1, 10.0, 0.5, 1.1), (99, 5, 2, 10.0, 1.0, 1.1), (99, 5, 3, 50.0, 0.0, 1.0)], "game_id long, team_id long, player_id long, points double, chance double, factor double")
    out = league.scorers(squad, form, 2).orderBy("place").collect()
    assert [r.player_id for r in out] == [2, 1] and out[0].projected_points == pytest.approx(11.0)
    assert out[1].projected_points == pytest.approx(0.75 * 11 + 0.25 * sum(used) / 10 * 0.5)


def test_trade_scenarios(spark):
    lines = spark.createDataFrame([(i, float(i), float(20 - i)) for i in range(1, 9)], "p long, pts double, ast double")
    trades = spark.createDataFrame([(1, [1], [8]), (2, [], []), (3, None, [None, 77]), (4, [8, 7], [1])], "trade_id long, give array<long>, get array<long>")
    out = {r.trade_id: r for r in valuation.trade_sensitivity(trades, lines, ["pts", "ast"], "p", 4, 2, 2).collect()}
    for t in (2, 3):
        assert (out[t].base, out[t].low, out[t].high, out[t].low_scenario, out[t].flips) == (0.0, 0.0, 0.0, "base", False)
    assert out[1].low <= out[1].base <= out[1].high and out[4].low < out[4].high

    def total(scaled):
        own = {i: (i * scaled.get(i, 1.0), (20 - i) * scaled.get(i, 1.0)) for i in range(1, 9)}
        pool = sorted(own, key=lambda i: (-round(own[i][0], 6), i))[:4]
        z = dict.fromkeys(own, 0.0)
        for c in (0, 1):
            m = sum(own[i][c] for i in pool) / 4
            s = math.sqrt(sum((own[i][c] - m) ** 2 for i in pool) / 4)
            for i in own:
                z[i] += (own[i][c] - m) / s if s > 0 else 0
        z = {i: round(v, 6) for i, v in z.items()}
        ranked = sorted(z, key=lambda i: (-z[i], i))[2:4]
        return z, sum(z[i] for i in ranked) / 2

    def nets(give, get):
        found = []
        for _, side, minutes, games in valuation.SCENARIOS:
            struck = {"give": give, "get": get, "all": give + get}[side]
            z, spare = total(dict.fromkeys(struck, minutes))
            k = lambda name, side=side, games=games: games / 82 if games and side == name else 1.0
            found.append(sum(z[i] * k("get") for i in get) - sum(z[i] * k("give") for i in give) + (len(give) - len(get)) * spare)
        return found

    for t, give, get in ((1, [1], [8]), (4, [8, 7], [1])):
        want = nets(give, get)
        assert (out[t].base, out[t].low, out[t].high) == pytest.approx((want[0], min(want), max(want)))
    assert valuation.trade_sensitivity(trades.limit(0), lines, ["pts", "ast"], "p", 4, 2, 2).count() == 0
    assert {r.base for r in valuation.trade_sensitivity(trades, lines.limit(0), ["pts", "ast"], "p", 4, 2, 2).collect()} == {0.0}


def test_count_probabilities(spark):
    df = spark.createDataFrame([(2.5, 0.3), (2.5, 0.0), (0.0, 0.3), (None, 0.1)], "m double, a double")
    nb, poisson, nothing, unknown = (r[0] for r in df.select(projection.count_probabilities(F.col("m"), F.col("a"), 60)).collect())
    assert sum(nb) == pytest.approx(1, abs=1e-6) and sum(k * p for k, p in enumerate(nb)) == pytest.approx(2.5, abs=1e-4)
    assert poisson[3] == pytest.approx(math.exp(-2.5) * 2.5**3 / 6)
    assert nothing[0] == 1 and sum(nothing) == 1 and unknown is None


def test_context_keeps_published_values_where_rows_are_few(spark):
    rows = [(11.0, 10.0, True, 1)] * 30 + [(9.0, 10.0, False, None)] * 5 + [(None, 10.0, True, 0), (5.0, 0.0, True, 0)]
    df = spark.createDataFrame(rows, "actual double, raw double, is_home boolean, rest_days int")
    out = {(r.factor, r.bucket): (r.n, round(r.value, 9), r.fitted) for r in projection.fitted_context(df).collect()}
    assert out["venue", 1] == (30, 1.1, True) and out["venue", 0] == (5, 0.988, False)
    assert out["rest", 1] == (30, 1.0, True) and out["rest", 0] == (0, 0.985, False) and len(out) == 6
    assert len(projection.fitted_context(df.limit(0)).collect()) == 6


def test_dispersion_counts_only_recorded_lines(spark):
    cols = ", ".join(f"{s} int" for s in projection.STATS)
    rows = [(1, 1, 30, *[5] * 7), (1, 1, 30, None, *[5] * 6), (1, 1, 4, *[99] * 7), (2, 1, None, *[5] * 7)]
    df = spark.createDataFrame(rows, f"p int, s int, min int, {cols}")
    alphas = projection.pooled_alphas(df, "p")
    got = projection.dispersion_multipliers(df, alphas, "p", ["s"]).collect()
    assert [r.p for r in got] == [1]
    league_rate, k, _ = projection.STATS["pts"]
    mu = 30 * (5 + k * league_rate) / (30 + k)
    assert got[0].c_pts == pytest.approx(((5 - mu) ** 2 / (mu + alphas.first().alpha_pts * mu * mu) + 60) / 61)
    assert set(projection.pooled_alphas(df.limit(0), "p").first()) == {0.0}


def test_pages(spark):
    rows = spark.createDataFrame([(1, i, DAY + datetime.timedelta(i // 2)) for i in range(9)], "p int, id long, d date")
    cursor = paging.encoded_cursor(F.struct(F.lit(DAY + datetime.timedelta(3)).alias("d"), F.lit(7).cast("long").alias("id")))
    page = lambda c: [r.id for r in paging.page_after(rows.withColumn("c", c), ["p"], "c", "d date, id long", {"d": "d", "id": "id"}, 3).orderBy("place").collect()]
    assert page(cursor) == [6, 5, 4]
    assert page(F.lit(None).cast("string")) == [8, 7, 6] and page(F.lit("no cursor!")) == [8, 7, 6]


def test_squads_and_spreads(spark):
    lines = spark.createDataFrame([(1, 5, DAY, 1, 1, 10, 4), (2, 6, DAY, 2, 1, 20, 8), (2, 7, DAY + datetime.timedelta(1), 3, 1, 30, 12)], "season long, team_id long, game_date date, game_id long, p long, min long, pts long")
    out = {r.season: r for r in squads.squad_stats(lines, "p").collect()}
    assert (out[1].minutes, out[1].team_id) == (10.0, 5) and out[2].team_id == 7 and out[2].minutes == pytest.approx((2 * 25 + 10 * 10) / 12)
    rows = [(1, False, 3.0, 1.0)] * 3 + [(2, True, 1.0, 1.0)] * 2 + [(3, True, 2.0, 0.0)] * 3 + [(2, None, None, 1.0)]
    got = {r.season: (r.source, r.games, r.team_sd, r.margin_sd) for r in ratings.fitted_spreads(spark.createDataFrame(rows, "season long, locked boolean, home double, away double"), 3).collect()}
    assert got[1] == (None, 0, None, None) and got[2] == ("fittedPrevSeason", 3, pytest.approx(math.sqrt(5)), 2.0) and got[3] == ("fittedLedger", 3, pytest.approx(math.sqrt(2)), 2.0)


def test_trades_of_the_same_keys_are_valued_once(spark, monkeypatch):
    """Distinct trades alone reach Python; ids beyond 2^53 beside nulls stay whole."""
    far = 2**60 + 1
    lines = spark.createDataFrame([(far + i, float(i % 7), float(i % 11)) for i in range(60)], "p long, pts double, ast double")
    trades = spark.createDataFrame([(i, [far + 2, None], [far + 3]) if i % 2 else (i, [far + 3], [far + 9]) for i in range(400)], "trade_id long, give array<long>, get array<long>")
    out = valuation.trade_sensitivity(trades, lines, ["pts", "ast"], "p", 10, 2, 2)
    rows = out.collect()
    assert sorted(r.trade_id for r in rows) == list(range(400)) and len({(r.base, r.low, r.high) for r in rows}) == 2 and all(r.base for r in rows)
    assert "MapInPandas" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" in plan[plan.index("MapInPandas") :]


def test_minutes_of_a_large_squad(spark):
    """Time and results of a squad of 60,000: a frame that ends with the squad takes its square."""
    squad = spark.range(60_000, numPartitions=3).select(F.lit(1).alias("t"), F.col("id").alias("k"), (F.col("id") * 7919 % 60_000 / 1e6).alias("m")).unionByName(spark.createDataFrame([(1, -1, 9e6), (1, -2, 9e5)], "t int, k long, m double"))
    out = squads.normalised_minutes(squad, ["t"], "k", "m")
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()
    total, top = out.agg(F.sum("normalised"), F.sum(F.when(F.col("k") < 0, F.col("normalised")))).first()
    assert total == pytest.approx(200.0) and top == 80.0


def test_slate_scorers_equal_all_players_in_all_games(spark):
    rng = random.Random(8)
    slate = [(g, 2000 + g % 2, t, rng.uniform(0.8, 1.2)) for g in range(12) for t in (g % 3, 3 + g % 3)]
    players = [(s, t, p, None if p % 13 == 0 else float(rng.randrange(-3, 30)), rng.choice([0.0, 0.5, 1.0]), rng.choice([None, float(rng.randrange(30))])) for s in (2000, 2001) for t in range(6) for p in range(3 if t == 4 else 60)]
    games = spark.createDataFrame(slate, "game_id long, season long, team_id long, factor double")
    squad = spark.createDataFrame(players, "season long, team_id long, player_id long, points double, chance double, form double")
    whole = league.best_scorers(games.join(squad, ["season", "team_id"]), 5)
    got, want = (sorted(df.collect(), key=lambda r: (r.game_id, r.team_id, r.place)) for df in (league.slate_scorers(games, squad, 5), whole))
    assert got == want and len(got) > 80


def test_form_meets_no_start_with_all_lines(spark):
    rng = random.Random(9)
    lines = {(rng.randrange(6), g, DAY + datetime.timedelta(rng.randrange(30)), rng.choice([None, 0, 600]), rng.choice([None, 3, 8, 21])) for g in range(300)}
    starts = [(1000 + 40 * p + d, p, DAY + datetime.timedelta(d)) for p in range(7) for d in range(0, 32, 3)]
    lined, asked = spark.createDataFrame(sorted(lines, key=str), "player_id long, game_id long, game_date date, seconds long, pts long"), spark.createDataFrame(starts, "game_id long, player_id long, start date")
    form = league.form_points(lined, asked, 4)
    assert "Join" not in league.form_before(lined, asked)._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g, p, day in starts:
        last = sorted((x[2], x[1], x[4]) for x in lines if x[0] == p and x[2] < day and x[3] and x[4] is not None)[-4:]
        if last:
            want[g] = sum(x[2] for x in last) / len(last)
    assert {r.game_id: r.form for r in form.collect()} == pytest.approx(want)


def test_equal_players_have_no_spread(spark):
    """The mean of equal values may be rounded; what is left is no spread, and such a category counts nothing."""
    lines = spark.createDataFrame([(i, 57.392857143 / 3, 0.1, float(i)) for i in range(60)], "p long, pts double, ast double, stl double")
    trades = spark.createDataFrame([(1, [55], [2])], "trade_id long, give array<long>, get array<long>")
    base = valuation.trade_sensitivity(trades, lines, ["pts", "ast", "stl"], "p", 50, 5, 5).first().base
    sd = math.sqrt((50 * 50 - 1) / 12)
    assert base == pytest.approx((2 - 55) / sd, abs=1e-5)


def test_rates_stand_beside_their_lines(spark):
    """Lines dealt by player meet their player's and season's rates without another shuffle; lines without a key are left out."""
    cols = ", ".join(f"{s} int" for s in projection.STATS)
    rows = [(p, s, 30, *[(p or 0) + (s or 0)] * 7) for p in (1, 2, None) for s in (1, 2, None) for _ in range(3)]
    dealt = spark.createDataFrame(rows, f"p int, s int, min int, {cols}").repartition(5, "p")
    counts = projection.expected_counts(dealt, ["p", "s"], ["p", "s"])
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    league, k, _ = projection.STATS["pts"]
    got = {(r.p, r.s): r.mu_pts for r in counts.collect()}
    assert got == pytest.approx({(p, s): 30 * (3 * (p + s) + k * league) / (90 + k) for p in (1, 2) for s in (1, 2)})


def test_intervals_project_players_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(outlooks, "next_lines", lambda *at, real=outlooks.next_lines: made.append(at) or real(*at))
    assert {r.stat for r in outlooks.stat_intervals(spark, "/root/testdata/sf0.001").select("stat").distinct().collect()} == {*projection.STATS, "pts+reb+ast"}
    assert len(made) == 1
