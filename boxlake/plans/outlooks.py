"""Queries over projections of all statistics, trade scenarios, and the second league's model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions import boxscore as b
from boxlake.functions.nullsafe import sdiv
from boxlake.operators import league, paging, projection, ratings, squads, valuation
from boxlake.operators.projection import STATS
from boxlake.operators.store import staged
from boxlake.plans.queries import CATS, query, r, rounded
from boxlake.plans.squads import CHANCE_SQL, STATUS, VALUED_SQL, player_seasons
from boxlake.plans.widgets import with_home
from boxlake.sources.tables import BOX_SQL, SIDES_SQL, box_view, by_player, games, sides, table

SCOPE = ["season", "season_type"]


def stat_box(spark, sf_dir):
    return box_view(spark, sf_dir).withColumn("reb", F.col("oreb") + F.col("dreb"))


def _each(text: str) -> str:
    """text for every statistic: S is its name, L, K and H its league rate, stabilising minutes and half-life."""
    return ", ".join(text.replace("{S}", s).replace("{L}", str(v[0])).replace("{K}", str(v[1])).replace("{H}", str(v[2])) for s, v in STATS.items())


ALPHA_SQL = f"""lines as (select *, oreb + dreb reb from box where "min" >= 5),
 own as (select player_id, {_each('(sum({S}) + {K} * {L}) / (sum("min") + {K}) r_{S}')} from lines group by 1),
 mu as (select l.*, {_each('l."min" * r_{S} mu_{S}')} from lines l join own using (player_id)),
 alpha as (select {_each('greatest(sum((pow({S} - mu_{S}, 2) - mu_{S}) * mu_{S} * mu_{S}) / sum(pow(mu_{S}, 4)), 0.0) alpha_{S}')} from mu),
 yearly as (select player_id, season, season_type, {_each('(sum({S}) + {K} * {L}) / (sum("min") + {K}) y_{S}')} from lines group by 1, 2, 3),
 spread as (select l.player_id, count(*) n, {_each('(sum(pow({S} - l."min" * y_{S}, 2) / (l."min" * y_{S} + alpha_{S} * pow(l."min" * y_{S}, 2))) + 60.0) / (count(*) + 60.0) c_{S}')} from lines l join yearly using (player_id, season, season_type), alpha group by 1)"""


@query(f"with {BOX_SQL}, {ALPHA_SQL} select * from alpha")
def pooled_dispersions(spark, sf_dir):
    """The fitted dispersion of each of the seven statistics."""
    return projection.pooled_alphas(stat_box(spark, sf_dir), "player_id")


@query(f"with {BOX_SQL}, {ALPHA_SQL} select player_id, {_each('c_{S}')} from spread")
def player_dispersions(spark, sf_dir):
    """How much each player varies beyond the pool, statistic by statistic."""
    box = stat_box(spark, sf_dir)
    return projection.dispersion_multipliers(box, projection.pooled_alphas(box, "player_id"), "player_id", SCOPE)


FORM_SQL = """tempo as (select season, season_type, team_id, game_date, 48 * ((tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov) + (opp_fga + 0.44 * opp_fta - opp_oreb + opp_tov)) / (2 * tm_min / 5) pace, 100 * opp_pts / nullif(tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov, 0) drtg from sides),
 average as (select season, season_type, avg(pace) l_pace, avg(drtg) l_drtg from tempo group by 1, 2),
 daily as (select season, season_type, team_id, game_date, sum(pace) p, sum(drtg) d, count(*) c from tempo group by 1, 2, 3, 4),
 before as (select season, season_type, team_id, game_date, sum(p) over w / sum(c) over w pace, sum(d) over w / sum(c) over w drtg from daily window w as (partition by season, season_type, team_id order by game_date rows between unbounded preceding and 1 preceding))"""


def form_before_day(spark, sf_dir):
    """season, season_type, team_id, game_date, pace, drtg: a team's means of the season before the day, and l_pace, l_drtg, the scope's own means. Games are summed by day before they are run over."""
    s = sides(box_view(spark, sf_dir)).select(*SCOPE, "team_id", "game_date", b.pace().alias("pace"), b.team_defensive_rating().alias("drtg"))
    daily = staged(s.groupBy(*SCOPE, "team_id", "game_date").agg(F.sum("pace").alias("p"), F.sum("drtg").alias("d"), F.count("*").alias("c")))  # a row a team and day, read for the average and the running means
    average = daily.groupBy(*SCOPE).agg((F.sum("p") / F.sum("c")).alias("l_pace"), (F.sum("d") / F.sum("c")).alias("l_drtg"))
    w = Window.partitionBy(*SCOPE, "team_id").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: sdiv(F.sum(c).over(w), F.sum("c").over(w))
    return daily.select(*SCOPE, "team_id", "game_date", so_far("p").alias("pace"), so_far("d").alias("drtg")).join(F.broadcast(average), SCOPE)  # a row a season


def with_context(rows, spark, sf_dir):
    """rows (season, season_type, team_id, opp_id, game_date) with pace and opponent means before the day, the league's where a side has none."""
    form = staged(form_before_day(spark, sf_dir))  # a row a team and day, read for both sides
    other = form.select(*SCOPE, F.col("team_id").alias("opp_id"), "game_date", F.col("pace").alias("opp_pace"), F.col("drtg").alias("opp_drtg"))
    both = rows.join(form.drop("drtg"), [*SCOPE, "team_id", "game_date"]).join(other, [*SCOPE, "opp_id", "game_date"])
    fill = {"pace": "l_pace", "opp_pace": "l_pace", "opp_drtg": "l_drtg"}
    return both.withColumns({c: F.coalesce(c, to) for c, to in fill.items()})


GAP_SQL = "date_diff('day', lag(game_date) over (partition by player_id order by game_date, game_id), game_date)"
REST_SQL = f"case when {GAP_SQL} is not null then least(greatest({GAP_SQL}, 0), 3) end"


@query(f"""with {SIDES_SQL}, {FORM_SQL}, lines as (select *, team_id = home_id is_home, case when team_id = home_id then away_id else home_id end opp_id, {REST_SQL} rest from box),
 own as (select player_id, (sum(pts) + 81 * 0.4182) / (sum("min") + 81) rate from lines group by 1),
 c as (select l.pts actual, l.is_home, l.rest, l."min" * o.rate * (coalesce(f.pace, l_pace) * coalesce(g.pace, l_pace) / (l_pace * l_pace)) * (coalesce(g.drtg, l_drtg) / l_drtg) raw from lines l join own o using (player_id)
   join average a on a.season = l.season and a.season_type = l.season_type
   join before f on f.season = l.season and f.season_type = l.season_type and f.team_id = l.team_id and f.game_date = l.game_date join before g on g.season = l.season and g.season_type = l.season_type and g.team_id = l.opp_id and g.game_date = l.game_date),
 v as (select cast(is_home as int) bucket, count(*) n, sum(actual) num, sum(raw) den from c group by 1), vf as (select d.bucket, coalesce(n, 0) n, case when n >= 25 then num / den else d.f end "value", coalesce(n >= 25, false) fitted from (values (0, 0.988), (1, 1.012)) d(bucket, f) left join v using (bucket)),
 w as (select rest bucket, count(*) n, sum(actual) num, sum(raw * "value") den from c join vf on vf.bucket = cast(is_home as int) where rest is not null group by 1)
 select 'venue' factor, * from vf union all select 'rest', d.bucket, coalesce(n, 0), case when n >= 25 then num / den else d.f end, coalesce(n >= 25, false) from (values (0, 0.985), (1, 1.0), (2, 1.005), (3, 1.005)) d(bucket, f) left join w using (bucket)""")
def context_calibration(spark, sf_dir):
    """Venue and rest factors fitted on all lines, with the published values where a bucket has too few."""
    box = box_view(spark, sf_dir)
    before = F.lag("game_date").over(Window.partitionBy("player_id").orderBy("game_date", "game_id"))
    lines = box.select(*SCOPE, "team_id", "game_date", "player_id", "pts", "min", (F.col("team_id") == F.col("home_id")).alias("is_home"), F.expr("if(team_id = home_id, away_id, home_id)").alias("opp_id"), F.datediff("game_date", before).alias("rest_days"))
    own = box.groupBy("player_id").agg(projection.padded_rate("pts", F.sum("pts"), F.sum("min")).alias("rate"))
    full = with_context(lines.join(own, "player_id"), spark, sf_dir)
    pace = F.col("pace") * F.col("opp_pace") / (F.col("l_pace") * F.col("l_pace"))
    raw = F.col("min") * F.col("rate") * pace * F.col("opp_drtg") / F.col("l_drtg")
    return projection.fitted_context(full.select(F.col("pts").alias("actual"), raw.alias("raw"), "is_home", "rest_days"))


NEXT_SQL = f"""with {SIDES_SQL}, {FORM_SQL}, {ALPHA_SQL}, o as (select *, oreb + dreb reb, row_number() over (partition by player_id order by game_date desc, game_id desc) - 1 k from box),
 t as (select *, team_id = home_id is_home, case when team_id = home_id then away_id else home_id end opp_id from o where k = 0),
 h as (select o.*, o.k - 1 age, o.season = t.season and o.season_type = t.season_type here, t.game_date - o.game_date gap from o join t using (player_id) where o.k > 0),
 p as (select player_id, least(greatest(sum(pow(0.5, age / 2.0) * "min") / sum(pow(0.5, age / 2.0)), 0), 48) minutes_mean, min(gap) rest, sum("min") cm, coalesce(sum("min") filter (here), 0) sm, count(*) filter (here) sg,
   {_each('cast(sum({S}) as double) ct_{S}, cast(coalesce(sum({S}) filter (here), 0) as double) s_{S}, sum(pow(0.5, age / {H}) * {S}) / sum(pow(0.5, age / {H})) f_{S}, sum(pow(0.5, age / {H}) * "min") / sum(pow(0.5, age / {H})) fm_{S}')} from h group by 1),
 x0 as (select t.player_id, coalesce(f.pace, l_pace) * coalesce(g.pace, l_pace) / (l_pace * l_pace) pace_factor, coalesce(g.drtg, l_drtg) / l_drtg opponent_factor, case when is_home then 1.012 else 0.988 end venue_factor, case least(greatest(p.rest, 0), 3) when 0 then 0.985 when 1 then 1.0 else 1.005 end rest_factor from t join p using (player_id)
   join average a on a.season = t.season and a.season_type = t.season_type
   join before f on f.season = t.season and f.season_type = t.season_type and f.team_id = t.team_id and f.game_date = t.game_date join before g on g.season = t.season and g.season_type = t.season_type and g.team_id = t.opp_id and g.game_date = t.game_date),
 x as (select *, pace_factor * opponent_factor * venue_factor * rest_factor context from x0),
 base as (select p.*, x.* exclude (player_id), {_each('(sm / (sm + 400.0)) * (s_{S} + {K} * {L}) / (sm + {K}) + (1 - sm / (sm + 400.0)) * (ct_{S} + {K} * {L}) / (cm + {K}) b_{S}')} from p join x using (player_id)),
 m as (select base.*, {_each('greatest(minutes_mean * (0.75 * b_{S} + 0.25 * coalesce(f_{S} / nullif(fm_{S}, 0), b_{S})) * context, 0) mean_{S}')} from base),
 e as (select m.*, {_each('greatest(c_{S} * alpha_{S} + coalesce((c_{S} - 1) / nullif(mean_{S}, 0), 0), 0) effective_{S}')} from m left join spread using (player_id), alpha),
 z as (select e.*, {_each('sqrt(mean_{S} + effective_{S} * mean_{S} * mean_{S}) sd_{S}')} from e)"""


def next_lines(spark, sf_dir):
    """Every player's newest game, projected from the games before it: minutes, context, and the seven statistics."""
    played = staged(stat_box(spark, sf_dir).select(*SCOPE, "game_id", "game_date", "team_id", "home_id", "away_id", "player_id", "min", *STATS))
    box = by_player(spark, sf_dir, played)
    aged = projection.aged(box, ["player_id"], ["game_date", "game_id"])
    target = aged.where("age = 0").select("player_id", *SCOPE, "team_id", "game_date", (F.col("team_id") == F.col("home_id")).alias("is_home"), F.expr("if(team_id = home_id, away_id, home_id)").alias("opp_id"))
    newest = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))  # the order of age, so that lines are sorted once
    history = aged.withColumns({"__s": F.first("season").over(newest), "__t": F.first("season_type").over(newest)}).where("age > 0").withColumn("age", F.col("age") - 1)
    here = (F.col("season") == F.col("__s")) & (F.col("season_type") == F.col("__t"))
    sums = [F.max("game_date").alias("last"), *projection.minute_sums("min")]
    for s, (_, _, halflife) in STATS.items():
        form = lambda c, h=halflife: projection.decayed(F.col(c).cast("double"), h)[0]
        known = F.col(s).isNotNull()
        sums += [F.sum(s).alias(f"c_total_{s}"), F.sum(F.when(known, F.col("min"))).alias(f"cm_{s}"), F.sum(F.when(here, F.col(s))).alias(f"s_{s}"), F.sum(F.when(here & known, F.col("min"))).alias(f"sm_{s}"), F.count_if(here & known).alias(f"sg_{s}"), form(s).alias(f"f_{s}"), form("min").alias(f"fm_{s}")]
    totals = history.groupBy("player_id").agg(*sums).withColumn("minutes_mean", projection.minute_range()[0]).drop("__m", "__sd")
    alphas = staged(projection.pooled_alphas(box, "player_id"))  # one row
    spread = projection.dispersion_multipliers(box, alphas, "player_id", SCOPE)
    placed = with_context(target, spark, sf_dir).join(totals, "player_id").join(spread, "player_id", "left").crossJoin(F.broadcast(alphas))  # one row of alphas
    factors = projection.context_factors(F.col("pace"), F.col("opp_pace"), F.col("l_pace"), F.col("opp_drtg"), F.col("l_drtg"), F.col("is_home"), F.datediff("game_date", "last"))
    placed = placed.withColumns({f"{name}_factor": factor for name, factor in factors.items()})
    return projection.project_stats(placed.withColumn("context", F.col("pace_factor") * F.col("opponent_factor") * F.col("venue_factor") * F.col("rest_factor")))


@query(NEXT_SQL + " " + " union all ".join(f"select player_id, '{s}' stat, minutes_mean, context, mean_{s} mean, sd_{s} sd, effective_{s} alpha, mean_{s} - s_{s} / nullif(sg, 0) delta from z" for s in STATS))
def stat_projections(spark, sf_dir):
    """Seven statistics of every player: mean in context, spread, fitted dispersion and the distance from the season's average."""
    return each_stat(next_lines(spark, sf_dir))


def each_stat(lines):
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(f"mean_{s}").alias("mean"), F.col(f"sd_{s}").alias("sd"), F.col(f"effective_{s}").alias("alpha"), F.col(f"delta_{s}").alias("delta")) for s in STATS))).alias("x")
    return lines.select("player_id", "minutes_mean", "context", each).select("player_id", "x.stat", "minutes_mean", "context", "x.mean", "x.sd", "x.alpha", "x.delta")


def combined_lines(lines):
    trio = {s: F.col(f"sd_{s}") for s in ("pts", "reb", "ast")}
    sd, alone = projection.combined(trio), F.sqrt(sum(x * x for x in trio.values()))
    out = lines.select("player_id", (F.col("mean_pts") + F.col("mean_reb") + F.col("mean_ast")).alias("mean"), sd.alias("sd"), alone.alias("sd_alone"))
    alpha = F.coalesce(sdiv(F.greatest(F.col("sd") * F.col("sd") - F.col("mean"), F.lit(0.0)), F.col("mean") * F.col("mean")), F.lit(0.0))
    return out.withColumn("inflation", F.coalesce(sdiv(F.col("sd"), F.col("sd_alone")) - 1, F.lit(0.0))).withColumn("alpha", alpha)


COMBINED_SQL = """, q as (select player_id, mean_pts + mean_reb + mean_ast mean, sqrt(sd_pts * sd_pts + sd_reb * sd_reb + sd_ast * sd_ast + 2 * 0.30 * sd_pts * sd_reb + 2 * 0.17 * sd_pts * sd_ast + 2 * 0.20 * sd_reb * sd_ast) sd, sqrt(sd_pts * sd_pts + sd_reb * sd_reb + sd_ast * sd_ast) sd_alone from z)"""


@query(NEXT_SQL + COMBINED_SQL + """
  select *, coalesce(sd / nullif(sd_alone, 0) - 1, 0) inflation, coalesce(greatest(sd * sd - mean, 0) / nullif(mean * mean, 0), 0) alpha from q""")
def combined_projections(spark, sf_dir):
    """Points, rebounds and assists together, with correlated spread, and what independence would have given."""
    return combined_lines(next_lines(spark, sf_dir))


@query(NEXT_SQL.replace("with ", "with recursive ", 1) + COMBINED_SQL + ", ib as (" + " union all ".join(f"select player_id, '{s}' stat, mean_{s} mean, effective_{s} alpha from z" for s in STATS) + " union all select player_id, 'pts+reb+ast', mean, coalesce(greatest(sd * sd - mean, 0) / nullif(mean * mean, 0), 0) from q), " + projection.interval_sql("ib", "player_id, stat") + " select player_id, stat, mean, al alpha, low, high from intervals")
def stat_intervals(spark, sf_dir):
    """The 80 % count intervals of those projections, and of points, rebounds and assists together."""
    lines = staged(next_lines(spark, sf_dir))  # a row a player, read for the statistics and their sums
    both = each_stat(lines).select("player_id", "stat", "mean", "alpha").unionByName(combined_lines(lines).select("player_id", F.lit("pts+reb+ast").alias("stat"), "mean", "alpha"))
    return projection.with_intervals(both, "mean", "alpha")


SCENARIO_SQL = ", ".join(f"({i}, '{n}', '{side}', {m}, {'1.0' if g is None else f'{g} / 82.0'})" for i, (n, side, m, g) in enumerate(valuation.SCENARIOS))


@query(VALUED_SQL.split(", p as (select")[0] + f""", legs as (select p_partkey trade_id, case when p_partkey % 2 = 0 then 'give' else 'get' end side, p_size player_id from part union all select p_partkey, case when p_partkey % 3 = 0 then 'give' else 'get' end, p_size + 1 from part where p_partkey % 3 < 2),
 kept as (select distinct legs.* from legs join l using (player_id)), trades as (select distinct trade_id from legs), sc(i, name, hits, minutes, games) as (values {SCENARIO_SQL}),
 own as (select trades.trade_id, i, l.player_id, k.side, case when k.side is not null and (hits = 'all' or hits = k.side) then games else 1.0 end share, {", ".join(f"{s} * case when k.side is not null and (hits = 'all' or hits = k.side) then minutes else 1.0 end {s}" for s in CATS)}
   from trades cross join sc cross join l left join kept k on k.trade_id = trades.trade_id and k.player_id = l.player_id),
 seeds as (select * from own qualify row_number() over (partition by trade_id, i order by round(pts, 6) desc, player_id) <= 50),
 mom as (select trade_id, i, {", ".join(f"avg({s}) m_{s}, stddev_pop({s}) s_{s}" for s in CATS)} from seeds group by 1, 2),
 v as (select trade_id, i, player_id, side, share, round({" + ".join(f"case when s_{s} > 0 then ({s} - m_{s}) / s_{s} else 0 end" for s in CATS)}, 6) total from own join mom using (trade_id, i)),
 rep as (select trade_id, i, avg(total) filter (k > 5 and k <= 10) rv from (select *, row_number() over (partition by trade_id, i order by total desc, player_id) k from v) group by 1, 2),
 net as (select trade_id, i, round(coalesce(sum(case side when 'get' then total * share when 'give' then -total * share end), 0) + (count(*) filter (side = 'give') - count(*) filter (side = 'get')) * coalesce(any_value(rv), 0), 9) net from v join rep using (trade_id, i) group by 1, 2)
 select trade_id, max(net) filter (i = 0) base, min(net) low, max(net) high, arg_min(name, (net, i)) low_scenario, arg_min(name, (-net, i)) high_scenario, min(net) < 0 and max(net) > 0 flips from net join sc using (i) group by 1""", rounds=True)
def trade_sensitivity(spark, sf_dir):
    """Every trade under five scenarios, the league valued anew under each."""
    p, s = table(spark, sf_dir, "part"), player_seasons(spark, sf_dir)
    lines = s.groupBy("player_id").agg(*(sdiv(F.sum(x), F.sum("gp")).alias(x) for x in CATS))
    one, two = F.array(F.col("p_size").cast("long")), F.array((F.col("p_size") + 1).cast("long"))
    none = F.array().cast("array<long>")
    first, more = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(none), F.when(F.col("p_partkey") % 3 == 0, two).otherwise(none)
    gets, also = F.when(F.col("p_partkey") % 2 == 1, one).otherwise(none), F.when(F.col("p_partkey") % 3 == 1, two).otherwise(none)
    trades = p.select(F.col("p_partkey").alias("trade_id"), F.concat(first, more).alias("give"), F.concat(gets, also).alias("get"))
    t = valuation.trade_sensitivity(trades, lines, list(CATS), "player_id", 50, 5, 5)
    return t.select("trade_id", *(rounded(F.col(x), x, 9) for x in ("base", "low", "high")), "low_scenario", "high_scenario", "flips")


ROUND = "cast((dayofyear(game_date) - 1) div 16 + 1 as int)"
ROUND_SQL = "cast((dayofyear(game_date) - 1) // 16 + 1 as int)"
HOME = 3.6


@query(f"""with {SIDES_SQL}, g as (select season, {ROUND_SQL} round, season_type <> 'P' or game_id % 199 > 0 scored, game_id % 13 = 0 postponed from pre) select season, round from g group by 1, 2 having bool_and(scored or postponed) and bool_or(scored)""")
def complete_rounds(spark, sf_dir):
    """Rounds whose games are all scored, postponed ones aside."""
    g = games(box_view(spark, sf_dir)).selectExpr("season", f"{ROUND} as round", "season_type != 'P' or game_id % 199 > 0 as scored", "game_id % 13 = 0 as postponed")
    return league.complete_rounds(g)


PRIORS_SQL = """t as (select season, home_id team_id, h_pts p, a_pts a from pre union all select season, away_id, a_pts, h_pts from pre),
 prior as (select season + 1 season, team_id, avg(p) pf, avg(a) pa from t group by 1, 2 having count(*) >= 10), lv as (select season, avg(pf) level from prior group by 1)"""


def club_priors(box):
    means = ratings.season_means(with_home(box), ["season"]).where("pf is not null")
    return means.select((F.col("season") + 1).alias("season"), "team_id", "pf", "pa")


@query(f"""with recursive {SIDES_SQL}, {PRIORS_SQL},
 q as (select season, {ROUND_SQL} round, game_date, game_id, team_id, opp_team_id, team_id = home_id is_home, case when game_id % 11 = 0 then tm_pts * 40.0 / 45 else tm_pts * 1.0 end s, case when game_id % 11 = 0 then opp_pts * 40.0 / 45 else opp_pts * 1.0 end a, case when game_id % 4 = 1 then tm_fga * 1.0 end ls, case when game_id % 4 = 1 then opp_fga * 1.0 end la
   from sides join pre using (game_id, season, season_type, game_date)),
 o as (select *, row_number() over (partition by season, team_id order by round, game_date, game_id) n from q),
 n as (select q.* from o q join prior x on x.season = q.season and x.team_id = q.team_id join prior y on y.season = q.season and y.team_id = q.opp_team_id),
 w as (select *, case n when 1 then 0.10 when 2 then 0.09 else 1.0 / (n + 9) end w from n),
 pairs as (select season, dense_rank() over (partition by season order by round) step, round, team_id, opp_team_id, is_home, sum(case when ls is null then w else 0 end) w, sum(w * (s - coalesce(ls, 0))) up, sum(w * (a - coalesce(la, 0))) down, count(*) games from w group by season, round, team_id, opp_team_id, is_home),
 steps as (select distinct season, step, round from pairs),
 state as (select season, cast(0 as bigint) step, team_id, cast(0 as double) att, cast(0 as double) def, cast(0 as bigint) games from prior
  union all
  select st.season, steps.step, st.team_id, cast(st.att + coalesce(k.up, 0) as double), cast(st.def + coalesce(k.down, 0) as double), cast(st.games + coalesce(k.games, 0) as bigint) from state st join steps on steps.season = st.season and steps.step = st.step + 1
   left join (select c.season, c.team_id, sum(pr.up - pr.w * ((lv.level + 0.7 * (x.pf - lv.level) + c.att) * (lv.level + 0.7 * (y.pa - lv.level) + o.def) / lv.level + case when is_home then {HOME / 2} else {-HOME / 2} end)) up,
      sum(pr.down - pr.w * ((lv.level + 0.7 * (y.pf - lv.level) + o.att) * (lv.level + 0.7 * (x.pa - lv.level) + c.def) / lv.level - case when is_home then {HOME / 2} else {-HOME / 2} end)) down, sum(pr.games) games
     from state c join pairs pr on pr.season = c.season and pr.team_id = c.team_id and pr.step = c.step + 1 join state o on o.season = c.season and o.team_id = pr.opp_team_id join lv on lv.season = c.season join prior x on x.season = c.season and x.team_id = c.team_id join prior y on y.season = c.season and y.team_id = pr.opp_team_id
     group by 1, 2) k on k.season = st.season and k.team_id = st.team_id)
 select state.season, steps.round, team_id, att attack_adj, def defence_adj, games from state join steps on steps.season = state.season and steps.step = state.step""")
def club_round_ratings(spark, sf_dir):
    """The second league's ratings after each round: overtime taken off, locked projections where there are some, else rebuilt ones."""
    box = box_view(spark, sf_dir)
    g = games(box).selectExpr("game_id", "season", "game_date", f"{ROUND} as round", "game_id % 11 = 0 as ot", "stack(2, home_id, away_id, true, h_pts, a_pts, h_fga, a_fga, away_id, home_id, false, a_pts, h_pts, a_fga, h_fga) as (team_id, opp_team_id, is_home, tm, opp, own_guess, opp_guess)")
    at_regulation = lambda c: league.regulation_points(F.col(c), F.when(F.col("ot"), 1).otherwise(0))
    guess = lambda c: F.when(F.col("game_id") % 4 == 1, F.col(c).cast("double"))
    s = g.select("game_id", "season", "round", "game_date", "team_id", "opp_team_id", "is_home", at_regulation("tm").alias("scored"), at_regulation("opp").alias("allowed"), guess("own_guess").alias("locked_scored"), guess("opp_guess").alias("locked_allowed"))
    return league.round_fold(s, club_priors(box), HOME)


AS_OF, BASE_ROUND = 9, 2
BASE_SQL = f"""lines as (select season, team_id, player_id, game_id, game_date, {ROUND_SQL} round, case when game_id % 10 > 0 then "min" * 60 end secs, case when game_id % 7 > 0 then pts end pts, ast, fgm, case when game_id % 9 > 0 then fga end fga from box),
 bases as (select season + 1 season, team_id, player_id, avg("min") m0, least(cast(sum("min") as double), 400) pm, 40.0 * sum(pts) / sum("min") pts0, 40.0 * sum(ast) / sum("min") ast0, 40.0 * sum(fga) / sum("min") fga0, sum(fgm) * 1.0 / nullif(sum(fga), 0) pct0 from box group by 1, 2, 3),
 cg as (select distinct season, team_id, game_id, {ROUND_SQL} round from sides), wn as (select * from cg where round > {BASE_ROUND} and round <= {AS_OF}), cn as (select season, team_id, count(*) g from wn group by 1, 2),
 ex as (select b.season, b.team_id, b.player_id, count(*) e from (select distinct l_suppkey + 2 player_id, l_orderkey game_id from lineitem where l_linenumber = 2) z join wn using (game_id) join bases b on b.season = wn.season and b.team_id = wn.team_id and b.player_id = z.player_id
   where not exists (select 1 from lines l where l.game_id = z.game_id and l.player_id = z.player_id and l.team_id = wn.team_id) group by 1, 2, 3),
 su as (select season, team_id, player_id, count(*) c, count(secs) known, coalesce(sum(secs) / 60.0, 0) obs, count(*) filter (secs > 0) ga, coalesce(sum(pts) filter (secs > 0), 0) t_pts, coalesce(sum(secs) filter (secs > 0 and pts is not null), 0) / 60.0 m_pts, coalesce(sum(ast) filter (secs > 0), 0) t_ast, coalesce(sum(secs) filter (secs > 0), 0) / 60.0 m_ast,
   coalesce(sum(fga) filter (secs > 0), 0) t_fga, coalesce(sum(fgm) filter (secs > 0 and fga is not null), 0) t_fgm, coalesce(sum(secs) filter (secs > 0 and fga is not null), 0) / 60.0 m_fga from lines where round > {BASE_ROUND} and round <= {AS_OF} group by 1, 2, 3),
 fu as (select b.*, coalesce(g, 0) - coalesce(c, 0) + coalesce(known, 0) - coalesce(e, 0) counted, g, coalesce(obs, 0) obs, coalesce(ga, 0) ga, t_pts, m_pts, t_ast, m_ast, t_fga, t_fgm, m_fga from bases b left join cn using (season, team_id) left join su using (season, team_id, player_id) left join ex using (season, team_id, player_id)),
 bl as (select *, case when g > 0 then ({BASE_ROUND + 3} * m0 + obs) / ({BASE_ROUND + 3} + counted) else m0 end m, case when m_pts > 0 then (pts0 * pm + 40 * t_pts) / (pm + m_pts) else pts0 end pts40, case when m_ast > 0 then (ast0 * pm + 40 * t_ast) / (pm + m_ast) else ast0 end ast40,
   case when m_fga > 0 then (fga0 * pm + 40 * t_fga) / (pm + m_fga) else fga0 end fga40, case when m_fga > 0 then (pct0 * fga0 * pm + 40 * t_fgm) / (pm + m_fga) else pct0 * fga0 end mk, max(counted > 0) over (partition by season, team_id) act from fu),
 oo as (select *, row_number() over k - 1 i, sum(m) over (partition by season, team_id order by m desc, player_id rows between current row and unbounded following) mass from bl window k as (partition by season, team_id order by m desc, player_id)),
 ff as (select *, case when 200 - 40.0 * i > 0 and mass > 0 then (200 - 40.0 * i) / mass end fac from oo), jj as (select season, team_id, min(i) j from ff where not coalesce(m * fac > 40 + 1e-12, false) group by 1, 2),
 gg as (select ff.*, jj.j, max(case when ff.i = jj.j then fac end) over (partition by ff.season, ff.team_id) fj from ff left join jj using (season, team_id)),
 states as (select season, team_id, player_id, case when not act then m when j is null or i < j then 40.0 else coalesce(m * fj, m) end as minutes, pts40, ast40, fga40, case when ga > 0 then case when fga40 > 0 then least(greatest(mk / fga40, 0), 1) end else pct0 end pct, ga games_after, counted club_games from gg)"""


def club_lines(box):
    return box.selectExpr("season", "team_id", "player_id", "game_id", "game_date", f"{ROUND} as round", "if(game_id % 10 > 0, min * 60, null) as seconds", "if(game_id % 7 > 0, pts, null) as pts", "ast", "fgm", "if(game_id % 9 > 0, fga, null) as fga")


def states_of_clubs(spark, sf_dir):
    box = box_view(spark, sf_dir)
    per = lambda c: 40.0 * F.sum(c) / F.sum("min")
    bases = box.groupBy("season", "team_id", "player_id").agg(
        F.avg("min").alias("base_minutes"), F.least(F.sum("min").cast("double"), F.lit(400.0)).alias("prior_minutes"), per("pts").alias("prior_pts"), per("ast").alias("prior_ast"), per("fga").alias("prior_fga"), sdiv(F.sum("fgm"), F.sum("fga")).alias("prior_pct")
    )
    bases = bases.withColumn("season", F.col("season") + 1).withColumn("base_round", F.lit(BASE_ROUND))
    rounds = games(box).selectExpr("game_id", "season", f"{ROUND} as round", "explode(array(home_id, away_id)) as team_id")
    excused = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select((F.col("l_suppkey") + 2).alias("player_id"), F.col("l_orderkey").alias("game_id"))
    return league.player_states(bases, club_lines(box), rounds, excused, ["pts", "ast", "fga"], {"pct": ("fgm", "fga")}, AS_OF)


@query(f"""with {SIDES_SQL}, {BASE_SQL} select * from states""")
def club_player_states(spark, sf_dir):
    """Minutes and rates of every player of a club after a round, from last season's and this season's lines."""
    return states_of_clubs(spark, sf_dir).select("season", "team_id", "player_id", "minutes", F.col("pts").alias("pts40"), F.col("ast").alias("ast40"), F.col("fga").alias("fga40"), "pct", "games_after", "club_games")


@query(f"""with {SIDES_SQL}, {PRIORS_SQL}, {BASE_SQL}, sl as (select season, max(game_date) d from sides group by 1),
 gs as (select s.game_id, s.season, s.team_id, s.opp_team_id, s.game_date, pre.home_id = s.team_id is_home from sides s join sl on sl.season = s.season and sl.d = s.game_date join pre using (game_id)),
 fx as (select gs.*, (lv.level + 0.7 * (y.pa - lv.level)) / lv.level + case when is_home then 1 else -1 end * {HOME} / (2 * (lv.level + 0.7 * (x.pf - lv.level))) factor from gs join lv using (season) join prior x on x.season = gs.season and x.team_id = gs.team_id join prior y on y.season = gs.season and y.team_id = gs.opp_team_id),
 sq as (select fx.*, player_id, minutes * pts40 / 40 * factor model_points, cast({CHANCE_SQL} as double) chance from fx join states using (season, team_id)),
 re as (select sq.game_id, sq.player_id, l.pts, row_number() over (partition by sq.game_id, sq.player_id order by l.game_date desc, l.game_id desc) i from (select distinct game_id, player_id, game_date from sq) sq join lines l on l.player_id = sq.player_id and l.game_date < sq.game_date and l.secs > 0 and l.pts is not null),
 fo as (select game_id, player_id, avg(pts) form from re where i <= 10 group by 1, 2),
 pp as (select sq.*, form, case when chance = 0 then 0 when form is null then model_points * chance else 0.75 * model_points * chance + 0.25 * form * chance end projected_points from sq left join fo using (game_id, player_id)),
 rk as (select *, row_number() over (partition by game_id, team_id order by projected_points desc, player_id) place from pp)
 select game_id, team_id, player_id, chance, model_points * chance model_points, form, projected_points, place from rk where place <= 5""")
def club_scorers(spark, sf_dir):
    """The five likeliest scorers of each side in a season's last slate."""
    box = box_view(spark, sf_dir)
    all_games = with_home(box)
    last = all_games.groupBy("season").agg(F.max("game_date").alias("game_date"))
    slate = all_games.join(F.broadcast(last), ["season", "game_date"]).select("season", "game_date", "game_id", "team_id", "opp_team_id", "is_home")  # a row a season
    priors = club_priors(box)
    level = priors.groupBy("season").agg(F.avg("pf").alias("level"))
    own, other = priors.select("season", "team_id", "pf"), priors.select("season", F.col("team_id").alias("opp_team_id"), F.col("pa").alias("opp_pa"))
    placed = slate.join(F.broadcast(level), "season").join(F.broadcast(own), ["season", "team_id"]).join(F.broadcast(other), ["season", "opp_team_id"])  # clubs x seasons rows
    defence = ratings.rating(F.col("opp_pa"), F.col("level"), F.lit(0.0)) / F.col("level")
    factor = league.context_factor(defence, F.when(F.col("is_home"), 1).otherwise(-1), HOME, ratings.rating(F.col("pf"), F.col("level"), F.lit(0.0)))
    chance = squads.model_chance(F.expr(STATUS))
    slate = staged(placed.select("game_id", "season", "team_id", "game_date", factor.alias("factor")))
    clubs = slate.select("season", "team_id", F.col("game_date").alias("start")).distinct()  # a season's last day
    states = states_of_clubs(spark, sf_dir).select("season", "team_id", "player_id", (F.col("minutes") * F.col("pts") / 40).alias("full"))
    players = staged(states.join(F.broadcast(clubs), ["season", "team_id"]).withColumn("chance", chance).withColumn("points", F.col("full") * F.col("chance")))
    form = league.form_before(club_lines(box), players.select("player_id", "start").distinct())
    players = staged(players.join(form, ["player_id", "start"], "left"))
    return league.slate_scorers(slate.drop("game_date"), players, 5)


FACTORS = ("pace", "opponent", "venue", "rest")


@query(NEXT_SQL + " " + " union all ".join(f"select player_id, '{f}' factor, cast({f}_factor as double) \"value\", mean_pts * ({f}_factor - 1) contribution from z" for f in FACTORS))
def factor_contributions(spark, sf_dir):
    """What each context factor adds to a player's projected points."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f"{f}_factor").alias("value"), projection.factor_contribution(F.col("mean_pts"), F.col(f"{f}_factor")).alias("contribution")) for f in FACTORS))).alias("x")
    return next_lines(spark, sf_dir).select("player_id", each).select("player_id", "x.factor", "x.value", "x.contribution")


@query(NEXT_SQL + """ select player_id, k, exp(lgamma(k + 1 / effective_stl) - lgamma(1 / effective_stl) - lgamma(k + 1) - (1 / effective_stl) * ln(1 + effective_stl * mean_stl) + k * ln(effective_stl * mean_stl / (1 + effective_stl * mean_stl))) chance from z, (select unnest(range(11)) k) where effective_stl > 1e-9 and mean_stl > 0
 union all select player_id, k, exp(k * ln(mean_stl) - mean_stl - lgamma(k + 1)) from z, (select unnest(range(11)) k) where not effective_stl > 1e-9 and mean_stl > 0""")
def count_chances(spark, sf_dir):
    """The chances of no to ten steals of every player."""
    chances = projection.count_probabilities(F.col("mean_stl"), F.col("effective_stl"), 10)
    return next_lines(spark, sf_dir).where("mean_stl > 0").select("player_id", F.posexplode(chances).alias("k", "chance")).withColumn("k", F.col("k").cast("long"))


CURSOR_SQL = """rtrim(translate(base64(encode('{"d":"' || cast(game_date as varchar) || '","id":' || game_id || '}')), '+/', '-_'), '=')"""


@query(f"""with {BOX_SQL}, o as (select player_id, game_id, game_date, pts, row_number() over (partition by player_id order by game_date desc, game_id desc) n from box), c as (select player_id, {CURSOR_SQL} "cursor" from o where n = 5)
 select player_id, "cursor", n - 5 n, game_id, pts from o join c using (player_id) where n > 5 and n <= 10""")
def game_log_pages(spark, sf_dir):
    """The second page of every player's log, found through the cursor that the first page ends with."""
    box = box_view(spark, sf_dir).select("player_id", "game_id", "game_date", "pts")
    w = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    first = box.withColumn("n", F.row_number().over(w)).where("n <= 5")
    ends = first.where("n = 5").select("player_id", paging.encoded_cursor(F.struct(F.col("game_date").alias("d"), F.col("game_id").alias("id"))).alias("cursor"))
    return paging.page_after(box.join(ends, "player_id"), ["player_id"], "cursor", "d date, id long", {"d": "game_date", "id": "game_id"}, 5).select("player_id", "cursor", F.col("place").alias("n"), "game_id", "pts")


SQUAD_SQL = f"""sq as (select season, player_id, count(*) n, avg("min") m, avg(pts) p, arg_max(team_id, (game_date, game_id)) team_id from box group by 1, 2),
 st as (select a.season, a.team_id, a.player_id, a.n, case when b.m is null then a.m else (a.n * a.m + 10 * b.m) / (a.n + 10) end m, case when b.p is null then a.p else (a.n * a.p + 10 * b.p) / (a.n + 10) end p from sq a left join sq b on b.season + 1 = a.season and b.player_id = a.player_id),
 ch as (select *, cast({CHANCE_SQL} as double) c from st)"""


def squads_with_chance(spark, sf_dir):
    return squads.squad_stats(box_view(spark, sf_dir), "player_id").withColumn("chance", squads.model_chance(F.expr(STATUS)))


@query(f"with {BOX_SQL}, {SQUAD_SQL} select season, team_id, player_id, n, m as minutes, p points from st")
def squad_stats(spark, sf_dir):
    """Each season's squads with expected minutes and points, blended with the season before."""
    return squads.squad_stats(box_view(spark, sf_dir), "player_id")


@query(f"with {BOX_SQL}, {SQUAD_SQL}, k as (select season, team_id, player_id, c chance, p * (1 - c) lost, row_number() over (partition by season, team_id order by p * (1 - c) desc, player_id) place from ch where c < 1) select * from k where place <= 3")
def key_absences(spark, sf_dir):
    """The three absences that cost a squad most."""
    lost = squads_with_chance(spark, sf_dir).where("chance < 1").withColumn("lost", F.col("points") * (1 - F.col("chance")))
    place = F.row_number().over(Window.partitionBy("season", "team_id").orderBy(F.desc("lost"), "player_id")).cast("long")  # a squad
    return lost.withColumn("place", place).where("place <= 3").select("season", "team_id", "player_id", "chance", "lost", "place")


MATCH_SQL = f"""{PRIORS_SQL}, {SQUAD_SQL}, s1 as (select season + 1 season, team_id, sum(p) full_, sum(p * c) av, sum(p * (1 - c)) lost, sum(m * (1 - c)) lm, count(*) filter (c = 0) absent from ch group by 1, 2),
 s2 as (select *, case when lost >= lm * 0.225 then lm * 0.225 + 0.6 * (lost - lm * 0.225) else lost end ab from s1), fac as (select season, team_id, absent, case when full_ = 0 then 1 else (av + least(ab, 0.15 * av + lm * 0.225)) / full_ end f from s2),
 mt as (select g.season, g.game_id, g.home_id, g.away_id, g.h_pts, g.a_pts, lv.level, coalesce(fh.f, 1) hk, coalesce(fa.f, 1) ak, coalesce(fh.absent, 0) ho, coalesce(fa.absent, 0) ao, lv.level + 0.7 * (x.pf - lv.level) hf, lv.level + 0.7 * (x.pa - lv.level) ha, lv.level + 0.7 * (y.pf - lv.level) af, lv.level + 0.7 * (y.pa - lv.level) aa
   from pre g join lv using (season) join prior x on x.season = g.season and x.team_id = g.home_id join prior y on y.season = g.season and y.team_id = g.away_id left join fac fh on fh.season = g.season and fh.team_id = g.home_id left join fac fa on fa.season = g.season and fa.team_id = g.away_id),
 mp as (select *, hf * hk * aa / level + 1.25 home_points, af * ak * ha / level - 1.25 away_points from mt)"""


def matches(spark, sf_dir):
    """Every game from the priors of its clubs, each side's attack times what its absences leave."""
    box = box_view(spark, sf_dir)
    chances = squads_with_chance(spark, sf_dir).withColumn("season", F.col("season") + 1)
    layer = squads.injury_totals(chances, ["season", "team_id"]).select("season", "team_id", "factor").join(chances.groupBy("season", "team_id").agg(F.count_if(F.col("chance") == 0).alias("absent")), ["season", "team_id"])
    priors = club_priors(box)
    of = lambda side: priors.select("season", *(F.col(c).alias(f"{side}_{c.split('_')[0]}" if c != "team_id" else f"{side}_id") for c in ("team_id", "pf", "pa"))).join(layer.select("season", F.col("team_id").alias(f"{side}_id"), F.col("factor").alias(f"{side}_factor"), F.col("absent").alias(f"{side}_absent")), ["season", f"{side}_id"], "left")
    level = priors.groupBy("season").agg(F.avg("pf").alias("level"))
    g = games(box).select("season", "game_id", "home_id", "away_id", "h_pts", "a_pts").join(F.broadcast(level), "season").join(F.broadcast(of("home")), ["season", "home_id"]).join(F.broadcast(of("away")), ["season", "away_id"])  # clubs x seasons rows
    g = g.fillna({"home_factor": 1.0, "away_factor": 1.0, "home_absent": 0, "away_absent": 0})
    rated = lambda side, c: ratings.rating(F.col(f"{side}_{c}"), F.col("level"), F.lit(0.0))
    home, away = ratings.match_scores(F.col("level"), rated("home", "pf") * F.col("home_factor"), rated("home", "pa"), rated("away", "pf") * F.col("away_factor"), rated("away", "pa"), F.lit(ratings.HOME_POINTS))
    return g.withColumns({"home_points": home, "away_points": away})


@query(f"with {SIDES_SQL}, {MATCH_SQL} select season, game_id, home_points, away_points, home_points - hf * aa / level - 1.25 absence_effect, sha256(concat_ws('|', game_id, home_id, away_id, ho, ao)) digest from mp")
def availability_projections(spark, sf_dir):
    """Games projected with both sides' absences, what those cost the home side, and the digest of the inputs, by which a ledger sees a change."""
    m = matches(spark, sf_dir)
    full = ratings.rating(F.col("home_pf"), F.col("level"), F.lit(0.0)) * ratings.rating(F.col("away_pa"), F.col("level"), F.lit(0.0)) / F.col("level") + ratings.HOME_POINTS / 2
    digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("game_id", "home_id", "away_id", "home_absent", "away_absent"))), 256)
    return m.select("season", "game_id", "home_points", "away_points", (F.col("home_points") - full).alias("absence_effect"), digest.alias("digest"))


@query(f"""with {SIDES_SQL}, {MATCH_SQL}, e as (select season, game_id % 4 = 1 locked, h_pts - home_points h, a_pts - away_points a from mp),
 y as (select season, count(*) filter (locked) ln, sqrt(sum(h * h + a * a) filter (locked) / (2 * count(*) filter (locked))) lt, sqrt(avg((h - a) * (h - a)) filter (locked)) lg, count(*) wn, sqrt(sum(h * h + a * a) / (2 * count(*))) wt, sqrt(avg((h - a) * (h - a))) wg from e group by 1)
 select a.season, case when a.ln >= 300 then 'fittedLedger' when b.wn >= 300 then 'fittedPrevSeason' end source, case when a.ln >= 300 then a.ln else coalesce(b.wn, 0) end games, case when a.ln >= 300 then a.lt when b.wn >= 300 then b.wt end team_sd, case when a.ln >= 300 then a.lg when b.wn >= 300 then b.wg end margin_sd from y a left join y b on b.season + 1 = a.season""")
def fitted_spreads(spark, sf_dir):
    """Spreads of team points and margins from locked projections, else from last season's; none on fewer than 300 games."""
    m = matches(spark, sf_dir)
    residuals = m.select("season", (F.col("game_id") % 4 == 1).alias("locked"), (F.col("h_pts") - F.col("home_points")).alias("home"), (F.col("a_pts") - F.col("away_points")).alias("away"))
    return ratings.fitted_spreads(residuals)
