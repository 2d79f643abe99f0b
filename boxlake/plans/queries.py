"""Named queries over the whole tables, each with its oracle SQL where SQL can express it. One registry, so that the two cannot drift."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions import boxscore as b
from boxlake.functions.nullsafe import sdiv
from boxlake.operators import joins, models, windows
from boxlake.operators.store import staged
from boxlake.sources import tables
from boxlake.sources.tables import BOX_SQL, SIDES_SQL, STATS, box_view, by_player, sides, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, rounds: bool = False):
    """Registers a query with its SQL. Where rounded values are ranked or shown (``rounds``), both sides round; elsewhere neither does, as rounding doubles is slow and makes ties."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if rounds else unrounded(sql)
        return f

    return add


def unrounded(sql: str) -> str:
    """sql with every round(x, digits) replaced by x as a double."""
    while (found := re.search(r"\bround\(", sql)) is not None:
        depth, at, comma = 1, found.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            comma = at if sql[at] == "," and depth == 1 else comma
            at += 1
        sql = f"{sql[:found.start()]}cast(({sql[found.end() : comma]}) as double){sql[at:]}"
    return sql


def r(column, name: str):
    return column.cast("double").alias(name)


def rounded(column, name: str, digits: int = 6):
    return F.round(column, digits).alias(name)


SEASON_SQL = BOX_SQL + ", ps as (select season, season_type, player_id, count(*) gp, " + ", ".join(f'cast(sum("{s}") as bigint) "{s}"' for s in STATS) + " from box group by 1, 2, 3)"


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_player(spark, sf_dir, box_view(spark, sf_dir)).groupBy("season", "season_type", "player_id").agg(F.count("*").alias("gp"), *(F.sum(s).alias(s) for s in STATS))


@query(f"with {BOX_SQL} select season, season_type, team_id, player_id, count(*) gp, cast(sum(pts) as bigint) total_pts, round(avg(pts), 1) ppg, round(avg(ast), 1) apg, round(100.0 * sum(fgm) / nullif(sum(fga), 0), 1) fg_pct from box group by 1, 2, 3, 4", rounds=True)
def season_averages(spark, sf_dir):
    g = by_player(spark, sf_dir, box_view(spark, sf_dir)).groupBy("season", "season_type", "team_id", "player_id")
    return g.agg(F.count("*").alias("gp"), F.sum("pts").alias("total_pts"), rounded(F.avg("pts"), "ppg", 1), rounded(F.avg("ast"), "apg", 1), rounded(100.0 * sdiv(F.sum("fgm"), F.sum("fga")), "fg_pct", 1))


@query(f"""with {SEASON_SQL} select season, season_type, player_id, round((fgm + 0.5 * fg3m) / nullif(fga, 0), 6) efg, round(pts / nullif(2 * (fga + 0.44 * fta), 0), 6) ts,
  round(fg3a / nullif(fga, 0), 6) fg3_rate, round(fta / nullif(fga, 0), 6) ft_rate, round(pts / nullif(fga, 0), 6) pps,
  round(100 * tov / nullif(fga + 0.44 * fta + tov, 0), 6) tov_pct, round(100 * ast / nullif(fga + 0.44 * fta + ast + tov, 0), 6) ast_ratio from ps""")
def shooting_rates(spark, sf_dir):
    return player_seasons(spark, sf_dir).select("season", "season_type", "player_id", r(b.effective_fg_pct(), "efg"), r(b.true_shooting_pct(), "ts"), r(b.three_point_attempt_rate(), "fg3_rate"), r(b.free_throw_rate(), "ft_rate"), r(b.points_per_shot(), "pps"), r(b.turnover_pct(), "tov_pct"), r(b.assist_ratio(), "ast_ratio"))


GAME_SQL = SIDES_SQL + ", full_lines as (select x.player_id, " + ", ".join(f'x."{s}"' for s in STATS) + ", t.* from box x join sides t on x.game_id = t.game_id and x.team_id = t.team_id)"


def full_lines(spark, sf_dir):
    return tables.full_lines(box_view(spark, sf_dir))


@query(f"""with {GAME_SQL} select game_id, player_id,
  round(100 * ((fga + 0.44 * fta + tov) * tm_min / 5) / nullif("min" * (tm_fga + 0.44 * tm_fta + tm_tov), 0), 6) usg,
  round(case when "min" / (tm_min / 5) * tm_fgm - fgm > 0 then 100 * ast / ("min" / (tm_min / 5) * tm_fgm - fgm) end, 6) ast_pct,
  round(100 * ((oreb + dreb) * tm_min / 5) / nullif("min" * (tm_oreb + tm_dreb + opp_oreb + opp_dreb), 0), 6) reb_pct,
  round(100 * (oreb * tm_min / 5) / nullif("min" * (tm_oreb + opp_dreb), 0), 6) oreb_pct,
  round(100 * (dreb * tm_min / 5) / nullif("min" * (tm_dreb + opp_oreb), 0), 6) dreb_pct,
  round(100 * (stl * tm_min / 5) / nullif("min" * (opp_fga + 0.44 * opp_fta - opp_oreb + opp_tov), 0), 6) stl_pct,
  round(100 * (blk * tm_min / 5) / nullif("min" * (opp_fga - opp_fg3a), 0), 6) blk_pct from full_lines""")
def usage_rates(spark, sf_dir):
    return full_lines(spark, sf_dir).select("game_id", "player_id", r(b.usage_pct(), "usg"), r(b.assist_pct(), "ast_pct"), r(b.rebound_pct(), "reb_pct"), r(b.offensive_rebound_pct(), "oreb_pct"), r(b.defensive_rebound_pct(), "dreb_pct"), r(b.steal_pct(), "stl_pct"), r(b.block_pct(), "blk_pct"))


@query(f"""with {SIDES_SQL}, p as (select *, tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov own, opp_fga + 0.44 * opp_fta - opp_oreb + opp_tov other from sides)
  select game_id, team_id, round(own, 6) poss, round(48 * (own + other) / (2 * tm_min / 5), 6) pace, round(100 * opp_pts / nullif(own, 0), 6) drtg from p""")
def team_pace(spark, sf_dir):
    return sides(box_view(spark, sf_dir)).select("game_id", "team_id", r(b.possessions("tm_"), "poss"), r(b.pace(), "pace"), r(b.team_defensive_rating(), "drtg"))


@query(f"""with {BOX_SQL} select game_id, player_id, round(pts + 0.4 * fgm - 0.7 * fga - 0.4 * (fta - ftm) + 0.7 * oreb + 0.3 * dreb + stl + 0.7 * ast + 0.7 * blk - 0.4 * pf - tov, 6) game_score,
  round(pts + 1.2 * (oreb + dreb) + 1.5 * ast + 3 * stl + 3 * blk - tov, 6) fantasy from box""")
def game_scores(spark, sf_dir):
    return box_view(spark, sf_dir).select("game_id", "player_id", r(b.game_score(), "game_score"), r(b.fantasy_points(), "fantasy"))


@query(f"""with {GAME_SQL},
 k as (select *, 1 - (1 - tm_ftm / tm_fta) * (1 - tm_ftm / tm_fta) tm_trip, tm_oreb / (tm_oreb + opp_dreb) o, "min" / (tm_min / 5) share from full_lines),
 s as (select *, tm_fgm + tm_trip * tm_fta * 0.4 scp from k),
 w as (select *, scp / (tm_fga + 0.4 * tm_fta + tm_tov) play from s),
 v as (select *, (1 - o) * play / ((1 - o) * play + o * (1 - play)) wt from w),
 q as (select *, share * (1.14 * (tm_ast - ast) / tm_fgm) + (tm_ast / tm_min * "min" * 5 - ast) / nullif(tm_fgm / tm_min * "min" * 5 - fgm, 0) * (1 - share) qast from v),
 p as (select *, case when fga = 0 then 0 else fgm * (1 - 0.5 * ((pts - ftm) / (2 * fga)) * qast) end fgp,
   0.5 * (((tm_pts - tm_ftm) - (pts - ftm)) / nullif(2 * (tm_fga - fga), 0)) * ast astp,
   case when fta = 0 then 0 else (1 - (1 - ftm / fta) * (1 - ftm / fta)) * 0.4 * fta end ftp, 1 - tm_oreb / scp * wt * play disc, oreb * wt * play orp from q),
 t as (select *, (fgp + astp + ftp) * disc + orp sc,
   ((case when fga = 0 then 0 else 2 * (fgm + 0.5 * fg3m) * (1 - 0.5 * ((pts - ftm) / (2 * fga)) * qast) end) + 2 * ((tm_fgm - fgm + 0.5 * (tm_fg3m - fg3m)) / nullif(tm_fgm - fgm, 0)) * astp + ftm) * disc + orp * tm_pts / scp pprod,
   (fga - fgm) * (1 - 1.07 * o) fgx, case when fta = 0 then 0 else (1 - ftm / fta) * (1 - ftm / fta) * 0.4 * fta end ftx from p)
 select game_id, player_id, round(sc, 5) sc_poss, round(sc + fgx + ftx + tov, 5) tot_poss, round(sc / nullif(sc + fgx + ftx + tov, 0), 5) floor_pct, round(pprod, 5) pprod, round(100 * pprod / nullif(sc + fgx + ftx + tov, 0), 5) ortg from t""")
def offensive_ratings(spark, sf_dir):
    lines = b.staged(full_lines(spark, sf_dir), b.OFFENCE)
    done = {f.__name__: F.col(f.__name__) for step in b.OFFENCE for f in step}
    return lines.select("game_id", "player_id", r(done["scoring_possessions"], "sc_poss"), r(done["total_possessions"], "tot_poss"), r(b.floor_pct(done), "floor_pct"), r(done["points_produced"], "pprod"), r(b.offensive_rating(done), "ortg"))


@query(f"""with {GAME_SQL},
 k as (select *, opp_fgm / opp_fga dfg, opp_oreb / (opp_oreb + tm_dreb) dor, tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov poss from full_lines),
 w as (select *, dfg * (1 - dor) / (dfg * (1 - dor) + (1 - dfg) * dor) fw from k),
 s as (select *, stl + blk * fw * (1 - 1.07 * dor) + dreb * (1 - fw) s1,
   ((opp_fga - opp_fgm - tm_blk) / tm_min * fw * (1 - 1.07 * dor) + (opp_tov - tm_stl) / tm_min) * "min" + pf / tm_pf * 0.4 * opp_fta * (1 - opp_ftm / opp_fta) * (1 - opp_ftm / opp_fta) s2 from w),
 t as (select *, (s1 + s2) * opp_min / (poss * "min") sp, opp_pts / (opp_fgm + (1 - (1 - opp_ftm / opp_fta) * (1 - opp_ftm / opp_fta)) * opp_fta * 0.4) dps, 100 * opp_pts / poss td from s)
 select game_id, player_id, round(s1 + s2, 5) stops, round(sp, 5) stop_pct, round(td + 0.2 * (100 * dps * (1 - sp) - td), 5) drtg from t""")
def defensive_ratings(spark, sf_dir):
    lines = b.staged(full_lines(spark, sf_dir), b.DEFENCE)
    done = {f.__name__: F.col(f.__name__) for step in b.DEFENCE for f in step}
    return lines.select("game_id", "player_id", r(done["stops"], "stops"), r(done["stop_pct"], "stop_pct"), r(b.defensive_rating(done), "drtg"))


def _pie(p: str) -> str:
    q = lambda s: f'{p}{s}'
    return f"({q('pts')} + {q('fgm')} + {q('ftm')} - {q('fga')} - {q('fta')} + {q('dreb')} + 0.5 * {q('oreb')} + {q('ast')} + {q('stl')} + 0.5 * {q('blk')} - {q('pf')} - {q('tov')})"


@query(f"with {GAME_SQL} select game_id, player_id, round({_pie('')} / nullif({_pie('tm_')} + {_pie('opp_')}, 0), 6) pie from full_lines")
def impact_estimate(spark, sf_dir):
    return full_lines(spark, sf_dir).select("game_id", "player_id", r(b.pie(), "pie"))


@query(f"""with {SIDES_SQL} select season, season_type, team_id, count(*) gp, cast(count(*) filter (tm_pts > opp_pts) as bigint) wins, cast(count(*) filter (tm_pts < opp_pts) as bigint) losses,
  round(avg(tm_pts), 4) ppg, round(avg(opp_pts), 4) opp_ppg, round((sum(tm_fgm) + 0.5 * sum(tm_fg3m)) / sum(tm_fga), 6) efg, round(sum(tm_tov) / (sum(tm_fga) + 0.44 * sum(tm_fta) + sum(tm_tov)), 6) tov,
  round(sum(tm_oreb) / (sum(tm_oreb) + sum(opp_dreb)), 6) oreb, round(sum(tm_fta) / sum(tm_fga), 6) ftr from sides group by 1, 2, 3""")
def team_seasons(spark, sf_dir):
    totals = sides(box_view(spark, sf_dir)).groupBy("season", "season_type", "team_id").agg(
        F.count("*").alias("gp"), F.count_if(F.col("tm_pts") > F.col("opp_pts")).alias("wins"), F.count_if(F.col("tm_pts") < F.col("opp_pts")).alias("losses"),
        r(F.avg("tm_pts"), "ppg"), r(F.avg("opp_pts"), "opp_ppg"), *(F.sum(p + s).alias(p + s) for p in ("tm_", "opp_") for s in STATS),
    )
    four = b.four_factors()
    return totals.select("season", "season_type", "team_id", "gp", "wins", "losses", "ppg", "opp_ppg", r(four["efg_pct"], "efg"), r(four["tov_pct"], "tov"), r(four["oreb_pct"], "oreb"), r(four["ft_rate"], "ftr"))


@query(f"""with {SEASON_SQL}, m as (unpivot (select season, season_type, player_id, cast(pts as double) / gp ppg, cast(ast as double) / gp apg, cast("min" as double) / gp mpg from ps) on ppg, apg, mpg into name metric value v)
  select season, season_type, metric, count(v) n, round(avg(v), 5) mean, round(stddev_pop(v), 5) sd, round(quantile_cont(v, 0.1), 5) p10, round(quantile_cont(v, 0.5), 5) p50, round(quantile_cont(v, 0.9), 5) p90, round(min(v), 5) low, round(max(v), 5) high
  from m group by 1, 2, 3 having count(v) >= 2""")
def league_distribution(spark, sf_dir):
    per = player_seasons(spark, sf_dir).select("season", "season_type", "player_id", *(sdiv(F.col(s), F.col("gp")).alias(n) for s, n in (("pts", "ppg"), ("ast", "apg"), ("min", "mpg"))))
    long = per.unpivot(["season", "season_type", "player_id"], ["ppg", "apg", "mpg"], "metric", "v")
    long, by = staged(long.where("v is not null")), ["season", "season_type", "metric"]
    whole = long.groupBy(*by).agg(F.count("v").alias("n"), r(F.avg("v"), "mean"), r(F.stddev_pop("v"), "sd"), r(F.min("v"), "low"), r(F.max("v"), "high")).where("n >= 2")
    places = windows.value_places(long, "v", by)
    return whole.join(windows.quantiles(places, "v", by, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), by)


LEADERS_SQL = f"""with {SEASON_SQL}, e as (select season, season_type, player_id, gp, round(cast(pts as double) / gp, 9) v, max(gp) over (partition by season, season_type) top from ps),
 q as (select * from e where gp >= greatest(1, cast(floor(0.2 * top) as bigint)))
 select season, season_type, player_id, v, dense_rank() over (partition by season, season_type order by v desc) as "rank",
  round((rank() over (partition by season, season_type order by v) - 1 + 0.5 * count(*) over (partition by season, season_type, v)) / count(*) over (partition by season, season_type), 6) percentile,
  round(v - avg(v) over (partition by season, season_type), 9) vs_league from q"""


@query(LEADERS_SQL, rounds=True)
def leaderboard(spark, sf_dir):
    scope = ["season", "season_type"]
    per = player_seasons(spark, sf_dir).select(*scope, "player_id", "gp", F.round(sdiv(F.col("pts"), F.col("gp")), 9).alias("v"))
    per = staged(per)
    tops = per.groupBy(*scope).agg(F.max("gp").alias("top"))
    able = per.join(tops, scope).where(F.col("gp") >= F.greatest(F.lit(1), F.floor(0.2 * F.col("top"))))
    means = able.groupBy(*scope).agg(F.avg("v").alias("mean"))
    ranked = able.join(windows.value_places(able, "v", scope), [*scope, "v"]).join(means, scope)
    percentile = (F.col("worse") + 0.5 * F.col("equal")) / F.col("n")
    return ranked.select(*scope, "player_id", "v", F.col("dense").alias("rank"), rounded(percentile, "percentile"), rounded(F.col("v") - F.col("mean"), "vs_league", 9))


@query(f"select * from ({LEADERS_SQL}) where \"rank\" <= 10", rounds=True)
def leaderboard_top(spark, sf_dir):
    return leaderboard(spark, sf_dir).where("rank <= 10")


@query("""select user_id, event_id, round(case when row_number() over w >= 10 then avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) end, 5) rolling10,
  datediff('day', cast(lag(ts) over w as date), cast(ts as date)) day_gap, greatest(datediff('day', cast(lag(ts) over w as date), cast(ts as date)) - 1, 0) + 0 * datediff('day', cast(lag(ts) over w as date), cast(ts as date)) rest
  from events window w as (partition by user_id order by ts, event_id)""")
def rolling_form(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.datediff("d", F.lag("d").over(by)).cast("long")
    rest = F.when(gap.isNotNull(), windows.rest_days("d", ["user_id"], ["ts", "event_id"]).cast("long"))
    return e.select("user_id", "event_id", r(windows.rolling_mean("value", ["user_id"], ["ts", "event_id"], 10), "rolling10"), gap.alias("day_gap"), rest.alias("rest"))


@query("""with a as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 age from events)
  select user_id, round(sum(pow(0.5, age / 5.0) * value) / sum(case when value is not null then pow(0.5, age / 5.0) end), 5) ewma from a group by 1""")
def ewma_form(spark, sf_dir):
    return windows.ewma_by(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"], 5.0).select("user_id", r(F.col("ewma"), "ewma"))


@query(f"""with {BOX_SQL} select game_id, player_id, round(pts - avg(pts) over (partition by season, season_type, player_id), 5) vs_own, round(pts - avg(pts) over (partition by season, season_type), 5) vs_league,
  round(pts / nullif(sum(pts) over (partition by game_id), 0), 6) share from box""")
def deltas_and_shares(spark, sf_dir):
    """The league's mean is an aggregate of one row per season and type, joined back: a window would put a season into one task."""
    box = box_view(spark, sf_dir)
    own, game, p = Window.partitionBy("season", "season_type", "player_id"), Window.partitionBy("game_id"), F.col("pts")
    league = box.groupBy("season", "season_type").agg(F.avg("pts").alias("league"))
    lines = box.withColumn("share", r(sdiv(p, F.sum(p).over(game)), "share")).join(F.broadcast(league), ["season", "season_type"])
    return lines.select("game_id", "player_id", r(p - F.avg(p).over(own), "vs_own"), r(p - F.col("league"), "vs_league"), "share")


@query(f"""with {SEASON_SQL} select player_id, cast(sum(gp) as bigint) gp, cast(sum(pts) as bigint) pts, round(sum(pts) / nullif(sum(gp), 0), 5) ppg, round(sum(ast * 1.0 / gp * "min") / nullif(sum("min"), 0), 5) apg_by_minutes,
  max(pts) best_pts, min(tov) least_tov, count(distinct season) seasons, arg_max(season * 10 + length(season_type), gp * 100000 + season * 10 + ascii(season_type) % 10) peak from ps group by 1""")
def career_totals(spark, sf_dir):
    s = player_seasons(spark, sf_dir)
    key = F.col("gp") * 100000 + F.col("season") * 10 + F.ascii("season_type") % 10
    return s.groupBy("player_id").agg(
        F.sum("gp").alias("gp"), F.sum("pts").alias("pts"), r(sdiv(F.sum("pts"), F.sum("gp")), "ppg"), r(sdiv(F.sum(sdiv(F.col("ast"), F.col("gp")) * F.col("min")), F.sum("min")), "apg_by_minutes"),
        F.max("pts").alias("best_pts"), F.min("tov").alias("least_tov"), F.countDistinct("season").alias("seasons"), F.max_by(F.col("season") * 10 + F.length("season_type"), key).alias("peak"),
    )


@query(f"""with {BOX_SQL}, g as (select game_id, team_id, player_id, pts, row_number() over (partition by game_id, team_id order by pts desc, player_id) i from box)
  select game_id, team_id, player_id, pts from (select *, row_number() over (partition by game_id order by pts desc, player_id) j from g where i = 1) where j <= 2""")
def top_performers(spark, sf_dir):
    box = box_view(spark, sf_dir)
    side = Window.partitionBy("game_id", "team_id").orderBy(F.desc("pts"), "player_id")
    game = Window.partitionBy("game_id").orderBy(F.desc("pts"), "player_id")
    best = box.withColumn("i", F.row_number().over(side)).where("i = 1")
    return best.withColumn("j", F.row_number().over(game)).where("j <= 2").select("game_id", "team_id", "player_id", "pts")


@query(f"""with {SIDES_SQL}, o as (select game_id, team_id, opp_team_id, season, season_type, tm_pts, sum(tm_pts) over w s, count(*) over w n from sides window w as (partition by season, season_type, opp_team_id))
  select game_id, team_id, case when n - 1 >= 2 then round((s - tm_pts) / (n - 1), 5) end others_mean from o""")
def adjusted_opponent_points(spark, sf_dir):
    return joins.leave_one_out_mean(sides(box_view(spark, sf_dir)), "tm_pts", ["season", "season_type", "opp_team_id"], 2).select("game_id", "team_id", r(F.col("others_mean"), "others_mean"))


@query("""with e as (select user_id, ts, event_id, value from events where event_type = 'purchase'), x as (select user_id, ts, max(event_id) error_id from events where event_type = 'error' group by 1, 2)
  select e.user_id, e.event_id, x.error_id asof_error_id from e asof left join x on e.user_id = x.user_id and e.ts > x.ts""")
def last_status_before(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("error_id"))
    return joins.asof_join(left, right, "user_id", "ts", ["error_id"]).select("user_id", "event_id", "asof_error_id")


@query("""select c_custkey, c_nationkey from customer c where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def known_not_retracted(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("""with t1 as (select p_name, p_brand, min(p_partkey) k from part where p_partkey % 2 = 0 group by 1, 2 having count(*) = 1), t2 as (select p_name, min(p_partkey) k from part where p_partkey % 2 = 0 group by 1 having count(*) = 1)
  select p.p_partkey, coalesce(t1.k, t2.k) match_id, case when t1.k is not null then 0.99 when t2.k is not null then 0.6 end confidence
  from part p left join t1 on t1.p_name = p.p_name and t1.p_brand = p.p_brand left join t2 on t2.p_name = p.p_name where p.p_partkey % 2 = 1""")
def name_crosswalk(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    right = p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "match_id")
    return joins.tiered_match(p.where("p_partkey % 2 = 1"), right, [(["p_name", "p_brand"], 0.99), (["p_name"], 0.6)], "p_partkey", "match_id")


@query(f"""with {SIDES_SQL} select team_id, count(*) filter (team_id < opp_team_id) home, round(avg(tm_pts) filter (team_id < opp_team_id), 5) home_ppg, round(avg(tm_pts) filter (team_id > opp_team_id), 5) away_ppg,
  round(sqrt(avg(pow(tm_pts - opp_pts, 2))), 5) rms_margin, round(var_samp(tm_pts), 4) var_pts from sides group by 1""")
def venue_splits(spark, sf_dir):
    home, away = F.col("team_id") < F.col("opp_team_id"), F.col("team_id") > F.col("opp_team_id")
    return sides(box_view(spark, sf_dir)).groupBy("team_id").agg(F.count_if(home).alias("home"), r(F.avg(F.when(home, F.col("tm_pts"))), "home_ppg"), r(F.avg(F.when(away, F.col("tm_pts"))), "away_ppg"), r(F.sqrt(F.avg(F.pow(F.col("tm_pts") - F.col("opp_pts"), 2))), "rms_margin"), r(F.var_samp("tm_pts"), "var_pts"))


@query("""select p_type, count(*) n, round(sum(l_quantity) / sum(sum(l_quantity)) over (), 6) share, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 4) per_shot from lineitem join part on l_partkey = p_partkey group by 1""")
def shot_diet(spark, sf_dir):
    z = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("x"))
    whole = z.agg(F.sum("q").alias("whole"))  # one row
    return z.crossJoin(F.broadcast(whole)).select("p_type", "n", r(sdiv(F.col("q"), F.col("whole")), "share"), r(sdiv(F.col("x"), F.col("q")), "per_shot"))


@query(f"""with {SEASON_SQL}, c as (select player_id, sum(pts) cp, sum("min") cm from ps group by 1)
  select season, season_type, player_id, round((pts + 400.0 * cp / nullif(cm, 0)) / ("min" + 400.0), 6) rate, round(pts * 1.0 / gp + 0.1 * pow(pts * 1.0 / gp, 2), 5) nb_var from ps join c using (player_id)""")
def regressed_rates(spark, sf_dir):
    s = player_seasons(spark, sf_dir)
    c = s.groupBy("player_id").agg(F.sum("pts").alias("cp"), F.sum("min").alias("cm"))
    per = sdiv(F.col("pts"), F.col("gp"))
    return s.join(c, "player_id").select("season", "season_type", "player_id", r(models.regressed_rate(F.col("pts"), F.col("min"), F.col("cp"), F.col("cm")), "rate"), r(models.nb_variance(per, F.lit(0.1)), "nb_var"))


@query(f"""with {BOX_SQL}, m as (select player_id, pts y, avg(pts) over (partition by player_id) mu from box),
 a as (select greatest(sum((pow(y - mu, 2) - mu) * mu * mu) / sum(mu * mu * mu * mu), 0.0) alpha from m)
 select player_id, count(*) n, round((count(*) * avg(pow(y - mu, 2) / (mu + alpha * mu * mu)) + 60) / (count(*) + 60), 5) multiplier from m, a where mu > 0 group by 1""")
def dispersion_multipliers(spark, sf_dir):
    m = box_view(spark, sf_dir).select("player_id", F.col("pts").alias("y"), F.avg("pts").over(Window.partitionBy("player_id")).alias("mu"))
    fitted = m.agg(models.fit_dispersion("y", "mu").alias("alpha"))  # one row
    z = F.pow(F.col("y") - F.col("mu"), 2) / models.nb_variance(F.col("mu"), F.col("alpha"))
    return m.where("mu > 0").crossJoin(F.broadcast(fitted)).groupBy("player_id").agg(F.count("*").alias("n"), r(models.shrunk_multiplier(F.avg(z), F.count("*")), "multiplier"))


CATS = ("pts", "ast", "stl", "blk", "fg3m")


@query(f"""with {SEASON_SQL}, l as (select player_id, {", ".join(f"cast(sum({s}) as double) / sum(gp) {s}" for s in CATS)} from ps group by 1), p as (select * from l order by round(pts, 6) desc, player_id limit 150),
 m as (select {", ".join(f"avg({s}) m_{s}, stddev_pop({s}) s_{s}" for s in CATS)} from p)
 select player_id, round({" + ".join(f"case when s_{s} > 0 then ({s} - m_{s}) / s_{s} else 0 end" for s in CATS)}, 9) total_z from l, m""", rounds=True)
def fantasy_values(spark, sf_dir):
    s = player_seasons(spark, sf_dir)
    lines = s.groupBy("player_id").agg(*(sdiv(F.sum(x), F.sum("gp")).alias(x) for x in CATS)).withColumn("seed", F.round("pts", 6))
    return models.value_pool(lines, 150, list(CATS), "seed", "player_id").select("player_id", rounded(F.col("total_z"), "total_z", 9))


@query(f"""with {SIDES_SQL} select game_id, team_id, tm_pts = 2 * (tm_fgm - tm_fg3m) + 3 * tm_fg3m + tm_ftm - 0 as points_ok, tm_fgm <= tm_fga and tm_fg3m <= tm_fg3a and tm_ftm <= tm_fta makes_ok, tm_pts <> opp_pts decided from sides""")
def quality_rules(spark, sf_dir):
    return sides(box_view(spark, sf_dir)).selectExpr("game_id", "team_id", "tm_pts = 2 * (tm_fgm - tm_fg3m) + 3 * tm_fg3m + tm_ftm as points_ok", "tm_fgm <= tm_fga and tm_fg3m <= tm_fg3a and tm_ftm <= tm_fta as makes_ok", "tm_pts != opp_pts as decided")


@query("""select n, ((n - 1) // 12) + 1 as "round", case when ((n - 1) // 12) % 2 = 0 then (n - 1) % 12 + 1 else 12 - (n - 1) % 12 end pick from (select distinct l_linenumber * 13 n from lineitem)""")
def snake_draft(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 13).alias("n")).distinct()
    return n.select("n", F.expr("cast((n - 1) div 12 + 1 as int)").alias("round"), F.expr("case when ((n - 1) div 12) % 2 = 0 then (n - 1) % 12 + 1 else 12 - (n - 1) % 12 end").alias("pick"))


@query("""select cast(ts as date) as "day", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def streamed_daily(spark, sf_dir):
    from boxlake.sources.shared import shared_dir
    from boxlake.streaming.ingest import stream_daily

    schema = table(spark, sf_dir, "events").schema
    return stream_daily(spark, sf_dir, "events.parquet", schema, shared_dir(spark)).select("day", "event_type", "n", r(F.col("total"), "total"))
