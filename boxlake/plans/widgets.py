"""Queries that answer one view each: tiles, logs, boards, slates, tables of the second league."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions import boxscore as b
from boxlake.functions.nullsafe import sdiv
from boxlake.functions import parsing
from boxlake.operators import availability, ingest, merge, quality, ratings, windows
from boxlake.plans.queries import SEASON_SQL, player_seasons, query, r, rounded
from boxlake.sources.tables import BOX_SQL, SIDES_SQL, box_view, by_player, games, sides, table, tasks

SCOPE = ["season", "season_type"]


@query(f"""with {SIDES_SQL}, l as (select x.player_id, x.game_id, x.game_date, s.opp_team_id, case when s.tm_pts > s.opp_pts then 'W' when s.tm_pts < s.opp_pts then 'L' else 'T' end outcome, x.pts, x.pts || ' PTS · ' || (x.oreb + x.dreb) || ' REB · ' || x.ast || ' AST' line,
   row_number() over (partition by x.player_id order by x.game_date desc, x.game_id desc) n from box x join sides s on s.game_id = x.game_id and s.team_id = x.team_id) select * from l where n <= 5""")
def game_log(spark, sf_dir):
    """The five newest games of every player, with the opponent, the outcome and the line in words."""
    box = box_view(spark, sf_dir)
    at = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    newest = by_player(spark, sf_dir, box).withColumn("n", F.row_number().over(at)).where("n <= 5")
    scores = sides(box).select("game_id", "team_id", "opp_team_id", "tm_pts", "opp_pts")
    n, side = tasks(spark, sf_dir), ["game_id", "team_id"]
    outcome = F.when(F.col("tm_pts") > F.col("opp_pts"), "W").when(F.col("tm_pts") < F.col("opp_pts"), "L").otherwise("T")
    line = F.concat_ws(" · ", F.concat("pts", F.lit(" PTS")), F.concat(F.col("oreb") + F.col("dreb"), F.lit(" REB")), F.concat("ast", F.lit(" AST")))
    return newest.repartition(n, *side).join(scores.repartition(n, *side), side).select("player_id", "game_id", "game_date", "opp_team_id", outcome.alias("outcome"), "pts", line.alias("line"), "n")


@query(f"""with {SEASON_SQL}, v as (select season, season_type, player_id, gp, cast(pts as double) / gp v from ps), k as (select *, dense_rank() over (partition by season, season_type order by v desc) place, count(*) over (partition by season, season_type) field, avg(v) over (partition by season, season_type) mean,
  rank() over (partition by season, season_type order by v) - 1 below, count(*) over (partition by season, season_type, v) same from v)
  select season, season_type, player_id, v, place, field, v - mean delta, (below + 0.5 * same) / field percentile from k where player_id % 10 = 1""")
def stat_tile(spark, sf_dir):
    """One figure with its place, its percentile in the field and its distance from the mean."""
    by = Window.partitionBy(*SCOPE)
    v = player_seasons(spark, sf_dir).select(*SCOPE, "player_id", (F.col("pts") / F.col("gp")).alias("v"))
    ranked = v.select("*", windows.dense_rank_by("v", SCOPE).cast("long").alias("place"), F.count("*").over(by).alias("field"), r(F.col("v") - F.avg("v").over(by), "delta"), r(windows.midrank_percentile("v", SCOPE), "percentile"))
    return ranked.where("player_id % 10 = 1")


@query(f"""with {BOX_SQL}, k as (select *, row_number() over (partition by player_id order by game_date desc, game_id desc) n, max(season) over (partition by player_id) now_ from box)
  select player_id, max(case when n = 1 then team_id end) team_id, max(case when n = 1 then game_id end) last_game, max(case when n = 1 then pts end) last_pts, count(*) gp, avg(pts) career_ppg, avg(case when season = now_ then pts end) season_ppg, avg(case when n <= 5 then pts end) recent_ppg from k group by 1""")
def player_snapshot(spark, sf_dir):
    """The newest game, team and line of every player beside recent, season and career means."""
    newest = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    k = box_view(spark, sf_dir).withColumn("n", F.row_number().over(newest)).withColumn("now", F.max("season").over(Window.partitionBy("player_id")))
    last = lambda c, name: F.max(F.when(F.col("n") == 1, F.col(c))).alias(name)
    mean = lambda cond, name: r(F.avg(F.when(cond, F.col("pts"))), name)
    return k.groupBy("player_id").agg(last("team_id", "team_id"), last("game_id", "last_game"), last("pts", "last_pts"), F.count("*").alias("gp"), mean(F.lit(True), "career_ppg"), mean(F.col("season") == F.col("now"), "season_ppg"), mean(F.col("n") <= 5, "recent_ppg"))


@query(f"""with {SEASON_SQL}, m as (unpivot (select season, season_type, player_id, cast(pts as double) / gp ppg, cast(ast as double) / gp apg, cast(tov as double) / gp topg from ps) on ppg, apg, topg into name metric value v)
  select a.season, a.season_type, a.metric, a.player_id, b.player_id other_id, a.v own, b.v other, case when a.v = b.v then 'level' when (a.v > b.v) = (a.metric <> 'topg') then 'own' else 'other' end better
  from m a join m b on a.season = b.season and a.season_type = b.season_type and a.metric = b.metric and b.player_id = a.player_id + 1 where a.player_id % 2 = 0""")
def comparison(spark, sf_dir):
    """Neighbouring players side by side; fewer turnovers are better, more of everything else."""
    per = player_seasons(spark, sf_dir).select(*SCOPE, "player_id", *((F.col(s) / F.col("gp")).alias(n) for s, n in (("pts", "ppg"), ("ast", "apg"), ("tov", "topg"))))
    m = per.unpivot([*SCOPE, "player_id"], ["ppg", "apg", "topg"], "metric", "v")
    own = m.where("player_id % 2 = 0").withColumnRenamed("v", "own")
    other = m.select(*SCOPE, "metric", (F.col("player_id") - 1).alias("player_id"), F.col("player_id").alias("other_id"), F.col("v").alias("other"))
    both = own.join(other, [*SCOPE, "metric", "player_id"])
    ahead = (F.col("own") > F.col("other")) == (F.col("metric") != "topg")
    return both.select(*SCOPE, "metric", "player_id", "other_id", "own", "other", F.when(F.col("own") == F.col("other"), "level").when(ahead, "own").otherwise("other").alias("better"))


@query(f"""with {SIDES_SQL}, k as (select game_date, game_id, home_id, away_id, h_pts, a_pts, season_type from pre), s as (select *, case season_type when 'F' then 'final' when 'P' then 'live' else 'scheduled' end status from k)
  select game_date, game_id, home_id, away_id, case when status <> 'scheduled' then h_pts end home_pts, case when status <> 'scheduled' then a_pts end away_pts, status, case when status = 'final' and abs(h_pts - a_pts) < 0.5 then 'Toss-up' when status = 'final' then (case when h_pts > a_pts then home_id else away_id end) || ' by ' || abs(h_pts - a_pts) end summary,
  row_number() over (partition by game_date order by game_id) slot from s""")
def scoreboard(spark, sf_dir):
    """Slates by day: both sides' points in one row, status, and the result in words."""
    status = F.when(F.col("season_type") == "F", "final").when(F.col("season_type") == "P", "live").otherwise("scheduled")
    g = games(box_view(spark, sf_dir)).withColumn("status", status)
    shown = lambda c, name: F.when(F.col("status") != "scheduled", F.col(c)).alias(name)
    gap = F.abs(F.col("h_pts") - F.col("a_pts"))
    words = F.when(gap < 0.5, "Toss-up").otherwise(F.concat(F.when(F.col("h_pts") > F.col("a_pts"), F.col("home_id")).otherwise(F.col("away_id")), F.lit(" by "), gap))
    slot = F.row_number().over(Window.partitionBy("game_date").orderBy("game_id")).cast("long").alias("slot")
    return g.select("game_date", "game_id", "home_id", "away_id", shown("h_pts", "home_pts"), shown("a_pts", "away_pts"), "status", F.when(F.col("status") == "final", words).alias("summary"), slot)


@query(f"""with {BOX_SQL}, o as (select *, pk_started from (select *, pts % 5 < 3 pk_started from box)) select game_id, team_id, player_id, pk_started started, pts, row_number() over (partition by game_id, team_id order by pk_started desc, "min" desc, player_id) place from o""")
def box_score(spark, sf_dir):
    """The players of every game and side: starters first, then by minutes."""
    at = Window.partitionBy("game_id", "team_id").orderBy(F.desc("started"), F.desc("min"), "player_id")
    return box_view(spark, sf_dir).withColumn("started", F.expr("pts % 5 < 3")).select("game_id", "team_id", "player_id", "started", "pts", F.row_number().over(at).cast("long").alias("place"))


@query(f"""with {SIDES_SQL}, t as (select team_id, count(*) gp, count(*) filter (tm_pts > opp_pts) wins, sum(tm_pts) p, min(game_date) since from sides where season_type in ('F', 'O') group by 1)
  select n_nationkey team_id, n_name name, r_name conference, coalesce(gp, 0) gp, coalesce(wins, 0) wins, cast(wins as double) / gp win_pct, cast(p as double) / gp ppg, since from nation join region on n_regionkey = r_regionkey left join t on t.team_id = n_nationkey where r_name in ('ASIA', 'EUROPE', 'AMERICA')""")
def teams_list(spark, sf_dir):
    """Teams of some conferences with their record over competitive games; teams without games stay."""
    t = sides(box_view(spark, sf_dir)).where(F.col("season_type").isin("F", "O")).groupBy("team_id").agg(F.count("*").alias("gp"), F.count_if(F.col("tm_pts") > F.col("opp_pts")).alias("wins"), F.sum("tm_pts").alias("p"), F.min("game_date").alias("since"))
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE", "AMERICA")), F.col("n_regionkey") == F.col("r_regionkey"))
    full = named.join(F.broadcast(t), F.col("n_nationkey") == F.col("team_id"), "left")  # at most one row a team
    none = F.lit(0).cast("long")
    return full.select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"), F.col("r_name").alias("conference"), F.coalesce("gp", none).alias("gp"), F.coalesce("wins", none).alias("wins"), r(sdiv(F.col("wins"), F.col("gp")), "win_pct"), r(sdiv(F.col("p"), F.col("gp")), "ppg"), "since")


@query(f"""with {SIDES_SQL}, u as (select game_id, game_date, home_id team_id, away_id opponent_id, true is_home from pre where season_type = 'O' and game_date >= date '1997-01-01' union all select game_id, game_date, away_id, home_id, false from pre where season_type = 'O' and game_date >= date '1997-01-01')
  select team_id, game_id, game_date, opponent_id, is_home from (select *, row_number() over (partition by team_id order by game_date, game_id) i from u) where i = 1""")
def next_games(spark, sf_dir):
    """The first scheduled game of every team, home or away, from a day on."""
    g = games(box_view(spark, sf_dir)).where("season_type = 'O' and game_date >= date'1997-01-01'")
    both = g.selectExpr("game_id", "game_date", "stack(2, home_id, away_id, true, away_id, home_id, false) as (team_id, opponent_id, is_home)")
    first = both.groupBy("team_id").agg(F.min(F.struct("game_date", "game_id", "opponent_id", "is_home")).alias("g"))  # combines before the shuffle, unlike a window by team
    return first.select("team_id", "g.game_id", "g.game_date", "g.opponent_id", "g.is_home")


@query(f"with {BOX_SQL} select season, season_type, count(distinct game_id) games, count(*) lines, count(distinct player_id) players, max(game_date) through, 1 - avg(case when pk_missing then 1.0 else 0.0 end) coverage from (select *, pts % 11 = 0 pk_missing from box) group by 1, 2")
def coverage_counts(spark, sf_dir):
    """What is stored by season and type: games, lines, players, the newest day and how much of it is complete."""
    return box_view(spark, sf_dir).groupBy(*SCOPE).agg(F.countDistinct("game_id").alias("games"), F.count("*").alias("lines"), F.countDistinct("player_id").alias("players"), F.max("game_date").alias("through"), r(1 - F.avg(F.expr("if(pts % 11 = 0, 1d, 0d)")), "coverage"))


@query(f"with {SEASON_SQL} select player_id, season, season_type, pts, gp from ps where gp >= 3 order by pts desc, season, season_type, player_id limit 50")
def all_time_leaders(spark, sf_dir):
    """The best fifty season lines of all; every row keeps its season."""
    return player_seasons(spark, sf_dir).where("gp >= 3").orderBy(F.desc("pts"), *SCOPE, "player_id").limit(50).select("player_id", *SCOPE, "pts", "gp")


@query(f"""with {SIDES_SQL}, d as (select season, team_id, game_date, count(*) n, sum(tm_pts * 2880.0 / (2880 + 300 * (game_id % 4))) p, sum(opp_pts * 100.0 / (tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov)) q from sides group by 1, 2, 3)
  select season, team_id, game_date, sum(p) over w / sum(n) over w pts_before, sum(q) over w / sum(n) over w drtg_before, cast(sum(n) over w as bigint) games_before from d window w as (partition by season, team_id order by game_date rows between unbounded preceding and 1 preceding)""")
def team_form(spark, sf_dir):
    """Regulation-scaled points and defensive rating of each team's games before a day; days are aggregated first, so a window holds days, not games."""
    s = sides(box_view(spark, sf_dir))
    scaled = F.col("tm_pts") * 2880.0 / (2880 + 300 * (F.col("game_id") % 4))
    d = s.groupBy("season", "team_id", "game_date").agg(F.count("*").alias("n"), F.sum(scaled).alias("p"), F.sum(b.team_defensive_rating()).alias("q"))
    before = Window.partitionBy("season", "team_id").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.sum(c).over(before)
    return d.select("season", "team_id", "game_date", r(sdiv(so_far("p"), so_far("n")), "pts_before"), r(sdiv(so_far("q"), so_far("n")), "drtg_before"), so_far("n").alias("games_before"))


SECOND_SQL = f"""with {BOX_SQL}, l as (select season, player_id, "min" m, case when pts % 13 > 0 then pts end p, fgm, case when fga % 17 > 0 then fga end a from box),
 g as (select season, player_id, count(p) lines, sum(p) total, sum(case when p is not null then m end) mp, sum(case when a is not null then fgm end) made, sum(a) tried from l group by 1, 2)"""


@query(SECOND_SQL + """ select season, player_id, total totals, total * 1.0 / nullif(lines, 0) per_game, 40.0 * total / nullif(mp, 0) per_40, made * 1.0 / nullif(tried, 0) pct, row_number() over (partition by season order by 40.0 * total / nullif(mp, 0) desc nulls last, player_id) place from g""")
def second_league_table(spark, sf_dir):
    """Totals, per game and per 40 minutes over each figure's own recorded lines; percentages over lines that have both parts; missing values last."""
    p, a = F.expr("if(pts % 13 > 0, pts, null)"), F.expr("if(fga % 17 > 0, fga, null)")
    l = box_view(spark, sf_dir).select("season", "player_id", F.col("min").alias("m"), p.alias("p"), "fgm", a.alias("a"))  # noqa: E741
    g = l.groupBy("season", "player_id").agg(F.count("p").alias("lines"), F.sum("p").alias("totals"), F.sum(F.when(F.col("p").isNotNull(), F.col("m"))).alias("mp"), F.sum(F.when(F.col("a").isNotNull(), F.col("fgm"))).alias("made"), F.sum("a").alias("tried"))
    per_40 = sdiv(40.0 * F.col("totals"), F.col("mp"))
    place = F.row_number().over(Window.partitionBy("season").orderBy(F.desc_nulls_last("per_40"), "player_id"))  # season lines, not games
    return g.withColumn("per_40", per_40).select("season", "player_id", "totals", r(sdiv(F.col("totals"), F.col("lines")), "per_game"), "per_40", r(sdiv(F.col("made"), F.col("tried")), "pct"), place.cast("long").alias("place"))


@query(f"""with {SIDES_SQL}, d as (select distinct season, team_id, game_date from sides), n as (select *, row_number() over (partition by season, team_id order by game_date) n from d)
  select season, team_id, game_date, n, case n when 1 then 0.10 when 2 then 0.09 else 1.0 / (n + 9) end weight, n > 2 extrapolated from n""")
def club_game_numbers(spark, sf_dir):
    """Each club's days in order with the weight of an update: a table for the first, a rule beyond."""
    d = sides(box_view(spark, sf_dir)).select("season", "team_id", "game_date").distinct()
    n = d.withColumn("n", F.row_number().over(Window.partitionBy("season", "team_id").orderBy("game_date")).cast("long"))
    return n.select("*", F.when(F.col("n") == 1, 0.10).when(F.col("n") == 2, 0.09).otherwise(1.0 / (F.col("n") + 9)).alias("weight"), (F.col("n") > 2).alias("extrapolated"))


@query(f"""with {BOX_SQL} select player_id, game_id, avg(pts) over (partition by player_id order by game_date, game_id rows between 10 preceding and 1 preceding) form, list(pts) over (partition by player_id order by game_date, game_id rows between 5 preceding and 1 preceding) is null first_game from box where "min" > 12""")
def form_before(spark, sf_dir):
    """Mean points of the last ten games that a player took part in before each."""
    by = Window.partitionBy("player_id").orderBy("game_date", "game_id")
    played = box_view(spark, sf_dir).where("min > 12")
    return played.select("player_id", "game_id", r(F.avg("pts").over(by.rowsBetween(-10, -1)), "form"), F.lag("pts").over(by).isNull().alias("first_game"))


# What a scoring system pays for each statistic.
SCORING = {"espn": {"pts": 1, "oreb": 1, "dreb": 1, "ast": 2, "stl": 4, "blk": 4, "tov": -2, "fgm": 2, "fga": -1, "ftm": 1, "fta": -1, "fg3m": 1}, "yahoo": {"pts": 1, "oreb": 1.2, "dreb": 1.2, "ast": 1.5, "stl": 3, "blk": 3, "tov": -1}}


@query(f"""with {BOX_SQL}, p as (select game_date, game_id, player_id, {", ".join("(" + " + ".join(f"{w} * {s}" for s, w in m.items()) + f") * 1.0 {name}" for name, m in SCORING.items())} from box where "min" >= 12)
  select * from (select *, row_number() over (partition by game_date order by espn desc, game_id, player_id) place from p) where place <= 3""")
def fantasy_night(spark, sf_dir):
    """The three best lines of every day by a scoring system, of those that played enough."""
    points = lambda name: sum((w * F.col(s) for s, w in SCORING[name].items()), F.lit(0.0)).alias(name)
    p = box_view(spark, sf_dir).where("min >= 12").select("game_date", "game_id", "player_id", points("espn"), points("yahoo"))
    best = F.row_number().over(Window.partitionBy("game_date").orderBy(F.desc("espn"), "game_id", "player_id"))
    return p.withColumn("place", best.cast("long")).where("place <= 3")


@query("""with o as (select o_orderkey k, o_orderstatus q, o_totalprice * 1.0 p from orders where o_orderkey % 4 <> 0), i as (select o_orderkey k, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end q, o_totalprice * 1.0 + case when o_orderkey % 5 = 0 then 1e-10 when o_orderkey % 7 = 0 then 1 else 0 end p from orders where o_orderkey % 4 <> 1)
  select coalesce(o.k, i.k) k, case when o.k is null then 'insert' when i.k is null then 'stale' when o.q is distinct from i.q or abs(o.p - i.p) > 1e-9 then 'update' else 'same' end change, coalesce(i.q, o.q) q from o full join i on o.k = i.k""")
def upserted_orders(spark, sf_dir):
    """A keyed merge: what an incoming batch inserts, changes, leaves alone (floats within 1e-9) or no longer holds."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("q"), (F.col("o_totalprice") * 1.0).cast("double").alias("p"))
    new = o.where("k % 4 != 1").select("k", F.expr("if(k % 3 = 0, 'X', q)").alias("q"), F.expr("p + if(k % 5 = 0, 1e-10d, if(k % 7 = 0, 1d, 0d))").alias("p"))
    return merge.merged(o.where("k % 4 != 0"), new, ["k"]).select("k", "change", "q")


@query(f"""with {BOX_SQL}, c as (select distinct season, season_type from box where game_id % 500 = 7), d as (select game_date, bool_and(season_type = 'F') done from box group by 1), w as (select max(game_date) through from d where done and game_date < (select coalesce(min(game_date), date '9999-01-01') from d where not done))
  select c.season, c.season_type, w.through from c, w""")
def affected_seasons(spark, sf_dir):
    """The seasons that changed games belong to, beside the day through which every slate is final."""
    box = box_view(spark, sf_dir)
    changed = box.where("game_id % 500 = 7").select(*SCOPE).distinct()
    return changed.crossJoin(F.broadcast(merge.data_through(box.withColumn("final", F.col("season_type") == "F"), "game_date", "final")))  # one row


@query(f"""with {BOX_SQL}, m as (select season, player_id, max_by(team_id, (n, -team_id)) team_id from (select season, player_id, team_id, count(*) n from box group by 1, 2, 3) group by 1, 2), z as (select season, player_id, ('rim', 'mid', 'three')[cast(pts % 3 as int) + 1] zone_, fga, fgm, pts from box)
  select m.season, m.team_id, zone_ as zone, sum(fga) attempts, sum(fgm) * 1.0 / nullif(sum(fga), 0) pct, sum(fga) * 1.0 / sum(sum(fga)) over (partition by m.season, m.team_id) share, sum(pts) * 1.0 / nullif(sum(fga), 0) per_shot from z join m on m.season = z.season and m.player_id = z.player_id group by 1, 2, 3""".replace("('rim', 'mid', 'three')[cast(pts % 3 as int) + 1]", "case pts % 3 when 0 then 'rim' when 1 then 'mid' else 'three' end"))
def shot_zones(spark, sf_dir):
    """Zones of a team, from its players by the team each mainly played for."""
    box = box_view(spark, sf_dir)
    stints = box.groupBy("season", "player_id", "team_id").agg(F.count("*").alias("n"))
    main = stints.groupBy("season", "player_id").agg(F.max(F.struct("n", (-F.col("team_id")).alias("t"))).alias("x")).select("season", "player_id", (-F.col("x.t")).alias("team_id"))
    zone = F.expr("element_at(array('rim', 'mid', 'three'), cast(pts % 3 as int) + 1)").alias("zone")
    by_player = box.groupBy("season", "player_id", zone).agg(*(F.sum(s).alias(s) for s in ("fga", "fgm", "pts")))
    z = by_player.join(main, ["season", "player_id"]).groupBy("season", "team_id", "zone").agg(*(F.sum(s).alias(s) for s in ("fga", "fgm", "pts")))
    whole = F.sum("fga").over(Window.partitionBy("season", "team_id"))  # three rows
    return z.select("season", "team_id", "zone", F.col("fga").alias("attempts"), r(sdiv(F.col("fgm"), F.col("fga")), "pct"), r(sdiv(F.col("fga"), whole), "share"), r(sdiv(F.col("pts"), F.col("fga")), "per_shot"))


@query(f"""with {SIDES_SQL}, p as (select season, h_pts - a_pts margin, (h_fgm - a_fgm) * 2.0 guess from pre) select season, count(*) games, count(*) filter (abs(guess) >= 0.5) decided, count(*) filter (abs(guess) >= 0.5 and sign(guess) = sign(margin)) called, count(*) filter (abs(guess) < 0.5) toss_ups, avg(abs(margin - guess)) miss, sqrt(avg(pow(margin - guess, 2))) rms from p group by 1""")
def review_metrics(spark, sf_dir):
    """How projected margins did: games, decided ones, winners called, toss-ups, mean and root mean square misses."""
    margin, guess = F.col("h_pts") - F.col("a_pts"), (F.col("h_fgm") - F.col("a_fgm")) * 2.0
    p = games(box_view(spark, sf_dir)).select("season", margin.alias("margin"), guess.alias("guess"))
    decided = F.abs("guess") >= 0.5
    miss = F.col("margin") - F.col("guess")
    return p.groupBy("season").agg(F.count("*").alias("games"), F.count_if(decided).alias("decided"), F.count_if(decided & (F.signum("guess") == F.signum(F.col("margin").cast("double")))).alias("called"), F.count_if(~decided).alias("toss_ups"), r(F.avg(F.abs(miss)), "miss"), r(F.sqrt(F.avg(miss * miss)), "rms"))


@query(f"""with {BOX_SQL}, p as (select season, ['G', 'F', 'C'][cast(player_id % 3 as int) + 1] bucket, sum("min") m, sum(pts) p, sum(fgm) fgm, sum(fga) fga from box group by season, player_id, 2)
  select season, bucket, sum(m * (p * 1.0 / m)) / sum(m) pts_rate, sum(fgm) * 1.0 / nullif(sum(fga), 0) pct, count(*) players from p group by 1, 2""")
def pooled_position_rates(spark, sf_dir):
    """Rates of a position, weighted by minutes; percentages from the made and the tried."""
    bucket = F.expr("element_at(array('G', 'F', 'C'), cast(player_id % 3 as int) + 1)").alias("bucket")
    p = box_view(spark, sf_dir).groupBy("season", "player_id", bucket).agg(*(F.sum(s).alias(s) for s in ("min", "pts", "fgm", "fga")))
    return p.groupBy("season", "bucket").agg(r(sdiv(F.sum(F.col("min") * sdiv(F.col("pts"), F.col("min"))), F.sum("min")), "pts_rate"), r(sdiv(F.sum("fgm"), F.sum("fga")), "pct"), F.count("*").alias("players"))


@query(f"""with {SEASON_SQL} select season, season_type, player_id, cast(case when season < 1994 then coalesce(nullif(fg3m, fg3m), 0) else fg3m end as double) threes, (oreb + dreb) * 1.0 reb, pts * 1.0 totals, pts * 1.0 / gp per_game, 36.0 * pts / nullif("min", 0) per_36, 100.0 * pts / nullif(fga + 0.44 * fta - oreb + tov, 0) per_100 from ps""")
def season_values(spark, sf_dir):
    """A season figure in every mode; rebounds from their parts, threes before a year as true zeros."""
    s = player_seasons(spark, sf_dir)
    mode = lambda m, name: r(b.per_mode(F.col("pts").cast("double"), m, F.col("gp"), F.col("min"), b.possessions(), F.lit(None)), name)
    threes = F.when(F.col("season") < 1994, 0.0).otherwise(F.col("fg3m").cast("double"))
    return s.select(*SCOPE, "player_id", threes.alias("threes"), r(F.coalesce(F.lit(None), F.col("oreb") + F.col("dreb")), "reb"), mode("Totals", "totals"), mode("PerGame", "per_game"), mode("Per36", "per_36"), mode("Per100", "per_100"))


@query(f"""with {BOX_SQL}, f as (select game_id, team_id, player_id, pts - case when game_id % 7 = 0 then 1 else 0 end pts, fgm, case when player_id % 9 = 0 then fgm - 1 else fga end fga, fg3m, ftm, case when game_id % 11 = 0 then null else "min" end m from box),
  u as (select * from f union all select * from f where player_id % 50 = 1), l as (select game_id, team_id, player_id, count(*) copies, max(pts) pts, max(fgm) fgm, max(fga) fga, max(fg3m) fg3m, max(ftm) ftm, max(m) m from u group by 1, 2, 3)
  select game_id, count(*) filter (copies > 1) duplicates, count(*) filter (pts <> 2 * (fgm - fg3m) + 3 * fg3m + ftm) points_wrong, count(*) filter (fgm > fga) makes_over, count(*) filter (m is null) no_minutes,
  count(*) filter (copies > 1) + count(*) filter (pts <> 2 * (fgm - fg3m) + 3 * fg3m + ftm) + count(*) filter (fgm > fga) = 0 accepted from l group by 1""")
def game_checks(spark, sf_dir):
    """Hard rules (duplicates, points that do not add up, makes over attempts) and a soft one by game, on lines with planted faults."""
    faulty = box_view(spark, sf_dir).selectExpr("game_id", "team_id", "player_id", "pts - if(game_id % 7 = 0, 1, 0) as pts", "fgm", "if(player_id % 9 = 0, fgm - 1, fga) as fga", "fg3m", "ftm", "if(game_id % 11 = 0, null, min) as min")
    return quality.checked_games(faulty.unionByName(faulty.where("player_id % 50 = 1")))


TEXTS = ("Round 4", "Around 8 Oct", "At least six weeks", "Out for the season", "Until November", "Day to day", "2-3 weeks", "Marc questionable", "0 weeks", "Around 8 Janua")
AS_OF = "2024-03-01 12:00:00"
ENTRIES_SQL = f"""with e as (select event_id, user_id player, ts, ['league', 'club', 'press'][cast(event_id % 3 as int) + 1] source, [{", ".join(f"'{t}'" for t in TEXTS)}][cast(event_id % 10 as int) + 1] txt from events where event_type in ('error', 'view')),
 p as (select user_id player, max(ts) played from events where event_type = 'purchase' group by 1),
 h as (select *, cast(ts as date) d from e),
 f as (select h.*, p.played, case event_id % 10 when 1 then case when make_date(year(d), 10, 8) >= d - 31 then make_date(year(d), 10, 8) else make_date(year(d) + 1, 10, 8) end end back,
   case event_id % 10 when 2 then d + 42 when 6 then d + 21 when 1 then case when make_date(year(d), 10, 31) < d - 31 then make_date(year(d) + 1, 10, 31) else make_date(year(d), 10, 31) end when 4 then case when make_date(year(d), 11, 30) < d - 31 then make_date(year(d) + 1, 11, 30) else make_date(year(d), 11, 30) end end horizon from h left join p using (player)),
 v as (select *, case when date '2024-03-01' > back then 'returnDatePassed' when played > ts then 'playedSince' when timestamp '{AS_OF}' > ts + interval 14 days and event_id % 10 <> 3 and (horizon is null or date '2024-03-01' > horizon) then 'tooOld' end reason from f)"""


def availability_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "player")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    played = e.where("event_type = 'purchase'").groupBy("player").agg(F.max("ts").alias("played"))
    entries = e.where("event_type in ('error', 'view')").select("event_id", "player", "ts", pick(("league", "club", "press"), 3).alias("source"), pick(TEXTS, 10).alias("txt"))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    full = entries.join(played, "player", "left").withColumn("reason", availability.out_of_force(F.col("ts").cast("timestamp_ntz"), F.col("txt"), F.col("played").cast("timestamp_ntz"), as_of))
    return full.withColumn("stale", availability.stale(F.col("ts").cast("timestamp_ntz"), F.col("txt"), F.col("reason"), as_of))


@query(ENTRIES_SQL + f""" select event_id, player, source, txt, reason, reason is not null or date_diff('microsecond', ts, timestamp '{AS_OF}') / 6e7 > case when event_id % 10 = 3 then 10080 else 1440 end stale from v""")
def availability_in_force(spark, sf_dir):
    """Why each entry is out of force on a day, if it is, and whether it is stale."""
    return availability_entries(spark, sf_dir).select("event_id", "player", "source", "txt", "reason", "stale")


@query(ENTRIES_SQL + """, n as (select *, row_number() over (partition by player, source order by ts desc, event_id desc) i from v where reason is null), k as (select *, row_number() over (partition by player order by case source when 'league' then 1 when 'club' then 2 else 3 end, ts desc, event_id desc) j from n where i = 1)
  select player, source, event_id, txt from k where j = 1""")
def availability_resolved(spark, sf_dir):
    """The entry that counts for each player: the league's newest before the club's before the press's."""
    inforce = availability_entries(spark, sf_dir).where("reason is null").select("player", "source", "ts", "event_id", "txt")
    return availability.resolved(inforce, "player", "source", "ts", "event_id", {"league": 1, "club": 2, "press": 3}).select("player", "source", "event_id", "txt")


@query(ENTRIES_SQL + """ select source, count(*) entries, count(*) filter (reason is null) in_force, count(*) filter (reason = 'tooOld') too_old, count(*) filter (reason = 'playedSince') played_since, count(*) filter (played is null) unmatched from v group by 1""")
def availability_report(spark, sf_dir):
    e = availability_entries(spark, sf_dir)
    return e.groupBy("source").agg(F.count("*").alias("entries"), F.count_if(F.col("reason").isNull()).alias("in_force"), F.count_if(F.col("reason") == "tooOld").alias("too_old"), F.count_if(F.col("reason") == "playedSince").alias("played_since"), F.count_if(F.col("played").isNull()).alias("unmatched"))


REASONS = {"Injury/Illness - Left Knee; Soreness": "injury", "Injury/Illness - Illness; Flu": "illness", "Not With Team - Personal": "notWithTeam", "G League - Two-Way": "gLeague", "League Suspension": "suspension", "Rest": "rest", "Personal Reasons": "personal", "Coach decision": "other", "  ": None}
STATES = {"Final/OT": "final", "Halftime": "live", "Q3 4:21": "live", "7:30 pm ET": "scheduled", "4:21": "live", "": "scheduled"}
KINDS = {"Pre-Season": "Pre Season", "All-Star Game": "All Star", "Play-In": "Play In", "Post season": "Playoffs", "regular": "Regular Season"}


def _values(pairs: dict) -> str:
    quoted = lambda v: "null" if v is None else f"'{v}'"
    return ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(pairs.items()))


@query(f"""with o as (select o_orderkey k, o_orderdate d from orders), a(i, t, v) as (values {_values(REASONS)}), s(i, t, v) as (values {_values(STATES)}), z(i, t, v) as (values {_values(KINDS)})
  select k, a.v reason, s.v status, z.v kind, year(d) || '-' || lpad(cast((year(d) + 1) % 100 as varchar), 2, '0') season, timezone('UTC', timezone('America/New_York', cast(d as timestamp) + interval 19 hours)) tip from o join a on a.i = k % 9 join s on s.i = k % 6 join z on z.i = k % 5""")
def parsed_labels(spark, sf_dir):
    """Reasons, states, season kinds and tip-off times as sources write them, in the library's vocabulary."""
    pick = lambda pairs, n: F.element_at(F.array(*map(F.lit, pairs)), (F.col("o_orderkey") % n + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    wall = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 19 hours")
    return o.select(
        F.col("o_orderkey").alias("k"), parsing.reason_category(pick(REASONS, 9)).alias("reason"), parsing.game_status(F.lit(None), pick(STATES, 6)).alias("status"), parsing.canonical_season_type(pick(KINDS, 5)).alias("kind"),
        parsing.season_from_season_id(F.concat(F.lit("2"), F.year("o_orderdate"))).alias("season"), parsing.eastern_to_utc(wall.cast("timestamp")).cast("timestamp_ntz").alias("tip"),
    )


@query("""select l_orderkey game_id, l_suppkey player_id, max(l_quantity) pts, max(l_tax * 1.0) pct from lineitem group by 1, 2""")
def result_set_rows(spark, sf_dir):
    """Payloads of headers and row arrays as rows: one JSON text a game, read back by position, percentages from 0-100 to fractions."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    row = F.array(F.col("l_suppkey").cast("string"), F.col("q").cast("string"), (F.col("t") * 100).cast("string"))
    lines = l.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"), F.max(F.col("l_tax") * 1.0).alias("t"))
    payload = lines.groupBy("l_orderkey").agg(F.to_json(F.struct(F.lit("Players").alias("name"), F.array(F.lit("PLAYER_ID"), F.lit("PTS"), F.lit("TAX_PCT")).alias("headers"), F.collect_list(row).alias("rowSet"))).alias("json"))
    return ingest.result_set(payload, "json", {"PLAYER_ID": ("player_id", "long"), "PTS": ("pts", "double"), "TAX_PCT": ("pct", "double")}, percent={"TAX_PCT"}, keep=["l_orderkey"]).withColumnRenamed("l_orderkey", "game_id")


PRIOR_SQL = f"""with {SIDES_SQL}, t as (select season, season_type, home_id team_id, h_pts p, a_pts a from pre union all select season, season_type, away_id, a_pts, h_pts from pre),
 l as (select season, season_type, avg(p) level from t group by 1, 2), m as (select season, season_type, team_id, case when count(*) >= 10 then avg(p) end pf, case when count(*) >= 10 then avg(a) end pa from t group by 1, 2, 3),
 g as (select g.*, l.level, 0.9 + 0.1 * (g.game_id % 2) factor, case when g.game_id % 5 = 0 then 0.0 else 2.5 end edge, l.level + 0.7 * (coalesce(x.pf, l.level) - l.level) hf, l.level + 0.7 * (coalesce(x.pa, l.level) - l.level) ha, l.level + 0.7 * (coalesce(y.pf, l.level) - l.level) af, l.level + 0.7 * (coalesce(y.pa, l.level) - l.level) aa
   from pre g join l on l.season + 1 = g.season and l.season_type = g.season_type join m x on x.season + 1 = g.season and x.season_type = g.season_type and x.team_id = g.home_id join m y on y.season + 1 = g.season and y.season_type = g.season_type and y.team_id = g.away_id),
 q as (select *, level * (hf * factor / level) * (aa / level) + edge / 2 home_points, level * (af / level) * (ha / level) - edge / 2 away_points, hf * (1 - factor) * aa / level lost from g)"""


@query(PRIOR_SQL + """ select season, season_type, game_id, home_points, away_points, home_points - away_points margin, home_points - away_points - 1.2816 * 11.5 margin_low, home_points - away_points + 1.2816 * 11.5 margin_high, -lost absence_effect, hf / level attack_index, case when abs(home_points - away_points) < 0.5 then 'toss-up' when home_points > away_points then 'home' else 'away' end winner from q""")
def match_projections(spark, sf_dir):
    """Every game from last season's ratings: points, margin with its interval, winner, and what absences cost."""
    box = box_view(spark, sf_dir)
    prior = ratings.season_means(with_home(box), SCOPE)
    g = games(box).select(*SCOPE, "game_id", "home_id", "away_id", F.expr("0.9d + 0.1d * (game_id % 2)").alias("factor"), F.expr("game_id % 5 = 0").alias("neutral"))
    winner = F.when(F.abs("margin") < 0.5, "toss-up").when(F.col("margin") > 0, "home").otherwise("away")
    return ratings.match_projections(g, prior).drop("summary").withColumn("winner", winner)


def with_home(box):
    g = games(box)
    return g.selectExpr("game_id", "season", "season_type", "game_date", "stack(2, home_id, away_id, true, h_pts, a_pts, away_id, home_id, false, a_pts, h_pts) as (team_id, opp_team_id, is_home, tm_pts, opp_pts)")
