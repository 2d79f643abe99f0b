"""Queries of the boards, parsers and the metric catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake import catalog
from boxlake.functions import parsing
from boxlake.operators import windows
from boxlake.plans.queries import GAME_SQL, SEASON_SQL, full_lines, player_seasons, query, r, rounded
from boxlake.sources.tables import BOX_SQL, SIDES_SQL, box_view, sides, table


@query("""with t as (select distinct l_linenumber n, cast(l_quantity as integer) q, case l_linenumber % 5 when 0 then q || ':0' || l_linenumber when 1 then 'PT' || q || 'M0' || l_linenumber || '.00S' when 2 then ' ' || q || ' ' when 3 then '--' else 'n/a' end s from lineitem)
  select n, q, s, round(case n % 5 when 0 then q + n / 60.0 when 1 then q + n / 60.0 when 2 then q end, 6) as minutes from t""")
def parsed_minutes(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")).distinct()
    s = F.expr("case n % 5 when 0 then q || ':0' || n when 1 then 'PT' || q || 'M0' || n || '.00S' when 2 then ' ' || q || ' ' when 3 then '--' else 'n/a' end")
    t = t.withColumn("s", s)
    return t.select("n", "q", "s", r(parsing.parse_minutes(F.col("s")), "minutes"))


@query("""select o_orderkey, (year(o_orderdate)) || '-' || lpad(cast((year(o_orderdate) + 1) % 100 as varchar), 2, '0') season, cast(o_orderdate as date) as "day", cast(year(o_orderdate) as integer) start from orders""")
def season_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.to_date("o_orderdate").alias("d"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("d", "M/d/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("d", "yyyyMMdd")).otherwise(F.date_format("d", "MMM d, yyyy"))
    season = parsing.season_string(F.col("y"))
    return o.select("o_orderkey", season.alias("season"), parsing.parse_date(text).alias("day"), parsing.season_start_year(season).alias("start"))


@query("""with f as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) folded from part)
  select * from (select p_partkey, folded, case when folded = 'al' then 1.0 when starts_with(folded, 'al') then 0.92 when starts_with(string_split(folded, ' ')[-1], 'al') then 0.88 when len(list_filter(string_split(folded, ' '), lambda x: starts_with(x, 'al'))) > 0 then 0.8 when contains(folded, 'al') then 0.62 end score from f) where score is not null""")
def name_search(spark, sf_dir):
    f = table(spark, sf_dir, "part").select("p_partkey", parsing.fold_name("p_name").alias("folded"))
    return f.withColumn("score", parsing.match_score(F.col("folded"), "al")).where("score is not null")


@query(f"""with {SEASON_SQL}, v as (select season, season_type, player_id, cast(pts as double) / gp ppg, 100.0 * fgm / nullif(fga, 0) pct from ps)
  select season, season_type, player_id, printf('%.1f', round(cast(ppg as decimal(38,12)), 1)) ppg, coalesce(printf('%.1f', round(cast(pct as decimal(38,12)), 1)) || '%', '—') fg from v""", rounds=True)
def formatted_lines(spark, sf_dir):
    s = player_seasons(spark, sf_dir)
    per, pct = F.expr("cast(pts as double) / gp"), F.expr("fgm / nullif(cast(fga as double), 0)")
    return s.select("season", "season_type", "player_id", parsing.format_value("decimal1", per).alias("ppg"), parsing.format_value("percent1", pct).alias("fg"))


ERA_KEYS = ("stl", "fg3m", "off_rtg")


@query("""with y as (select distinct cast(year(o_orderdate) - 30 + o_orderkey % 25 as integer) y from orders) select y,
  case when y < 1973 then 'unavailable' else 'full' end stl, case when y < 1979 then 'unavailable' else 'full' end fg3m, case when y < 1996 then 'unavailable' else 'full' end off_rtg, case when y < 1977 then 'unavailable' when y < 1996 then 'estimated' else 'full' end usg_pct from y""")
def metric_availability(spark, sf_dir):
    y = table(spark, sf_dir, "orders").select((F.year("o_orderdate") - 30 + F.col("o_orderkey") % 25).cast("int").alias("y")).distinct()
    return y.select("y", *(catalog.availability(k, F.col("y")).alias(k) for k in (*ERA_KEYS, "usg_pct")))


@query(f"""with {GAME_SQL} select game_id, player_id, oreb + dreb * 1.0 reb, round(fgm / nullif(fga, 0), 6) fg_pct, round(ast / nullif(tov, 0), 6) ast_tov, round((opp_fgm + 0.5 * opp_fg3m) / nullif(opp_fga, 0), 6) opp_efg_pct,
  round(opp_fta / nullif(opp_fga, 0), 6) opp_ftr, round((tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov) * "min" / (tm_min / 5), 5) poss, cast(null as double) bpm from full_lines""")
def resolved_metrics(spark, sf_dir):
    lines = full_lines(spark, sf_dir)
    get = lambda k: catalog.resolve(k, lines.columns)
    return lines.select("game_id", "player_id", get("reb"), *(r(get(k), k) for k in ("fg_pct", "ast_tov", "opp_efg_pct", "opp_ftr")), r(get("poss"), "poss"), get("bpm"))


@query(f"""with {GAME_SQL} select season, season_type, player_id, count(*) n, round(avg(fgm / nullif(fga, 0)), 9) v from full_lines group by 1, 2, 3""")
def metric_means(spark, sf_dir):
    lines = full_lines(spark, sf_dir)
    return lines.withColumn("v", catalog.resolve("fg_pct", lines.columns)).groupBy("season", "season_type", "player_id").agg(F.count("*").alias("n"), r(F.avg("v"), "v"))


@query(f"""with {BOX_SQL}, s as (select *, avg(pts) over (partition by season, season_type, player_id) base, max(game_date) over (partition by season) last_ from box)
  select season, game_id, player_id, pts, round(pts - base, 5) delta from s where game_date = last_ and "min" >= 12""")
def daily_movers(spark, sf_dir):
    box = box_view(spark, sf_dir)
    last = box.groupBy("season").agg(F.max("game_date").alias("game_date"))  # one row a season
    base = box.groupBy("season", "season_type", "player_id").agg(F.avg("pts").alias("base"))
    day = box.join(F.broadcast(last), ["season", "game_date"], "left_semi").where("min >= 12")
    return day.join(base, ["season", "season_type", "player_id"]).select("season", "game_id", "player_id", "pts", r(F.col("pts") - F.col("base"), "delta"))


@query(f"""with {SEASON_SQL}, c as (select player_id, season, cast(sum(pts) as double) / sum(gp) ppg from ps group by 1, 2)
  select player_id, season, round(ppg, 9) ppg, round(ppg - lag(ppg) over w, 9) change, season = first_value(season) over (partition by player_id order by round(ppg, 6) desc, season) peak from c window w as (partition by player_id order by season)""", rounds=True)
def career_arc(spark, sf_dir):
    c = player_seasons(spark, sf_dir).groupBy("player_id", "season").agg((F.sum("pts").cast("double") / F.sum("gp")).alias("ppg"))
    by, best = Window.partitionBy("player_id").orderBy("season"), Window.partitionBy("player_id").orderBy(F.desc(F.round("ppg", 6)), "season")
    return c.select("player_id", "season", rounded(F.col("ppg"), "ppg", 9), rounded(F.col("ppg") - F.lag("ppg").over(by), "change", 9), (F.col("season") == F.first("season").over(best)).alias("peak"))


@query(f"""with {SIDES_SQL}, t as (select season, season_type, team_id, sum(tm_pts) * 100.0 / sum(tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov) o, sum(opp_pts) * 100.0 / sum(tm_fga + 0.44 * tm_fta - tm_oreb + tm_tov) d, avg(case when tm_pts > opp_pts then 1.0 else 0.0 end) win from sides group by 1, 2, 3),
 q as (select season, season_type, team_id, round(o, 9) ortg, round(d, 9) drtg, round(o - d, 9) net, round(win, 9) win_pct from t)
 select *, dense_rank() over (partition by season, season_type order by ortg desc) o_rank, dense_rank() over (partition by season, season_type order by drtg) d_rank, dense_rank() over (partition by season, season_type order by net desc) n_rank from q""", rounds=True)
def team_efficiency(spark, sf_dir):
    scope = ["season", "season_type"]
    poss = F.sum(F.expr("tm_fga + 0.44d * tm_fta - tm_oreb + tm_tov"))
    t = sides(box_view(spark, sf_dir)).groupBy(*scope, "team_id").agg(
        F.sum("tm_pts").alias("p"), F.sum("opp_pts").alias("a"), poss.alias("q"), rounded(F.avg((F.col("tm_pts") > F.col("opp_pts")).cast("double")), "win_pct", 9)
    )
    o, d = 100 * F.col("p") / F.col("q"), 100 * F.col("a") / F.col("q")
    t = t.select(*scope, "team_id", rounded(o, "ortg", 9), rounded(d, "drtg", 9), rounded(o - d, "net", 9), "win_pct")
    rank = lambda c, high, name: windows.dense_rank_by(c, scope, high).cast("long").alias(name)
    return t.select("*", rank("ortg", True, "o_rank"), rank("drtg", False, "d_rank"), rank("net", True, "n_rank"))


@query(f"""with {BOX_SQL} select game_id, game_date, player_id, pts from box where (game_date < date '1998-01-01' or (game_date = date '1998-01-01' and game_id < 5000)) order by game_date desc, game_id desc, player_id limit 25""")
def game_page(spark, sf_dir):
    day = F.lit("1998-01-01").cast("date")
    before = (F.col("game_date") < day) | ((F.col("game_date") == day) & (F.col("game_id") < 5000))
    return box_view(spark, sf_dir).where(before).orderBy(F.desc("game_date"), F.desc("game_id"), "player_id").limit(25).select("game_id", "game_date", "player_id", "pts")


@query(f"""with {SEASON_SQL}, q as (select *, max(gp) over (partition by season, season_type) top from ps), k as (select *, gp >= greatest(1, cast(floor(0.2 * top) as bigint)) and cast("min" as double) / gp >= 20 able from q),
 n as (select *, count(*) filter (able) over (partition by season, season_type) m from k) select season, season_type, player_id, gp from n where able or m < 2""")
def qualified_players(spark, sf_dir):
    scope = Window.partitionBy("season", "season_type")
    q = player_seasons(spark, sf_dir).withColumn("top", F.max("gp").over(scope))
    q = q.withColumn("able", (F.col("gp") >= F.greatest(F.lit(1), F.floor(0.2 * F.col("top")))) & (F.col("min") / F.col("gp") >= 20))
    return q.withColumn("m", F.count_if("able").over(scope)).where("able or m < 2").select("season", "season_type", "player_id", "gp")
