"""Queries over squads, projections and valuations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.functions.nullsafe import sdiv
from boxlake.operators import models, projection, squads, valuation
from boxlake.plans.queries import CATS, SEASON_SQL, player_seasons, query, r, rounded
from boxlake.sources.tables import BOX_SQL, SIDES_SQL, box_view, by_player, table

STATUS = "case player_id % 7 when 0 then 'out' when 1 then 'doubtful' when 2 then 'questionable' when 3 then 'probable' when 4 then 'available' end"
CHANCE_SQL = "case player_id % 7 when 0 then 0.0 when 1 then 0.25 when 2 then 0.5 when 3 then 0.85 else 1.0 end"
INJURY_SQL = f"""with {BOX_SQL}, pl as (select team_id, season, player_id, avg("min") m, avg(pts) p, cast({CHANCE_SQL} as double) c from box group by 1, 2, 3),
 s as (select team_id, season, sum(p) full_, sum(p * c) avail, sum(p * (1 - c)) lost, sum(m * (1 - c)) lm, sum(m * c) am from pl group by 1, 2),
 a as (select *, case when lost >= lm * 0.225 then lm * 0.225 + 0.6 * (lost - lm * 0.225) else lost end ab from s),
 b as (select *, case when avail = 0 then 1.0 else least(1 + ab / avail, 1.15) end boost, least(ab, 0.15 * avail + lm * 0.225) eff from a)"""


def squad_players(spark, sf_dir):
    box = by_player(spark, sf_dir, box_view(spark, sf_dir)).groupBy("team_id", "season", "player_id").agg(F.avg("min").alias("minutes"), F.avg("pts").alias("points"))
    return box.withColumn("chance", squads.model_chance(F.expr(STATUS)))


@query(INJURY_SQL + " select team_id, season, round(ab, 5) absorbed, round(boost, 6) boost, round(avail + eff, 5) squad_points, round(case when full_ = 0 then 1 else (avail + eff) / full_ end, 6) factor from b")
def injury_layer(spark, sf_dir):
    t = squads.injury_totals(squad_players(spark, sf_dir), ["team_id", "season"])
    return t.select("team_id", "season", r(F.col("absorbed"), "absorbed"), r(F.col("boost"), "boost"), r(F.col("squad_points"), "squad_points"), r(F.col("factor"), "factor"))


@query(INJURY_SQL + " select team_id, season, player_id, round(p * c * boost, 9) points, round(m * c * least(1 + 0.7 * lm / greatest(am, 1), 1.15), 9) as minutes from b join pl using (team_id, season)")
def injury_projected_players(spark, sf_dir):
    p = squad_players(spark, sf_dir)
    out = squads.injury_players(p, squads.injury_totals(p, ["team_id", "season"]), ["team_id", "season"])
    return out.select("team_id", "season", "player_id", r(F.col("projected_points"), "points"), r(F.col("projected_minutes"), "minutes"))


@query(f"""with {BOX_SQL}, pl as (select team_id, player_id, avg("min") m from box group by 1, 2), o as (select *, row_number() over w - 1 i, sum(m) over (partition by team_id order by m desc, player_id rows between current row and unbounded following) mass from pl window w as (partition by team_id order by m desc, player_id)),
 f as (select *, case when 200 - 40.0 * i > 0 and mass > 0 then (200 - 40.0 * i) / mass end fac from o), k as (select team_id, min(i) j from f where not coalesce(m * fac > 40 + 1e-12, false) group by 1),
 g as (select f.*, k.j, max(case when f.i = k.j then fac end) over (partition by f.team_id) fj from f left join k on f.team_id = k.team_id)
 select team_id, player_id, round(case when j is null or i < j then 40.0 else coalesce(m * fj, m) end, 5) as minutes from g""")
def squad_minutes(spark, sf_dir):
    p = by_player(spark, sf_dir, box_view(spark, sf_dir)).groupBy("team_id", "player_id").agg(F.avg("min").alias("m"))
    return squads.normalised_minutes(p, ["team_id"], "player_id", "m").select("team_id", "player_id", r(F.col("normalised"), "minutes"))


DEFENCE_SQL = f"""with {SIDES_SQL}, w as (select 0 pos, 'G' bucket, 1.0 w union all select 1, 'G', 0.5 union all select 1, 'F', 0.5 union all select 2, 'F', 1.0 union all select 3, 'F', 0.5 union all select 3, 'C', 0.5 union all select 4, 'C', 1.0),
 g as (select s.season, s.opp_team_id team_id, s.game_id, w.bucket, sum(x.pts * w.w) points from sides s join box x on x.game_id = s.game_id and x.team_id = s.team_id join w on w.pos = x.player_id % 5 group by 1, 2, 3, 4),
 n as (select distinct season, opp_team_id team_id, game_id from sides), f as (select n.*, b.bucket, coalesce(g.points, 0) points from n cross join (select distinct bucket from w) b left join g on g.season = n.season and g.team_id = n.team_id and g.game_id = n.game_id and g.bucket = b.bucket),
 l as (select season, bucket, avg(points) mu from f group by 1, 2), p as (select season, team_id, bucket, count(*) n, avg(points) a, stddev_samp(points) sd from f group by 1, 2, 3 having count(*) >= 4),
 i as (select p.*, a / mu raw, sd / sqrt(n) / mu se from p join l using (season, bucket)), t as (select *, greatest(var_samp(raw) over (partition by season, bucket) - avg(se * se) over (partition by season, bucket), 0) tau2 from i)
 select season, team_id, bucket, n, round(a, 5) allowed, round(raw, 5) raw_index, round(se, 5) se, round(1 + coalesce(tau2 / nullif(tau2 + se * se, 0), 0) * (raw - 1), 5) "index" from t"""


def position_games(spark, sf_dir):
    """Points allowed by season, side, game and bucket. Each line counts for the other side, and as nothing for its own, so that both sides have all buckets within the games' deal."""
    box = box_view(spark, sf_dir)
    weight = lambda g, f, c: F.create_map(*(F.lit(v) for v in ("G", g, "F", f, "C", c)))
    weights, none = F.array(weight(1.0, 0.0, 0.0), weight(0.5, 0.5, 0.0), weight(0.0, 1.0, 0.0), weight(0.0, 0.5, 0.5), weight(0.0, 0.0, 1.0)), weight(0.0, 0.0, 0.0)
    own = F.when(F.col("team_id").isNotNull(), F.get(weights, (F.col("player_id") % 5).cast("int")))
    against = F.struct(F.expr("if(team_id = home_id, away_id, home_id)").alias("defence"), F.coalesce(own, none).alias("weights"))
    lines = box.select("season", "game_id", F.col("pts").alias("points"), F.col("min").alias("minutes"), F.explode(F.array(against, F.struct(F.col("team_id").alias("defence"), none.alias("weights")))).alias("x"))
    got = squads.allocated(lines.select("season", "game_id", "points", "minutes", "x.*"), "weights", ["season", "defence", "game_id"])
    return got.select("season", F.col("defence").alias("team_id"), "game_id", "bucket", F.coalesce("points", F.lit(0.0)).alias("points"))


@query(DEFENCE_SQL)
def defence_by_position(spark, sf_dir):
    d = squads.defence_by_position(position_games(spark, sf_dir), ["season"], "team_id", least=4)
    return d.select("season", "team_id", "bucket", "n", r(F.col("allowed"), "allowed"), r(F.col("raw_index"), "raw_index"), r(F.col("se"), "se"), r(F.col("index"), "index"))


@query("""with e as (select user_id, event_id, ts, event_type, cast(ts as date) + interval 20 hour deadline, lag(event_type) over (partition by user_id order by ts, event_id) b from events)
  select user_id, cast(deadline as date) as "day", arg_max(event_id, (ts, event_id)) locked_id, count(*) n from e where event_type is distinct from b and ts < deadline group by 1, 2""")
def ledger_locks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.to_date("ts").alias("day")).withColumn("deadline", F.expr("cast(day as timestamp_ntz) + interval 20 hours"))
    kept = squads.changed_only(e, ["user_id"], ["ts", "event_id"], "event_type")
    sizes = kept.where("ts < deadline").groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return squads.locked(kept, ["user_id", "day"], "ts", "deadline", "event_id").join(sizes, ["user_id", "day"]).select("user_id", "day", F.col("event_id").alias("locked_id"), "n")


PROJECT_SQL = f"""with {BOX_SQL}, a as (select *, row_number() over (partition by player_id order by game_date desc, game_id desc) - 1 age, max(season) over (partition by player_id) now_ from box),
 p as (select player_id, sum(pow(0.5, age / 2.0) * "min") / sum(pow(0.5, age / 2.0)) mm, sum(pow(0.5, age / 2.0) * "min" * "min") / sum(pow(0.5, age / 2.0)) m2, sum(pow(0.5, age / 6.0) * pts) / sum(pow(0.5, age / 6.0)) fp, sum(pow(0.5, age / 6.0) * "min") / sum(pow(0.5, age / 6.0)) fm,
   cast(sum(pts) as double) cp, cast(sum("min") as double) cm, cast(coalesce(sum(pts) filter (season = now_), 0) as double) sp, cast(coalesce(sum("min") filter (season = now_), 0) as double) sm from a group by 1),
 q as (select *, least(greatest(mm, 0), 48) m, 1.2816 * greatest(sqrt(greatest(m2 - mm * mm, 0)), 0.15 * mm) half, sm / (sm + 400) w, (sp + 81 * 0.4182) / (sm + 81) rs, (cp + 81 * 0.4182) / (cm + 81) rc from p),
 z as (select *, w * rs + (1 - w) * rc base from q)
 select player_id, round(m, 5) minutes_mean, round(greatest(m - half, 0), 5) minutes_low, round(least(m + half, 48), 5) minutes_high, round(0.75 * base + 0.25 * coalesce(fp / nullif(fm, 0), base), 6) rate, round(m * (0.75 * base + 0.25 * coalesce(fp / nullif(fm, 0), base)), 5) mean_pts from z"""


def projected(spark, sf_dir):
    box = box_view(spark, sf_dir).withColumn("now", F.max("season").over(Window.partitionBy("player_id")))
    rows = projection.aged(box, ["player_id"], ["game_date", "game_id"])
    minutes = projection.project_minutes(rows, ["player_id"], "min")
    halflife = projection.STATS["pts"][2]
    current = F.col("season") == F.col("now")
    sums = rows.groupBy("player_id").agg(
        F.sum("pts").alias("cp"), F.sum("min").alias("cm"), F.sum(F.when(current, F.col("pts"))).alias("sp"), F.sum(F.when(current, F.col("min"))).alias("sm"),
        projection.decayed(F.col("pts").cast("double"), halflife)[0].alias("fp"), projection.decayed(F.col("min").cast("double"), halflife)[0].alias("fm"),
    )
    rate = projection.regressed_rate("pts", *(F.col(x) for x in ("sp", "sm", "cp", "cm", "fp", "fm")))
    return minutes.join(sums.select("player_id", rate.alias("rate")), "player_id").withColumn("mean_pts", F.col("minutes_mean") * F.col("rate"))


@query(PROJECT_SQL)
def player_projection(spark, sf_dir):
    p = projected(spark, sf_dir)
    return p.select("player_id", *(r(F.col(x), x) for x in ("minutes_mean", "minutes_low", "minutes_high")), r(F.col("rate"), "rate"), r(F.col("mean_pts"), "mean_pts"))


_HEAD, _, _TAIL = PROJECT_SQL.rpartition(" select player_id, ")


@query(_HEAD.replace("with ", "with recursive ", 1) + ", pp as (select player_id, " + _TAIL + "), ib as (select player_id, mean_pts mean, greatest(1.1 * 0.1 + coalesce(0.1 / nullif(case when mean_pts > 0 then mean_pts end, 0), 0), 0) alpha from pp), " + projection.interval_sql("ib", "player_id") + " select player_id, mean mean_pts, low, high from intervals")
def projection_intervals(spark, sf_dir):
    """The 80 % count interval of every player's projected points."""
    alpha = projection.effective_alpha(F.col("mean_pts"), F.lit(0.1), F.lit(1.1))
    return projection.with_intervals(projected(spark, sf_dir).withColumn("alpha", alpha), "mean_pts", "alpha").select("player_id", r(F.col("mean_pts"), "mean_pts"), "low", "high")


VALUED_SQL = f"""with {SEASON_SQL}, l as (select player_id, {", ".join(f"cast(sum({s}) as double) / sum(gp) {s}" for s in CATS)} from ps group by 1), p as (select * from l order by round(pts, 6) desc, player_id limit 50),
 m as (select {", ".join(f"avg({s}) m_{s}, stddev_pop({s}) s_{s}" for s in CATS)} from p), zz as (select player_id, {", ".join(f"case when s_{s} > 0 then ({s} - m_{s}) / s_{s} else 0 end z_{s}" for s in CATS)} from l, m),
 v as (select *, round({" + ".join(f"z_{s}" for s in CATS)}, 6) total_z from zz)"""


def valued(spark, sf_dir):
    s = player_seasons(spark, sf_dir)
    lines = s.groupBy("player_id").agg(*(sdiv(F.sum(x), F.sum("gp")).alias(x) for x in CATS)).withColumn("seed", F.round("pts", 6))
    return models.value_pool(lines, 50, list(CATS), "seed", "player_id").withColumn("total_z", F.round("total_z", 6))


@query(VALUED_SQL + """, top as (select *, row_number() over (order by total_z desc, player_id) k from v), rep as (select coalesce(avg(total_z), 0) rv from top where k > 5 and k <= 10),
 legs as (select p_partkey trade_id, case when p_partkey % 2 = 0 then 'give' else 'get' end side, p_size player_id from part union all select p_partkey, 'give', p_size + 1 from part where p_partkey % 3 = 0),
 t as (select trade_id, sum(case when side = 'get' then total_z else -total_z end) ch, count(*) filter (side = 'give') - count(*) filter (side = 'get') spots from legs join v using (player_id) group by 1)
 select trade_id, round(ch, 9) change_z, round(spots * rv, 9) roster_adjustment, round(ch + spots * rv, 9) net_z from t, rep""", rounds=True)
def fantasy_trades(spark, sf_dir):
    p, v = table(spark, sf_dir, "part"), valued(spark, sf_dir)
    side = F.when(F.col("p_partkey") % 2 == 0, "give").otherwise("get")
    first = p.select(F.col("p_partkey").alias("trade_id"), side.alias("side"), F.col("p_size").cast("long").alias("player_id"))
    more = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("trade_id"), F.lit("give").alias("side"), (F.col("p_size") + 1).cast("long").alias("player_id"))
    t = valuation.evaluate_trades(first.unionByName(more), v, valuation.replacement_value(v, "player_id", 5, 5), "player_id")
    return t.select("trade_id", *(rounded(F.col(x), x, 9) for x in ("change_z", "roster_adjustment", "net_z")))


@query(VALUED_SQL + f""", s as ({" union all ".join(f"select '{c}' c, sum(z_{c}) z, count(*) have from v where player_id % 10 = 3" for c in CATS)}), k as (select c from s order by z, c limit 3), h as (select max(have) have from s),
 d as (select player_id, total_z, round(total_z + case when have >= 3 then 0.25 * ({" + ".join(f"case when exists (select 1 from k where k.c = '{c}') then z_{c} else 0 end" for c in CATS)}) / 3 else 0 end, 6) g from v, h where player_id % 10 not in (3, 4))
 select player_id, round(total_z, 9) total_z, round(g, 9) suggestion from d order by g desc, player_id limit 20""", rounds=True)
def fantasy_draft_board(spark, sf_dir):
    v = valued(spark, sf_dir)
    b = valuation.draft_board(v, list(CATS), v.where("player_id % 10 in (3, 4)"), v.where("player_id % 10 = 3"), "player_id", 20)
    return b.select("player_id", rounded(F.col("total_z"), "total_z", 9), rounded(F.col("suggestion"), "suggestion", 9))


