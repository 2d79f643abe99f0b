"""The day-by-day fold of team ratings, with and without availability, against the same fold as a recursion in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlake.operators import ratings, squads
from boxlake.plans.queries import query
from boxlake.plans.widgets import with_home
from boxlake.sources.tables import SIDES_SQL, box_view

SCOPE = ["season", "season_type"]
# A third of the players have an entry a season, in force for two weeks from a day of its own.
ENTRY_DAY, ENTRY_CHANCE, IN_FORCE = "player_id * 37 % 300", "(player_id % 4) * 0.25", 14


def entries(box):
    """Two events an entry: its chance from the day after it is published, 1 again when it is no longer in force."""
    one = box.select(*SCOPE, "player_id").distinct().where("player_id % 3 = 0").withColumn("published", F.expr(f"date_add(make_date(cast(season as int), 1, 1), cast({ENTRY_DAY} as int))"))
    return one.selectExpr(*SCOPE, "player_id", f"stack(2, published, cast({ENTRY_CHANCE} as double), date_add(published, {IN_FORCE}), 1.0D) as (game_date, chance)")


FOLD_SQL = """tm as (select season, season_type, game_date, home_id team, away_id opp, h_pts pf, a_pts pa, true is_home from pre union all select season, season_type, game_date, away_id, home_id, a_pts, h_pts, false from pre),
 mean as (select season + 1 season, season_type, team, case when count(*) >= 10 then avg(pf) end pf, case when count(*) >= 10 then avg(pa) end pa from tm group by 1, 2, 3),
 lst as (select season + 1 season, season_type, avg(pf) level0, cast(sum(pf - pa) filter (is_home) as double) ms0, count(*) filter (is_home) mn0 from tm group by 1, 2),
 day as (select season, season_type, game_date, count(*) games, cast(sum(pf) as double) total, cast(sum(pf - pa) filter (is_home) as double) margin, count(*) filter (is_home) mg from tm group by 1, 2, 3),
 run as (select d.*, row_number() over w step, coalesce(sum(games) over p, 0) gb, coalesce(sum(total) over p, 0) tb, coalesce(sum(margin) over p, 0) + coalesce(ms0, 0) mb, coalesce(sum(mg) over p, 0) + coalesce(mn0, 0) nb, level0
   from day d left join lst using (season, season_type) window w as (partition by d.season, d.season_type order by game_date), p as (partition by d.season, d.season_type order by game_date rows between unbounded preceding and 1 preceding)),
 lvl as (select *, case when gb = 0 then level0 when level0 is null then tb / gb else (tb + 150 * level0) / (gb + 150) end level, case when nb >= 300 then mb / nb else 2.5 end edge from run),
 tp as (select t.season, t.season_type, t.game_date, step, team, opp, is_home, level, level0, edge, count(*) games, avg(t.pf) pf, avg(t.pa) pa from tm t join lvl using (season, season_type, game_date) group by all),
 td as (select season, season_type, step, team, sum(games) played, row_number() over (partition by season, season_type, team order by step) nth from tp group by 1, 2, 3, 4),
 full_ as (select tp.*, coalesce(x.pf * level / level0, level) bf, coalesce(x.pa * level / level0, level) ba, coalesce(y.pf * level / level0, level) of_, coalesce(y.pa * level / level0, level) oa, 1.0 / (nth + 10) * games / played w, {own} own, {other} other
   from tp join td using (season, season_type, step, team) left join mean x on x.season = tp.season and x.season_type = tp.season_type and x.team = tp.team left join mean y on y.season = tp.season and y.season_type = tp.season_type and y.team = tp.opp {factors}),
 every as (select distinct season, season_type, team from tp),
 state as (select season, season_type, cast(0 as bigint) step, team, cast(0 as double) up, cast(0 as double) down from every
  union all
  select st.season, st.season_type, lvl.step, st.team, cast(st.up + coalesce(k.up, 0) as double), cast(st.down + coalesce(k.down, 0) as double) from state st join lvl on lvl.season = st.season and lvl.season_type = st.season_type and lvl.step = st.step + 1
   left join (select c.season, c.season_type, c.team, sum(w * (f.pf - ((level + 0.7 * (bf - level) + c.up) * own * (level + 0.7 * (oa - level) + o.down) / level + case when is_home then edge else -edge end / 2))) up,
      sum(w * (f.pa - ((level + 0.7 * (of_ - level) + o.up) * other * (level + 0.7 * (ba - level) + c.down) / level - case when is_home then edge else -edge end / 2))) down
     from state c join full_ f on f.season = c.season and f.season_type = c.season_type and f.team = c.team and f.step = c.step + 1 join state o on o.season = c.season and o.season_type = c.season_type and o.team = f.opp where level > 0 group by 1, 2, 3) k
   on k.season = st.season and k.season_type = st.season_type and k.team = st.team)
 select f.season, f.season_type, f.game_date, f.team home_id, f.opp away_id, f.games, f.level,
   (level + 0.7 * (bf - level) + h.up) * own * (level + 0.7 * (oa - level) + a.down) / level + edge / 2 projected_home, (level + 0.7 * (of_ - level) + a.up) * other * (level + 0.7 * (ba - level) + h.down) / level - edge / 2 projected_away
 from full_ f join state h on h.season = f.season and h.season_type = f.season_type and h.step = f.step - 1 and h.team = f.team join state a on a.season = f.season and a.season_type = f.season_type and a.step = f.step - 1 and a.team = f.opp where is_home"""

# Squads by a join of every team's days with the stretches between its players' lines.
FACTOR_SQL = f"""pd as (select season, season_type, player_id, game_date, count(*) n, sum("min") m, sum(pts) p, arg_max(team_id, game_id) team from box where "min" > 0 group by 1, 2, 3, 4),
 pm as (select season + 1 season, season_type, player_id, sum(m) * 1.0 / sum(n) m0, sum(p) * 1.0 / sum(n) p0 from pd group by 1, 2, 3),
 stretch as (select pd.*, sum(n) over w cn, sum(m) over w cm, sum(p) over w cp, lead(game_date) over (partition by pd.season, pd.season_type, pd.player_id order by game_date) until from pd window w as (partition by pd.season, pd.season_type, pd.player_id order by game_date)),
 teamday as (select distinct season, season_type, team_id team, game_date d from box),
 member as (select t.*, s.player_id, coalesce((cm + 10 * m0) / (cn + 10), cm * 1.0 / cn) m, coalesce((cp + 10 * p0) / (cn + 10), cp * 1.0 / cn) p, make_date(s.season, 1, 1) + cast(s.player_id * 37 % 300 as int) published
   from teamday t join stretch s on s.season = t.season and s.season_type = t.season_type and s.team = t.team and s.game_date < t.d and (s.until is null or t.d <= s.until) left join pm on pm.season = s.season and pm.season_type = s.season_type and pm.player_id = s.player_id),
 chanced as (select *, case when player_id % 3 = 0 and published < d and d <= published + {IN_FORCE} then (player_id % 4) * 0.25 else 1.0 end c from member),
 sq as (select season, season_type, team, d, cast(sum(p) as double) f, cast(sum(p * c) as double) av, cast(sum(p * (1 - c)) as double) lost, cast(sum(m * (1 - c)) as double) lm, bool_or(c < 1) doubt from chanced group by 1, 2, 3, 4),
 ab as (select *, case when lost >= lm * 0.225 then lm * 0.225 + 0.6 * (lost - lm * 0.225) else lost end ab from sq),
 factor as (select season, season_type, team, d game_date, case when not doubt or f = 0 then 1.0 else (av + least(ab, 0.15 * av + lm * 0.225)) / f end factor from ab)"""
JOINS = " ".join(f"left join factor {n} on {n}.season = tp.season and {n}.season_type = tp.season_type and {n}.game_date = tp.game_date and {n}.team = tp.{side}" for n, side in (("fo", "team"), ("fp", "opp")))


@query("with recursive " + SIDES_SQL + ", " + FOLD_SQL.format(own="1.0", other="1.0", factors=""))
def rating_fold(spark, sf_dir):
    """Every pairing of a day projected from the state before it, ratings moved by its misses."""
    return ratings.rating_fold(with_home(box_view(spark, sf_dir)))


@query(f"with {SIDES_SQL}, {FACTOR_SQL} select season, season_type, team team_id, d game_date, coalesce(factor, 1.0) factor from teamday left join (select season, season_type, team, game_date d, factor from factor) using (season, season_type, team, d)")
def squad_factors(spark, sf_dir):
    """What availability leaves of each side's points as of every day it plays."""
    box = box_view(spark, sf_dir)
    return squads.daily_factors(box, entries(box), SCOPE)


@query("with recursive " + SIDES_SQL + ", " + FACTOR_SQL + ", " + FOLD_SQL.format(own="coalesce(fo.factor, 1.0)", other="coalesce(fp.factor, 1.0)", factors=JOINS))
def availability_fold(spark, sf_dir):
    """The fold with each side's attack scaled by its squad's availability as of the day: as-of squads and entries feed the sequential step."""
    box = box_view(spark, sf_dir)
    return ratings.rating_fold(with_home(box), squads.daily_factors(box, entries(box), SCOPE))
