"""Queries over what sources send: typed items and their rejects, ranked writers, ledgers and their review, season composites."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.functions.parsing import valid_weights
from boxlake.operators import identity, models, precedence, quality, ratings, snapshots, squads
from boxlake.operators.payloads import Field, checked_items
from boxlake.operators.store import KeyedTable, staged
from boxlake.plans.folds import FACTOR_SQL, FOLD_SQL, JOINS, SCOPE, entries
from boxlake.plans.queries import STATS, query
from boxlake.plans.widgets import with_home
from boxlake.sources.shared import shared_dir
from boxlake.sources.tables import BOX_SQL, SIDES_SQL, box_view, by_player, games, sides, table

PHASES = ("RS", "PI", "PO", "FF")
GAME_FIELDS = [
    Field("gameCode", "code", "long", least=1, most=9999), Field("round", "round", "int", least=1, most=99), Field("phaseType.code", "phase", "string", among=PHASES),
    Field("local.club.code", "home", "string"), Field("road.club.code", "away", "string"), Field("local.score", "home_score", "int", required=False), Field("road.score", "away_score", "int", required=False), Field("played", "played", "boolean", required=False), Field("utcDate", "tipoff", "timestamp"),
]
GAME_RULES = [("road.club.code", "both sides are one club", "home = away")]
# The first fault of each item, as planted by the order's key.
FAULT_SQL = "case when k % 29 = 0 then 'gameCode:not a long' when k % 31 = 0 then 'gameCode:missing' when k % 11 = 0 then 'round:under 1' when k % 37 = 0 then 'round:over 99' when k % 41 = 0 then 'round:not a int' when k % 19 = 0 then 'phaseType.code:not one of RS, PI, PO, FF' when k % 43 = 0 then 'local.club.code:missing' when k % 23 = 0 then 'utcDate:not a timestamp' when k % 17 = 0 then 'road.club.code:both sides are one club' end"
DOCS_SQL = f"""o as (select o_orderkey k, o_custkey doc, o_custkey % 53 = 0 torn, o_custkey % 59 = 0 renamed from orders), p as (select *, case when torn then '$:not JSON' when renamed then '$.data:not a list' else {FAULT_SQL} end fault from o)"""


def documents(spark, sf_dir):
    """A document of games a customer, with planted faults; some are cut off, in some the list has another name."""
    k = "o_orderkey"
    code = F.expr(f"case when {k} % 29 = 0 then '\"n-' || {k} || '\"' when {k} % 31 = 0 then 'null' else cast({k} % 9999 + 1 as string) end")
    round_ = F.expr(f"case when {k} % 11 = 0 then '0' when {k} % 37 = 0 then '100' when {k} % 41 = 0 then 'true' else cast({k} % 38 + 1 as string) end")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    phase = F.expr(f"case when {k} % 19 = 0 then 'XX' else element_at(array('RS', 'PI', 'PO', 'FF'), cast({k} % 4 as int) + 1) end")
    home, away = F.expr(f"'C' || {k} % 18"), F.expr(f"'C' || case when {k} % 17 = 0 then {k} % 18 else ({k} + 1) % 18 end")
    local = F.when(F.expr(f"{k} % 43 = 0"), F.lit('{"score": 80}')).otherwise(F.concat(F.lit('{"club": {"code": '), text(home), F.lit('}, "score": '), F.expr(f"cast({k} % 50 + 60 as string)"), F.lit("}")))
    day = F.expr(f"case when {k} % 23 = 0 then 'soon' else cast(o_orderdate as string) end")
    game = F.concat(F.lit('{"gameCode": '), code, F.lit(', "round": '), round_, F.lit(', "phaseType": {"code": '), text(phase), F.lit('}, "local": '), local, F.lit(', "road": {"club": {"code": '), text(away), F.lit('}}, "utcDate": '), text(day), F.lit("}"))
    lists = table(spark, sf_dir, "orders").select("o_custkey", game.alias("g")).groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.collect_list("g"), ", ").alias("g"))
    body = F.concat(F.when(F.expr("doc % 59 = 0"), F.lit('{"games": [')).otherwise(F.lit('{"data": [')), F.col("g"), F.lit("]}"))
    return lists.select("doc", F.when(F.expr("doc % 53 = 0"), F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body).alias("body"))


@query(f"""with {DOCS_SQL}, u as (select distinct doc, fault from p where fault like '$%' union all select doc, fault from p where fault is null or fault not like '$%')
 select case when fault like '$%' then split_part(fault, ':', 1) when fault is not null then split_part(fault, ':', 1) end path, split_part(fault, ':', 2) reason, count(*) items from u group by 1, 2""")
def payload_rejects(spark, sf_dir):
    """How many games of the documents are accepted (no path) and rejected, by path and reason."""
    found = checked_items(documents(spark, sf_dir), "body", "data", GAME_FIELDS, GAME_RULES, ("doc",))
    path = F.regexp_replace("path", r"^\$\.data\[\d+\]\.", "")
    return found.groupBy(path.alias("path"), "reason").agg(F.count("*").alias("items"))


@query(f"""with {DOCS_SQL}, s as (select doc, bool_or(fault is not null) spoiled from p group by 1)
 select doc, count(*) games, cast(sum(k % 38 + 1) as bigint) rounds from p join s using (doc) where not spoiled group by 1""")
def whole_payloads(spark, sf_dir):
    """Documents that are accepted whole: one fault rejects a document."""
    found = checked_items(documents(spark, sf_dir), "body", "data", GAME_FIELDS, GAME_RULES, ("doc",), whole=True)
    return found.where("reason is null").groupBy("doc").agg(F.count("*").alias("games"), F.sum(F.col("round").cast("long")).alias("rounds"))


RANKS = {"roster": 1, "box": 2, "import": 3}
SOURCE = "element_at(array('roster', 'box', 'import'), cast({x} % 3 as int) + 1)"


@query(f"""with {BOX_SQL}, ps as (select player_id, season, count(*) gp, cast(sum(pts) as bigint) pts from box group by 1, 2),
 held as (select player_id, season, ['G', 'F', '?'][cast(gp % 3 as int) + 1] val, case when pts % 5 = 0 then 'seed' else ['roster', 'box', 'import'][cast(pts % 3 as int) + 1] end src, 10 seen from ps where player_id % 4 > 0),
 offers as (select player_id, season, ['G', 'F', '?'][cast((gp + r) % 3 as int) + 1] val, ['roster', 'box', 'import'][cast((pts + r * gp) % 3 as int) + 1] src, 20 + r * gp % 2 seen from ps, range(2) t(r) where player_id % 7 > 0),
 ranked as (select *, case src when 'roster' then 1 when 'box' then 2 else 3 end rnk, row_number() over (partition by player_id, season order by case src when 'roster' then 1 when 'box' then 2 else 3 end, val <> '?' desc, seen desc, val desc) i from offers),
 j as (select coalesce(o.player_id, h.player_id) player_id, coalesce(o.season, h.season) season, o.val ov, o.src os, o.seen od, h.val hv, h.src hs, h.seen hd,
  case when o.val is null then 'untouched' when h.val is null then 'inserted' when h.src = 'seed' or o.rnk > case h.src when 'roster' then 1 when 'box' then 2 else 3 end or (o.val = '?' and h.val <> '?') then 'kept' when o.val = h.val and o.src = h.src then 'unchanged' else 'updated' end outcome
  from (select * from ranked where i = 1) o full join held h on h.player_id = o.player_id and h.season = o.season)
 select player_id, season, case when outcome in ('inserted', 'updated') then ov else hv end val, case when outcome in ('inserted', 'updated') then os else hs end src, case when outcome in ('inserted', 'updated') then od else hd end as seen, outcome from j""")
def position_precedence(spark, sf_dir):
    """Positions offered by several sources against those held: seeds stay, weaker sources and unusable values keep out."""
    ps = box_view(spark, sf_dir).groupBy("player_id", "season").agg(F.count("*").alias("gp"), F.sum("pts").alias("pts"))
    held = ps.where("player_id % 4 > 0").selectExpr("player_id", "season", "element_at(array('G', 'F', '?'), cast(gp % 3 as int) + 1) as val", f"case when pts % 5 = 0 then 'seed' else {SOURCE.format(x='pts')} end as src", "10 as seen")
    offers = ps.where("player_id % 7 > 0").selectExpr("*", "explode(array(0, 1)) as r").selectExpr("player_id", "season", "element_at(array('G', 'F', '?'), cast((gp + r) % 3 as int) + 1) as val", f"{SOURCE.format(x='(pts + r * gp)')} as src", "20 + r * gp % 2 as seen")
    return precedence.ranked_merge(held, offers.withColumn("seen", F.col("seen").cast("int")), ["player_id", "season"], "val", "src", "seen", RANKS, ("seed",), F.col("val") != "?")


@query("""with o as (select user_id, event_type digest, ts, event_id, lag(event_type) over w before, row_number() over w i from events window w as (partition by user_id order by ts, event_id)),
 s as (select * from o where i = 1 or digest is distinct from before)
 select user_id, digest, min(event_id) filter (ts = f) first_id, max(event_id) filter (ts = l) stamped_id, count(*) runs from (select *, min(ts) over (partition by user_id, digest) f, max(ts) over (partition by user_id, digest) l from s) group by 1, 2""")
def ledger_restamps(spark, sf_dir):
    """A ledger after all computations: an older row whose digest comes back is stamped again, not copied."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("digest"), "ts", "event_id")
    found = squads.restamped(e, ["user_id"], ["ts", "event_id"], "digest")
    return found.select("user_id", "digest", F.col("first.event_id").alias("first_id"), F.col("stamped.event_id").alias("stamped_id"), "runs")


@query("with recursive " + SIDES_SQL + ", " + FACTOR_SQL + ", " + FOLD_SQL.format(own="coalesce(fo.factor, 1.0)", other="coalesce(fp.factor, 1.0)", factors=JOINS).replace("\n select f.season", ",\n fold as (select f.season", 1) + """),
 e as (select game_id, season, season_type, game_date, home_id, away_id, h_pts - a_pts margin, case when game_id % 4 = 1 then (h_fgm - a_fgm) * 2.0 end locked from pre),
 v as (select e.season, margin, locked is not null is_locked, coalesce(locked, projected_home - projected_away) guess from e join fold using (season, season_type, game_date, home_id, away_id))
 select season, is_locked, count(*) games, count(guess) reviewed, count(*) filter (abs(guess) >= 0.5) decided, count(*) filter (abs(guess) >= 0.5 and sign(guess) = sign(margin)) called, avg(abs(margin - guess)) miss, sqrt(avg(pow(margin - guess, 2))) rms from v group by 1, 2""")
def reconstructed_review(spark, sf_dir):
    """Review of margins: the locked projection where there is one, else the one the fold makes of the state before the day."""
    box = box_view(spark, sf_dir)
    fold = ratings.rating_fold(with_home(box), squads.daily_factors(box, entries(box), SCOPE))
    pair = [*SCOPE, "game_date", "home_id", "away_id"]
    e = games(box).select("game_id", *pair, (F.col("h_pts") - F.col("a_pts")).alias("margin"), F.when(F.col("game_id") % 4 == 1, (F.col("h_fgm") - F.col("a_fgm")) * 2.0).alias("locked"))
    made = F.nanvl(F.col("projected_home") - F.col("projected_away"), F.lit(None).cast("double"))
    v = e.join(fold, pair).select("season", "margin", F.col("locked").isNotNull().alias("is_locked"), F.coalesce("locked", made).alias("guess"))
    gap, decided = F.col("margin") - F.col("guess"), F.abs("guess") >= 0.5
    return v.groupBy("season", "is_locked").agg(F.count("*").alias("games"), F.count("guess").alias("reviewed"), F.count_if(decided).alias("decided"), F.count_if(decided & (F.signum("guess") == F.signum("margin"))).alias("called"), F.avg(F.abs(gap)).alias("miss"), F.sqrt(F.avg(gap * gap)).alias("rms"))


SUMS = ", ".join(f'cast(sum("{s}") as double) "{s}"' for s in STATS)


@query(f"""with {SIDES_SQL}, tg as (select season, season_type, team_id, count(*) team_games, count(*) filter (tm_pts > opp_pts) team_wins, cast(sum(tm_fga + 0.44 * tm_fta + tm_tov) as double) tq, cast(sum(tm_min) as double) tmin from sides group by 1, 2, 3),
 ps as (select season, season_type, team_id, player_id, {SUMS} from box group by 1, 2, 3, 4),
 u as (select ps.*, team_games, team_wins, (fga + 0.44 * fta + tov) * (tmin / 5) / nullif("min" * tq, 0) usg, (pts + 0.7 * ast + 0.7 * oreb + 0.3 * dreb + stl + 0.7 * blk - 0.72 * (fga - fgm) - 0.42 * (fta - ftm) - tov - 0.28 * pf) / "min" raw from ps join tg using (season, season_type, team_id)),
 m as (select season, season_type, sum(raw * "min") / sum("min") mean from u group by 1, 2), a as (select u.*, greatest(0.0, least(raw * 15.0 / mean, 35.0)) per from u join m using (season, season_type)),
 c as (select season, season_type, sum((per - 15) / 2.2 * "min") / sum("min") centre from a group by 1, 2), b as (select a.*, greatest(-8.0, least((per - 15) / 2.2 - centre, 14.0)) bpm, greatest(0.05, per - 5) * "min" w from a join c using (season, season_type)),
 t as (select season, season_type, team_id, sum(w) ws_ from b group by 1, 2, 3), f as (select b.*, team_wins * w / ws_ ws from b join t using (season, season_type, team_id))
 select season, season_type, team_id, player_id, per, bpm, bpm * greatest(0.35, least(0.62 + 0.25 * (coalesce(usg, 0.2) - 0.2), 0.85)) obpm, bpm * (1 - greatest(0.35, least(0.62 + 0.25 * (coalesce(usg, 0.2) - 0.2), 0.85))) dbpm, ws, ws * greatest(0.25, least(0.5 + 0.9 * (coalesce(usg, 0.2) - 0.2), 0.82)) ows, ws * (1 - greatest(0.25, least(0.5 + 0.9 * (coalesce(usg, 0.2) - 0.2), 0.82))) dws,
   greatest(-0.05, least(48 * ws / "min", 0.32)) ws48, (bpm + 2) * "min" / (team_games * 240.0) * team_games / 82 vorp from f""")
def season_composites(spark, sf_dir):
    """Ratings of players' seasons normalised over the league in two passes."""
    box = box_view(spark, sf_dir)
    of = [*SCOPE, "team_id"]
    teams = sides(box).groupBy(*of).agg(F.count("*").alias("team_games"), F.count_if(F.col("tm_pts") > F.col("opp_pts")).alias("team_wins"), F.sum(F.expr("tm_fga + 0.44D * tm_fta + tm_tov")).alias("tq"), F.sum("tm_min").alias("tmin"))
    rows = by_player(spark, sf_dir, box).groupBy(*of, "player_id").agg(*(F.sum(s).cast("double").alias(s) for s in STATS)).join(F.broadcast(teams), of)
    usg = F.expr("(fga + 0.44D * fta + tov) * (tmin / 5) / nullif(min * tq, 0)")
    found = models.season_composites(staged(rows.withColumn("usg", usg)), SCOPE)
    return found.select(*of, "player_id", "per", "bpm", "obpm", "dbpm", "ws", "ows", "dws", "ws48", "vorp")


FETCH_SQL = """e as (select user_id % 10 source, ts, event_id, sha256(concat(event_type, ':', cast(floor(value) as bigint) % 5)) sha, event_type name from events),
 f as (select source, sha, min(struct_pack(ts := ts, event_id := event_id)) x from e group by 1, 2), k as (select source, sha, x.event_id first_id, row_number() over (partition by source order by x.ts desc, x.event_id desc) - 1 age from f)"""


def fetches(spark, sf_dir):
    """Each event as a payload that a source (a group of users) sent."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.col("event_type"), F.lit(":"), (F.floor("value") % 5).cast("string"))
    return e.select((F.col("user_id") % 10).alias("source"), "ts", "event_id", F.sha2(body, 256).alias("sha256"), F.col("event_type").alias("name"))


@query(f"with {FETCH_SQL} select source, sha sha256, first_id, age from k where age < 3")
def payload_snapshots(spark, sf_dir):
    """The three newest snapshots of each source, stored in two rounds: payloads that a source has sent before add none."""
    sent, at = fetches(spark, sf_dir), ["ts", "event_id"]
    half = sent.where("event_id % 2 = 0")
    stored = snapshots.new_snapshots(half, half.limit(0), at)
    later = snapshots.new_snapshots(sent, stored, at)
    # what the second round finds earlier than the first is the same content: the stored row stays, with the earlier fetch as its first
    first = stored.unionByName(later).join(sent.groupBy("source", "sha256").agg(F.min_by("event_id", F.struct(*at)).alias("first_id"), F.min(F.struct(*at)).alias("first")), ["source", "sha256"])
    kept = snapshots.last_kept(first.select("source", "sha256", "first_id", "first"), 3, ["first"])
    return kept.select("source", "sha256", "first_id", F.col("age").cast("long").alias("age"))


@query(f"with {FETCH_SQL} select e.source, e.name, count(*) as rows from e join k on k.source = e.source and k.sha = e.sha and age = 0 where e.name not in ('view', 'click') group by 1, 2")
def review_queue(spark, sf_dir):
    """Names that nobody knows in each source's newest snapshot."""
    sent, at = fetches(spark, sf_dir), ["ts", "event_id"]
    known = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(F.col("event_type").alias("name"))
    return snapshots.review_queue(sent, snapshots.new_snapshots(sent, sent.limit(0), at), known, at)


LOAD_SQL = """l as (select season, game_id, player_id, pts - case when game_id % 7 = 0 then 1 else 0 end pts, fgm, case when player_id % 9 = 0 then fgm - 1 else fga end fga, fg3m, ftm, game_id % 13 = 0 off from box),
 v as (select *, fgm > fga makes, pts <> 2 * fgm + fg3m + ftm points from l)"""


@query(f"""with {BOX_SQL}, {LOAD_SQL} select season, count(*) filter (not makes and not points and not off) held, count(*) filter (makes) makes, count(*) filter (points) points, count(*) filter (off) weights, count(*) filter (makes or points or off) rejected from v group by 1""")
def gated_loads(spark, sf_dir):
    """A table after a clean batch, one that is stopped and one whose faulty rows are diverted: rows held and rejected by rule and season."""
    lines = box_view(spark, sf_dir).selectExpr("season", "game_id", "player_id", "pts - if(game_id % 7 = 0, 1, 0) as pts", "fgm", "if(player_id % 9 = 0, fgm - 1, fga) as fga", "fg3m", "ftm", "map('G', 0.5D, 'F', if(game_id % 13 = 0, 0.6D, 0.5D)) as weights")
    rules = {"makes": F.col("fgm") <= F.col("fga"), "points": F.col("pts") == F.expr("2 * fgm + fg3m + ftm"), "weights": valid_weights(F.col("weights"))}
    root = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    schema = T.StructType([f for f in lines.schema if f.name != "weights"])
    held = KeyedTable(spark, f"{root}/lines", schema, ("season", "game_id", "player_id"), ("season",))
    rejects = KeyedTable(spark, f"{root}/rejects", T.StructType([*schema.fields, T.StructField("broken", T.StringType())]), held.keys, held.partition)
    quality.gated_load(held, lines.where("game_id % 7 > 0 and game_id % 13 > 0 and player_id % 9 > 0 and game_id % 2 = 0"), rules)
    try:
        quality.gated_load(held, lines.where("game_id % 2 = 1"), rules)
        raise AssertionError("the batch was to be stopped")
    except quality.ConstraintError:
        pass
    quality.gated_load(held, lines, rules, rejects)
    has = lambda name: F.count_if(F.array_contains(F.split("broken", ","), name)).alias(name)
    counts = rejects.read().groupBy("season").agg(has("makes"), has("points"), has("weights"), F.count("*").alias("rejected"))
    return held.read().groupBy("season").agg(F.count("*").alias("held")).join(counts, "season", "full").fillna(0)


# People: suppliers are provisional (negative ids), customers official. Strong evidence pairs a supplier with a customer, weaker evidence
# suppliers with each other and, for some, with a second customer.
PEOPLE_SQL = """s as (select s_suppkey k from supplier), ev as (select -k - 1 a, k * 3 + 1 b, 0 tier from s where k % 5 <> 0 union all select -k - 1, -k - 2, 1 from s where k % 3 = 0 union all select -k - 1, k * 7 + 2, 1 from s where k % 11 = 0),
 official as (select c_custkey id from customer)"""


def walked_sql(tier: int, before: str) -> str:
    """Groups of a tier over the labels of ``before``."""
    t = f"t{tier}"
    return f"""{t}p as (select distinct x.label a, y.label b from ev join {before} x on x.id = ev.a join {before} y on y.id = ev.b where tier = {tier} and x.label <> y.label), {t}e as (select a, b from {t}p union select b, a from {t}p),
 {t}r as (select a id, a other from {t}e union select r.id, e.b from {t}r r join {t}e e on e.a = r.other), {t}j as (select id label, least(id, min(other)) joint from {t}r group by id),
 {t}g as (select h.id, h.label, coalesce(j.joint, h.label) joint, j.joint is not null touched from {before} h left join {t}j j using (label)),
 {t}bad as (select joint, count(*) officials from {t}g where id in (select id from official) group by 1 having count(*) > 1 and bool_or(touched)),
 {t}h as (select g.id, case when b.joint is not null then g.label else g.joint end label from {t}g g left join {t}bad b using (joint))"""


IDENTITY_SQL = f"with recursive {PEOPLE_SQL}, h as (select id, id label from (select a id from ev union select b from ev)), {walked_sql(0, 'h')}, {walked_sql(1, 't0h')}, named as (select t1h.id, coalesce(o.official, t1h.label) identity from t1h left join (select label, min(id) official from t1h where id in (select id from official) group by 1) o using (label))"


def people(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    strong = s.where("k % 5 != 0").selectExpr("-k - 1 as a", "k * 3 + 1 as b", "0 as tier")
    weak = s.where("k % 3 = 0").selectExpr("-k - 1 as a", "-k - 2 as b", "1 as tier").unionByName(s.where("k % 11 = 0").selectExpr("-k - 1 as a", "k * 7 + 2 as b", "1 as tier"))
    return identity.reconciled(strong.unionByName(weak), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id")), 2)


@query(IDENTITY_SQL + """ select coalesce(n.identity, -l_suppkey - 1) person, count(*) lines, cast(sum(l_quantity) as bigint) quantity from lineitem left join (select * from named where id <> identity) n on n.id = -l_suppkey - 1 group by 1""")
def rekeyed_lines(spark, sf_dir):
    """Lines by person once provisional ids have become the ones they were matched to: no line is lost."""
    mapping, _ = people(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey").cast("long") - 1).alias("person"), "l_quantity")
    return identity.rekeyed(lines, mapping, ["person"]).groupBy("person").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(IDENTITY_SQL + " select joint identity, 0 tier, officials from t0bad union all select joint, 1, officials from t1bad")
def identity_conflicts(spark, sf_dir):
    """Groups that would have two official ids, by the tier of evidence that would have joined them; they are left open."""
    return people(spark, sf_dir)[1]
