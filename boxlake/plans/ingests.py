"""Queries over stores that are filled batch by batch, against one pass over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.operators.store import staged
from boxlake.plans.queries import query
from boxlake.sources.shared import shared_dir
from boxlake.sources.tables import BOX_SQL, STATS, box_view
from boxlake.streaming import games

# Of games whose key this divides the first box that lands is wrong: five field goals too many a player, and a player too many.
WRONG, NEVER_FINAL = 7, 10


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word on each game: a poll with its whole box."""
    box = box_view(spark, sf_dir)
    lines = F.collect_list(F.struct("player_id", "team_id", *(F.col(s).cast("long").alias(s) for s in STATS)))
    rows = box.groupBy("game_id", "season", "season_type", "game_date", "home_id", "away_id").agg(lines.alias("box"))
    return rows.withColumn("status", F.when(F.col("game_id") % NEVER_FINAL == 0, "live").otherwise("final")).withColumn("polled_at", F.expr("cast(game_date as timestamp) + interval 40 hours"))


def wrong(rows: DataFrame) -> DataFrame:
    """rows as they were reported at first."""
    spoiled = F.transform("box", lambda x: x.withField("fgm", x["fgm"] + 5))
    ghost = F.array(F.struct(F.lit(-1).cast("long").alias("player_id"), F.col("home_id").alias("team_id"), *(F.lit(1).cast("long").alias(s) for s in STATS)))
    off = F.col("game_id") % WRONG == 0
    return rows.withColumn("box", F.when(off, F.concat(spoiled, ghost)).otherwise(F.col("box"))).withColumn("polled_at", F.expr("cast(game_date as timestamp) + interval 22 hours"))


def live(rows: DataFrame, hours: int) -> DataFrame:
    return rows.withColumn("box", F.slice("box", 1, 1)).withColumn("status", F.lit("live")).withColumn("polled_at", F.expr(f"cast(game_date as timestamp) + interval {hours} hours"))


def landed(spark: SparkSession, sf_dir: str) -> games.GameStore:
    """A store after three micro-batches: final, live, repeated, corrected and late polls."""
    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    true = staged(polls(spark, sf_dir))
    third = lambda k: F.col("game_id") % 3 == k
    again = true.withColumn("polled_at", F.expr("polled_at + interval 1 hours"))
    store = games.GameStore(spark, root)
    for number, batch in enumerate((
        [wrong(true.where(third(0))), live(true.where(third(1)), 20)],
        [wrong(true.where(third(1))), true.where(third(0)), again.where(third(0))],
        [true.where(third(2)), true.where(third(1)), again.where(third(1)), live(true.where(third(0)), 21)],
    )):
        rows = batch[0]
        for more in batch[1:]:
            rows = rows.unionByName(more)
        rows.write.option("compression", "zstd").parquet(f"{root}/landing/batch={number}")
        games.stream(store, f"{root}/landing", f"{root}/checkpoint")
    return store


TOTALS = ", ".join(f'cast(sum("{s}") as bigint) "{s}"' for s in STATS)


@query(f"with {BOX_SQL} select season, season_type, player_id, count(*) gp, {TOTALS} from box where game_id % {NEVER_FINAL} <> 0 group by 1, 2, 3")
def ingested_seasons(spark, sf_dir):
    """Season totals of a store that three micro-batches have filled, with late, repeated and corrected polls: those of one pass over the final games."""
    return landed(spark, sf_dir).seasons.read()


@query(f"""with {BOX_SQL}, g as (select game_id, season, season_type, count(*) n from box where game_id % {NEVER_FINAL} <> 0 group by 1, 2, 3),
 b as (select *, game_id % 3 part, game_id % {WRONG} = 0 bad from g),
 c as (select batch, b.*, case when part = batch then n + case when bad and batch < 2 then 1 else 0 end else 0 end ins, case when part = batch - 1 and bad then n else 0 end upd, case when part = batch - 1 and bad then 1 else 0 end del from b, range(3) r(batch))
 select batch + 1 "version", count(*) filter (part = batch) newly_final, cast(sum(ins) as bigint) inserted, cast(sum(upd) as bigint) updated, cast(sum(del) as bigint) deleted, count(distinct concat(season, season_type)) filter (ins + upd + del > 0) seasons from c group by batch""")
def ingest_versions(spark, sf_dir):
    """What each micro-batch changed."""
    return landed(spark, sf_dir).versions().drop("batch", "data_through")


FIRST, LAST = "1994-01-01", "1996-06-30"


@query(f"""with {BOX_SQL}, w as (select season, season_type, game_id, player_id, {", ".join(f'"{s}"' + (" + 5 as fgm" if s == "fgm" else "") for s in STATS)} from box where game_id % {WRONG} = 0 and game_date not between date '{FIRST}' and date '{LAST}'
   union all select distinct season, season_type, game_id, -1, {", ".join("1" for _ in STATS)} from box where game_id % {WRONG} = 0 and game_date not between date '{FIRST}' and date '{LAST}'
   union all select season, season_type, game_id, player_id, {", ".join(f'"{s}"' for s in STATS)} from box where not (game_id % {WRONG} = 0 and game_date not between date '{FIRST}' and date '{LAST}'))
 select season, season_type, player_id, count(*) gp, {TOTALS} from w where game_id % {NEVER_FINAL} <> 0 group by 1, 2, 3""")
def repaired_seasons(spark, sf_dir):
    """Season totals after a bulk ingest of the first reports and a repair of a range of days, run twice: right within the range, as first reported outside."""
    store = games.GameStore(spark, f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}")
    true = staged(polls(spark, sf_dir))
    games.ingest(store, wrong(true), 0)
    for batch in (1, 2):
        games.refetch(store, true, FIRST, LAST, batch)
    return store.seasons.read()
