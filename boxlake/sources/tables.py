"""Input tables, and the box-score grain that the analytics run on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.sources.shared import file_system

STATS = ("fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "ast", "stl", "blk", "tov", "pf", "pts", "min")
# The bench line that is added to every team, so that a team is more than its listed players.
BENCH = dict(zip(STATS, (20, 45, 6, 17, 9, 12, 6, 19, 13, 4, 3, 8, 12, 55, 180)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_BYTES = 4 << 20  # of the lines' files a task: some 250,000 to 330,000 lines


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Among how many tasks the lines are dealt: as many as their files' size asks for, so that what one task holds does not grow with them, and at least one a core."""
    at, files = file_system(spark, f"{sf_dir}/lineitem.parquet")
    return max(-(-files.getContentSummary(at).getLength() // TASK_BYTES), spark.sparkContext.defaultParallelism)


def by_player(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows dealt by player among as many tasks as the lines: groups, windows and joins that include player_id need no other shuffle."""
    return rows.repartition(tasks(spark, sf_dir), "player_id")


def box_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (game, player): an order is a game between two of the nations, a supplier a player, who plays for the home side if the key is even; statistics derive from the order's lines.

    Lines and games are dealt by game once, among ``tasks``; the grain, the games' own columns and all windows within a game need no other shuffle of them.
    """
    n = tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player_id"), "l_partkey", "l_linenumber", "l_quantity")
    grain = lines.repartition(n, "game_id").groupBy("game_id", "player_id").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum("l_linenumber").alias("ln"), F.sum("l_partkey").alias("pk"))
    games = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"), F.year("o_orderdate").cast("long").alias("season"), F.col("o_orderstatus").alias("season_type"),
        F.expr("o_custkey % 25").alias("home_id"), F.expr("(o_custkey + 1 + o_orderkey % 24) % 25").alias("away_id"),
    )
    made = grain.join(games.repartition(n, "game_id"), "game_id").selectExpr(
        "game_id", "player_id", "case when player_id % 2 = 0 then home_id else away_id end as team_id", "home_id", "away_id", "season", "season_type", "game_date", "q * 9 div 20 as fgm", "q as fga", "q * 9 div 60 as fg3m", "q * 2 div 5 as fg3a",
        "ln + pk % 2 as ftm", "2 * ln as fta", "pk % 4 as oreb", "pk % 7 as dreb", "pk % 9 as ast", "pk % 3 as stl", "pk % 2 as blk", "(pk + game_id) % 5 as tov", "n + pk % 3 as pf", "10 + pk % 30 as min",
    )
    return made.withColumn("pts", F.expr("2 * fgm + fg3m + ftm"))


def games(box: DataFrame) -> DataFrame:
    """One row per game: h_ and a_ columns are the home and away players' sums plus the bench line."""
    sums = [f"sum(if(team_id {op} home_id, {s}, 0)) + {BENCH[s]} as {p}{s}" for p, op in (("h_", "="), ("a_", "!=")) for s in STATS]
    return box.groupBy("game_id", "season", "season_type", "game_date", "home_id", "away_id").agg(*map(F.expr, sums))


def sides(box: DataFrame) -> DataFrame:
    """One row per (game, side): tm_ columns are the side's, opp_ columns the other side's. One aggregate by game gives both."""
    names = ", ".join(["team_id", "opp_team_id", *(p + s for p in ("tm_", "opp_") for s in STATS)])
    side = lambda own, other, p, q: ", ".join([own, other, *(p + s for s in STATS), *(q + s for s in STATS)])
    both = f"stack(2, {side('home_id', 'away_id', 'h_', 'a_')}, {side('away_id', 'home_id', 'a_', 'h_')}) as ({names})"
    return games(box).selectExpr("game_id", "season", "season_type", "game_date", both)


def full_lines(box: DataFrame) -> DataFrame:
    """Every box line with its side's tm_ columns and the other side's opp_ columns, by windows within the game."""
    game = lambda s: f"sum({s}) over (partition by game_id)"
    side = lambda s: f"sum({s}) over (partition by game_id, team_id)"
    return box.selectExpr("*", *(f"{side(s)} + {BENCH[s]} as tm_{s}" for s in STATS), *(f"{game(s)} - {side(s)} + {BENCH[s]} as opp_{s}" for s in STATS))


#: The same views as common table expressions, for oracle queries.
BOX_SQL = """grain as (
  select l_orderkey game_id, l_suppkey player_id, count(*) n, cast(sum(l_quantity) as bigint) q, cast(sum(l_linenumber) as bigint) ln, cast(sum(l_partkey) as bigint) pk
  from lineitem group by 1, 2),
raw as (
  select game_id, player_id, case when player_id % 2 = 0 then o_custkey % 25 else (o_custkey + 1 + o_orderkey % 24) % 25 end team_id, o_custkey % 25 home_id, (o_custkey + 1 + o_orderkey % 24) % 25 away_id,
    cast(year(o_orderdate) as bigint) season, o_orderstatus season_type, cast(o_orderdate as date) game_date,
    q * 9 // 20 fgm, q fga, q * 9 // 60 fg3m, q * 2 // 5 fg3a, ln + pk % 2 ftm, 2 * ln fta, pk % 4 oreb, pk % 7 dreb, pk % 9 ast, pk % 3 stl, pk % 2 blk,
    (pk + game_id) % 5 tov, n + pk % 3 pf, 10 + pk % 30 "min"
  from grain join orders on o_orderkey = game_id),
box as (select *, 2 * fgm + fg3m + ftm pts from raw)"""
SIDES_SQL = (
    BOX_SQL
    + ",\npre as (select game_id, season, season_type, game_date, home_id, away_id, "
    + ", ".join(f'cast(sum(case when team_id {op} home_id then "{s}" else 0 end) as bigint) + {BENCH[s]} {p}{s}' for p, op in (("h_", "="), ("a_", "<>")) for s in STATS)
    + " from box group by 1, 2, 3, 4, 5, 6),\nsides as ("
    + " union all ".join(f"select game_id, {own} team_id, season, season_type, game_date, {other} opp_team_id, " + ", ".join(f"{p}{s} tm_{s}, {q}{s} opp_{s}" for s in STATS) + " from pre" for own, other, p, q in (("home_id", "away_id", "h_", "a_"), ("away_id", "home_id", "a_", "h_")))
    + ")"
)
