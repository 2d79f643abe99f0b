"""Incremental ingest of games: polls of the scoreboard that carry the box score, merged by key as games turn final.

A stateful operator lets each poll through once, however often its file or row is delivered. A micro-batch is held against the stored
games: what is newer moves them, and what also says something else has its lines merged and the seasons of changed lines
recomputed. The games are written last: they mark the batch as done, so a batch that stops on the way is redone whole, and
one that is repeated changes nothing. Polls may come late and in any order, as times are compared and never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.operators.merge import data_through
from boxlake.operators.store import BITS, KeyedTable, bit_of, file_system, settings, staged
from boxlake.sources.tables import STATS

SCOPE = ("season", "season_type")
SIDES = "home_id long, away_id long"
BOX = "array<struct<player_id:bigint,team_id:bigint," + ",".join(f"{s}:bigint" for s in STATS) + ">>"
POLL = f"game_id long, season long, season_type string, game_date date, {SIDES}, status string, polled_at timestamp, box {BOX}"
VERSION = "batch long, version long, newly_final long, inserted long, updated long, deleted long, seasons long, data_through date"
# A poll is known for so long after it was received.
KEEP_STATE = "3 days"
# Known polls lie on disk, under a bound of memory: in the executors' heap each took 195 bytes and up to twice that.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def schema(fields: str) -> T.StructType:
    return T.DataType.fromDDL(fields)


@dataclass(frozen=True)
class GameStore:
    """Tables of one store: games, lines of final games, season totals, and a version a batch that changed something."""

    spark: SparkSession
    root: str

    def _table(self, name: str, fields: str, keys: tuple[str, ...], partition: tuple[str, ...] = SCOPE) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", schema(fields), keys, partition)

    @property
    def games(self) -> KeyedTable:
        return self._table("games", f"game_id long, season long, season_type string, game_date date, {SIDES}, status string, polled_at timestamp, digest binary", (*SCOPE, "game_id"))

    @property
    def lines(self) -> KeyedTable:
        return self._table("lines", "season long, season_type string, game_id long, player_id long, game_date date, team_id long, " + ", ".join(f"`{s}` long" for s in STATS), (*SCOPE, "game_id", "player_id"))

    @property
    def seasons(self) -> KeyedTable:
        return self._table("seasons", "season long, season_type string, player_id long, gp long, " + ", ".join(f"`{s}` long" for s in STATS), (*SCOPE, "player_id"))

    def versions(self) -> DataFrame:
        at, files = file_system(self.spark, f"{self.root}/versions")
        return self.spark.read.schema(schema(VERSION)).parquet(f"{self.root}/versions") if files.exists(at) else self.spark.createDataFrame([], VERSION)


def digested(polls: DataFrame) -> DataFrame:
    """polls with a digest of what they say, apart from when they were taken; players of a box in any order, a null box an empty one."""
    box = F.array_sort(F.coalesce("box", F.from_json(F.lit("[]"), BOX)))
    said = F.to_json(F.struct(*(F.col(c) for c in ("season", "season_type", "game_date", "home_id", "away_id", "status")), box.alias("box")), {"ignoreNullFields": "false"})
    return polls.withColumn("digest", F.unhex(F.substring(F.sha2(said, 256), 1, 32)))  # 16 bytes tell the polls of a game apart


def placed(polls: DataFrame) -> DataFrame:
    """Where the polls of a scan of Parquet files stand, and what is needed to tell which of them count: no box. Polls without a game, sides or a season are left out."""
    known = polls.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    known = known.where(F.expr("game_id is not null and home_id is not null and away_id is not null and season is not null and season_type is not null and polled_at is not null"))
    return digested(known).select("game_id", *SCOPE, "polled_at", F.coalesce(F.col("status") == "final", F.lit(False)).alias("final"), "digest", "file", "row")


def newest(polls: DataFrame, held: DataFrame) -> DataFrame:
    """One of the placed polls a game, ``poll``: the last, of those taken at once a final one, then by digest; beside it ``held`` (game_id, at, said, was), what is stored of the game."""
    said = polls.select("game_id", F.struct("polled_at", "final", "digest", *SCOPE, "file", "row").alias("poll"), F.lit(None).cast("struct<at:timestamp,said:binary,was:boolean>").alias("held"))
    known = held.select("game_id", F.lit(None).cast(said.schema["poll"].dataType).alias("poll"), F.struct("at", "said", "was").alias("held"))
    return said.unionByName(known).groupBy("game_id").agg(F.max("poll").alias("poll"), F.max("held").alias("held")).where("poll is not null")


def fetched(spark: SparkSession, chosen: DataFrame) -> DataFrame:
    """The polls at ``chosen`` (file, row) and whether they are ``told`` there, read from their files by maps of a bit a poll: boxes are not shuffled."""
    files = [r[0] for r in chosen.select("file").distinct().collect()]
    at = lambda row: ((row / BITS).cast("long").alias("part"), (row % BITS).alias("bit"))
    part, bit = at(F.col("row"))
    maps = chosen.select("file", part, bit, "told").groupBy("file", "part").agg(F.expr("bitmap_construct_agg(bit)").alias("any"), F.expr("bitmap_construct_agg(bit) filter (where told)").alias("some"))
    polls = spark.read.schema(schema(POLL)).parquet(*map(unquote, files)).select("*", F.col("_metadata.file_path").alias("file"), *at(F.col("_metadata.row_index")))
    found = polls.join(F.broadcast(maps), ["file", "part"]).where(bit_of("any", "bit"))
    return found.select(*schema(POLL).names, F.when(F.col("some").isNull(), False).otherwise(bit_of("some", "bit")).alias("told"))


def box_lines(finals: DataFrame) -> DataFrame:
    """The lines of polls, one a game and player: of lines that repeat a player the greatest by all columns, found within the box; lines without a player are left out."""
    ordered = finals.select(*SCOPE, "game_id", "game_date", F.sort_array("box").alias("__box"))
    last = lambda x, i: x["player_id"].isNotNull() & ~x["player_id"].eqNullSafe(F.get(F.col("__box"), i + 1)["player_id"])
    return ordered.select(*SCOPE, "game_id", "game_date", F.explode(F.filter("__box", last)).alias("__x")).select(*SCOPE, "game_id", "game_date", "__x.*")


def ingest(store: GameStore, polls: DataFrame, batch: int, repair: bool = False) -> DataFrame:
    """Merge a batch of polls (POLL) into the store; its version row, or no row if nothing changed.

    A poll that is not newer than the stored one is passed over, one that says the same only moves its time; ``repair`` merges the lines of all again. Lines of a final game replace
    what is stored of it: players it no longer has are deleted. Lines of a game that is not final stay as they are.
    """
    return merge_placed(store, placed(staged(polls.select(*schema(POLL).names))), batch, repair)


def merge_placed(store: GameStore, polls: DataFrame, batch: int, repair: bool = False) -> DataFrame:
    """``ingest`` of polls that are known by their places; only the boxes of final polls that say something else are read from there."""
    parts = [tuple(r) for r in polls.select(*SCOPE).distinct().collect()]
    if not parts:
        return store.spark.createDataFrame([], VERSION)
    held = store.games.within(parts).select("game_id", F.col("polled_at").alias("at"), F.col("digest").alias("said"), F.coalesce(F.col("status") == "final", F.lit(False)).alias("was"))
    newer = F.col("held").isNull() | (F.col("poll.polled_at") > F.col("held.at")) | (F.lit(repair) & (F.col("poll.polled_at") == F.col("held.at")))
    says = F.col("held").isNull() | (F.col("poll.digest") != F.col("held.said"))
    moved = says | (F.col("poll.polled_at") != F.col("held.at"))
    told = F.col("poll.final") & (F.lit(repair) | says)
    fresh = staged(newest(polls, held).where(newer).select(*(F.col(f"poll.{c}") for c in SCOPE), "game_id", "poll.file", "poll.row", told.alias("told"), (F.lit(repair) | says).alias("other"), moved.alias("moved"), (told & ~F.coalesce("held.was", F.lit(False))).alias("newly")))
    newly, spoken = fresh.agg(F.count_if("newly"), F.count_if("other")).first()
    keys, finals = [*SCOPE, "game_id"], fresh.where("told")
    report = store.lines.replace(staged(box_lines(fetched(store.spark, finals).where("told"))), finals.select(*keys))
    affected = sorted({(r["season"], r["season_type"]) for r in report if r["change"] != "same"})
    if affected:
        with settings(store.spark, {"spark.sql.files.minPartitionNum": "1"}):  # a partition's files among few tasks
            store.seasons.merge(season_totals(store.lines, affected), affected, unique=True)
    store.games.replace(digested(fetched(store.spark, fresh.where("moved"))).select(*store.games.schema.names), fresh.where("moved").select(*keys), told=False)
    if not affected and (repair or not spoken):
        return store.spark.createDataFrame([], VERSION)
    through = data_through(store.games.read().withColumn("__final", F.col("status") == "final"), "game_date", "__final").first()["through"]
    last = store.versions().where(F.col("batch") != batch).agg(F.max("version")).first()[0] or 0
    counts = [sum(r["n"] for r in report if r["change"] == c) for c in ("insert", "update", "stale")]
    row = store.spark.createDataFrame([(batch, last + 1, newly, *counts, len(affected), through)], VERSION)
    row.coalesce(1).drop("batch").write.mode("overwrite").parquet(f"{store.root}/versions/batch={batch}")
    return row


def season_totals(lines: KeyedTable, parts: list[tuple]) -> DataFrame:
    """Totals of some partitions. Each is a scan of its own, so that a task sums lines of one of them and sends few rows a player."""
    found = reduce(DataFrame.unionByName, (lines.within([part]) for part in parts))
    return found.groupBy(*SCOPE, "player_id").agg(F.count("*").alias("gp"), *(F.sum(s).alias(s) for s in STATS))


def refetch(store: GameStore, polls: DataFrame, first: str, last: str, batch: int) -> DataFrame:
    """Repair: the polls of games from ``first`` to ``last`` are merged whatever the store says of them; run again, it changes nothing."""
    return ingest(store, polls.where(F.col("game_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))), batch, repair=True)


def stream(store: GameStore, landing: str, checkpoint: str) -> None:
    """Ingest what has landed since the checkpoint: Parquet files of POLL under ``landing``'s folders."""
    polls = placed(store.spark.readStream.schema(schema(POLL)).option("recursiveFileLookup", "true").parquet(landing))
    once = polls.withColumn("__received", F.current_timestamp()).withWatermark("__received", KEEP_STATE).dropDuplicatesWithinWatermark(["game_id", "polled_at", "digest"])

    def merge(rows: DataFrame, number: int) -> None:
        merge_placed(GameStore(rows.sparkSession, store.root), staged(rows.drop("__received")), number)

    with settings(store.spark, STATE):
        once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
