"""Keyed tables over several merges, and the ingest of games over repeated, late and redelivered polls."""

import random
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.operators.store import KeyedTable, sifted
from boxlake.streaming import games

FIELDS = T.StructType().add("part", "string").add("k", "long").add("a", "integer").add("x", "double")


def files(path, part):
    return {f.name: f.stat().st_mtime_ns for f in Path(path).glob(f"part={part}/*.parquet")}


def changes(report):
    return {(r["part"], r["change"]): r["n"] for r in report}


def test_merges(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", FIELDS, ("part", "k"), ("part",))
    frame = lambda rows: spark.createDataFrame(rows, FIELDS)
    held = lambda: {(r.part, r.k): (r.a, r.x) for r in table.read().collect()}
    assert table.read().count() == 0 and table.merge(frame([])) == []
    first = [("p", 1, 1, 1.0), ("p", 2, 2, 2.0), ("q", 1, 3, 3.0), (None, 1, 4, None), ("r/s", 1, 9, 9.0), ("q", 1, 2, 8.0)]  # q 1 twice: the greater counts
    assert changes(table.merge(frame(first))) == {("p", "insert"): 2, ("q", "insert"): 1, (None, "insert"): 1, ("r/s", "insert"): 1}
    before = {p: files(table.path, p) for p in ("p", "q")}
    assert changes(table.merge(frame(first))) == {("p", "same"): 2, ("q", "same"): 1, (None, "same"): 1, ("r/s", "same"): 1}
    assert {p: files(table.path, p) for p in before} == before
    # p: one updated, one within the tolerance; q stays out of it; the null partition gets a row
    report = table.merge(frame([("p", 1, 1, 1.0 + 1e-12), ("p", 2, 7, 2.0), (None, 2, 5, 5.0)]))
    assert changes(report) == {("p", "same"): 1, ("p", "update"): 1, (None, "same"): 1, (None, "insert"): 1}
    assert files(table.path, "q") == before["q"] and files(table.path, "p") != before["p"]
    # whole partitions made anew: p loses a row, r/s all its rows; a column that is not given stays
    report = table.merge(spark.createDataFrame([("p", 2, 2.5)], "part string, k long, x double"), [("p",), ("r/s",)])
    assert changes(report) == {("p", "update"): 1, ("p", "stale"): 1, ("r/s", "stale"): 1}
    assert held() == {("p", 2): (7, 2.5), ("q", 1): (3, 3.0), (None, 1): (4, None), (None, 2): (5, 5.0)}
    assert not [d for d in Path(table.path).iterdir() if "r%2Fs" in d.name]
    # a scope of some keys: only those can be stale; rounding is half to even, unknown columns are dropped
    scope = spark.createDataFrame([("q", 1), ("p", 9)], "part string, k long")
    report = table.merge(spark.createDataFrame([("p", 3, 2.5, 1)], "part string, k long, a double, other int"), scope)
    assert changes(report) == {("p", "same"): 1, ("p", "insert"): 1, ("q", "stale"): 1} and held()["p", 3] == (2, None) and ("q", 1) not in held()


def poll(game, hour, status, box, day=1, season=2000):
    line = lambda p, pts: {"player_id": p, "team_id": 1, **dict.fromkeys(games.STATS, 1), "pts": pts}
    return (game, season, "R", date(2000, 1, day), 1, 2, status, datetime(2000, 1, day, hour), [line(*x) for x in box] if box is not None else None)


def test_stream(spark, tmp_path):
    store = games.GameStore(spark, f"{tmp_path}/store")
    landings = [
        [poll(1, 20, "live", [(1, 3)]), poll(1, 22, "final", [(1, 9), (2, 4)]), poll(2, 21, "live", None), poll(3, 22, "final", [(1, 5)], season=2001), (None, 2000, "R", None, 1, 2, "final", datetime(2000, 1, 1), None)],
        [poll(1, 22, "final", [(2, 4), (1, 9)]), poll(1, 23, "final", [(1, 9), (2, 4)]), poll(2, 22, "final", [(1, 6)])],  # delivered again, the same later, newly final
        [poll(1, 21, "live", [(7, 7)]), poll(2, 23, "final", [(3, 6)])],  # late; corrected
    ]
    seen = []
    for i, rows in enumerate(landings):
        spark.createDataFrame(rows, games.POLL).coalesce(1).write.parquet(f"{tmp_path}/landing/{i}")
        games.stream(store, f"{tmp_path}/landing", f"{tmp_path}/checkpoint")
        seen.append({(r.season, r.player_id): (r.gp, r.pts) for r in store.seasons.read().collect()})
    assert seen == [
        {(2000, 1): (1, 9), (2000, 2): (1, 4), (2001, 1): (1, 5)},
        {(2000, 1): (2, 15), (2000, 2): (1, 4), (2001, 1): (1, 5)},
        {(2000, 1): (1, 9), (2000, 2): (1, 4), (2000, 3): (1, 6), (2001, 1): (1, 5)},
    ]
    versions = sorted((r.version, r.newly_final, r.inserted, r.updated, r.deleted, r.seasons) for r in store.versions().collect())
    assert versions == [(1, 2, 3, 0, 0, 2), (2, 1, 1, 0, 0, 1), (3, 0, 1, 0, 1, 1)]
    assert {(r.game_id, r.status, r.polled_at.hour) for r in store.games.read().collect()} == {(1, "final", 23), (2, "final", 23), (3, "final", 22)}
    # a repair of the day puts game 2 right, and nothing the second time; a batch that is repeated changes nothing
    fixed = spark.createDataFrame([poll(2, 23, "final", [(1, 6)]), poll(1, 23, "final", [(1, 9), (2, 4)])], games.POLL)
    assert games.refetch(store, fixed, "2000-01-01", "2000-01-01", 9).count() == 1 and games.refetch(store, fixed, "2000-01-01", "2000-01-01", 10).count() == 0
    assert games.refetch(store, fixed, "2000-01-02", "2000-01-09", 11).count() == 0
    assert games.ingest(store, spark.createDataFrame(landings[1], games.POLL), 12).count() == 0
    assert {(r.season, r.player_id): (r.gp, r.pts) for r in store.seasons.read().collect()} == seen[1]


def test_lines_of_a_box(spark):
    """Lines that repeat a player are settled within the box, without a shuffle: the greatest counts, null least."""
    rows = spark.createDataFrame([poll(1, 22, "final", [(2, 4), (1, 9), (None, 5), (2, 8), (1, None), (2, 8)]), poll(2, 22, "final", []), poll(3, 22, "final", None)], games.POLL)
    lines = games.box_lines(rows)
    assert sorted((r.game_id, r.player_id, r.pts, r.game_date.day) for r in lines.collect()) == [(1, 1, 9, 1), (1, 2, 8, 1)]
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()


def test_whole_numbers_stay_whole(spark, tmp_path):
    """A long goes into a long column as it is, not by way of a double."""
    table = KeyedTable(spark, f"{tmp_path}/t", T.StructType().add("part", "string").add("k", "long").add("v", "long"), ("part", "k"), ("part",))
    table.merge(spark.createDataFrame([("p", 2**60 + 1, 2**53 + 1)], table.schema))
    assert [tuple(r) for r in table.read().collect()] == [("p", 2**60 + 1, 2**53 + 1)]


def shuffled(spark):
    """Bytes of shuffle that the session's tasks have written."""
    held = spark._jsc.sc().statusStore().executorList(False)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))


def widened(rng, rows):
    """Polls whose boxes no codec makes smaller than 90 bytes a line."""
    return [(*r[:8], [{s: rng.getrandbits(48) if s in games.STATS and s != "pts" else v for s, v in x.items()} for x in r[8]]) for r in rows]


def test_boxes_are_not_shuffled(spark, tmp_path):
    """Polls are settled by their places; boxes go from the landed files into the store, also those of a folder with signs in its name."""
    rng = random.Random(3)
    box = lambda: [(p, rng.getrandbits(48)) for p in range(100)]
    first, fixed = ([poll(g, hour, "final", box()) for g in range(200)] for hour in (20, 22))
    root = f"{tmp_path}/a b%20c"
    store = games.GameStore(spark, f"{root}/store")
    wide = lambda rows: spark.createDataFrame(widened(rng, rows), games.POLL)
    wide(first).coalesce(2).write.parquet(f"{root}/landing/0")
    size = 200 * 100 * 15 * 6
    before = shuffled(spark)
    games.stream(store, f"{root}/landing", f"{root}/checkpoint")
    assert shuffled(spark) - before < size / 4
    wide(fixed[:20]).coalesce(2).write.parquet(f"{root}/landing/1")
    before = shuffled(spark)
    games.stream(store, f"{root}/landing", f"{root}/checkpoint")
    assert shuffled(spark) - before < size
    want = {(r[0], p): pts for r in fixed[:20] + first[20:] for p, pts in ((x["player_id"], x["pts"]) for x in r[8])}
    assert {(r.game_id, r.player_id): r.pts for r in store.lines.read().collect()} == want
    assert sorted((r.version, r.newly_final, r.inserted, r.updated, r.deleted) for r in store.versions().collect()) == [(1, 200, 20_000, 0, 0), (2, 0, 0, 2000, 0)]


def test_known_polls_lie_on_disk(spark, tmp_path):
    """State of the stream is no heap of the executors; the session's own settings are as they were."""
    kept = {k: spark.conf.get(k, None) for k in games.STATE}
    store = games.GameStore(spark, f"{tmp_path}/store")
    spark.createDataFrame([poll(1, 20, "final", [(1, 9)])], games.POLL).write.parquet(f"{tmp_path}/landing/0")
    games.stream(store, f"{tmp_path}/landing", f"{tmp_path}/checkpoint")
    assert list(Path(f"{tmp_path}/checkpoint/state").rglob("*.zip")) and store.games.read().count() == 1
    assert {k: spark.conf.get(k, None) for k in games.STATE} == kept


def test_a_repair_moves_lines_once(spark, tmp_path):
    """To be compared, stored and fetched lines of the range's games meet in one shuffle; other games' lines stay where they are."""
    rng = random.Random(4)
    store = games.GameStore(spark, f"{tmp_path}/store")
    rows = widened(rng, [poll(g, 20, "final", [(p, p) for p in range(100)], day=1 + g // 100) for g in range(400)])
    polls = spark.createDataFrame(rows, games.POLL).coalesce(2)
    games.ingest(store, polls, 0)
    size = 100 * 100 * 15 * 6
    for batch in (1, 2):
        before = shuffled(spark)
        assert games.refetch(store, polls, "2000-01-02", "2000-01-02", batch).count() == 0
        assert shuffled(spark) - before < 3 * size
    assert store.lines.read().count() == 40_000


def test_replace(spark, tmp_path):
    """What a scope holds gives way; other rows stay, whether the sieve tells them apart or the join, and partitions without a change are not written."""
    fields = T.StructType().add("part", "string").add("g", "long").add("k", "long").add("v", "long")
    table = KeyedTable(spark, f"{tmp_path}/t", fields, ("part", "g", "k"), ("part",))
    frame = lambda rows: spark.createDataFrame(rows, fields)
    scope = lambda rows: spark.createDataFrame(rows, "part string, g long")
    held = lambda: {(r.part, r.g, r.k): r.v for r in table.read().collect()}
    rows = [(p, g, k, g + k) for p in ("p", "q", "r/s") for g in range(4000 if p == "p" else 2) for k in (1, 2)]
    games_of = sorted({r[:2] for r in rows})
    assert changes(table.replace(frame(rows), scope(games_of))) == {("p", "insert"): 8000, ("q", "insert"): 4, ("r/s", "insert"): 4}
    before = {p: files(table.path, p) for p in ("p", "q")}
    assert changes(table.replace(frame(rows), scope(games_of))) == {("p", "same"): 8000, ("q", "same"): 4, ("r/s", "same"): 4}
    assert {p: files(table.path, p) for p in before} == before
    assert table.replace(frame([]), scope([])) == []
    # p: a game gets another value, loses a row and gets one, another game is new, a third has no rows any more; r/s is emptied; q is as it was
    new = [("p", 7, 1, 99), ("p", 7, 3, 5), ("p", 9000, 1, 1), ("q", 1, 1, 2), ("q", 1, 2, 3)]
    report = table.replace(frame(new), scope([("p", 7), ("p", 9000), ("p", 8), ("q", 1), ("r/s", 0), ("r/s", 1)]))
    assert changes(report) == {("p", "update"): 1, ("p", "insert"): 2, ("p", "stale"): 3, ("q", "same"): 2, ("r/s", "stale"): 4}
    want = {r[:3]: r[3] for r in rows if r[0] != "r/s" and r[:2] not in (("p", 7), ("p", 8))} | {r[:3]: r[3] for r in new}
    assert held() == want and files(table.path, "q") == before["q"] and not [d for d in Path(table.path).iterdir() if "r%2Fs" in d.name]


def test_sieve(spark):
    """It lets all that is wanted pass, and little else."""
    rows = spark.range(100_000).withColumn("s", F.when(F.col("id") % 5 > 0, "x"))
    wanted = rows.where("id % 10 = 0")
    passed = {r.id for r in sifted(rows, ["id", "s"], wanted).where("__may").collect()}
    assert len(passed) < 20_000 and passed >= set(range(0, 100_000, 10))
    assert sifted(rows, ["id"], wanted.limit(0)).where("__may").count() == 0
