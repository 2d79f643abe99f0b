"""The number of tasks that lines are dealt to follows their files' size, not the session's partitions."""

import re

import pytest
from pyspark.sql import functions as F

from boxlake.plans.queries import QUERIES
from boxlake.sources import tables

DIR = "/root/testdata/sf0.001"


def test_tasks_follow_the_size(spark, monkeypatch, tmp_path):
    spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    held = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("part-*"))
    least = spark.sparkContext.defaultParallelism
    assert tables.tasks(spark, str(tmp_path)) == least
    monkeypatch.setattr(tables, "TASK_BYTES", held // 40)
    assert 40 <= tables.tasks(spark, str(tmp_path)) <= 43


def test_a_task_holds_no_more_of_larger_lines(spark, monkeypatch):
    want = {name: sorted(map(tuple, QUERIES[name](spark, DIR).collect())) for name in ("season_averages", "team_pace")}
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    n = tables.tasks(spark, DIR)
    assert n > 8
    for name, rows in want.items():
        df = QUERIES[name](spark, DIR)
        assert df.rdd.getNumPartitions() == n and sorted(map(tuple, df.collect())) == rows


def test_projections_read_the_lines_once(spark):
    """The lines, the days' means and the pooled dispersions are staged; the plan that is left derives none of them again."""
    plan = QUERIES["stat_projections"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "o_custkey" not in plan


@pytest.mark.parametrize("name", ["season_composites", "defence_by_position", "injury_projected_players", "game_log"])
def test_no_shuffle_takes_the_sessions_partitions(spark, monkeypatch, name):
    """Lines are shuffled by game or player among the lines' tasks, and what is joined to them by scope or team is broadcast."""
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    n = tables.tasks(spark, DIR)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\)", plan)
    assert {int(k) for keys, k in dealt if "game_id" in keys or "player_id" in keys} <= {n}
    if name != "defence_by_position":  # its other joins are of teams' sums
        assert all("game_id" in keys for keys in re.findall(r"SortMergeJoin \[([^]]*)\]", plan))
