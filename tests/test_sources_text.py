"""Parsers of what sources write, payload shapes and merges, on cases worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from boxlake.functions import parsing
from boxlake.operators import ingest, merge

DAY = date(2024, 11, 20)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("back in five weeks or so", date(2024, 12, 25)), ("3 – 4 weeks", date(2024, 12, 18)), ("needs a couple of months", date(2025, 1, 21)), ("a few days", date(2024, 11, 23)), ("Several months", date(2025, 2, 21)), ("an week", date(2024, 11, 27)), ("one to two days", date(2024, 11, 22)),
        ("not before December", date(2024, 12, 31)), ("end-October", date(2024, 10, 31)), ("Sept, maybe Feb", date(2025, 2, 28)), ("JUL", date(2025, 7, 31)), ("may return", None), ("no word", None), ("", None), (None, None), ("2 days, 1 week", date(2024, 11, 27)), ("10 days after January", date(2025, 1, 31)),
        ("Marc questionable", None), ("Augu trip", None), ("0 weeks", None), ("100 weeks", None), ("x6 weeks", None), ("six, weeks", None), ("decem 2 days", date(2024, 11, 22)), ("of weeks", None), ("zero or 3 days", date(2024, 11, 23)),
    ],
)
def test_return_horizon(spark, text, want):
    assert value(spark, parsing.return_horizon(F.lit(text).cast("string"), F.lit(DAY))) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Round 12", (12, 12, None)), ("ROUNDS 7 — 9", (7, 9, None)), ("rounds 8-8", (8, 8, None)), ("Rounds 9-2", (None, None, None)), ("round 0", (None, None, None)), ("maybe round 2", (None, None, None)), ("round 1234", (None, None, None)), ("round two", (None, None, None)),
        (" around 19  Sept ", (None, None, date(2025, 9, 19))), ("Around 25 October", (None, None, date(2024, 10, 25))), ("around 3 jan.", (None, None, date(2025, 1, 3))), ("Around 30 Feb", (None, None, None)), ("Around 8 Janua", (None, None, None)), ("around 8 oct 2024", (None, None, None)), (None, (None, None, None)),
    ],
)
def test_expected_return(spark, text, want):
    assert tuple(value(spark, parsing.expected_return(F.lit(text).cast("string"), F.lit(DAY)))) == want


def test_positions_and_weights(spark):
    resolve = lambda *a: tuple(value(spark, parsing.resolved_position(*(F.lit(x).cast("string") for x in a[:3]), F.lit(a[3]))))
    assert resolve("1", "2", "PF", False) == ("G", "registration") and resolve(None, "2", "C", True) == ("F", "boxScore")
    assert resolve(None, None, "pf", False) == ("F", "workbook") and resolve(None, None, "PF", True) == (None, None)
    weights = lambda m: value(spark, parsing.valid_weights(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))))
    assert weights({"G": 0.5, "F": 0.5}) and not weights({"G": 0.5, "F": 0.6}) and not weights({"G": 1.5, "F": -0.5})


def test_payloads(spark):
    box = '{"homeTeam": {"teamId": 1, "players": [{"personId": 7, "points": 3}]}, "awayTeam": {"teamId": 2, "players": [{"personId": 8, "points": null}]}}'
    rows = spark.createDataFrame([("g", box), ("h", "{}"), ("i", None)], "game string, json string")
    got = sorted(map(tuple, ingest.two_sides(rows, "json", "personId:bigint,points:int", ["game"]).collect()))
    assert got == [("g", False, 2, 8, None), ("g", True, 1, 7, 3)]
    sets = spark.createDataFrame([('{"headers": ["pts", "ID"], "rowSet": [["x", "1"], ["50", "2"]]}',), ('{"headers": [], "rowSet": []}',)], "json string")
    got = sorted(map(tuple, ingest.result_set(sets, "json", {"ID": ("id", "long"), "PTS": ("pts", "double"), "GONE": ("gone", "int")}, percent={"PTS"}).collect()))
    assert got == [(1, None, None), (2, 0.5, None)]
    aliased = ingest.resolved_columns(spark.createDataFrame([(1, 2)], "`Player ID` int, PTS int"), {"player_id": ["id", "player id"], "points": ["pts"], "gone": ["x"]})
    assert tuple(aliased.first()) == (1, 2, None)


def test_merge(spark):
    schema = "k int, a string, x double"
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "c", 3.0), (4, "d", float("nan"))], schema)
    new = spark.createDataFrame([(1, "a", 1.0 + 1e-12), (2, "b", None), (4, "d", float("nan")), (5, "e", 5.0)], schema)
    got = {r.k: (r.change, r.a) for r in merge.merged(old, new, ["k"]).collect()}
    assert got == {1: ("same", "a"), 2: ("update", "b"), 3: ("stale", "c"), 4: ("same", "d"), 5: ("insert", "e")}
    assert merge.merged(old.limit(0), new.limit(0), ["k"]).count() == 0
    kept = merge.coerced(spark.createDataFrame([(2.5, "7", 1)], "n double, t string, other int"), spark.createDataFrame([], "n int, t double, missing int").schema)
    assert kept.columns == ["n", "t"] and tuple(kept.first()) == (2, 7.0)
    days = spark.createDataFrame([(date(2024, 1, d), f) for d, f in ((1, True), (2, True), (2, True), (3, False), (4, True))], "day date, final boolean")
    assert merge.data_through(days, "day", "final").first().through == date(2024, 1, 2)
