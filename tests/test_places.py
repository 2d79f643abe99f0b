"""Ranks and quantiles by block counts against plain sorting: ties, a value that holds a third of the rows, nulls, small and empty scopes."""

import random
from statistics import quantiles

import pytest

from boxlake.operators import windows


@pytest.mark.parametrize("best_high", [True, False])
def test_places(spark, best_high):
    rng = random.Random(4)
    rows = [("a", float(rng.randrange(400))) for _ in range(900)] + [("a", 7.0)] * 400 + [("b", 1.0), ("b", 1.0), ("c", -2.5), ("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "s string, v double").repartition(5)
    got = {(r.s, r.v): (r.dense, r.worse, r.equal, r.n) for r in windows.value_places(df, "v", ["s"], best_high, blocks=8).collect()}
    want = {}
    for s in "abc":
        values = [v for t, v in rows if t == s and v is not None]
        order = sorted(set(values), reverse=best_high)
        for v in order:
            want[s, v] = (order.index(v) + 1, sum(x < v if best_high else x > v for x in values), values.count(v), len(values))
    assert got == want
    assert windows.value_places(df.limit(0), "v", ["s"]).count() == 0


def test_quantiles(spark):
    rng = random.Random(5)
    rows = [("a", rng.random()) for _ in range(731)] + [("b", 3.0), ("b", 4.0), ("c", 9.0)] + [("e", float(i // 50)) for i in range(200)]
    places = windows.value_places(spark.createDataFrame(rows, "s string, v double"), "v", ["s"], blocks=8)
    got = {r.s: (r.p10, r.p50, r.p90) for r in windows.quantiles(places, "v", ["s"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    for s in "abe":
        cut = quantiles([v for t, v in rows if t == s], n=10, method="inclusive")
        assert got[s] == pytest.approx((cut[0], cut[4], cut[8]))
    assert got["c"] == (9.0, 9.0, 9.0)


def test_blocks_are_made_once(spark):
    """Approximate cuts differ with the order in which parts arrive, so no two reads may make them anew."""
    df = spark.createDataFrame([("a", float(i % 37)) for i in range(500)], "s string, v double")
    plan = windows.value_places(df, "v", ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan
