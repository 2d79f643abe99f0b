"""Fantasy decisions over valued players: trades, draft boards, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Where fair ends and clear begins, on z and on points; weight of need, and the roster from which need means anything.
BANDS = {"categories": (0.75, 2.0), "points": (3.0, 8.0)}
NEED_WEIGHT, NEED_ROSTER = 0.25, 3


def verdict(net: Column, scale: str = "categories") -> Column:
    fair, clear = BANDS[scale]
    side = F.when(net > 0, "win").otherwise("loss")
    return F.when(F.abs(net) < fair, "fair").when(F.abs(net) >= clear, F.concat(F.lit("clear "), side)).otherwise(F.concat(F.lit("slight "), side))


def replacement_value(valued: DataFrame, key: str, pool: int, depth: int) -> DataFrame:
    """One row, ``replacement``: mean total z of the ``depth`` players ranked after the pool, 0 if there are none."""
    top = valued.orderBy(F.desc("total_z"), key).limit(pool + depth)
    ranked = top.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("total_z"), key)))  # pool + depth rows
    return ranked.where(F.col("__r") > pool).agg(F.coalesce(F.avg("total_z"), F.lit(0.0)).alias("replacement"))


def evaluate_trades(trades: DataFrame, valued: DataFrame, replacement: DataFrame, key: str) -> DataFrame:
    """trade_id, change_z, roster_adjustment, net_z, verdict for rows of trade_id, side (give or get) and player; players without a value count nothing."""
    legs = trades.join(valued.select(key, "total_z"), key)
    give, get = F.col("side") == "give", F.col("side") == "get"
    sums = legs.groupBy("trade_id").agg(F.sum(F.when(get, F.col("total_z")).otherwise(-F.col("total_z"))).alias("change_z"), (F.count_if(give) - F.count_if(get)).alias("spots"))
    out = sums.crossJoin(F.broadcast(replacement))  # one row
    out = out.withColumn("roster_adjustment", F.col("spots") * F.col("replacement")).withColumn("net_z", F.col("change_z") + F.col("roster_adjustment"))
    return out.select("trade_id", "change_z", "roster_adjustment", "net_z", verdict(F.col("net_z")).alias("verdict"))


def draft_board(valued: DataFrame, cats: list[str], drafted: DataFrame, mine: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` best undrafted players by total z plus a quarter of their mean z in my three weakest categories (once I have three players).

    ``drafted`` and ``mine`` are tables of keys.
    """
    roster = valued.join(mine.select(key).distinct(), key, "left_semi")
    strength = roster.agg(F.count("*").alias("__have"), *(F.sum(f"z_{c}").alias(f"__s_{c}") for c in cats))
    pairs = F.array_sort(F.array(*(F.struct(F.col(f"__s_{c}").alias("s"), F.lit(c).alias("c")) for c in cats)))
    weakest = strength.select("__have", F.transform(F.slice(pairs, 1, 3), lambda x: x["c"]).alias("__weak"))
    open_ = valued.join(drafted.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(weakest))  # one row
    need = sum((F.when(F.array_contains("__weak", c), F.col(f"z_{c}")).otherwise(0.0) for c in cats), F.lit(0.0)) / 3
    score = F.col("total_z") + F.when(F.col("__have") >= NEED_ROSTER, NEED_WEIGHT * need).otherwise(0.0)
    return open_.withColumn("suggestion", F.round(score, 6)).orderBy(F.desc("suggestion"), key).limit(limit).select(key, "total_z", "suggestion")


# What may go otherwise in a trade. Name, the side it strikes, minutes kept, games of FULL_SEASON played (none: all).
SCENARIOS = (("base", "all", 1.0, None), ("get_injured", "get", 1.0, 60.0), ("get_role_loss", "get", 0.85, None), ("give_injured", "give", 1.0, 60.0), ("give_breakout", "give", 1.15, None))
FULL_SEASON = 82.0
MOST_PLAYERS = 2_000_000  # of a league, whose lines every task holds: 48 bytes each


def trade_sensitivity(trades: DataFrame, lines: DataFrame, cats: list[str], key: str, pool: int, cut: int, depth: int) -> DataFrame:
    """trade_id, base, low, high, low_scenario, high_scenario, flips: the net of each trade when one assumption fails at a time.

    ``trades`` has trade_id, give and get (arrays of keys); ``lines`` a row a player, of which ``pool`` (the best by the first category) set the
    moments and the ``depth`` ranked after the first ``cut`` the replacement. Fewer minutes change the lines, so the whole league is valued anew around
    them; missed games weigh what is received. Keys without a line, and null ones, count nothing; of equal nets the first scenario is named.
    Trades of the same keys are valued once.
    The league's lines go to every task, so more than MOST_PLAYERS are an error.
    """
    held = lines.select(F.col(key).cast("long").alias(key), *(F.col(c).cast("double").alias(c) for c in cats)).where(F.col(key).isNotNull()).orderBy(key).limit(MOST_PLAYERS + 1).toArrow()
    if len(held) > MOST_PLAYERS:
        raise ValueError(f"a league of over {MOST_PLAYERS} players")
    keys = held[key].to_numpy()
    table = np.column_stack([held[c].to_numpy() for c in cats]).astype(np.float64)

    def places(ids: np.ndarray) -> list[int]:
        ids = np.asarray(ids, np.int64)
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        return [int(i) for i in at[keys[at] == ids]]

    def first(order: np.ndarray, n: int) -> np.ndarray:
        """The places of the n smallest, by key where equal; only those up to the n-th value are sorted."""
        near = np.flatnonzero(~(order > np.partition(order, n - 1)[n - 1])) if 0 < n < len(order) else np.arange(len(order))
        return near[np.lexsort((keys[near], order[near]))][:n]

    def totals(own: np.ndarray) -> np.ndarray:
        seeds = first(-np.round(own[:, 0], 6), pool)
        mean, sd = own[seeds].mean(axis=0), own[seeds].std(axis=0)
        sd[np.ptp(own[seeds], axis=0) == 0] = 0.0  # equal values have no spread, though their sum may be rounded
        z = np.divide(own - mean, sd, out=np.zeros_like(own), where=sd > 0)
        return np.round(z.sum(axis=1), 6)

    def replacement(total: np.ndarray) -> float:
        rest = first(-total, cut + depth)[cut:]
        return float(total[rest].mean()) if len(rest) else 0.0

    def nets(give: list[int], get: list[int], usual: np.ndarray | None) -> list[float]:
        found = []
        for _, side, minutes, games in SCENARIOS:
            struck = {"give": give, "get": get, "all": give + get}[side]
            total = usual
            if minutes != 1.0 and struck:
                own = table.copy()
                own[struck] *= minutes
                total = totals(own)
            kept = 1.0 if games is None else games / FULL_SEASON
            worth = lambda ids, name: sum(total[i] * (kept if side in (name, "all") else 1.0) for i in ids)  # noqa: B023, E731
            found.append(worth(get, "get") - worth(give, "give") + (len(give) - len(get)) * replacement(total))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual = totals(table) if len(table) else None
        for batch in batches:
            out = []
            for give, get in zip(batch["give"], batch["get"]):
                net = nets(places(give), places(get), usual) if usual is not None else [0.0] * len(SCENARIOS)
                near = [round(x, 9) for x in net]
                low, high = near.index(min(near)), near.index(max(near))
                out.append((give, get, net[0], net[low], net[high], SCENARIOS[low][0], SCENARIOS[high][0], near[low] < 0 < near[high]))
            yield pd.DataFrame(out, columns=["give", "get", "base", "low", "high", "low_scenario", "high_scenario", "flips"])

    sides = "give array<long>, get array<long>"
    asked = trades.select(F.col("trade_id").cast("long").alias("trade_id"), *(F.array_compact(F.coalesce(F.col(c).cast("array<long>"), F.array().cast("array<long>"))).alias(c) for c in ("give", "get")))
    tasks = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few distinct trades are not put into one task
    found = asked.select("give", "get").distinct().repartition(tasks, "give", "get").mapInPandas(run, f"{sides}, base double, low double, high double, low_scenario string, high_scenario string, flips boolean")
    return asked.join(found, ["give", "get"]).drop("give", "get")
