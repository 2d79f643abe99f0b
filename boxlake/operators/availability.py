"""Availability entries: which is in force on a day, which is stale, and what a player's is over several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.parsing import expected_return, return_horizon

# Days that an entry without a horizon drives the model, days until a long absence is stale, and what marks one.
MAX_AGE_DAYS, LONG_STALE_DAYS = 14, 7
LONG_TERM = r"(?i)long[- ]term|indefinite|season|surgery"


def long_term(text: Column) -> Column:
    return F.coalesce(text.rlike(LONG_TERM), F.lit(False))


def out_of_force(published: Column, text: Column, last_played: Column, as_of: Column) -> Column:
    """Why an entry no longer counts: its return day has passed, the player has played since, or it is too old; null while it is in force."""
    day, source = F.to_date(as_of), F.to_date(published)
    horizon = return_horizon(text, source)
    old = (as_of > published + F.expr(f"interval {MAX_AGE_DAYS} days")) & ~long_term(text) & (horizon.isNull() | (day > horizon))
    return F.when(day > expected_return(text, source)["day"], "returnDatePassed").when(last_played > published, "playedSince").when(F.coalesce(old, F.lit(False)), "tooOld")


def stale(published: Column, text: Column, reason: Column, as_of: Column, limit_minutes: int = 24 * 60) -> Column:
    """Out of force, a long absence of over a week, or older than the league's limit."""
    minutes = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 60_000_000
    return reason.isNotNull() | (minutes > F.when(long_term(text), LONG_STALE_DAYS * 24 * 60).otherwise(limit_minutes))


def resolved(entries: DataFrame, player: str, source: str, published: str, key: str, ranks: dict[str, int]) -> DataFrame:
    """One entry a player: of each source its newest, of those the one of the best rank, then the newest.

    Both steps are aggregates, so they combine before the shuffle.
    """
    rank = F.try_element_at(F.create_map(*(F.lit(v) for kv in ranks.items() for v in kv)), F.col(source))
    rest = [c for c in entries.columns if c not in (player, source, published, key)]
    newest = entries.groupBy(player, source).agg(F.max(F.struct(published, key, *rest)).alias("__e")).withColumn("__rank", -F.coalesce(rank, F.lit(99)))
    best = newest.groupBy(player).agg(F.max(F.struct("__rank", F.col(f"__e.{published}").alias("__at"), "__e", source)).alias("__b"))
    return best.select(player, f"__b.{source}", "__b.__e.*")
