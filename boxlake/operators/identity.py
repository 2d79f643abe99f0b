"""One identity from evidence that pairs of ids are the same, and references moved to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.operators.store import staged


def components(pairs: DataFrame) -> DataFrame:
    """(id, label) of every id in ``pairs`` (a, b): the smallest id that a chain of pairs reaches.

    Each round takes the least label among the neighbours and then jumps to that label's own label, so chains halve; rounds are
    written to the shared folder, and the last changes nothing. Hot ids combine before the shuffle, as all steps are minima.
    """
    edges = staged(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("to"))
        to = moved.select(F.col("id").alias("__id"), F.col("to").alias("__to"))
        jumped = staged(moved.join(to, F.col("to") == F.col("__id")).select("id", "label", F.least("to", "__to").alias("next")))
        if jumped.where("next != label").isEmpty():
            return labels
        labels = jumped.select("id", F.col("next").alias("label"))


def reconciled(evidence: DataFrame, official: DataFrame, tiers: int) -> tuple[DataFrame, DataFrame]:
    """Tables (id, identity) of the ids that evidence moves to another one, and (identity, tier, officials) of the conflicts left open.

    ``evidence``: a, b, tier (0 is the strongest); ``official``: id. The tiers are taken in turn: pairs of a tier join what the stronger ones made, unless
    that would put two official ids into one identity; such a group stays as it was before the tier and is a conflict. The identity of a group is its official id, else its
    smallest id. Ids without evidence are their own and are not listed.
    """
    known = official.select("id").distinct()
    everyone = evidence.select(F.col("a").alias("id")).unionByName(evidence.select(F.col("b").alias("id"))).where("id is not null").distinct()
    held = staged(everyone.withColumn("label", F.col("id")))
    conflicts = []
    for tier in range(tiers):
        of = lambda side: held.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))  # noqa: B023, E731
        pairs = evidence.where(F.col("tier") == tier).join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = components(pairs.where("a != b")).select(F.col("id").alias("label"), F.col("label").alias("joint"))
        grouped = held.join(joined, "label", "left").withColumn("joint", F.coalesce("joint", "label"))
        officials = grouped.join(known, "id", "left_semi").groupBy("joint").agg(F.count("*").alias("officials"))
        bad = staged(officials.where("officials > 1").join(joined.select("joint").distinct(), "joint", "left_semi"))
        conflicts.append(bad.select(F.col("joint").alias("identity"), F.lit(tier).alias("tier"), "officials"))
        held = staged(grouped.join(bad.select("joint", F.lit(True).alias("__bad")), "joint", "left").select("id", F.when(F.col("__bad"), F.col("label")).otherwise(F.col("joint")).alias("label")))
    named = held.join(held.join(known, "id", "left_semi").groupBy("label").agg(F.min("id").alias("__official")), "label", "left")
    mapping = staged(named.select("id", F.coalesce("__official", "label").alias("identity")).where("id != identity"))
    left = conflicts[0]
    for more in conflicts[1:]:
        left = left.unionByName(more)
    return mapping, left


def rekeyed(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each of the id columns moved to its identity; ids that the mapping lacks, and nulls, stay, and no row is lost. ``mapping`` has a row an id."""
    out = rows
    for c in columns:
        out = out.join(mapping.select(F.col("id").alias("__id"), F.col("identity").alias("__to")), F.col(c) == F.col("__id"), "left").withColumn(c, F.coalesce("__to", c)).drop("__id", "__to")
    return out.select(*rows.columns)
