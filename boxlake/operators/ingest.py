"""Payload shapes of sources as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_SET = "name string, headers array<string>, rowSet array<array<string>>"


def result_set(payloads: DataFrame, json: str, mapping: dict[str, tuple[str, str]], percent: set[str] = frozenset(), keep: list[str] | None = None) -> DataFrame:
    """Rows of a payload of ``headers`` and ``rowSet``: each header of ``mapping`` becomes the column and kind it names, whatever its place
    and case; those of ``percent`` go from 0-100 to fractions. Absent headers and values that are not of their kind are null."""
    p = payloads.select(*(keep or []), F.from_json(json, RESULT_SET).alias("__p"))
    p = p.withColumn("__at", F.transform("__p.headers", F.upper)).withColumn("__row", F.explode("__p.rowSet"))

    def value(header: str, name: str, kind: str):
        text = F.get("__row", F.nullif(F.array_position("__at", F.lit(header.upper())), F.lit(0)).cast("int") - 1)
        out = text.try_cast("double" if header in percent else kind)
        return (out / 100 if header in percent else out).cast(kind).alias(name)

    return p.select(*(keep or []), *(value(h, *to) for h, to in mapping.items()))


def two_sides(payloads: DataFrame, json: str, player: str, keep: list[str] | None = None) -> DataFrame:
    """Players of a nested box score: {"homeTeam": {"teamId", "players": [...]}, "awayTeam": ...} with ``player`` as the fields of one."""
    side = f"struct<teamId:bigint,players:array<struct<{player}>>>"
    p = payloads.select(*(keep or []), F.from_json(json, f"homeTeam {side}, awayTeam {side}").alias("__p"))
    both = F.explode(F.array(F.struct(F.lit(True).alias("is_home"), F.col("__p.homeTeam").alias("t")), F.struct(F.lit(False).alias("is_home"), F.col("__p.awayTeam").alias("t"))))
    return p.select(*(keep or []), both.alias("__s")).select(*(keep or []), "__s.is_home", F.col("__s.t.teamId").alias("team_id"), F.explode("__s.t.players").alias("__x")).select(*(keep or []), "is_home", "team_id", "__x.*")


def resolved_columns(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """rows with each target column taken from whichever spelling the file has, case aside; absent ones are null."""
    held = {c.lower(): c for c in rows.columns}
    found = {target: next((held[a.lower()] for a in names if a.lower() in held), None) for target, names in aliases.items()}
    return rows.select(*((F.col(f"`{c}`") if c else F.lit(None)).alias(t) for t, c in found.items()))
