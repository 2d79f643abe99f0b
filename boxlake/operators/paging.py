"""Pages by key: a cursor names the last row that was shown, and the next page starts below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def encoded_cursor(key: Column) -> Column:
    """A struct as text that fits in an address."""
    return F.rtrim(F.translate(F.base64(F.to_json(key).cast("binary")), "+/", "-_"), F.lit("="))


def decoded_cursor(cursor: Column, schema: str) -> Column:
    """The struct again; null for a text that is none."""
    plain = F.translate(cursor, "-_", "+/")
    filled = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.try_to_binary(filled, F.lit("base64")).cast("string"), schema)


def page_after(rows: DataFrame, keys: list[str], cursor: str, schema: str, columns: dict[str, str], size: int) -> DataFrame:
    """Of each key the ``size`` newest rows below its cursor, with their ``place``; a cursor that cannot be read gives the first page.

    ``columns`` maps the cursor's fields, in order, to the columns they were taken from.
    """
    at = decoded_cursor(F.col(cursor), schema)
    below = F.struct(*(F.col(c).alias(f) for f, c in columns.items())) < F.struct(*(F.col("__at")[f].alias(f) for f in columns))
    read = F.col("__at")[next(iter(columns))].isNotNull()
    kept = rows.withColumn("__at", at).where(~F.coalesce(read, F.lit(False)) | below).drop("__at")
    order = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in columns.values()))
    return kept.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= size)
