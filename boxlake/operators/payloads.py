"""Typed items of JSON documents, with what is rejected, where and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMBERS = ("int", "long", "double")


@dataclass(frozen=True)
class Field:
    """A value of an item: its path below the item, the column it becomes, its kind and what is allowed."""

    path: str
    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    among: tuple[str, ...] = ()

    def value(self, item: Column) -> Column:
        return F.try_variant_get(item, f"$.{self.path}", self.kind)

    def fault(self, item: Column, value: Column) -> Column:
        """Why the value cannot be used, or null. A truth value is no number."""
        raw = F.try_variant_get(item, f"$.{self.path}", "string")
        typed = value.isNull() | (F.schema_of_variant(F.try_variant_get(item, f"$.{self.path}", "variant")) == "BOOLEAN") if self.kind in NUMBERS else value.isNull()
        found = F.when(raw.isNull(), F.lit("missing") if self.required else F.lit(None)).when(typed, f"not a {self.kind}")
        if self.least is not None:
            found = found.when(value < self.least, f"under {self.least:g}")
        if self.most is not None:
            found = found.when(value > self.most, f"over {self.most:g}")
        return found.when(~value.isin(*self.among), "not one of " + ", ".join(self.among)) if self.among else found


def checked_items(documents: DataFrame, json: str, listed: str, fields: list[Field], rules: list[tuple[str, str, str]] = (), keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """One row an item of the list ``listed``: ``keep``, item (from 0), path, reason, and the fields' columns; a row without an item for a document that is not read.

    The first fault in order of ``fields``, then of ``rules`` (path, reason, condition on the fields' columns that must not hold), gives path and
    reason; accepted items have none. ``whole``: one fault rejects all items of its document, the others with the reason "document". Null documents and those
    that are not JSON or lack the list are rejected as such; an empty list gives no rows. Accepted and rejected items come from one read.
    """
    parsed = documents.select(*keep, F.try_parse_json(json).alias("__doc")).withColumn("__items", F.try_variant_get("__doc", f"$.{listed}", "array<variant>"))
    unread = F.when(F.col("__doc").isNull(), F.struct(F.lit("$").alias("path"), F.lit("not JSON").alias("reason"))).when(F.col("__items").isNull(), F.struct(F.lit(f"$.{listed}").alias("path"), F.lit("not a list").alias("reason")))
    nothing = F.array(F.try_parse_json(F.lit(None).cast("string")))
    each = parsed.withColumn("__unread", unread).withColumn("__one", F.monotonically_increasing_id()).select("*", F.posexplode(F.when(unread.isNull(), F.col("__items")).otherwise(nothing)).alias("item", "__item"))
    item, at = F.col("__item"), F.format_string(f"$.{listed}[%d]", F.col("item"))
    each = each.withColumns({f.name: f.value(item) for f in fields})
    faults = [F.when(f.fault(item, F.col(f.name)).isNotNull(), F.struct(F.concat(at, F.lit(f".{f.path}")).alias("path"), f.fault(item, F.col(f.name)).alias("reason"))) for f in fields]
    faults += [F.when(F.expr(condition), F.struct(F.concat(at, F.lit(f".{path}")).alias("path"), F.lit(reason).alias("reason"))) for path, reason, condition in rules]
    each = each.withColumn("__fault", F.coalesce("__unread", *faults))
    if whole:
        spoiled = F.max(F.col("__fault").isNotNull()).over(Window.partitionBy("__one"))
        each = each.withColumn("__fault", F.when(spoiled, F.coalesce("__fault", F.struct(F.lit("$").alias("path"), F.lit("document").alias("reason")))))
    return each.select(*keep, F.when(F.col("__unread").isNull(), F.col("item")).alias("item"), "__fault.path", "__fault.reason", *(f.name for f in fields))
