"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source the documents stand in order of size. Their expected copies are summed up along that order, one random offset
is added, and a document is emitted once for every integer that its stretch of the sum crosses. Because sizes ascend, the words
taken miss the target by less than the source's largest document, whatever the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.llm.common import ranked, written

# Expected copies are whole numbers of this part of a copy, so sums are exact and agree on reruns.
UNIT = 1 << 30
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Of one row a source (source, source_size): with target, the words that the mix shall take, and expected, in units of a copy.

    Sources by code point, null last, have the weights in turn and divide ``share`` of all sizes by them. A target stops at ``most``
    times its source's size, and the others share the excess by weight until none is above: all lie on one level a weight, the
    largest that stopping the sources in order of their own levels leaves. The window holds one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    weighed = sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(most)
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - stopped) / open_weight)
    target = F.least("cap", F.max("level").over(everything) * F.col("weight"))
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    return leveled.select("source", "source_size", target.alias("target")).withColumn("expected", expected)


def offset(seed: int, draw: Column, source: Column) -> Column:
    """A random offset under one copy, in units, the same on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), draw, F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") * 4


def crossings(nth: Column, expected: Column, start: Column) -> Column:
    """How many integers lie in the ``nth`` stretch of a sum of equal terms that begins at ``start`` (both in units)."""
    before = F.pmod(F.pmod(expected, F.lit(UNIT)) * F.pmod(nth, F.lit(UNIT)) + start, F.lit(UNIT))
    return F.shiftright(before + expected, 30)


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, draws: int = 16, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """The key column, size, source_size, target, copies and ``keep`` of every row.

    Of ``draws`` random offsets a source takes the one whose words come nearest its target (the first of equals). Size is the
    number of words; null text has none. Null is a source of its own. Documents of one size stand in order of their key's digest;
    rows that agree in source, size and key are numbered in any order, so the rows as a whole are the same on every run. A
    source without words has target 0 and takes nothing; an empty table gives no rows; other columns are left out. The plan
    sums the sizes that it has ranked, so one source may hold any share of the rows: ranges of (source, size, digest) are dealt.
    """
    sized = written(docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.col(key).cast("string").cast("binary")).alias("__digest"), *keep))
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rows = ranked(sized, [F.col("source"), F.col("size"), F.col("__digest"), F.col("__key")], "__nth", ("source",)).drop("__digest")
    matched = rows.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    takes = [F.sum(F.col("size") * crossings(F.col("__nth"), F.col("expected"), offset(seed, F.lit(d), F.col("source")))) for d in range(draws)]
    missed = matched.groupBy("source", "target").agg(*[t.alias(f"__{d}") for d, t in enumerate(takes)])
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col(f"__{d}") - F.col("target")).alias("by"), F.lit(d).alias("draw")) for d in range(draws)]))
    chosen = written(missed.select(F.col("source").alias("__source"), offset(seed, miss["draw"], F.col("source")).alias("__start")))
    drawn = matched.join(chosen, F.col("source").eqNullSafe(F.col("__source")))
    return drawn.select(F.col("__key").alias(key), "size", "source_size", "target", crossings(F.col("__nth"), F.col("expected"), F.col("__start")).alias("copies"), *keep)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as the plan says, whole, with ``copy`` (0, 1, ...) beside its own columns (it takes the place of one of that name).

    Rows are numbered in a table of their own, so repeated rows and null keys stay apart. Options are those of ``mixing_plan``.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    plan = mixing_plan(numbered, **options, keep=("__row",)).where("copies > 0").select("__row", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    return numbered.drop("copy").join(plan, "__row").drop("__row")


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of it, repeats counted) of every row; see ``mixing_plan``."""
    return mixing_plan(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
