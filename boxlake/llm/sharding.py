"""Sharding by jump consistent hashing, in DataFrame functions only.

A key walks a chain of pseudo-random jumps through shard numbers; the last jump below the shard count is its shard. No
ring table is kept, and one more shard takes rows only into itself. The 64-bit generator runs on three limbs (22, 22 and
20 bits), because products of whole 64-bit numbers overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.llm.common import gapless_index, text_or_empty, written

# Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
LOW, HIGH = (1 << 22) - 1, (1 << 20) - 1


def jump_chain(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among ``shards`` and among one more. At most ``shards`` + 1 jumps are taken, which is all there can be."""
    a0, a1, a2 = (F.lit(x).cast("long") for x in (MULTIPLIER & LOW, MULTIPLIER >> 22 & LOW, MULTIPLIER >> 44))
    low, high = F.lit(LOW).cast("long"), F.lit(HIGH).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(
        key.bitwiseAND(low).alias("k0"), F.shiftrightunsigned(key, 22).bitwiseAND(low).alias("k1"), F.shiftrightunsigned(key, 44).alias("k2"),
        zero.alias("at"), zero.alias("shard"), zero.alias("grown"),
    )

    def jump(s: Column, _: Column) -> Column:
        p0 = s["k0"] * a0 + 1
        p1 = s["k0"] * a1 + s["k1"] * a0 + F.shiftright(p0, 22)
        p2 = s["k0"] * a2 + s["k1"] * a1 + s["k2"] * a0 + F.shiftright(p1, 22)
        k1, k2 = p1.bitwiseAND(low), p2.bitwiseAND(high)
        top = F.shiftleft(k2, 11) + F.shiftright(k1, 11)  # the upper 31 bits
        to = ((s["at"] + 1) * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long")
        moved = F.struct(
            p0.bitwiseAND(low).alias("k0"), k1.alias("k1"), k2.alias("k2"), to.alias("at"),
            F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]).alias("shard"), s["at"].alias("grown"),
        )
        return F.when(s["at"] > shards, s).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), start, jump)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", blocks: int = 256) -> DataFrame:
    """The key column, size, text_crc32, law, shard, slot and grown_shard of every row.

    Size is the text's UTF-8 bytes plus 8. Null text counts as no bytes; a null key counts as 0; keys that are not integers go
    by their 64-bit hash. Rows of one key share a shard; slots number a shard's rows without gaps, rows that agree in key, size
    and checksum in any order. Other columns are left out; an empty table gives no rows.
    """
    of = F.col(key)
    number = F.coalesce(of.cast("long") if isinstance(docs.schema[key].dataType, T.IntegralType) else F.xxhash64(of), F.lit(0).cast("long"))
    text = text_or_empty()
    sized = docs.select(of.alias(key), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), jump_chain(number, shards).alias("jump"))
    rows = written(sized.select(key, "size", "text_crc32", F.lit("key").alias("law"), "jump.shard", F.col("jump.grown").alias("grown_shard")))
    return gapless_index(rows, ["shard"], [key, "size", "text_crc32"], blocks, "slot")
