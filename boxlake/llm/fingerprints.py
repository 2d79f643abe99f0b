"""Document fingerprints: threshold-scaled sketches.

The shingles of a text are its runs of ``WIDTH`` code points, with both ends padded, so that a text of one word has several. A
fingerprint keeps every shingle hash below a fixed fraction, 1 / ``SCALE``, of the range; where fewer than ``FLOOR`` are, it keeps the
``FLOOR`` smallest, which only moves its own fraction up. Sketches of parts merge by union, and the share of one sketch inside
another, below the smaller of both fractions, estimates containment, however unequal the documents are.

The estimate rests on n hashes of the shorter text: at least ``FLOOR``, or all its shingles, if the texts are alike in length, else
its shingles times the longer one's fraction. Its standard error is at most 1 / (2 * sqrt(n)): 0.09 for texts of up to some
4,000 characters, falling with the root of the length from there; a short text in a far longer one may have no hash to go by and counts as not held.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_batches, text_or_empty, written

WIDTH, SCALE, FLOOR = 8, 128, 32
GROUP_CHARS = 8_000_000
LOWEST = -(1 << 63)
# Hashes have 48 bits.
TOP = 1 << 48
# The odd multipliers that mix a shingle's code points.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def shingle_values(text: str, width: int = WIDTH) -> np.ndarray:
    """48-bit hashes of all runs of ``width`` code points of the padded text, repeats included; none of the empty text."""
    if not text:
        return np.empty(0, np.uint64)
    pad = "\0" * (width - 1)
    points = np.frombuffer(f"{pad}{text}{pad}".encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    count = len(points) - width + 1
    value = np.zeros(count, np.uint64)
    for i in range(width):
        value = value * np.uint64(MIX[0]) + points[i : i + count]
    value = (value ^ value >> np.uint64(29)) * np.uint64(MIX[1])
    return (value ^ value >> np.uint64(32)) >> np.uint64(16)


def sketch(text: str, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The kept hashes of a text, ascending."""
    return _kept(shingle_values(text), scale, floor)


def _kept(values: np.ndarray, scale: int, floor: int) -> np.ndarray:
    low = np.unique(values[values < np.uint64(TOP // scale)])
    return low if len(low) >= floor else np.unique(values)[:floor]


def written_sketch(kept: np.ndarray) -> str:
    """The kept hashes, ascending, six bytes each, in base64."""
    return base64.b64encode(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read_sketch(text: str) -> np.ndarray:
    parts = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(parts), 2), np.uint8), parts], axis=1).view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> np.ndarray:
    """The sketch of two parts together (shingles across the seam are not in it)."""
    return _kept(np.concatenate([a, b]), scale, floor)


def limit(kept: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> int:
    """Below it every hash of the text is in its sketch."""
    if len(kept) < floor:
        return TOP
    return max(TOP // scale, int(kept[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> float:
    """Share of the smaller sketch that the larger holds, below both limits; two empty sketches are alike (1), an empty and another are not (0)."""
    top = np.uint64(min(limit(a, scale, floor), limit(b, scale, floor)))
    a, b = a[: np.searchsorted(a, top)], b[: np.searchsorted(b, top)]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint_documents(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """A table of doc_id, fingerprint of every text (null: empty). Repeated rows and null ids each keep a row; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written_sketch(sketch(t, scale)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    source = docs.select("doc_id", text_or_empty().alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string"))


def with_followers(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id so that each range ends in a copy of the next range's first row (``tail``), sorted within.

    Ranges come from quantiles of doc_id (as many as there are shuffle partitions); the last range ends in the first row
    of all. Null ids stand first; rows of one id are ordered by text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), text_or_empty().alias("text"))
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    limits = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    part = F.size(F.filter(limits, lambda x: x <= F.col("key")))
    firsts = sorted((r["part"], r["first"]) for r in rows.groupBy(part.alias("part")).agg(F.min("key").alias("first")).collect())
    if not firsts:
        return rows.select("doc_id", "key", "text", F.lit(0).alias("part"), F.lit(0).alias("tail"))
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first range's first row ends the last range
    keys, targets = F.array(*[F.lit(k).cast("long") for k in before]), F.array(*[F.lit(p) for p in before.values()])
    own = F.struct(part.alias("part"), F.lit(0).alias("tail"))
    also = F.struct(F.element_at(targets, F.array_position(keys, F.col("key")).cast("int")).alias("part"), F.lit(1).alias("tail"))
    dealt = rows.withColumn("at", F.explode(F.when(F.array_contains(keys, F.col("key")), F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "key", "text", "at.part", "at.tail")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "tail", "key", "text")


def compare_edited(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """A table of doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by the first as many code points of the
    next document's text, ascending by doc_id, the first following the last. Null text counts as empty, and empty texts are alike.
    Repeated rows and null ids keep a row each; an empty table gives none; a single row is its own next. Ties and nulls: see with_followers.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def frame(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out, chars = [], 0
            for doc, text, part, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail"))):
                now = (part, tail, doc, text, sketch(text, scale))
                if held and held[0] == part and not held[1]:
                    _, _, of, body, kept = held
                    cut = len(body) // 4
                    edited = body[: len(body) - cut] + text[:cut]
                    other = sketch(edited, scale)
                    out.append((of, len(body), hashlib.sha256(edited.encode()).hexdigest(), written_sketch(kept), written_sketch(other), containment(kept, other, scale), containment(kept, now[4], scale)))
                    chars += 8 * (len(kept) + len(other))
                    if chars >= GROUP_CHARS:
                        yield frame(out)
                        out, chars = [], 0
                held = now
            if out:
                yield frame(out)

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = with_followers(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "part", "tail")
    with arrow_batches(docs.sparkSession):
        return written(rows.mapInArrow(run, fields))
