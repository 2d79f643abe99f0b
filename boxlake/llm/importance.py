"""Target-distribution importance resampling with an integer word dictionary.

The distinct words of a group of documents get ids; an n-gram is the id of the n-gram before its last word, and that word's id.
Each distinct tuple's bytes are put together and hashed once, and its bucket is joined back to the places where it stands. Of every document
only its buckets leave the group. Their counts over all documents and over the target make the gains; the documents with the highest sums of mean gain and noise are drawn.

A group is what one Arrow batch holds: a dictionary of all documents would shuffle every occurrence of every word, where now
only one row a bucket leaves each task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_batches, ranked, text_or_empty, written
from boxlake.llm.licenses import license_words

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7


class _Ids(dict):
    """Ids of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def hashed_ngrams(texts: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the end of its features, and the bucket of every feature: its runs of one word, then of two, and so on."""
    ids = _Ids()
    rows = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in map(license_words, texts)]
    n_words = np.fromiter(map(len, rows), np.int64, len(rows))
    word = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), n_words)
    per_doc = [np.maximum(n_words - k, 0) for k in range(longest)]
    ends = np.cumsum(sum(per_doc))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint16)
    begin = ends - sum(per_doc)  # where the features of k words of each document go
    spelled = [b" " + w for w in ids]
    checks = np.fromiter((zlib.crc32(w) for w in ids), np.int64, len(ids))
    gram = word
    at = np.arange(len(word))
    for k in range(longest):
        if k:  # the gram that starts at a place and the word after it, where that is in the same document
            stands = doc[at] == doc[np.minimum(at + k, len(doc) - 1)]
            stands &= at + k < len(doc)
            at, gram = at[stands], gram[stands]
            tuples, gram = np.unique(gram << 32 | word[at + k], return_inverse=True)
            checks = np.fromiter((zlib.crc32(spelled[w], c) for w, c in zip((tuples & 0xFFFFFFFF).tolist(), checks[tuples >> 32].tolist())), np.int64, len(tuples))
        starts = np.repeat(begin, per_doc[k])
        within = np.arange(len(at)) - np.repeat(np.cumsum(per_doc[k]) - per_doc[k], per_doc[k])
        out[starts + within] = (checks % buckets)[gram]
        begin = begin + per_doc[k]
    return n_words, ends, out


def _fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def featured(docs: DataFrame, keys: list[str], text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """A table of the key columns, n_words and features of every row: the buckets of all its features, two bytes each. Null text has none."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket takes two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, ends, found = hashed_ngrams(batch.column("text").to_pylist(), longest, buckets)
            places = np.concatenate([[0], 2 * ends]).astype(np.int32)
            features = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(found.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(n_words, pa.int64()), features], names=[*keys, "n_words", "features"])

    source = docs.select(*keys, text_or_empty(text_col).alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"{_fields(source, keys)}n_words long, features binary"))


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over a whole table; every task hands on at most one row a bucket, and the driver gets no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("features").to_pylist()), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in table.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the documents, floored."""
    k, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw from the key's digest, floored; a null key has the empty text's."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighed(table: DataFrame, gains: np.ndarray, keys: list[str]) -> DataFrame:
    """The key columns, n_words, n_features and weight: the floored mean gain of a row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("features").to_pylist()
            n = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 2
            sums = np.concatenate([[0], np.cumsum(gains[np.frombuffer(b"".join(bodies), "<u2")])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), batch.column("n_words"), pa.array(n), pa.array(weight)], names=[*keys, "n_words", "n_features", "weight"])

    return table.mapInArrow(run, f"{_fields(table, keys)}n_words long, n_features long, weight long")


def resampling_plan(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_features, weight, score, rank) and ``keep`` of every row of docs.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller id (null first), ranked 1, 2, 3, ...; the rank of all others is null. Null and wordless texts have no features and
    weight 0. Repeated rows keep a row each and tie; an empty table gives no rows, an empty target counts as one without
    features; other columns are left out. Memory follows an Arrow batch or the longest text, not the table; ranks are dealt by ranges of the score.
    """
    keys = [id_col, *keep]
    table, wanted = featured(docs, keys, text_col), featured(target, [], target_text)
    gains = bucket_gains(bucket_counts(table), bucket_counts(wanted))
    scored = weighed(table, gains, keys).withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn("__fit", F.col("n_words") >= least_words)
    with arrow_batches(docs.sparkSession):
        scored = written(scored)
    drawn = percent * scored.where("__fit").count() // 100
    rows = ranked(scored, [F.col("__fit").desc(), F.col("score").desc(), F.col(id_col)], "__nth")
    return rows.select(id_col, "n_features", "weight", "score", F.when(F.col("__nth") < drawn, F.col("__nth") + 1).alias("rank"), *keep)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, whole, with their ``rank`` (it takes the place of a column of that name).

    Rows are numbered in a table of their own, so repeated rows and null ids stay apart. Options are those of ``resampling_plan``.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    plan = resampling_plan(numbered, target, **options, keep=("__row",)).where("rank IS NOT NULL")
    return numbered.drop("rank").join(plan.select("__row", "rank"), "__row").drop("__row")
