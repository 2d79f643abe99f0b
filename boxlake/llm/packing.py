"""Best-fit packing by bin completion.

Documents become token sequences, long ones are cut, and the cut lengths are counted: at most ``capacity`` counts, whatever
the corpus holds. Bin completion runs on those counts and yields patterns (the lengths in one sequence, and how many
sequences look so). Pieces of one length are alike, so their gapless numbers within the length look up their places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.bpe import PATTERN, joined_chunks, vocabulary
from boxlake.llm.common import arrow_batches, gapless_index, text_or_empty, written

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by lengths over half plus what cannot stand beside those."""
    best = -(-sum(k * c for k, c in counts.items()) // capacity)
    for low in sorted({k for k in counts if k <= capacity // 2} | {0}):
        alone = sum(c for k, c in counts.items() if k > capacity - low)
        half = [(k, c) for k, c in counts.items() if capacity // 2 < k <= capacity - low]
        small = sum(k * c for k, c in counts.items() if low <= k <= capacity // 2)
        pairs = sum(c for _, c in half)
        free = pairs * capacity - sum(k * c for k, c in half)
        best = max(best, alone + pairs + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in decreasing order on counts: each length goes into the fullest sequences that still take it."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        at = open_.setdefault(capacity - sum(pattern), {})
        at[pattern] = at.get(pattern, 0) + n

    for k in sorted(counts, reverse=True):
        left = counts[k]
        while left:
            free = min((r for r in open_ if r >= k), default=None)
            if free is None:
                per = min(left, capacity // k)
                n = left // per
                put((k,) * per, n)
                left -= n * per
                continue
            pattern, n = next(iter(open_[free].items()))
            used = min(n, left)
            if used == n:
                del open_[free][pattern]
                if not open_[free]:
                    del open_[free]
            else:
                open_[free][pattern] = n - used
            put((*pattern, k), used)
            left -= used
    return [(p, n) for at in open_.values() for p, n in at.items()]


def dominated(filling: tuple[int, ...], free: int, counts: list[int], spare: int) -> bool:
    """Whether a length that is left over could stand for some of the filling's: for a shorter sum of them if it fits, or for an equal
    sum of several (the replaced ones can go wherever the longer one would). ``spare`` holds the counted lengths as bits."""
    single, several = 0, 0  # bits: sums of one of the lengths, of two or more
    for k in filling:
        several |= several << k | single << k
        single |= 1 << k
        if filling.count(k) == counts[k]:
            spare &= ~(1 << k)
    sums = single | several
    return bool(several & spare) or any(sums << d & spare for d in range(1, free + 1))


def fillings(room: int, counts: list[int], keep: int, steps: int) -> list[tuple[int, ...]]:
    """The ``keep`` best undominated fillings of ``room`` from the counted lengths: the least waste first, the longest lengths first among equals.

    Sums that the lengths from each one down can reach are kept as bits, so the search goes only where a filling of the
    wanted sum lies; ``steps`` bounds it, and the first filling of the least waste is always found.
    """
    lengths = [k for k in range(min(room, len(counts) - 1), 0, -1) if counts[k]]
    reach = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        k = lengths[i]
        bits, left, batch = reach[i + 1], min(counts[k], room // k), 1
        while left:
            n = min(batch, left)
            bits |= bits << n * k
            left, batch = left - n, 2 * batch
        reach[i] = bits & (1 << room + 1) - 1
    spare = sum(1 << k for k, n in enumerate(counts) if n)
    found: list[tuple[int, ...]] = []
    budget = steps

    def grow(chosen: tuple[int, ...], free: int, first: int, waste: int) -> Iterator[tuple[int, ...]]:
        nonlocal budget
        if not free:
            yield chosen
            return
        for i in range(first, len(lengths)):
            k = lengths[i]
            budget -= 1
            if budget < 0 and found:
                return
            if k <= free and reach[i] >> free - k & 1 and chosen.count(k) < counts[k]:
                yield from grow((*chosen, k), free - k, i, waste)
            if not reach[i + 1] >> free & 1:
                return

    first: tuple[int, ...] | None = None
    for waste in range(room + 1):
        if reach[0] >> room - waste & 1:
            for way in grow((), room - waste, 0, waste):
                first = way if first is None else first
                if not dominated(way, waste, counts, spare):
                    found.append(way)
                    if len(found) == keep:
                        return found
            if budget < 0 and first is not None:
                break
    return found or [first or ()]


def bin_completion(counts: dict[int, int], capacity: int, node_limit: int = 3_000, keep: int = 4, steps: int = 300) -> list[Pattern]:
    """Patterns (lengths, copies) that use all counts in as few sequences as the search finds.

    The largest remaining length is completed in the ``keep`` best undominated ways, as often as the counts allow and, as a
    second branch, once. A branch ends when its waste leaves no room for fewer sequences than the incumbent, which begins as
    best fit. The search stops at the lower bound (then the packing is proved minimal) or after ``node_limit`` nodes: bounds on search
    only, each result is a whole packing.
    """
    total, bound = sum(k * c for k, c in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    left = [0] * (capacity + 1)
    for k, c in counts.items():
        left[k] = c
    path: list[Pattern] = []
    nodes = bins = waste = 0

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        top = next((k for k in range(capacity, 0, -1) if left[k]), 0)
        if not top:
            return
        left[top] -= 1
        ways = fillings(capacity - top, left, keep, steps)
        left[top] += 1
        for once in (False, True):
            for way in ways:
                pattern = (top, *way)
                n = min(left[k] // pattern.count(k) for k in set(pattern))
                if not once or n > 1:
                    yield pattern, 1 if once else n

    stack = [options()] if total else []
    while stack and most > bound and nodes < node_limit:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                pattern, n = path.pop()
                bins, waste = bins - n, waste - n * (capacity - sum(pattern))
                for k in pattern:
                    left[k] += n
            continue
        pattern, n = step
        if waste + n * (capacity - sum(pattern)) > (most - 1) * capacity - total:
            continue
        nodes += 1
        for k in pattern:
            left[k] -= n
        path.append(step)
        bins, waste = bins + n, waste + n * (capacity - sum(pattern))
        if not any(left):
            best, most = list(path), bins
        stack.append(options())
    return best


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """Text to uint32 ids as the tokenizers library gives them for the vocabulary file.

    The file's ids are its ranks, and every token is rebuilt by its own merges, so the rank-based encoder of tiktoken gives
    the same ids; it takes the chunks that are met for the first time, and the library itself texts with special tokens.
    """
    import re
    import struct

    import tiktoken
    from tokenizers import Tokenizer

    vocab = vocabulary(path)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: i for b, i in vocab.id_of.items()}, special_tokens={}).encode_ordinary
    ranks = [vocab.rank[t] for t in sorted(vocab.merge_results())]
    same = len(vocab.single) == len(vocab.id_of) and ranks == sorted(ranks)

    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_library(text: str) -> bytes:
        return pack(library.encode(text, add_special_tokens=False).ids)

    special = re.compile("|".join(map(re.escape, vocab.special))).search if vocab.special else lambda text: None
    vocabulary.cache_clear()  # its tables are no longer needed; a worker goes on to other stages
    encode = (lambda text: pack(ordinary(text))) if same else by_library
    memo: dict[str, bytes] = {}  # at most MEMO chunks
    space_run = re.compile(r"\s ").search
    return lambda text: by_library(text) if special(text) else joined_chunks(text, memo, encode, space_run)


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """A table of doc_id, piece, start, length, ids_crc32 of every piece; only documents of over ``capacity`` ids are cut, the rest of the division first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(at, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, k].copy()) for k in (2, 3, 4))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select("doc_id", text_or_empty().alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, block_rows: int = 1_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place.

    Null text counts as empty (one end id); repeated rows are packed as often as they occur, and null ids keep their rows; texts of any
    length are cut; an empty table gives no rows; other columns are left out, those named like the output's too. Slots of a length are numbered in blocks
    of about ``block_rows`` pieces. Only counts by length (``capacity`` at most) and patterns (bounded by them) reach the driver.
    """
    pieces = cut_documents(docs, path, capacity, end_id)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = dict.fromkeys(counts, 0)
    table, sequence = [], 0
    for pattern, copies in bin_completion(counts, capacity):
        offset = 0
        for k in sorted(set(pattern), reverse=True):
            per = pattern.count(k)
            table.append(((k << 44) + at[k], per, sequence, offset))
            at[k] += per * copies
            offset += per * k
        sequence += copies
    table = np.array(sorted(table), np.int64).reshape(-1, 4)

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << 44) + batch.column("nth").to_numpy()
            row = table[np.searchsorted(table[:, 0], key, "right") - 1]
            copy, slot = np.divmod(key - row[:, 0], np.maximum(row[:, 1], 1))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(row[:, 2] + copy), pa.array(row[:, 3] + slot * length)], names=[*names, "sequence_id", "offset"])

    blocks = max(64, -(-max(counts.values(), default=0) // block_rows))
    numbered = gapless_index(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], blocks, "nth")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.select(*names, "nth").mapInArrow(place, f"{fields}, sequence_id long, offset long")
