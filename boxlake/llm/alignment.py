"""Cross-tokenizer alignment by bitsets of token ends.

Two tokenizers cut the same bytes. Each one's token ends are bits in packed words; AND leaves the cuts that both make. The number
of set bits up to a cut (popcounts, summed up by words) is the number of tokens that end there, which maps cuts to token
ranges: the groups. The tokens of both sides that end on a cut are linked, and links are counted by their pair of ids.

A block of documents holds its links as numbers into its own distinct pairs. Counts over all documents are asked for by block and
distinct pair, so no table of all pairs is sent to every task, and texts are tokenized once.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.llm.bpe import MEMO, PATTERN, joined_chunks, vocabulary
from boxlake.llm.common import arrow_batches, text_or_empty, written


class Side:
    """A tokenizer: ids of a text (uint32, packed), and each id's bytes."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode, self.size = encode, len(token_bytes)
        self.blob = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.length = np.fromiter(map(len, token_bytes), np.int64, self.size)
        self.at = np.cumsum(self.length) - self.length

    def spelled(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        shift = self.at[ids] - (np.cumsum(size) - size)
        place = np.repeat(shift, size)
        return self.blob[place + np.arange(len(place))].tobytes()


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """Byte-level BPE of a blank and the text; strings of special tokens are plain text.

    The rank-based encoder of tiktoken takes the chunks where the file's ids are its ranks and every token is rebuilt by its merges, else the tokenizers library does.
    """
    import tiktoken
    from tokenizers import Tokenizer

    vocab = vocabulary(path)
    ranks = [vocab.rank[t] for t in sorted(vocab.merge_results())]
    if len(vocab.single) == len(vocab.id_of) and ranks == sorted(ranks):
        ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: i for b, i in vocab.id_of.items()}, special_tokens={}).encode_ordinary
    else:
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        library.no_truncation()
        library.no_padding()
        ordinary = lambda text: library.encode(text, add_special_tokens=False).ids
    memo: dict[str, bytes] = {}
    space_run = re.compile(r"\s ").search
    encode = lambda text: _pack(ordinary(text))
    return Side(lambda text: joined_chunks(" " + text, memo, encode, space_run), [vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of) + 1)])


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """Pieces of a text, before which the model puts a blank.

    No piece holds a blank after another character (checked), so chunks that single blanks part are encoded one by one; texts with runs of blanks,
    or with blanks at an end, are encoded whole.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    apart = not any("▁" in p.lstrip("▁") for p in pieces)
    memo: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        if not apart or "▁" in text or "  " in f" {text} ":
            return _pack(model.encode(text))
        out = []
        for chunk in text.split(" "):
            found = memo.get(chunk)
            if found is None:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[chunk] = _pack(model.encode(chunk))
            out.append(found)
        return b"".join(out)

    return Side(encode, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


class Bits:
    """A bitset in packed words with the number of set bits before each word."""

    def __init__(self, places: np.ndarray, size: int):
        marks = np.zeros(-(-(size + 1) // 64) * 64, bool)
        marks[places] = True
        self.words = np.packbits(marks, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Set bits at or before each place."""
        word = place >> 6
        mask = (np.uint64(2) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def select(words: np.ndarray) -> np.ndarray:
    """Places of all set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


class Aligned:
    """The alignment of some texts: ids, number of tokens of each text, and of each group the ends of its tokens on both sides.

    Texts that are empty, or that a side does not spell as a blank and the text, have no tokens.
    """

    def __init__(self, texts: list[str], a: Side, b: Side):
        self.most = max(a.size, b.size) - 1
        self.a, self.n_a, spelled_a = self._tokens(texts, a)
        self.b, self.n_b, spelled_b = self._tokens(texts, b)
        wanted = [b" " + t.encode() if t else b"" for t in texts]
        right = np.array([x == w == y for x, w, y in zip(spelled_a, wanted, spelled_b)], bool)
        self.a, self.b = self.a[np.repeat(right, self.n_a)], self.b[np.repeat(right, self.n_b)]
        self.n_a, self.n_b = self.n_a * right, self.n_b * right
        ends_a, ends_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        bits_a, bits_b = Bits(ends_a, size), Bits(ends_b, size)
        cuts = select(bits_a.words & bits_b.words)
        self.end_a, self.end_b = bits_a.rank(cuts), bits_b.rank(cuts)
        text_ends = np.cumsum(np.fromiter(map(len, wanted), np.int64, len(texts)) * right)
        at = np.searchsorted(cuts, text_ends, "right")
        self.n_groups = np.diff(at, prepend=0)

    @staticmethod
    def _tokens(texts: list[str], side: Side) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        packed = [side.encode(t) if t else b"" for t in texts]
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        spelled, ends = side.spelled(ids), np.concatenate([[0], np.cumsum(side.length[ids])])
        stops = ends[np.cumsum(n)].tolist() if len(n) else []
        return ids, n, [spelled[i:j] for i, j in zip([0, *stops], stops)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the two tokens that end on each cut."""
        return self.a[self.end_a - 1], self.b[self.end_b - 1]

    def listed(self) -> list[str]:
        """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens.

        Tokens of both sides go to their places in one row of digits, each with the sign behind it.
        """
        n = len(self.a) + len(self.b)
        begin_a, begin_b = np.diff(self.end_a, prepend=0), np.diff(self.end_b, prepend=0)  # sizes of the groups
        at_a = np.arange(len(self.a)) + np.repeat(self.end_b - begin_b, begin_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.end_a, begin_b)
        ids, signs = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        signs[at_a[self.end_a - 1]] = ord("|")
        signs[at_b[self.end_b - 1]] = ord(";")
        text_ends = np.cumsum(self.n_a + self.n_b)
        signs[text_ends[self.n_a > 0] - 1] = 0
        row = np.concatenate([_digits(self.most)[ids], signs[:, None]], axis=1)
        filled = row != 0
        ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])[text_ends].tolist()
        body = memoryview(row[filled].tobytes())
        return [hashlib.sha256(body[i:j]).hexdigest() if j > i else "" for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def _digits(most: int) -> np.ndarray:
    """Decimal digits of 0, 1, 2, ... ``most``, with zero bytes for the leading ones."""
    width = len(str(most))
    return np.frombuffer(b"".join(str(i).encode().rjust(width, b"\0") for i in range(most + 1)), np.uint8).reshape(-1, width)


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of (id_col, ids_a, ids_b, group_ends_a, group_ends_b) of every row: tokens of both sides, and of each group the number of tokens up to its end.

    Null and empty texts, and texts that a tokenizer does not spell byte by byte, have empty lists. Repeated rows and null ids keep a row each; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(byte_path), piece_side(piece_path)
        for batch in batches:
            found = Aligned(batch.column("text").to_pylist(), a, b)
            rows = np.repeat(np.arange(len(found.n_a)), found.n_groups)
            first_a, first_b = np.cumsum(found.n_a) - found.n_a, np.cumsum(found.n_b) - found.n_b
            listed = lambda values, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values.astype(np.int32)))
            columns = [listed(found.a, found.n_a), listed(found.b, found.n_b), listed(found.end_a - first_a[rows], found.n_groups), listed(found.end_b - first_b[rows], found.n_groups)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "ids_a", "ids_b", "group_ends_a", "group_ends_b"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids_a array<int>, ids_b array<int>, group_ends_a array<int>, group_ends_b array<int>")).withColumnRenamed("id", id_col)


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """A table of one row a block of documents: their ids and figures, their distinct linked pairs with counts, and each link's place among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(byte_path), piece_side(piece_path)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            found = Aligned(batch.column("text").to_pylist(), a, b)
            left, right = found.links()
            pairs, place, counts = np.unique(left << 32 | right, return_inverse=True, return_counts=True)
            row = [pa.array([first + number]), *[pa.array([x.tolist()]) for x in (found.n_a, found.n_b, found.n_groups)], pa.array([found.listed()], pa.list_(pa.string()))]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            links = place.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()
            row += [ids, pa.array([links], pa.binary()), pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(row, names=["block", "n_a", "n_b", "n_groups", "groups", "doc_id", "links", "pairs", "counts"])

    source = docs.select("doc_id", text_or_empty().alias("text"))
    fields = f"block long, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, doc_id array<{source.schema['doc_id'].dataType.simpleString()}>, links binary, pairs array<long>, counts array<long>"
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, fields))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """A table of (pair, id_a, id_b, n, best): links of each pair of ids over all documents, and whether no pair of its id_b has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    ids = each.select("pair", F.shiftright("pair", 32).cast("int").alias("id_a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("id_b"), "n")
    return written(ids.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("id_b"))))


def alignment_report(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Links join the tokens whose ranges end together; a link's count is how many links of all documents have its pair of ids, and
    n_best are the links that no other id of the first tokenizer surpasses at their second id. Null and empty texts, and texts that a
    tokenizer does not spell byte by byte, have zeros and ''. Repeated rows and null ids keep a row each (and all count);
    an empty table gives none; other columns are left out. A block holds one Arrow batch, so memory follows the longest text.
    """
    blocks = aligned_blocks(docs, byte_path, piece_path)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(blocks).select("pair", "n", "best"), "pair")
    answers = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("x")).select("block", F.col("x.n").alias("n"), F.col("x.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda name: batch.column(name).slice(i, 1).flatten()  # noqa: E731, B023
                groups = of("n_groups").to_numpy()
                body = batch.column("links")[i].as_py()
                place = np.frombuffer(body, f"<u{len(body) // int(groups.sum())}") if len(body) else np.zeros(0, np.int64)
                ends = np.cumsum(groups)
                n, best = (np.asarray(of(name).to_numpy(zero_copy_only=False)).astype(np.int64)[place] if len(place) else np.zeros(0, np.int64) for name in ("n", "best"))
                n, best = (np.concatenate([[0], np.cumsum(x)]) for x in (n, best))
                sums = [pa.array(x[ends] - x[ends - groups], pa.int64()) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([of("doc_id"), of("n_a"), of("n_b"), of("n_groups"), of("n_groups"), *sums, of("groups")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    with arrow_batches(docs.sparkSession, 8):
        joined = blocks.drop("pairs", "counts").join(answers, "block", "left")
        return written(joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
