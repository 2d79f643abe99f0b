"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton gives the longest token that starts at each byte of a pre-token. The encoder takes it if the
pair-compatibility table lets it stand after the token before it, else the next shorter token, else it steps back; a
position that failed once is not tried again, so the work is linear in the pre-token. The result equals applying the merges by rank.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_batches, text_or_empty, written

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 150_000
NEVER = 1 << 40


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        to_bytes = lambda s: bytes(symbol[c] for c in s)
        self.id_of = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(self.bytes_of) + 1
        self.rank, self.halves, self.merge = [-1] * size, [(-1, -1)] * size, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (to_bytes(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b, both = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.merge[a, b] = rank
            self.rank[both], self.halves[both] = rank, (a, b)
        self.lengths = [len(self.bytes_of.get(i, b"")) for i in range(size)]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # a token takes part only if the merges rebuild it from its own bytes
        ordered = sorted(self.id_of.values(), key=self.rank.__getitem__)
        whole = set()
        for t in ordered:
            a, b = self.halves[t]
            if a < 0 and self.lengths[t] == 1 or a in whole and b in whole and self._stand(a, b, self.rank[t]):
                whole.add(t)
        self.single = {self.bytes_of[t]: t for t in whole}
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for t in whole:
            word = self.bytes_of[t]
            self.shorter[t] = next((s for k in range(len(word) - 1, 0, -1) if (s := self.id_of.get(word[:k], -1)) in whole), -1)
            self.automaton.add_word(word.decode("latin-1"), (t, len(word)))
        self.automaton.make_automaton()
        # decoding: all tokens' bytes in one row, and where each begins
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.token_len = np.array(self.lengths, np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.decimal = [b"%d" % i for i in range(size)]
        self.pretokens = regex.compile(PATTERN).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space_run = re.compile(r"\s ").search

    def merge_results(self) -> list[int]:
        return [t for t in self.id_of.values() if self.rank[t] >= 0]

    def _stand(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of rank under ``before`` joins a's end with b's start when both are built from bytes."""
        rank, halves, merge = self.rank, self.halves, self.merge
        while True:
            if merge.get((a, b), NEVER) < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # the later-built of the two is taken apart; at equal ranks the left place merges first
                before, a = rank[a], halves[a][1]
            else:
                before, b = rank[b] + 1, halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        """The pair table, filled as pairs are met."""
        if len(self.pairs) >= 3 * MEMO:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self._stand(a, b, NEVER)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.single.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [-1] * n
        for end, (t, k) in self.automaton.iter(word.decode("latin-1")):
            longest[end - k + 1] = t
        lengths, shorter, pairs, failed, out = self.lengths, self.shorter, self.pairs, None, []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + lengths[token]
            if failed is None or not failed[end]:
                fits = True
                if last >= 0:
                    key = last << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                if failed is None:
                    failed = bytearray(n + 1)
                failed[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= lengths[token]

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            ids = self.encode_word(word.encode())
            found = self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _piece(self, text: str) -> bytes:
        return b"".join(map(self._word, self.pretokens(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens become their ids."""
        if self.specials and self.specials.search(text):
            ids = [np.array([self.special[s]], np.uint32).tobytes() if i % 2 else self._plain(s) for i, s in enumerate(self.specials.split(text))]
            return np.frombuffer(b"".join(ids), np.uint32)
        return np.frombuffer(self._plain(text), np.uint32)

    def _plain(self, text: str) -> bytes:
        return joined_chunks(text, self.chunks, self._piece, self.space_run)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_len[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.token_at[ids] - (ends - size), size)
        return self.blob[at + np.arange(len(at))].tobytes()


def joined_chunks(text: str, memo: dict[str, bytes], encode: Callable[[str], bytes], space_run: Callable) -> bytes:
    """Ids of a text by its blank-separated chunks, which repeat: a blank after a non-blank always starts a pre-token."""
    if space_run(text):
        return encode(text)
    first, *rest = text.split(" ")
    out = [encode(first)]
    get = memo.get
    for chunk in rest:
        found = get(chunk)
        if found is None:
            if len(memo) >= MEMO:
                memo.clear()
            found = memo[chunk] = encode(" " + chunk)
        out.append(found)
    return b"".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of (id, ids array<int>, decoded string) of every text.

    Null text counts as empty and yields no ids; repeated rows and null ids each keep their own row; an empty table gives none; any other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = [vocab.encode(t) for t in batch.column("text").to_pylist()]
            decoded = [vocab.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")).withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """A table of doc_id, n_tokens, ids_sha256, decoded_sha256: digests taken where the ids are made, so that only they leave the task.

    Null text counts as empty; repeated rows and null ids each keep a row; an empty table gives none; other columns are left out.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = vocab.encode(text)
                listed = b",".join(map(vocab.decimal.__getitem__, ids.tolist()))
                decoded = vocab.decode(ids).decode("utf-8", "replace").encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, listed, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select("doc_id", text_or_empty().alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
