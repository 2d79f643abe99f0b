import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from boxlake.llm.alignment import Bits, align_documents, alignment_report, select
from boxlake.llm.bpe import byte_symbols

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, block int"
TEXTS = [
    None, "", " ", "  two  blanks ", "a", "plain words and, more words.", "<|endoftext|> and <s> </s> <unk> <0x41>", "tabs\tand\nlines\r\n\n end", "naïve 漢字 🙂🙂 ﬁ é", "under▁score", "▁", "nul \x00 byte",
    "trailing ", " leading", "no break 　 wide", "12345 67,890.12 1st", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thwhesou " * 4000, "repeat me", "repeat me", "don't won't I'll", "​﻿x",
]


def brute(texts):
    """By the libraries and loops over byte offsets."""
    library, model = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    symbol, names = byte_symbols(), {i: t for t, i in library.get_vocab().items()}
    rows, counts = [], Counter()
    for text in texts:
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        bytes_a = [bytes(symbol[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append(([], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        links, groups = [(x, y) for x, e in zip(a, ends_a) if e in set(ends_b) for y, f in zip(b, ends_b) if e == f] if len(a) < 999 else None, []
        i = j = 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = [(x[-1], y[-1]) for x, y in groups] if links is None else links
        counts.update(links)
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((a, b, links, hashlib.sha256(listed.encode()).hexdigest(), groups))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return rows, counts, most


def test_against_the_libraries(spark):
    docs = [(2**60 + 1 if i == 5 else None if i in (3, 4) else i, t, "x", 0) for i, t in enumerate(TEXTS)]
    rows, counts, most = brute(TEXTS)
    want = Counter()
    for (doc, *_), (a, b, links, digest, *_) in zip(docs, rows):
        want[doc, len(a), len(b), len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest] += 1
    for parts in (1, 3):
        got = alignment_report(spark.createDataFrame(docs, SCHEMA).repartition(parts), BYTE, PIECE)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(map(tuple, got.collect())) == want
    assert sum(n for (_, n_a, *_), n in want.items() if not n_a) < 6


def test_groups(spark):
    docs = [(i, t, "x", 0) for i, t in enumerate(TEXTS)]
    for r, (a, b, *_, last) in zip(sorted(align_documents(spark.createDataFrame(docs, SCHEMA).coalesce(1), BYTE, PIECE).collect(), key=lambda r: r.doc_id), (x if len(x) == 5 else (*x, []) for x in brute(TEXTS)[0])):
        assert (r.ids_a, r.ids_b) == (a, b)
        assert (r.group_ends_a, r.group_ends_b) == (np.cumsum([len(x) for x, _ in last]).tolist(), np.cumsum([len(y) for _, y in last]).tolist())


def test_bits():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        places = np.flatnonzero(rng.random(size + 1) < 0.3)
        bits = Bits(places, size)
        assert select(bits.words).tolist() == places.tolist()
        at = np.arange(size + 1)
        assert bits.rank(at).tolist() == [int((places <= x).sum()) for x in at]


def test_empty(spark):
    assert alignment_report(spark.createDataFrame([], SCHEMA), BYTE, PIECE).count() == 0
    assert [tuple(r) for r in alignment_report(spark.createDataFrame([(1, None, "", 0)], SCHEMA), BYTE, PIECE).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
