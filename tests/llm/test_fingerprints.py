import hashlib
import random

import numpy as np

from boxlake.llm.fingerprints import FLOOR, SCALE, TOP, WIDTH, compare_edited, containment, fingerprint_documents, merged, read_sketch, shingle_values, sketch, written_sketch
from boxlake.llm.shingles import shingle_hashes, words_of


def test_shingles():
    assert words_of("A\x0bÉ b\xa0c\x1cd") == [b"a", "É".encode(), "b\xa0c\x1cd".encode()]
    text = " ".join(str(i % 17) for i in range(400))
    words = text.split()
    assert len(shingle_hashes(text)) == len({tuple(words[i : i + 5]) for i in range(396)})
    assert len(shingle_hashes("a b")) == 1 and len(shingle_hashes(" \n")) == 0 and shingle_hashes("a b") != shingle_hashes("b a")


def exact(a, b):
    a, b = ({p[i : i + WIDTH] for i in range(len(p) - WIDTH + 1)} if t else set() for t, p in ((t, "\0" * (WIDTH - 1) + t + "\0" * (WIDTH - 1)) for t in (a, b)))
    return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)


def test_containment_is_close_to_the_truth():
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    small = [word() for _ in range(3000)]
    large = [word() for _ in range(30_000)] + small[:1500] + [word() for _ in range(9000)]
    a, b = sketch(" ".join(small)), sketch(" ".join(large))
    assert abs(containment(a, b) - exact(" ".join(small), " ".join(large))) < 0.09 and containment(a, a) == 1
    both = sketch(" ".join(small) + " \n " + " ".join(large))
    assert len(np.setdiff1d(both, merged(a, b))) <= 4
    assert (read_sketch(written_sketch(a)) == a).all() and len(read_sketch(written_sketch(sketch("")))) == 0


def test_the_error_falls_with_the_length():
    """Root mean square error against the exact containment: by length for texts alike in length, and for long texts in ones five times as long. Sketches are small."""
    rng = random.Random(9)
    for n, longer, bound in ((1, 0, 0.0001), (4, 0, 0.09), (40, 0, 0.09), (400, 0, 0.08), (400, 5, 0.08), (4000, 0, 0.04), (4000, 5, 0.04)):
        squares = []
        for _ in range(120 if n < 1000 else 12):
            words = [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
            share = rng.random()
            other = [w if rng.random() < share else f"x{rng.randint(0, 10**7)}" for w in words] + [f"y{rng.randint(0, 10**7)}" for _ in range(longer * n)]
            a, b = " ".join(words), " ".join(other)
            squares.append((containment(sketch(a), sketch(b)) - exact(a, b)) ** 2)
        assert (sum(squares) / len(squares)) ** 0.5 <= bound, (n, longer)
        assert len(written_sketch(sketch(a))) <= max(8 * 32, len(a) // 12)


def test_every_hash_below_the_fraction_is_kept():
    text = " ".join(f"{i * 7919 % 10007}" for i in range(9000))
    values = shingle_values(text)
    assert sketch(text).tolist() == sorted({v for v in values.tolist() if v < TOP // SCALE}) and len(sketch(text)) >= FLOOR
    assert sketch("short one").tolist() == sorted(set(shingle_values("short one").tolist()))[:FLOOR]
    assert merged(sketch("ab" * 5), sketch("cd")).tolist() == sorted(set(shingle_values("ab" * 5).tolist() + shingle_values("cd").tolist()))[:FLOOR]


def test_edited(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 6) for _ in range(rng.randint(0, 120))) + "é" * (i % 3) for i in range(150)] + [None, "", "one"]
    ids = rng.sample(range(10**6), len(texts))
    docs = spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts)], "doc_id long, text string, key string")
    rows = {r.doc_id: r for r in compare_edited(docs).collect()}
    order = sorted(zip(ids, (t or "" for t in texts)))
    assert len(rows) == len(order)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == written_sketch(sketch(text)) and r.edited_fingerprint == written_sketch(sketch(edited))
        assert r.near_edited == containment(sketch(text), sketch(edited)) and r.near_next == containment(sketch(text), sketch(after))


def test_edges(spark):
    schema = "doc_id long, text string"
    assert compare_edited(spark.createDataFrame([], schema)).count() == 0
    assert compare_edited(spark.createDataFrame([(4, "only one")], schema)).first().near_next == 1
    repeated = compare_edited(spark.createDataFrame([(4, "x y")] * 3 + [(None, "z"), (5, "a")], schema)).collect()
    assert sorted(str(r.doc_id) for r in repeated) == ["4", "4", "4", "5", "None"]
    assert fingerprint_documents(spark.createDataFrame([(1, None), (2, "a b")], schema)).count() == 2


def test_ids_stay_whole(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b c d"), (None, "x")], "doc_id long, text string").coalesce(1)
    for rows in (compare_edited(docs), fingerprint_documents(docs)):
        assert {r.doc_id for r in rows.collect()} == {2**60 + 1, None}
