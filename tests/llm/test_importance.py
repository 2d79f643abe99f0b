import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from boxlake.llm.importance import hashed_ngrams, resample, resampling_plan

SCHEMA = "doc_id long, text string, score string, rank int"
BUCKETS = 10_000


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, longest=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % BUCKETS


def brute(docs, target):
    raw, want = (Counter(bucket(g) for t in texts for g in grams(t)) for texts in ([d[1] for d in docs], target))
    s, t = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + BUCKETS) / ((raw[b] + 1) * (t + BUCKETS))))
    out = []
    for doc, text, *_ in docs:
        found = [gain(bucket(g)) for g in grams(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return [r[:4] for r in out], [r[:4] for r in fit[: 25 * len(fit) // 100]]


def texts():
    vocab = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "漢字", "don't", "x_y", "A1"]
    rows = [(i, " ".join(vocab[(i * 7 + j * (1 + i % 5)) % len(vocab)] for j in range(i % 60)), "z", 1) for i in range(300)]
    return rows + [(2**60 + 1, "a b c " * 30, "z", 1), (None, "w1 w2 " * 12, "z", 1), (400, None, "z", 1), (401, "", "z", 1), (402, " .;\x00", "z", 1), (403, "Foo BAR " * 20_000, "z", 1)] + [(5, "w3 w4 w5 " * 9, "z", 1)] * 30


def test_against_brute_force(spark):
    docs, target = texts(), ["w1 w2 w3", None, "", "foo bar", "w7 w9 w11 漢字 éa"]
    want, drawn = brute(docs, target)
    df, bench = spark.createDataFrame(docs, SCHEMA).coalesce(1), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling_plan(df, bench).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    assert [(r.doc_id, r.n_features, r.weight, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))
    rows = resample(df, bench)
    assert rows.columns == ["doc_id", "text", "score", "rank"] and rows.count() == len(drawn)


def test_ngrams_of_any_length():
    bodies = ["a b c d a b c", "", "é", "b c", " ".join("xyz"[i % 3] for i in range(50))]
    for longest in (1, 2, 3, 5):
        n_words, ends, found = hashed_ngrams(bodies, longest, BUCKETS)
        assert n_words.tolist() == [len(words(b)) for b in bodies]
        parts = np.split(found, ends[:-1])
        assert [p.tolist() for p in parts] == [[bucket(g) for g in grams(b, longest)] for b in bodies]
    assert hashed_ngrams([], 2, BUCKETS)[2].tolist() == []


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(texts()[:40], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling_plan(docs.limit(0), bench).count() == 0
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in resampling_plan(docs, bench).collect()) == Counter(brute(texts()[:40], [])[0])
