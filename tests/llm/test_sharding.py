import zlib
from collections import Counter

from boxlake.llm.sharding import shard_documents


def jump(key, n):
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_the_loop(spark):
    keys = [*range(-500, 1500), 2**63 - 1, -(2**63), 10**15, None]
    docs = spark.createDataFrame([(k, None if i % 7 == 0 else "é" * (i % 5), "x") for i, k in enumerate(keys)], "doc_id long, text string, slot string")
    rows = shard_documents(docs).collect()
    texts = {k: None if i % 7 == 0 else "é" * (i % 5) for i, k in enumerate(keys)}
    assert len(rows) == len(keys)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25))
        assert r.grown_shard in (r.shard, 24) and r.size == len(body) + 8 and r.text_crc32 == zlib.crc32(body) and r.law == "key"
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(5, "a")] * 300, "doc_id long, text string")
    rows = shard_documents(docs).collect()
    assert sorted(r.slot for r in rows) == list(range(300)) and len({r.shard for r in rows}) == 1
    assert shard_documents(docs.limit(0)).count() == 0
    named = spark.createDataFrame([(f"k{i}", "a") for i in range(5000)], "doc_id string, text string")
    counts = Counter(r.shard for r in shard_documents(named, shards=8).collect())
    assert len(counts) == 8 and min(counts.values()) > 450
