import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from boxlake.llm.mixing import UNIT, crossings, mix_documents, mixing_plan, mixture_report, source_targets

SCHEMA = "doc_id long, text string, source string, size string, copy int"


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by stopping and resharing, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target[s] for s in target if s not in open_)
        for s in open_:
            target[s] = left * weight[s] / sum(weight[x] for x in open_)
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
        open_ -= above


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(["w"] * (1 + i * i % 97)), "hot" if i % 3 == 0 else f"s{i % 7}", "x", 5) for i in range(900)]
    out += [(None, "a b\tc d\x0be", None, "x", 5), (None, "a b", None, "x", 5), (2**60 + 1, None, "empty", "x", 5), (7, "", "empty", "x", 5)]
    return out + [(3, "one two three", "é", "x", 5)] * 40


def test_whole_mix(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixture_report(docs).collect()
    assert got.__len__() == len(rows) and sorted(map(str, got)) == sorted(map(str, mixture_report(docs.repartition(3)).collect()))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for _, text, source, *_ in rows:
        sizes[source] += count(text)
        largest[source] = max(largest[source], count(text))
    want = filled(sizes)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((d, count(t), sizes[s]) for d, t, s, *_ in rows)
    taken = defaultdict(int)
    for r in mixing_plan(docs.withColumn("of", F.col("source")), keep=("of",)).collect():
        assert r.target == pytest.approx(want[r.of])
        taken[r.of] += r.size * r.copies
    for r in got:
        assert r.size == 0 and r.taken == 0 or r.taken // r.size in (0, 1, 2) and r.taken % r.size == 0
    for s, target in want.items():
        assert abs(taken[s] - target) <= largest[s], s


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1, None: 4}, {"a": 0, "b": 0}, {"x": 5}, {f"s{i:02}": (i * 37) % 50 for i in range(40)}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(filled(sizes))


def test_crossings_are_exact_far_out(spark):
    cases = [(n, e, u) for n in (0, 1, 10**6, 10**12) for e in (0, 1, UNIT - 1, UNIT, 1_234_567_891, 2 * UNIT) for u in (0, 12345, UNIT - 1)]
    df = spark.createDataFrame(cases, "n long, e long, u long").select("n", "e", "u", crossings(F.col("n"), F.col("e"), F.col("u")).alias("c"))
    for r in df.collect():
        assert r.c == ((r.n + 1) * r.e + r.u) // UNIT - (r.n * r.e + r.u) // UNIT <= 2


def test_emits_whole_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mix_documents(docs)
    assert out.columns == [*(c for c in docs.columns if c != "copy"), "copy"]
    copies = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    plan = Counter()
    for r in mixing_plan(docs.withColumn("of", F.col("source")), keep=("text", "of")).collect():
        plan[r.doc_id, r.text, r.of] += r.copies
    assert copies == +plan


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, None, "", 0), (2, " ", "a", "", 0)], SCHEMA)
    assert mixture_report(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixture_report(docs).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
