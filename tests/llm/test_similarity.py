import random

from hypothesis import given, settings
from hypothesis import strategies as st

from boxlake.llm import similarity
from boxlake.llm.shingles import shingle_hashes
from boxlake.llm.similarity import differing_cells, keep_one, near_duplicates, parity_bits, prefix_length


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3)
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.8:
            texts.append(" ".join(passage + [word() for _ in range(rng.randint(1, 80))]))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(0, 90))))
    return list(zip(rng.sample(range(5000), n), [*texts[:-2], None, " \n"]))


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, corpus(1))


def test_long_lists(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FREQUENT", 3)
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "BROADCAST_KEYS", 5)
    check(spark, corpus(2))


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(3, "A b", "s"), (1, "a B", "s"), (1, "a B", "s"), (None, "a b", "s"), (4, "", None), (5, None, "s")], schema)
    got = sorted((str(r.doc_id), str(r.n_shingles), str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == [("1", "1", "1"), ("1", "1", "1"), ("3", "1", "1"), ("4", "0", "4"), ("5", "0", "5"), ("None", "None", "None")]
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "None"]


def test_one_id_with_several_texts(spark):
    long, short = " ".join("abcdefghijklmnop"), " ".join("qrstuvwxyz")
    rows = [(7, long, 1), (7, short, 2), (7, short, 1), (9, short, 3), (8, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(7, 6, 7), (7, 6, 7), (7, 12, 7), (8, 12, 8), (9, 6, 7)]
    assert sorted(map(tuple, keep_one(docs).collect())) == [(7, long, 1), (8, long, 4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.lists(st.integers(0, 30), min_size=1, max_size=60))
def test_bounds(a, b):
    x, y = (shingle_hashes(" ".join(map(str, v))) for v in (a, b))
    union, both = len(set(x) | set(y)), len(set(x) & set(y))
    assert differing_cells(parity_bits(x), parity_bits(y)) <= union - both
    if 100 * both >= 80 * union:
        assert set(x[: prefix_length(len(x))]) & set(y[: prefix_length(len(y))])
