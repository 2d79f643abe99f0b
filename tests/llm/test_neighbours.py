import numpy as np

from boxlake.llm.neighbours import balanced_centroids, graph_of, search, unit, walk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(rows, k=5):
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in good if i % 50 == 0):
        scores = sorted(((-float(good[q] @ v / (np.linalg.norm(good[q]) * np.linalg.norm(v))), i) for i, v in good.items() if i != q))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = brute(rows)
    got = search(frame(spark, rows)).collect()
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert len(got) == 300 and hits / 300 >= 0.9
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_small_tables_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(40)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(100, 160)]
    rows += [(200, None, 0), (250, [0.0] * 4, 0), (300, [1.0, None, 0.0, 0.0], 0), (350, [float("nan"), 1.0, 0.0, 0.0], 0), (400, [float("inf"), 1.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (450, [], 0)]
    got = {}
    for r in search(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in near] for q, near in brute(rows).items()}
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]
    assert search(frame(spark, [])).count() == 0
    assert search(frame(spark, [(0, [1.0, 0.0], 0)])).count() == 0
    assert [r.vec_id for r in search(frame(spark, [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (3, [1.0, 1.0], 0)])).collect()] == [3]


def test_graph_walk_finds_near_centroids():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(4000, 16)))
    centroids = balanced_centroids(x, 200)
    sizes = np.bincount((x @ centroids.T).argmax(axis=1), minlength=200)
    assert sizes.max() < 5 * sizes.mean()
    graph = graph_of(centroids)
    found = [len({c for _, c in walk(q, centroids, graph, 20)[:10]} & set(np.argsort(-(centroids @ q))[:10].tolist())) for q in x[:100]]
    assert np.mean(found) > 9
