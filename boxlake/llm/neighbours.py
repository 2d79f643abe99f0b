"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample by spherical k-means with a penalty on full clusters. Every vector is posted to its
nearest centroid, and boundary vectors to further ones that are almost as near. A query walks an in-memory graph of the
centroids, keeps the lists whose distance is within a ratio of the nearest, and is compared with every vector of those.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.llm.common import written

SAMPLE = 20_000  # rows at most (in expectation) that the index is fitted on
LIST_SIZE = 128  # vectors of a list, as planned
PART_SIZE = 2_000  # rows of a list that one group compares; longer lists are dealt into parts
SAMPLE_PER_LIST = 8


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit rows; a cluster that is too full becomes less attractive in the next round."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        own = np.concatenate([(part @ centroids.T - penalty).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sizes = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        norms = np.linalg.norm(sums, axis=1)
        good = (sizes > 0) & (norms > 1e-12)
        centroids[good] = sums[good] / norms[good, None]
        centroids[~good] = x[rng.choice(len(x), int((~good).sum()))]
        penalty += 0.02 * (sizes * k / len(x) - 1)
        penalty = np.clip(penalty - penalty.min(), 0, 0.2)
    return centroids


def graph_of(centroids: np.ndarray, degree: int = 24) -> np.ndarray:
    """Nearest other centroids of each."""
    near = [np.argsort(-(part @ centroids.T), axis=1, kind="stable")[:, : degree + 1] for part in np.array_split(centroids, max(1, len(centroids) // 1024))]
    return np.concatenate(near)


def walk(query: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int) -> list[tuple[float, int]]:
    """(similarity, centroid), nearest first, of the best ``beam`` centroids that a best-first walk of the graph meets."""
    starts = np.linspace(0, len(centroids) - 1, min(len(centroids), 12)).astype(int)
    seen = set(starts.tolist())
    found = [(float(s), int(c)) for s, c in zip(centroids[starts] @ query, starts)]
    best = found[:]
    heapq.heapify(best)
    todo = [(-s, c) for s, c in found]
    heapq.heapify(todo)
    while todo:
        s, c = heapq.heappop(todo)
        if len(best) >= beam and -s < best[0][0]:
            break
        fresh = [int(n) for n in graph[c] if int(n) not in seen]
        seen.update(fresh)
        for score, n in zip((centroids[fresh] @ query).tolist() if fresh else (), fresh):
            if len(best) < beam or score > best[0][0]:
                heapq.heappush(best, (score, n))
                heapq.heappush(todo, (-score, n))
                if len(best) > beam:
                    heapq.heappop(best)
    return sorted(best, key=lambda x: (-x[0], x[1]))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed alike for every row, so that equal vectors get equal scores."""
    dot = lambda x, y: np.ascontiguousarray(x * y).sum(axis=1)
    return np.clip(dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))), -1.0, 1.0)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: of the commonest length, all components finite, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == sizes[0]["d"]) if sizes else rows


def search(vectors: DataFrame, query_every: int = 50, k: int = 5, copies: int = 6, closeness: float = 1.25, lists: int = 64, ratio: float = 1.6) -> DataFrame:
    """query_id, rank, vec_id, score: of every vector whose id ``query_every`` divides, the ``k`` nearest others found.

    Scores are cosines in double precision; ties go to the smaller id. Of equal vectors only the k + 1 smallest ids can be among
    the k nearest, so the rest are not indexed. Null, zero and non-finite vectors and null ids take no part; repeated rows
    count once; other columns are left out; an empty table gives no rows.
    """
    rows = written(usable(vectors).dropDuplicates(["vec_id"]))
    total = rows.count()
    every = max(1, total // SAMPLE)
    sample = np.array([r["embedding"] for r in rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).orderBy("vec_id").collect()])
    empty = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        if not total:
            return vectors.sparkSession.createDataFrame([], empty)
        sample = np.array([r["embedding"] for r in rows.orderBy("vec_id").limit(SAMPLE_PER_LIST).collect()])
    sample = unit(sample)
    n_lists = max(1, min(total // LIST_SIZE, len(sample) // SAMPLE_PER_LIST))
    centroids = balanced_centroids(sample, n_lists)
    index = rows.sparkSession.sparkContext.broadcast((centroids, graph_of(centroids)))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, _ = index.value
        for batch in batches:
            if not len(batch):
                continue
            distance = 1 - unit(matrix(batch["embedding"])) @ centres.T
            near = np.argsort(distance, axis=1, kind="stable")[:, :copies]
            away = np.take_along_axis(distance, near, axis=1)
            row, place = np.nonzero(away <= closeness * away[:, :1] + 1e-12)
            yield pd.DataFrame({"list": near[row, place], "vec_id": batch["vec_id"].to_numpy()[row], "embedding": [batch["embedding"].iat[i] for i in row]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, graph = index.value
        for batch in batches:
            out = []
            for query, vector in zip(batch["vec_id"], batch["embedding"]):
                met = walk(vector / np.linalg.norm(vector), centres, graph, lists)
                limit = ratio * (1 - met[0][0]) + 1e-9
                out += [(int(c), query, vector) for s, c in met if 1 - s <= limit or c in {m[1] for m in met[:4]}]
            yield pd.DataFrame(out, columns=["list", "query_id", "embedding"])

    def compare(queries: pd.DataFrame, posted: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(posted):
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        q, v = matrix(queries["embedding"]), matrix(posted["embedding"])
        ids, asked, out = posted["vec_id"].to_numpy(), queries["query_id"].to_numpy(), []
        for at in range(0, len(q), 256):
            rough = unit(q[at : at + 256]) @ unit(v).T
            rough[asked[at : at + 256, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, -min(k, rough.shape[1]), axis=1)[:, -min(k, rough.shape[1])]
            i, j = np.nonzero((rough >= least[:, None] - 1e-9) & np.isfinite(rough))
            out.append(pd.DataFrame({"query_id": asked[at + i], "vec_id": ids[j], "score": cosines(q[at + i], v[j])}))
        found = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)[columns]

    same = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    indexed = rows.withColumn("copy", same).where(F.col("copy") <= k + 1).drop("copy")
    posted = written(indexed.mapInPandas(post, "list long, vec_id long, embedding array<double>"))
    parts = posted.groupBy("list").agg(F.ceil(F.count("*") / PART_SIZE).cast("int").alias("parts"))  # a row for each list
    dealt = posted.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    asked = rows.where(F.col("vec_id") % query_every == 0).mapInPandas(route, "list long, query_id long, embedding array<double>")
    asked = asked.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = asked.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.distinct().withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
