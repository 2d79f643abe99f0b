"""N-gram Jaccard join by vertical partitioning.

The global order of the shingles is cut into fragments, and every fragment is worked on by itself:

1. The first fragment in hash order is counted over all documents. A shingle that only one document holds is missing from any
   partner, so a document with more of those than a similarity of 0.8 forgives links with nothing and leaves. The same
   count over all fragments of the documents left takes out most others, however many passages they share with strangers.
2. The rest get their shingles in one global order, the rarest first, which is cut into FRAGMENTS of equal weight. Two sets
   that are alike enough meet in a shingle of both prefixes of that order: those posting lists name the pairs.
3. Each pair's partial overlap is counted fragment by fragment, and the counts are summed per pair.

What links must answer here is which documents belong together, so equal sets are one node, and pairs inside one component need
no test. Lists are first tested against two leaders each (linear in their length); only pairs that still lie in different
components are then enumerated, dealt into blocks. No pair is left untested by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxlake.llm.common import Tables, arrow_batches
from boxlake.llm.shingles import shingle_hashes

FRAGMENTS = 8
FIRST_FRAGMENT = 3 / 8  # share of the hash order that all documents are counted in
FREQUENT = 1_000  # rows of one key that one task takes; longer ones are split
BLOCK = 256
BROADCAST_KEYS = 1_000_000  # keys of 8 or 16 bytes; more are joined by a shuffle


def prefix_length(n):
    """Shingles of a set of n that any set of similarity 0.8 must meet with one of its own prefix."""
    return n - (4 * n + 4) // 5 + 1


def forgiven(n: str) -> Column:
    """Shingles of a set of n that a set of similarity 0.8 may lack."""
    return F.expr(f"{n} - (4 * {n} + 4) div 5")


def parity_bits(hashes: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2**k cells, at least as many as shingles, packed."""
    cells = max(64, 1 << max(0, int(len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Maps (rows) halved until they have ``size`` bytes."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def differing_cells(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: the longer map is folded onto the shorter."""
    size = min(len(a), len(b))
    x, y = (folded(np.frombuffer(v, np.uint8)[None], size) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def near_by_bits(na: np.ndarray, nb: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Of each pair, whether sizes and maps allow a similarity of 0.8 (maps of one length are compared at once)."""
    total = na + nb
    most = total - 2 * -(-4 * total // 9)
    ok = (5 * na >= 4 * nb) & (5 * nb >= 4 * na)
    sizes = np.array([list(map(len, bits_a)), list(map(len, bits_b))])
    for la, lb in np.unique(sizes[:, ok], axis=1).T:
        at = np.flatnonzero(ok & (sizes[0] == la) & (sizes[1] == lb))
        x, y = (np.frombuffer(b"".join(bits[at]), np.uint8).reshape(len(at), -1) for bits in (bits_a, bits_b))
        size = min(la, lb)
        ok[at] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(axis=1, dtype=np.int64) <= most[at]
    return ok


def set_hash(h: np.ndarray) -> tuple[int, int]:
    mixed = (h ^ (h >> np.uint64(27))) * np.uint64(0xD6E8FEB86659FD93)
    return int(mixed.sum(dtype=np.uint64)) - (1 << 63), int((mixed ^ (mixed >> np.uint64(33))).sum(dtype=np.uint64)) - (1 << 63)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), two halves of the set's own hash, low (the set's part in the first fragment)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = np.uint64(int(FIRST_FRAGMENT * (1 << 64)))
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                h = shingle_hashes(text)
                out.append((doc, len(h), *set_hash(h), h[: np.searchsorted(h, limit)].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "s1", "s2", "low"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    return source.mapInPandas(run, "doc_id long, n long, s1 long, s2 long, low array<long>")


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, bits, set (all hashes) of the documents that ``nodes`` (node, n, s1, s2) names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["node"], batch["text"]):
                h = shingle_hashes(text)
                out.append((doc, len(h), *set_hash(h), parity_bits(h), h.view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "n", "s1", "s2", "bits", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(sized(nodes.select("node")), "node", "left_semi").mapInPandas(run, "node long, n long, s1 long, s2 long, bits binary, set array<long>")
    return found.join(sized(nodes), ["node", "n", "s1", "s2"], "left_semi").select("node", "n", "bits", "set")


def sized(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast only if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def hopeless(postings: DataFrame) -> DataFrame:
    """node of those with more shingles of their own than a partner may lack. Only counts and least values by shingle are
    needed, which combine before the shuffle, so that frequent shingles are no burden."""
    held = postings.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node"), F.min("n").alias("n"))
    return held.where("c = 1").groupBy("node", "n").agg(F.count("*").alias("own")).where(F.col("own") > forgiven("n")).select("node")


def by_key(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with ``found``, a written table of ``keys``, c (rows of the key) and more.

    Frequent keys meet their rows by a broadcast of those few keys (or, if they are many, by a join that adaptive execution splits),
    so that no task takes one key's whole list.
    """
    often = sized(found.where(F.col("c") > FREQUENT))
    seldom = rows.join(often, keys, "left_anti").join(found.where(F.col("c") <= FREQUENT), keys)
    return rows.join(often, keys).unionByName(seldom)


def in_order(postings: DataFrame, tables: Tables) -> DataFrame:
    """postings (node, n, s) with c (documents that hold s) of the shingles that several hold: the global order is by c, then s."""
    return by_key(postings, tables.write(postings.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")), ["s"])


def ranked(ordered: DataFrame, tables: Tables) -> DataFrame:
    """ordered (node, n, s, c) with ``fragment`` and ``head`` (whether s is in the node's prefix), without nodes that share too little.

    Shingles of one document come first in the order and match nothing; they shorten the prefix.
    """
    place = F.col("c") + F.col("s") / F.lit(2.0**64) + 0.5
    cuts = ordered.agg(F.percentile_approx(place, [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000).alias("q")).first()["q"] or []
    by = Window.partitionBy("node")
    counted = ordered.withColumn("fragment", sum(((place >= q).cast("int") for q in cuts), F.lit(0))).withColumn("k", F.count("*").over(by)).withColumn("i", F.row_number().over(by.orderBy("c", "s")))
    alone = F.col("n") - F.col("k")
    return tables.write(counted.where(alone <= forgiven("n")).select("node", "n", "s", "c", "fragment", (F.col("i") <= forgiven("n") + 1 - alone).alias("head")))


def part_of(node: str) -> Column:
    """The part of its list that a posting is dealt to, where ``c`` bounds the list's length."""
    return F.pmod(F.xxhash64(node), parts()).cast("int").alias("part")


def parts() -> Column:
    return F.expr(f"cast(1 + (c - 1) div {FREQUENT} as int)")


def per_list(lists: DataFrame, **wanted: Column) -> DataFrame:
    """lists (s, node, c, ...) joined with aggregates of each list. The aggregates combine before the shuffle, and long lists meet them in parts."""
    found = lists.groupBy("s", "c").agg(*(column.alias(name) for name, column in wanted.items()))
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts() - 1))).drop("c")
    return lists.withColumn("part", part_of("node")).join(found, ["s", "part"])


def leader_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's first and last node with every other node of the list."""
    led = per_list(lists, first=F.min("node"), last=F.max("node")).select("node", F.explode(F.array("first", "last")).alias("leader")).where("node != leader")
    return led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with each node's component."""
    return lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that touch more than one component, with their ``length``."""
    found = per_list(labelled(lists, labels), length=F.count("*"), low=F.min("label"), high=F.max("label"))
    return found.where("low != high").select("s", "node", "label", "length")


def cross_pairs(lists: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs of a list that lie in different components and that sizes and bitmaps leave: each list is dealt into blocks of
    about BLOCK nodes, and every two blocks of a list meet in one place, where only the pairs left are emitted."""
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    dealt = lists.join(bits, "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("s", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "n", "node", "label", "bits")

    def compare(rows: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        n, label, node, own, bits = (rows[c].to_numpy() for c in ("n", "label", "node", "own", "bits"))
        within = (rows["lo"] == rows["hi"]).to_numpy()
        found = []
        for step in range(1, len(rows)):  # rows of a group stand by size, so that a step without fitting sizes ends the search
            i = np.flatnonzero((group[step:] == group[:-step]) & (5 * n[:-step] >= 4 * n[step:]))
            if not len(i):
                break
            j = i + step
            asked = (label[i] != label[j]) & (within[i] | (own[i] != own[j]))
            i, j = i[asked], j[asked]
            if len(i):
                ok = near_by_bits(n[i], n[j], bits[i], bits[j])
                found.append(np.stack([node[i[ok]], node[j[ok]]], axis=1))
        pairs = np.sort(np.concatenate(found), axis=1) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"]).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = rows[["s", "lo", "hi"]].to_numpy()
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))]) if len(rows) else np.empty(0, np.int64)
            whole = np.searchsorted(group, group[-1]) if len(rows) else 0
            held = rows.iloc[whole:]
            if whole:
                yield compare(rows.iloc[:whole], group[:whole])
        if held is not None and len(held):
            yield compare(held, np.zeros(len(held), np.int64))

    count = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(count, "s", "lo", "hi").sortWithinPartitions("s", "lo", "hi", "n").mapInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, bits: DataFrame, segments: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) that link: after sizes and bitmaps, partial overlaps are counted in every fragment by itself and summed per pair."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[near_by_bits(*(batch[c].to_numpy() for c in ("na", "nb", "bits_a", "bits_b"))), ["a", "na", "b", "nb"]]

    named = lambda x: bits.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
    left = tables.write(pairs.join(named("a"), "a").join(named("b"), "b").mapInPandas(near, "a long, na long, b long, nb long"))
    by_fragment = left.withColumn("fragment", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    segment = lambda x: segments.select(F.col("node").alias(x), "fragment", F.col("segment").alias(f"segment_{x}"))
    both = by_fragment.join(segment("a"), ["a", "fragment"]).join(segment("b"), ["b", "fragment"])
    partial = both.select("a", "na", "b", "nb", F.size(F.array_intersect("segment_a", "segment_b")).alias("shared"))
    summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("shared").alias("shared"))
    return tables.write(summed.where(9 * F.col("shared") >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"))


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, label (the smallest node reachable) of every node that has a link: smallest labels spread, and labels of labels are followed.

    Nodes with more than FREQUENT links meet their label in parts.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degrees = tables.write(both.groupBy("a").agg(F.count("*").alias("c"), F.min("b").alias("least")))
    hubs = degrees.where(F.col("c") > FREQUENT).select("a", "c")
    both = tables.write(both.join(sized(hubs), "a", "left").withColumn("c", F.coalesce("c", F.lit(1))).select("a", "b", part_of("b")))
    labels = tables.write(degrees.select(F.col("a").alias("node"), F.least("a", "least").alias("label"), parts().alias("parts")))
    while True:
        dealt = labels.select(F.col("node").alias("a"), "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        spread = both.join(dealt, ["a", "part"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("least"))
        lower = labels.join(spread, "node").select("node", "parts", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = tables.write(lower.join(target, "label", "left").select("node", "parts", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = now.select("node", "label", "parts")
        if now.where(F.col("old") != F.col("label")).isEmpty():
            return now.select("node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Two documents link when 100 * shared >= 80 * united shingles of five words. Null, empty and blank texts have no shingles and
    no links (their component is their own id); null ids belong to nothing (null component); repeated rows come out as often.
    An id that names several texts goes by the one with the fewest shingles, ties by hash; all its rows get that component. An
    empty table gives no rows; other columns are left out.
    """
    with arrow_batches(docs.sparkSession, 200):  # all steps that run Python write their rows
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    tables = Tables(docs.sparkSession)
    described = tables.write(describe(docs))
    ids = described.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    one = described.where("n > 0")
    if ids["rows"] > ids["ids"]:
        one = tables.write(described.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2", "low")).alias("x")).select("doc_id", "x.*").where("n > 0"))
    classes = tables.write(one.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")))
    members = tables.write(by_key(one.select("doc_id", "n", "s1", "s2"), classes, ["n", "s1", "s2"]).select("doc_id", "node"))
    copies = tables.write(members.where("doc_id != node").select(F.col("doc_id").alias("node")))
    nodes = one.withColumnRenamed("doc_id", "node").join(sized(copies), "node", "left_anti")

    lone = tables.write(hopeless(nodes.select("node", "n", F.explode("low").alias("s"))))
    alive = tables.write(nodes.select("node", "n", "s1", "s2").join(sized(lone), "node", "left_anti"))
    found = whole_sets(docs, alive)
    sets = tables.write(found if ids["rows"] == ids["ids"] else found.dropDuplicates(["node"]))
    postings = sets.select("node", "n", F.explode("set").alias("s"))
    lone = tables.write(hopeless(postings))
    order = ranked(in_order(postings.join(sized(lone), "node", "left_anti"), tables), tables)
    segments = tables.write(order.groupBy("node", "fragment").agg(F.collect_list("s").alias("segment")))
    bits = sets.select("node", "n", "bits")
    lists = order.where("head").select("s", "node", "c")

    links = verified(leader_pairs(lists), bits, segments, tables)
    more = verified(cross_pairs(open_lists(lists, components(links, tables)), bits), bits, segments, tables)
    labels = components(links.unionByName(more), tables)
    known = members.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
    rows = described.select("doc_id", F.col("n").alias("n_shingles"))
    out = tables.write(rows.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")))
    tables.keep(out)
    nothing = F.lit(None).cast("long")
    nameless = docs.where("doc_id is null").select(nothing.alias("doc_id"), nothing.alias("n_shingles"), nothing.alias("component_id"))
    return out.unionByName(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id. All columns stay; rows without an id stay.

    Of rows that repeat a kept id, one stays: that of the least text, then of the least other columns (which must have an order).
    """
    tables = Tables(docs.sparkSession)
    found = near_duplicates(docs).where("doc_id is not null")
    ids = tables.write(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    unlike = tables.write(ids.where("doc_id != component_id or rows > 1").select(F.col("doc_id").alias("__id")))  # the few that go, so that texts need no shuffle
    repeated = ids.where("doc_id = component_id and rows > 1").select(F.col("doc_id").alias("__id"))
    same = F.col("doc_id").cast("long") == F.col("__id")
    once = docs.join(sized(unlike), same, "left_anti")  # null ids stay
    rows = docs.join(sized(repeated), same, "left_semi").select("doc_id", F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("__row"))
    least = rows.groupBy("doc_id").agg(F.min("__row").alias("__row")).select("doc_id", "__row.*").select(*docs.columns)
    return once.unionByName(least)
