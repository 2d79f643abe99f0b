"""Payload items, ranked writers, gates, snapshots and identities on cases worked out by hand or by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from boxlake.operators import identity, precedence, quality, snapshots
from boxlake.operators.payloads import Field, checked_items
from boxlake.operators.store import KeyedTable


def test_items(spark):
    docs = [
        ("a", '{"data": [{"n": 5, "c": {"k": "X"}}, {"n": true, "c": {"k": "X"}}, {"n": "7"}, {"c": {"k": "X"}}, {"n": 0, "c": {"k": "X"}}, {"n": 5, "c": {"k": "Q"}}, null]}'),
        ("b", '{"data": []}'), ("c", '{"data": {"n": 5}}'), ("d", '{"data": [{"n": 5, "c"'), ("e", None), ("f", '{"data": [{"n": 2, "c": {"k": "Y"}}]}'), ("f", '{"data": [{"n": 2, "c": {"k": "Y"}}]}'),
    ]
    df = spark.createDataFrame(docs, "doc string, body string")
    fields = [Field("n", "n", "long", least=1, most=9), Field("c.k", "k", "string", among=("X", "Y"))]
    rows = lambda **o: sorted((r.doc, -1 if r["item"] is None else r["item"], r.path, r.reason) for r in checked_items(df, "body", "data", fields, [("n", "five is out", "n = 5 and k = 'X'")], ("doc",), **o).collect())
    unread = [("c", -1, "$.data", "not a list"), ("d", -1, "$", "not JSON"), ("e", -1, "$", "not JSON")]
    assert rows() == [("a", 0, "$.data[0].n", "five is out"), ("a", 1, "$.data[1].n", "not a long"), ("a", 2, "$.data[2].c.k", "missing"), ("a", 3, "$.data[3].n", "missing"), ("a", 4, "$.data[4].n", "under 1"), ("a", 5, "$.data[5].c.k", "not one of X, Y"), ("a", 6, "$.data[6].n", "missing"), *unread, ("f", 0, None, None), ("f", 0, None, None)]
    good = spark.createDataFrame([("g", '{"data": [{"n": 2, "c": {"k": "Y"}}, {"n": 99, "c": {"k": "Y"}}]}')], "doc string, body string")
    assert sorted(r.reason for r in checked_items(good, "body", "data", fields, keep=("doc",), whole=True).collect()) == ["document", "over 9"]
    assert checked_items(df.limit(0), "body", "data", fields).count() == 0


def test_ranked_and_ensured(spark):
    schema = "k long, v string, src string, at int"
    held = spark.createDataFrame([(1, "G", "seed", 1), (2, "G", "box", 1), (3, "?", "box", 1), (4, "F", "box", 1), (5, "G", "box", 1), (6, "G", "import", 1), (9, "G", "box", 1)], schema)
    offers = spark.createDataFrame([(1, "F", "roster", 2), (2, "F", "import", 2), (3, "G", "box", 2), (4, "F", "box", 2), (5, "?", "roster", 2), (6, "C", "odd", 2), (7, "C", "odd", 2), (7, "F", "box", 1), (7, "?", "box", 3), (None, "C", "box", 1)], schema)
    got = {r.k: (r.v, r.src, r.outcome) for r in precedence.ranked_merge(held, offers, ["k"], "v", "src", "at", {"roster": 1, "box": 2, "import": 3}, ("seed",), F.col("v") != "?").collect()}
    assert got == {1: ("G", "seed", "kept"), 2: ("G", "box", "kept"), 3: ("G", "box", "updated"), 4: ("F", "box", "unchanged"), 5: ("G", "box", "kept"), 6: ("G", "import", "kept"), 7: ("F", "box", "inserted"), None: ("C", "box", "inserted"), 9: ("G", "box", "untouched")}
    people = spark.createDataFrame([(1, "Ann", None, ""), (2, "Bob", "7", "G")], "id long, name string, jersey string, pos string")
    more = spark.createDataFrame([(1, "Other", "9", "F"), (2, "Other", "8", "C"), (3, "Cy", None, "C")], people.schema)
    assert sorted(map(tuple, precedence.ensured(people, more, ["id"], ["jersey", "pos"]).collect())) == [(1, "Ann", "9", "F"), (2, "Bob", "7", "G"), (3, "Cy", None, "C")]


def test_gate(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 5), ("p", 2, 50), ("q", 1, None)], "part string, k long, v int")
    table = KeyedTable(spark, f"{tmp_path}/t", rows.schema, ("part", "k"), ("part",))
    rules = {"low": F.col("v") < 10, "odd": F.col("v") % 2 == 1}
    with pytest.raises(quality.ConstraintError, match="low: 1, odd: 1"):
        quality.gated_load(table, rows, rules)
    with pytest.raises(quality.ConstraintError, match="size: 3"):
        quality.gated_load(table, rows, {}, size=1)
    assert table.read().count() == 0
    assert quality.gated_load(table, rows.where("k = 1 and part = 'p'"), rules, size=1) == {"low": 0, "odd": 0} and table.read().count() == 1
    rejects = KeyedTable(spark, f"{tmp_path}/r", rows.withColumn("broken", F.lit("")).schema, ("part", "k"), ("part",))
    assert quality.gated_load(table, rows, rules, rejects) == {"low": 1, "odd": 1}
    assert [tuple(r) for r in rejects.read().select("k", "v", "broken").collect()] == [(2, 50, "low,odd")] and table.read().count() == 2


def test_files(spark, tmp_path):
    for name, text in (("x/1.json", "one"), ("x/2.json", "one"), ("y/1.json", "one"), ("y/2.txt", "two")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    at = ["fetched_at", "path"]
    first = snapshots.new_snapshots(snapshots.payload_files(spark, str(tmp_path), "*.json"), snapshots.payload_files(spark, str(tmp_path), "none"), at)
    assert sorted((r.source, r.size) for r in first.collect()) == [("x", 3), ("y", 3)]
    again = snapshots.new_snapshots(snapshots.payload_files(spark, str(tmp_path)), first, at)
    assert [r.source for r in again.collect()] == ["y"] and snapshots.last_kept(first.unionByName(again), 1, at).count() == 2


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_identities(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300, 340)]
    pairs = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)] + chain + [(5, 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.label for r in identity.components(df).collect()}
    assert got == groups(pairs, {x for p in pairs for x in p})
    official = set(range(0, 60, 2))
    tiers = [rng.randrange(2) for _ in pairs]
    label, open_ = {x: x for p in pairs for x in p}, []
    for tier in (0, 1):
        joint = groups([(label[a], label[b]) for (a, b), t in zip(pairs, tiers) if t == tier], set(label.values()))
        for g in set(joint.values()):
            members = [i for i in label if joint[label[i]] == g]
            n = sum(i in official for i in members)
            if n > 1 and len({label[i] for i in members}) > 1:
                open_.append((g, tier, n))
            else:
                label |= {i: g for i in members} if len({label[i] for i in members}) > 1 else {}
    name = {g: min((i for i in label if label[i] == g and i in official), default=g) for g in label.values()}
    mapping, conflicts = identity.reconciled(spark.createDataFrame([(a, b, t) for (a, b), t in zip(pairs, tiers)], "a long, b long, tier int"), spark.createDataFrame([(i,) for i in official], "id long"), 2)
    assert {r.id: r.identity for r in mapping.collect()} == {i: name[g] for i, g in label.items() if name[g] != i}
    assert sorted(map(tuple, conflicts.collect())) == sorted(open_) and open_
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i) for i in range(-60, 60)], "x long, y long")
    moved = identity.rekeyed(rows, mapping, ["x", "y"])
    assert moved.count() == 120 and {r.x for r in moved.collect()} == {name.get(label.get(i), i) for i in range(-60, 60)}
