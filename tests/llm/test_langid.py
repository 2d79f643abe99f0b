import itertools
import random

import numpy as np
import pytest

from boxlake.llm.langid import Chain, identify, keep_identified, label_texts, train, training_sample, words_of

PARTS = {"xx": ["tha", "ing", "re", "on"], "yy": ["sch", "ung", "ei", "lich"], "zz": ["ció", "os", "que", "rra"]}


def text(lang, rng, n=30):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(1)
    return train([(text(lang, rng, 80), lang) for lang in PARTS for _ in range(20)])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    chain = Chain(["a", "b"], {f: i for i, f in enumerate(["=u", "=v", "=w"])}, rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    texts = [["u", "w", "v", "u"], [], ["v"], ["w", "w", "q", "u", "v", "v"]]
    for words, got in zip(texts, chain.marginals(texts)):
        want, total = np.zeros((len(words), 2)), 0.0
        for path in itertools.product(range(2), repeat=len(words)):
            score = sum(chain.weights[chain.rows[f"={w}"]][p] if f"={w}" in chain.rows else 0 for w, p in zip(words, path))
            score += sum(chain.transitions[a, b] for a, b in zip(path, path[1:]))
            total += np.exp(score)
            for i, p in enumerate(path):
                want[i, p] += np.exp(score)
        assert np.allclose(got, want / total)


def test_held_out_accuracy_and_switches(chain):
    rng = random.Random(2)
    cases = [(lang, text(lang, rng, 12)) for lang in PARTS for _ in range(60)]
    assert np.mean([label_texts([t], chain)[0][0] == lang for lang, t in cases]) > 0.97
    right = total = 0
    for _ in range(40):
        a, b = rng.sample(sorted(PARTS), 2)
        words = words_of(text(a, rng, 15) + " " + text(b, rng, 15))
        labels = chain.marginals([words])[0].argmax(axis=1)
        right += sum(chain.languages[x] == (a if i < 15 else b) for i, x in enumerate(labels))
        total += 30
    assert right / total > 0.95


def test_edges(chain):
    assert label_texts([None, "", "12 3!", "²³"], chain) == [("und", 0.0)] * 4
    long = label_texts(["schung " * 30_000, "x"], chain)[0]
    assert long[0] == "yy" and 0.9 < long[1] <= 1
    assert train([]) is None and label_texts(["a"], None) == [("und", 0.0)]


def test_frames(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, rng), lang if i % 5 else None, "s") for i, lang in enumerate(list(PARTS) * 40)] + [(1000, None, "xx", "s"), (1000, None, "xx", "s"), (None, text("xx", rng), "xx", "s"), (1001, "77", "yy", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, lang in enumerate(list(PARTS) * 40)}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.doc_id in truth]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001)} == {"und"}
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {1000, 1001}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 119
    assert identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("lang is null")).collect()} <= {"und"}


def test_every_letter_of_a_long_run_has_a_say(chain):
    rng = random.Random(4)
    glued = {lang: text(lang, rng, 600).replace(" ", "") for lang in PARTS}
    for size in (1, 39, 40, 41, 42, 77, 78, 79, 1000):
        run = glued["xx"][:size]
        pieces = words_of(run)
        assert max(map(len, pieces)) <= 40 and pieces[0] + "".join(p[2:] for p in pieces[1:]) == run
        assert {run[i : i + 3] for i in range(size - 2)} == {p[i : i + 3] for p in pieces for i in range(len(p) - 2)}
    for head in PARTS:
        for body in set(PARTS) - {head}:
            assert label_texts([glued[head][:80] + glued[body]], chain)[0][0] == body


def test_sample_is_of_distinct_documents(spark):
    rows = [(i, f"{lang} text {i}", lang) for i in range(0, 2000) for lang in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = training_sample(docs)
    assert [lang for _, lang in plain] == ["xx"] * 100 + ["yy"] * 100 and len(set(plain)) == 200
    hot = [r for r in rows if (r[1], r[2]) in plain[::50]]
    assert training_sample(spark.createDataFrame(rows + hot * 300, docs.schema)) == plain
