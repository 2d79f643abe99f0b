import random
import re

from boxlake.llm.licenses import PHRASES, TEMPLATES, Automaton, license_words, scan_licenses, scanner

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = [(label, i) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def test_words_and_places():
    rng = random.Random(5)
    vocabulary = " ".join(PHRASES).split() + ["the", "under", "éa", "by cc", "MIT", "License", "2.0", "x-y"]
    for _ in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", ", ", "-", "\xa0 ", "_"]) for _ in range(rng.randint(0, 40)))
        n, places, _ = scanner().scan(text)
        want_n, want = brute(text)
        assert n == want_n and sorted((p[0], p[1]) for p in places) == sorted(want), text


def test_matching_statistics():
    rng = random.Random(6)
    for _ in range(60):
        templates = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.randint(0, 4) for _ in range(40)]
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        automaton = Automaton(templates)
        for i, (state, size) in enumerate(automaton.run(text)):
            assert size == max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in runs))
            for number, end in automaton.ends[state].items() if size else ():
                assert templates[number][end + 1 - size : end + 1] == text[i + 1 - size : i + 1]


def test_templates_are_found_whole_cut_and_with_gaps():
    for label, text in TEMPLATES:
        noisy = "zz yy " + text + " zz"
        assert any(s[0] == label and s[3] == 1 for s in scanner().scan(noisy)[2])
    words = TEMPLATES[0][1].split()
    words[20] = words[45] = "changed"
    spans = scanner().scan("filler " * 9 + " ".join(words))[2]
    assert [s[0] for s in spans] == ["mit"] and spans[0][1] == 9 and spans[0][3] > 0.9
    assert scanner().scan("the software is free and the terms of this work are to be used by any person " * 20)[2] == []


def test_frames(spark):
    data = [(1, "Released under the MIT License.", "s"), (2, None, "s"), (2, None, "s"), (None, "cc-by", None), (3, "gnu general public license " * 5000, "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, labels string")
    rows = scan_licenses(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and (by[1].n_base, by[1].first_word, by[1].base_labels, by[1].score) == (1, 3, "mit", 1.0)
    assert (by[2].n_words, by[2].first_word, by[2].labels) == (0, None, "") and by[None].base_labels == "cc-by" and by[3].n_base == 5000
    assert scan_licenses(docs.limit(0)).count() == 0
    assert license_words("A1_b") == [b"a1", b"b"]


def test_ids_stay_whole(spark):
    docs = spark.createDataFrame([(2**60 + 1, "mit license"), (None, "x")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in scan_licenses(docs).collect()} == {2**60 + 1, None}
