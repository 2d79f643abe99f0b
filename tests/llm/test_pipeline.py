import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    parts = {"xx": ["tha", "ing", "re", "on"], "yy": ["sch", "ung", "ei", "lich"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(i, text(lang), lang, "s", 0) for i, lang in enumerate(["xx", "yy"] * 30)]
    rows += [(100, rows[3][1] + " tail", "yy", "s", 0), (101, rows[3][1], "yy", "s", 0), (102, None, "xx", "s", 0), (103, "123 456", "xx", "s", 0)]
    rows += [(104, text("xx") + ' token = "0123456789abcdef0123456789abcdef"', "xx", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        seen.append({r.doc_id: r for r in at.collect()})
    assert set(seen[0]) == set(range(60)) | {100, 101, 104}
    assert set(seen[1]) == set(range(60)) | {104}
    assert set(seen[2]) == set(seen[1]) and seen[2][104].text.endswith(' [SECRET]"') and seen[2][104].n_chars == len(seen[2][104].text)
    assert all(seen[2][i].text == rows[i][1] for i in range(60))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[2])
