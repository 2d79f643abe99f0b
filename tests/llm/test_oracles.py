"""The queries whose rows SQL can express, against DuckDB over the same whole tables."""

import os

import duckdb
import pytest

from boxlake.llm.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"create view {view} as select * from '{DIR}/{view}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_links_on_edges(spark, tmp_path):
    """Null, blank and short texts, copies, exactly 0.8 and just under, non-ASCII blanks and capitals."""
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \t\n ", "one two", "One  TWO", "one two three", " ".join(words[:22]), " ".join(words[:18] + ["x"]), " ".join(words[:20]), " ".join(words[:22]).upper(), "Éa b c d e f", "éa b c d e f", "a b c d e f g"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["op9_ngram_jaccard_join"])
    got = QUERIES["op9_ngram_jaccard_join"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
