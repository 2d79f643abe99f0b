"""Ids come out as they went in, also above 2**53 and beside a null in one Arrow batch; empty tables give empty results; the session's settings stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxlake.llm import alignment, bpe, chat, fingerprints, importance, langid, licenses, mixing, neighbours, packing, secrets, sharding, similarity
from boxlake.llm.queries import byte_bpe, piece_bpe

LARGE = 2**60 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(LARGE, "the rain in spain stays mainly in the plain " * 2, "en", "a", 88), (None, "der regen in spanien bleibt in der ebene " * 2, "de", "a", 82), (LARGE + 2, "mit license", "en", "b", 11)]
EACH = {
    "licenses": licenses.scan_licenses,
    "chat": lambda docs: chat.read_back(chat.prefix_target_examples(docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text"))).withColumnRenamed("conv_id", "doc_id"),
    "sharding": sharding.shard_documents,
    "encode": lambda docs: bpe.encode_documents(docs, byte_bpe()),
    "digest": lambda docs: bpe.digest_documents(docs, byte_bpe()),
    "packing": lambda docs: packing.pack_documents(docs, byte_bpe()),
    "secrets": secrets.secret_report,
    "identify": langid.identify,
    "near_duplicates": similarity.near_duplicates,
    "keep_one": similarity.keep_one,
    "fingerprints": fingerprints.fingerprint_documents,
    "edited": fingerprints.compare_edited,
    "mixing": mixing.mixture_report,
    "importance": lambda docs: importance.resampling_plan(docs, docs.select("text")),
    "alignment": lambda docs: alignment.alignment_report(docs, byte_bpe(), piece_bpe()),
}


@pytest.mark.parametrize("name", EACH)
def test_ids_and_empty_tables(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    held = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    out = EACH[name](docs)
    assert {r.doc_id for r in out.collect()} == {LARGE, None, LARGE + 2}
    assert {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in held} == held
    empty = EACH[name](docs.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_neighbours(spark):
    rows = [(v, [float(i), 1.0]) for i, v in enumerate([LARGE - LARGE % 50, None, LARGE + 2])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(LARGE - LARGE % 50, LARGE + 2)}


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert kept and kept == {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} <= {LARGE, None, LARGE + 2}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
