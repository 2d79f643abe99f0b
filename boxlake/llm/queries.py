"""The registered queries of the operators: thin wrappers with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlake.llm import alignment, bpe, chat, fingerprints, importance, langid, licenses, mixing, neighbours, packing, secrets, sharding, similarity


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return chat.read_back(chat.prefix_target_examples(turns.unionByName(extra)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampling_plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_chat_formatting, op3_sharding, op4_bpe, op5_best_fit_packing, op6_secret_scan, op7_nearest_neighbours, op8_language_id, op9_ngram_jaccard_join, op10_fingerprints, op11_source_mixing, op12_importance_resampling, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place, len(w) AS words FROM worded
), runs AS (
    SELECT doc_id, place, words, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS shingle
    FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY place)
), held AS (
    SELECT DISTINCT doc_id, shingle FROM runs WHERE place = 1 OR place + 4 <= words
), sets AS (
    SELECT doc_id, count(shingle) AS n FROM documents LEFT JOIN held USING (doc_id) GROUP BY doc_id
), postings AS (
    SELECT doc_id, n, shingle FROM held JOIN sets USING (doc_id)
), linked AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN linked l ON l.a = r.other
)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id
FROM sets JOIN reached USING (doc_id)
GROUP BY doc_id
""",
    "op11_source_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        ([3, 1, 2])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, CAST(2 AS DOUBLE) * source_size AS cap,
        (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - CAST(2 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
    FROM sources WINDOW o AS (ORDER BY CAST(2 AS DOUBLE) * source_size / weight, source IS NULL, source)
), targets AS (
    SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
), placed AS (
    SELECT s.doc_id, s.size, t.*, row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(CAST(s.doc_id AS VARCHAR)) NULLS FIRST, s.doc_id NULLS FIRST) - 1 AS nth,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1073741824) AS BIGINT) ELSE 0 END AS expected
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), starts AS (
    SELECT source, draw, 4 * CAST('0x' || substr(md5('11:' || draw || ':' || coalesce(source, '')), 1, 7) AS BIGINT) AS start FROM targets, range(16) r(draw)
), copied AS (
    SELECT p.*, draw, ((expected % 1073741824) * (nth % 1073741824) + start) % 1073741824 + expected AS reached
    FROM placed p JOIN starts s ON s.source IS NOT DISTINCT FROM p.source
), missed AS (
    SELECT source, draw, abs(CAST(sum(size * (reached >> 30)) AS BIGINT) - any_value(target)) AS miss FROM copied GROUP BY source, draw
), chosen AS (
    SELECT source, arg_min(draw, (miss, draw)) AS draw FROM missed GROUP BY source
)
SELECT doc_id, size, source_size, target, size * (reached >> 30) AS taken
FROM copied c JOIN chosen d ON d.source IS NOT DISTINCT FROM c.source AND d.draw = c.draw
""",
    "op12_importance_resampling": r"""
WITH places AS (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) r(k)
), crcs AS (
    SELECT list(crc ORDER BY k) AS crc FROM places
), texts AS (
    SELECT 0 AS wanted, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), worded AS (
    SELECT wanted, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
    SELECT wanted, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM worded
), known AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(feature)), lambda i: CAST('0x' || substr(hex(feature), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM features), crcs
), counted AS (
    SELECT bucket, count(*) FILTER (wanted = 0) AS s, count(*) FILTER (wanted = 1) AS t FROM features JOIN known USING (feature) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (CAST(sum(s) OVER () AS BIGINT) + 10000) AS DOUBLE) / CAST((s + 1) * (CAST(sum(t) OVER () AS BIGINT) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counted
), meant AS (
    SELECT id AS doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS BIGINT) / count(*)) AS BIGINT) AS weight
    FROM features JOIN known USING (feature) JOIN gains USING (bucket) WHERE wanted = 0 GROUP BY id
), scored AS (
    SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
    FROM worded LEFT JOIN meant ON meant.doc_id = worded.id WHERE wanted = 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, 25 * count(*) FILTER (fit) OVER () // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM placed
""",
}
