"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductlake.llm import exact_dedup, language, lexical, licences, mixing, neighbours, packing, ppm, quality, simhash, simple8b, spelling, urls


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op2_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), bits=3, shingle=3)


def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"), exponent=0.5, budget=1.0, seed=17)


def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    odds = quality.fit(documents, table(spark, sf, "labels").where(remainder(4) != 2))
    return quality.quality_scores(documents, odds).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


def op6_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf, "documents"), remainder(7) == 2)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf, "pages"), RULES)


def op8_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), "id % 20 = 0", k=20)


def op9_id_files(spark: SparkSession, sf: str) -> DataFrame:
    return simple8b.ids_by_files(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    model = language.fit(documents.where(remainder(5) != 0))
    return language.identify_languages(documents.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    scanned = licences.licence_scan(table(spark, sf, "documents"))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"))


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


QUERIES = {q.__name__: q for q in (
    op1_best_fit_packing, op2_simhash_near_dedup, op3_source_mixing, op4_quality_classifier, op5_exact_dedup,
    op6_lm_scoring, op7_url_filter, op8_nearest_neighbours, op9_id_files, op10_language_id,
    op11_licence_scan, op12_spelling_variants, op13_lexical_search,
)}

ORACLE = {
    "op13_lexical_search": r"""
WITH found AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT row, doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
counts AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM items) GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, totals),
scores AS (
  SELECT i.item_id, c.row, c.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM items AS i JOIN counts AS c USING (term) JOIN weights AS w USING (term), totals GROUP BY i.item_id, c.row, c.doc_id)
SELECT item_id, CAST(row_number() OVER same AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW same AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER same <= 10
""",
    "op3_source_mixing": """
WITH sizes AS (
  SELECT source, CAST(sum(greatest(1, coalesce(length(text), 0))) AS BIGINT) AS size FROM documents GROUP BY source),
weights AS (SELECT source, size, pow(CAST(size AS DOUBLE), 0.5) AS weight FROM sizes),
scale AS (SELECT CAST(sum(size) AS DOUBLE) / CAST(sum(CAST(weight AS DECIMAL(30, 6))) AS DOUBLE) AS s FROM weights),
rates AS (SELECT source, round(weight * s / size, 9) AS rate FROM weights, scale),
parted AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 16) AS INTEGER)) AS parts FROM rates),
terms AS (
  SELECT source, CAST(k AS INTEGER) AS k, sum(exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS total
  FROM parted, generate_series(0, 63) AS g(k)),
ids AS (SELECT DISTINCT doc_id, source FROM documents),
numbers AS (
  SELECT doc_id, i.source, part,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(part AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 AS at
  FROM ids AS i JOIN parted AS p ON i.source IS NOT DISTINCT FROM p.source, generate_series(1, p.parts) AS g(part)),
counts AS (
  SELECT n.doc_id, n.source, CAST(count(t.k) AS INTEGER) AS copies
  FROM numbers AS n JOIN terms AS t ON n.source IS NOT DISTINCT FROM t.source AND n.at >= t.total GROUP BY n.doc_id, n.source)
SELECT d.*, p.rate, c.copies, CAST(g.copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('17|order|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || CAST(g.copy AS VARCHAR)), 1, 12) AS BIGINT) AS shuffle_key
FROM documents AS d
JOIN counts AS c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source
JOIN parted AS p ON d.source IS NOT DISTINCT FROM p.source, generate_series(1, c.copies) AS g(copy)
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op7_url_filter": r"""
WITH parsed AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
cased AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parsed),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (
  SELECT c.*, r.rule_host || r.rule_path AS rule, r.verdict AS rule_verdict
  FROM cased AS c LEFT JOIN rules AS r ON (c.host = r.rule_host OR ends_with(c.host, '.' || r.rule_host)) AND starts_with(c.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fitting
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
""",
}
