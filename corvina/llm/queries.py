"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, neardup, packing, pii, quality, secret_scan, tokens, toxicity, urls

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokens.encode_corpus(spark, docs, public_tokenizers.path(TOKENIZER))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.find(spark, docs, pii.train(docs))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(spark, table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents", "doc_id", "text"), k=2, percent=80)


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(docs, fold("doc_id", 4) != 2)
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return language.predict(spark, held, model, keep=["doc_id", "held_out"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.find_hits(spark, docs, table(spark, sf_dir, "benchmark", "item_id", "text"), window=10, keep=["doc_id"])
    return found.select("doc_id", "n_words", decontam.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    judged = quality.judge(docs).withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold("doc_id", 3) != 1)
    model = toxicity.train(docs, labels)
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    scored = toxicity.score(spark, held, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(spark, docs, public_tokenizers.path(TOKENIZER))


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_personal_data": op2_personal_data,
    "op3_url_rules": op3_url_rules,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_decontamination": op6_decontamination,
    "op7_secrets": op7_secrets,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

ORACLE: dict[str, str] = {
    "op3_url_rules": r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
""",
    "op8_quality_cascade": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
again AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT windows.doc_id, unnest(range(windows.i, windows.i + 8)) AS p FROM windows JOIN again USING (doc_id, w))
  GROUP BY doc_id),
measures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\x0B\f\r]*\z'))) AS n_cut_lines,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_list_lines
  FROM split LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words
    OR 2 * n_digits > word_chars OR 10 * n_cut_lines > 3 * n_lines OR 10 * n_list_lines > 9 * n_lines) AS kept
FROM failed
""",
}
