"""Queries of the corpus operators over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandloom.llm import chat, decontaminate, html_extract, language_id, licenses, matroska, near_dedup, packing, quality, warc
from brandloom.llm.common import read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.describe(matroska.encode(read(spark, sf_dir, "documents")))


def media_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet tables of op3's files."""
    return matroska.packets(matroska.encode(read(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rate(docs, *quality.fit(docs))


def labeller_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 has learned of its labellers."""
    return quality.accuracies(spark, quality.weak_labels(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("url")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(read(spark, sf_dir, "documents"), percent=80, size=2)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_perspectives": op2_perspectives,
        "op3_matroska": op3_matroska,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_language_id": op5_language_id,
        "op6_quality": op6_quality,
        "op7_warc_index": op7_warc_index,
        "op8_decontaminate": op8_decontaminate,
        "op9_setsketch_dedup": op9_setsketch_dedup,
        "op10_licenses": op10_licenses,
        "labeller_accuracies": labeller_accuracies,
        "media_packets": media_packets,
    }


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT hex, min(page_id) AS first FROM p GROUP BY hex
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""
OP8_SQL = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM w WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS s
  FROM (SELECT doc_id, ws, l, unnest(range(1, greatest(len(ws) - l + 2, 1))) AS i FROM d, (SELECT DISTINCT l FROM win))
), hit AS (
  SELECT doc_id, dw.l, i, item_id FROM dw JOIN win ON dw.s = win.s AND dw.l = win.l
), n AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), e AS (
  SELECT x, y FROM link UNION SELECT y, x FROM link
), reach AS (
  SELECT x AS doc_id, x AS r FROM e UNION SELECT doc_id, y FROM reach JOIN e ON reach.r = e.x
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, w.doc_id = coalesce(c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_perspectives": chat.DUCKDB_SQL,
        "op7_warc_index": OP7_SQL,
        "op8_decontaminate": OP8_SQL,
        "op9_setsketch_dedup": OP9_SQL,
        "op10_licenses": licenses.duckdb_sql(),
    }
