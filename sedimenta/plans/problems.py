"""Queries of the general data problems: rolling totals (2) and broken references (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.references import broken_references, integers_in, report
from sedimenta.operators.rolling import latest_rows, silent_days, trailing_totals
from sedimenta.sources import load

AMOUNTS = ("input_tokens", "output_tokens")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    return trailing_totals(load(spark, d, "token_usage_log"), "user_id", "created_at", AMOUNTS, record_id="id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return silent_days(p2_rolling(spark, d), "user_id", AMOUNTS)


def _refs(df: DataFrame, table: str, field: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(field).alias("field"), F.col("id").alias("row_id"), F.col("key").alias("ref_key"), F.col("created_at").alias("ref_created_at"))


def _scalar(df: DataFrame, table: str, field: str) -> DataFrame:
    rows = latest_rows(df.select("id", F.col(field).alias("key"), "created_at"), "id", ["created_at"], ["key", "created_at"])
    return _refs(rows, table, field)


def p4_findings(spark: SparkSession, d: str) -> DataFrame:
    chunks, points, calls = (load(spark, d, t) for t in ("document_chunk", "knowledge_point", "code_method_call"))
    no = F.lit(False)
    documents = latest_rows(load(spark, d, "knowledge_document").select("id", "updated_at", "created_at", "deleted"), "id", ["updated_at"], ["created_at", "deleted"])
    documents = documents.select(F.col("id").alias("key"), "created_at", F.coalesce(F.col("deleted") == 1, no).alias("gone"))
    projects = latest_rows(load(spark, d, "code_project").select("id", "updated_at", "created_at", "status"), "id", ["updated_at"], ["created_at", "status"])
    projects = projects.select(F.col("id").alias("key"), "created_at", F.coalesce(F.upper("status") == "ARCHIVED", no).alias("gone"))
    chunk_keys = chunks.groupBy(F.col("id").alias("key")).agg(F.max("created_at").alias("created_at")).withColumn("gone", no)
    listed = latest_rows(points.select("id", "chunk_ids", "created_at"), "id", ["created_at"], ["chunk_ids", "created_at"])
    listed = listed.select("id", F.explode(integers_in("chunk_ids")).alias("key"), "created_at")
    to_projects = _scalar(points, "knowledge_point", "related_project_id").unionByName(_scalar(calls, "code_method_call", "project_id"))
    return (
        broken_references(_scalar(chunks, "document_chunk", "doc_id"), documents)
        .unionByName(broken_references(_refs(listed, "knowledge_point", "chunk_ids"), chunk_keys))
        .unionByName(broken_references(to_projects, projects))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_findings(spark, d).select("table_name", "field", "row_id", "ref_key")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return report(p4_findings(spark, d))


QUERIES = {"p2_rolling": p2_rolling, "p2_found": p2_found, "p4_found": p4_found, "p4_report": p4_report}

_ROLLING = """
WITH r AS (
  SELECT user_id, CAST(created_at AS DATE) AS d, coalesce(input_tokens, 0) AS i, coalesce(output_tokens, 0) AS o
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) AS rn FROM token_usage_log) t
  WHERE rn = 1 AND user_id IS NOT NULL AND created_at IS NOT NULL),
g AS (SELECT user_id, d, count(*) AS n, sum(i) AS i, sum(o) AS o FROM r GROUP BY user_id, d),
cal AS (SELECT user_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM g GROUP BY user_id),
f AS (SELECT cal.user_id, cal.d, coalesce(n, 0) AS n, coalesce(i, 0) AS i, coalesce(o, 0) AS o
      FROM cal LEFT JOIN g ON g.user_id = cal.user_id AND g.d = cal.d),
w AS (SELECT user_id, strftime(d, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n_rows,
  CAST(sum(i) OVER w7 AS BIGINT) AS i7, CAST(sum(o) OVER w7 AS BIGINT) AS o7, CAST(sum(i) OVER w30 AS BIGINT) AS i30, CAST(sum(o) OVER w30 AS BIGINT) AS o30
  FROM f WINDOW w7 AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                w30 AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

_BROKEN = """
WITH doc AS (SELECT id, created_at, deleted = 1 AS gone FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM knowledge_document) t WHERE rn = 1),
prj AS (SELECT id, created_at, coalesce(upper(status) = 'ARCHIVED', false) AS gone FROM code_project),
chk AS (SELECT id, max(created_at) AS created_at, false AS gone FROM document_chunk GROUP BY id),
refs AS (
  SELECT DISTINCT 'document_chunk' AS table_name, 'doc_id' AS field, id AS row_id, doc_id AS ref_key, created_at, 'doc' AS target FROM document_chunk
  UNION ALL SELECT DISTINCT 'knowledge_point', 'chunk_ids', id, CAST(unnest(regexp_extract_all(chunk_ids, '[0-9]+')) AS BIGINT), created_at, 'chk' FROM knowledge_point
  UNION ALL SELECT DISTINCT 'knowledge_point', 'related_project_id', id, related_project_id, created_at, 'prj' FROM knowledge_point
  UNION ALL SELECT DISTINCT 'code_method_call', 'project_id', id, project_id, created_at, 'prj' FROM code_method_call),
parents AS (SELECT 'doc' AS target, * FROM doc UNION ALL SELECT 'chk', * FROM chk UNION ALL SELECT 'prj', * FROM prj),
bad AS (
  SELECT DISTINCT r.table_name, r.field, r.row_id, r.ref_key, r.created_at,
    CASE WHEN p.id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.created_at > r.created_at THEN 'later' END AS reason
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.id = r.ref_key WHERE r.ref_key IS NOT NULL)
"""

SQL = {
    "p2_rolling": _ROLLING + """
SELECT user_id, day, n_rows, i7 AS input_tokens_total_7, i7 / 7.0 AS input_tokens_avg_7, o7 AS output_tokens_total_7, o7 / 7.0 AS output_tokens_avg_7,
  i30 AS input_tokens_total_30, i30 / 30.0 AS input_tokens_avg_30, o30 AS output_tokens_total_30, o30 / 30.0 AS output_tokens_avg_30 FROM w""",
    "p2_found": _ROLLING + "SELECT user_id, day FROM w WHERE n_rows = 0 AND i7 + o7 > 0",
    "p4_found": _BROKEN + "SELECT table_name, field, row_id, ref_key FROM bad WHERE reason IS NOT NULL",
    "p4_report": _BROKEN + """
SELECT table_name, field, strftime(created_at, '%Y-%m') AS month, count(*) AS n_references,
  count(*) FILTER (WHERE reason = 'missing') AS n_missing, count(*) FILTER (WHERE reason = 'deleted') AS n_deleted, count(*) FILTER (WHERE reason = 'later') AS n_later
FROM bad WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
}
