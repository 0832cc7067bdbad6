"""Streaming queries, drained once over the given tables; their SQL twins are the batch answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import streaming
from sedimenta.plans.usage_state import LIMITED
from sedimenta.sources import is_folder, scratch_dir
from sedimenta.streaming.events import read_stream


def _table(spark: SparkSession, d: str, name: str, ts: str) -> DataFrame:
    """A table as a stream; it may be one file or a folder of files."""
    path = f"{d}/{name}.parquet"
    return read_stream(spark, f"{path}/*.parquet" if is_folder(spark, path) else f"{path}*", ts)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    counted = streaming.run_once(streaming.windowed_counts(_table(spark, d, "events", "ts"), "ts", "event_type", "value", "1 day", "1 day"), "complete")
    return counted.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    calls = _table(spark, d, "code_method_call", "created_at")
    return streaming.run_once(streaming.deduplicated(calls, "created_at", ["id"], "400 days").select("id", "project_id", "method_name"))


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return streaming.rate_limited(_table(spark, d, "events", "ts"), "ts", "user_id", "event_id", 3, 86_400)


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of live text taken in by micro-batches: each batch is prepared and written under its number."""
    base = f"{scratch_dir(spark)}/ingest-{uuid.uuid4().hex}"
    prepare = lambda batch: batch.where(F.length(F.trim("content")) > 0).select("id", "doc_id", F.length("content").alias("n_chars")).dropDuplicates(["id"])
    streaming.ingest(_table(spark, d, "document_chunk", "created_at"), f"{base}/out", prepare, f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("id long, doc_id long, n_chars int").parquet(f"{base}/out").select("id", "doc_id", "n_chars").dropDuplicates(["id"])


def stream_usage(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "token_usage_log", "created_at").where("user_id IS NOT NULL AND created_at IS NOT NULL")
    return streaming.run_once(streaming.latest_usage(streaming.deduplicated(log, "created_at", ["id"], "30 days"), "created_at", "user_id"), "complete")


QUERIES = {f.__name__: f for f in (stream_windows, stream_dedup, stream_rate_limit, stream_usage, stream_ingest)}

SQL = {
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT DISTINCT id, project_id, method_name FROM code_method_call",
    "stream_rate_limit": LIMITED,
    "stream_ingest": "SELECT DISTINCT id, doc_id, CAST(length(content) AS INT) AS n_chars FROM document_chunk WHERE length(trim(content)) > 0",
    "stream_usage": """SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens
FROM (SELECT DISTINCT ON (id) * FROM token_usage_log WHERE user_id IS NOT NULL AND created_at IS NOT NULL) t GROUP BY 1, 2""",
}
