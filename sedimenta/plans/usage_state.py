"""Queries over usage, events and conversations: roll-ups, limits, deduplication, caches, memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import state, usage
from sedimenta.sources import load


def _log(spark: SparkSession, d: str) -> DataFrame:
    return usage.first_rows(load(spark, d, "token_usage_log"), "id")


def _total():
    return F.coalesce(F.col("input_tokens").cast("long"), F.lit(0)) + F.coalesce(F.col("output_tokens").cast("long"), F.lit(0))


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(_log(spark, d).withColumn("scene", F.upper("scene")), ["user_id", "scene"], "created_at", ["input_tokens", "output_tokens"])


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).rollup("user_id", F.upper("scene").alias("scene")).agg(F.grouping_id().cast("int").alias("level"), F.sum(_total()).alias("total"), F.count(F.lit(1)).alias("n"))


def usage_since(spark: SparkSession, d: str) -> DataFrame:
    return usage.total_since(_log(spark, d), "user_id", "created_at", F.lit("2026-01-01").cast("timestamp_ntz"), _total())


def usage_breaches(spark: SparkSession, d: str) -> DataFrame:
    return usage.budget_breaches(_log(spark, d), "user_id", "created_at", "id", _total(), 20_000)


def usage_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return usage.spread(_log(spark, d).withColumn("scene", F.upper("scene")), ["scene"], "input_tokens")


def event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return usage.spread(load(spark, d, "events"), ["event_type"], "value")


def rate_attempts(spark: SparkSession, d: str) -> DataFrame:
    return state.attempts_in_window(load(spark, d, "events"), ["user_id", "event_type"], "ts", 86_400).select("event_id", "attempts", (F.col("attempts") > 3).alias("over"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return state.limit_rate(load(spark, d, "events"), "user_id", "ts", "event_id", 3, 86_400)


def idempotent_claims(spark: SparkSession, d: str) -> DataFrame:
    return state.first_claims(load(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 86_400)


def message_once(spark: SparkSession, d: str) -> DataFrame:
    calls = load(spark, d, "code_method_call")
    return state.once(calls, ["project_id", "caller_file", "method_name"], "created_at", "id")


def unexpired_points(spark: SparkSession, d: str) -> DataFrame:
    points = load(spark, d, "knowledge_point").dropDuplicates(["id"])
    return state.unexpired(points, "updated_at", 24 * 90, F.lit("2026-03-01").cast("timestamp_ntz")).select("id", "updated_at")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    points = load(spark, d, "knowledge_point").dropDuplicates(["id"]).where(F.col("source_conversation_id").isNotNull())
    return points.select(F.col("source_conversation_id").alias("conv_id"), "updated_at", "id", F.coalesce("source_question", "title").alias("text"), "status", "pattern_name")


def memory_compaction(spark: SparkSession, d: str) -> DataFrame:
    return state.compact_memory(_turns(spark, d), "conv_id", ["updated_at", "id"], "text", 4, 2)


def facts_active(spark: SparkSession, d: str) -> DataFrame:
    rows = state.active_facts(_turns(spark, d), "conv_id", F.coalesce(F.upper("status") == "ARCHIVED", F.lit(False)), [F.col("updated_at").desc(), F.col("id")], 3)
    category = F.when(F.upper("pattern_name").isin("STRATEGY", "OBSERVER"), F.upper("pattern_name")).otherwise("FACT")
    return rows.select("conv_id", "rank", "id", category.alias("category"))


def facts_superseded(spark: SparkSession, d: str) -> DataFrame:
    """A fact is superseded by the next one of its conversation and category."""
    after = Window.partitionBy("conv_id", "pattern_name").orderBy("updated_at", "id")
    return _turns(spark, d).withColumn("superseded_by", F.lead("id").over(after)).select("conv_id", "id", "superseded_by", F.col("superseded_by").isNotNull().alias("superseded"))


def experience_keys(spark: SparkSession, d: str) -> DataFrame:
    points = load(spark, d, "knowledge_point").dropDuplicates(["id"]).where(F.col("source_question").isNotNull())
    return points.select("id", state.experience_key(F.coalesce(F.col("difficulty_level"), F.lit(0)), F.lit("doc"), F.col("source_question"), ["the", "and", "with", "for", "that"]).alias("cache_key"))


def version_updates(spark: SparkSession, d: str) -> DataFrame:
    """Optimistic locking over a document's changes in order: a change applies if it brings the next version or keeps it."""
    order = Window.partitionBy("id").orderBy("updated_at", "status", "chunk_count")
    docs = load(spark, d, "knowledge_document").distinct()
    before = F.lag("version").over(order)
    return docs.select("id", "updated_at", "status", "version", (before.isNull() | F.col("version").between(before, before + 1)).alias("applies"))


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").cast("string").alias("start"), "n", "users")


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        usage_daily, usage_rollup, usage_since, usage_breaches, usage_percentiles, event_percentiles, rate_attempts, rate_limit, idempotent_claims, message_once, unexpired_points,
        memory_compaction, facts_active, facts_superseded, experience_keys, version_updates, events_tumbling, events_sliding, events_sessions,
    )
}

_LOG = "WITH log AS (SELECT *, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS total FROM (SELECT DISTINCT ON (id) * FROM token_usage_log) t) "
#: Each user's events in order, with the times that were accepted and are not older than a day.
LIMITED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT user_id, n, event_id, [us] AS kept, true AS allowed FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END, len(live) < 3 FROM (SELECT e.user_id, e.n, e.event_id, e.us, list_filter(f.kept, lambda t: t > e.us - 86400000000) AS live FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) t)
SELECT event_id, allowed FROM f"""
_TURNS = """WITH p AS (SELECT DISTINCT ON (id) * FROM knowledge_point),
turns AS (SELECT source_conversation_id AS conv_id, updated_at, id, coalesce(source_question, title) AS text, status, pattern_name FROM p WHERE source_conversation_id IS NOT NULL) """

SQL = {
    "usage_daily": _LOG + "SELECT user_id, upper(scene) AS scene, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n_rows, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS sum_input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS sum_output_tokens FROM log WHERE created_at IS NOT NULL GROUP BY 1, 2, 3",
    "usage_rollup": _LOG + "SELECT user_id, scene, CAST(grouping(user_id, scene) AS INT) AS level, CAST(sum(total) AS BIGINT) AS total, count(*) AS n FROM (SELECT user_id, upper(scene) AS scene, total FROM log) t GROUP BY ROLLUP (user_id, scene)",
    "usage_since": _LOG + "SELECT user_id, CAST(coalesce(sum(total) FILTER (WHERE created_at >= TIMESTAMP '2026-01-01'), 0) AS BIGINT) AS total FROM log GROUP BY user_id",
    "usage_breaches": _LOG + "SELECT id, user_id, CAST(running AS BIGINT) AS running FROM (SELECT id, user_id, sum(total) OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS running FROM log WHERE created_at IS NOT NULL) t WHERE running > 20000",
    "usage_percentiles": _LOG + "SELECT upper(scene) AS scene, count(*) AS n, avg(input_tokens) AS mean, quantile_cont(input_tokens, 0.5) AS p50, quantile_cont(input_tokens, 0.95) AS p95, quantile_cont(input_tokens, 0.99) AS p99 FROM log WHERE input_tokens IS NOT NULL GROUP BY 1",
    "event_percentiles": "SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "rate_attempts": "SELECT event_id, attempts, attempts > 3 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS attempts FROM events) t",
    "idempotent_claims": """WITH RECURSIVE c AS (SELECT user_id, event_type, min(ts) AS at FROM events GROUP BY 1, 2 UNION ALL SELECT e.user_id, e.event_type, min(e.ts) FROM c JOIN events e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.ts >= c.at + INTERVAL 1 DAY GROUP BY 1, 2),
w AS (SELECT min(event_id) AS event_id FROM c JOIN events e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.ts = c.at GROUP BY c.user_id, c.event_type, c.at)
SELECT event_id, event_id IN (SELECT event_id FROM w) AS claimed FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL""",
    "rate_limit": LIMITED,
    "message_once": "SELECT project_id, caller_file, method_name, first(id ORDER BY created_at, id) AS id, count(*) AS n_seen FROM code_method_call GROUP BY 1, 2, 3",
    "unexpired_points": "SELECT DISTINCT id, updated_at FROM knowledge_point WHERE updated_at + INTERVAL 2160 HOURS > TIMESTAMP '2026-03-01'",
    "memory_compaction": _TURNS + """, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY updated_at DESC, id DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS size FROM turns)
SELECT conv_id, 'turn' AS kind, CAST(back AS INT) AS back, text FROM r WHERE size <= 4 OR back <= 2
UNION ALL SELECT conv_id, 'summary', 3, 'summary of ' || count(*) || ' turns' FROM r WHERE size > 4 AND back > 2 GROUP BY conv_id""",
    "facts_active": _TURNS + """SELECT conv_id, CAST(rank AS INT) AS rank, id, CASE WHEN upper(pattern_name) IN ('STRATEGY', 'OBSERVER') THEN upper(pattern_name) ELSE 'FACT' END AS category
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY updated_at DESC, id) AS rank FROM turns WHERE NOT coalesce(upper(status) = 'ARCHIVED', false)) t WHERE rank <= 3""",
    "facts_superseded": _TURNS + "SELECT conv_id, id, superseded_by, superseded_by IS NOT NULL AS superseded FROM (SELECT *, lead(id) OVER (PARTITION BY conv_id, pattern_name ORDER BY updated_at, id) AS superseded_by FROM turns) t",
    "experience_keys": r"""WITH p AS (SELECT DISTINCT ON (id) * FROM knowledge_point),
w AS (SELECT id, coalesce(difficulty_level, 0) AS level, list_filter(string_split(regexp_replace(lower(source_question), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'with', 'for', 'that')) AS words FROM p WHERE source_question IS NOT NULL),
n AS (SELECT id, level, list_filter(words, lambda w, i: list_position(words, w) = i) AS words FROM w)
SELECT id, substring(sha256(level || ':doc:' || coalesce(array_to_string(words[1:5], ','), '')), 1, 16) AS cache_key FROM n""",
    "version_updates": "SELECT id, updated_at, status, version, b IS NULL OR version BETWEEN b AND b + 1 AS applies FROM (SELECT *, lag(version) OVER (PARTITION BY id ORDER BY updated_at, status, chunk_count) AS b FROM (SELECT DISTINCT * FROM knowledge_document) t) u",
    "events_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(unnest([0, 1]) AS INT)) AS s FROM events) t GROUP BY 1",
    "events_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
