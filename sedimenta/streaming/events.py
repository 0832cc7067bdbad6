"""Streams of events: windows, sessions, deduplication, limits, and ingest with an idempotent sink.

Every function takes and gives an unbounded DataFrame (``ingest`` gives a query, ``rate_limited`` what it drained);
state is bounded by watermarks or by the window of a limit. ``run_once`` drains what is there and gives the result as a table, with its checkpoint and output in
the folder all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.state import limit_rate
from sedimenta.sources import scratch_dir


def read_stream(spark: SparkSession, pattern: str, ts: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``ts`` becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(pattern).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(pattern).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str, late: str) -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    s = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """The first event of each key; keys are remembered for ``within``."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, ts: str, key: str, record: str, capacity: int, seconds: int) -> DataFrame:
    """Sliding-window limiter over a stream, drained into a table (record, allowed). Exact if events arrive in order.

    Each micro-batch is limited by the batch operator, which streams a hot key through in time order; what it must know of
    earlier batches, the accepted times of the last window, is a table written under the batch's number, so a repeated
    batch overwrites itself.
    """
    spark, base = events.sparkSession, f"{scratch_dir(events.sparkSession)}/limit-{uuid.uuid4().hex}"
    kind = events.schema[record].dataType.simpleString()
    state = f"k {events.schema[key].dataType.simpleString()}, at timestamp"
    rows = events.select(F.col(key).alias("k"), F.col(ts).alias("at"), record)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.sparkSession.read.schema(state).parquet(f"{base}/state/batch={number - 1}") if number else None
        limit_rate(batch, "k", "at", record, capacity, seconds, kept).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        allowed = batch.sparkSession.read.schema(f"{record} {kind}, allowed boolean").parquet(f"{base}/out/batch={number}").where("allowed")
        new = batch.join(allowed.select(record), record, "left_semi").select("k", "at")
        every = new if kept is None else new.unionByName(kept)
        last = every.groupBy("k").agg(F.max("at").alias("last"))
        every.join(last, "k").where(F.col("at") > F.expr(f"last - INTERVAL {seconds} SECONDS")).select("k", "at").write.mode("overwrite").parquet(f"{base}/state/batch={number}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{record} {kind}, allowed boolean").parquet(f"{base}/out").select(record, "allowed")


def latest_usage(log: DataFrame, ts: str, user: str) -> DataFrame:
    """Tokens per user and day, by event time; ``log`` has its watermark, which bounds the days kept."""
    day = log.groupBy(F.window(ts, "1 day").alias("w"), user)
    total = F.coalesce(F.col("input_tokens").cast("long"), F.lit(0)) + F.coalesce(F.col("output_tokens").cast("long"), F.lit(0))
    return day.agg(F.sum(total).alias("tokens")).select(user, F.to_date("w.start").cast("string").alias("day"), "tokens")


def ingest(stream: DataFrame, path: str, prepare: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Each micro-batch prepared and written under its number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """All input there is, drained into a table. In complete mode the last state of the result counts."""
    spark, base = df.sparkSession, f"{scratch_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema = df.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)
