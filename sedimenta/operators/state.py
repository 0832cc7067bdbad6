"""Keyed state as batch operators: deduplication, rate limits, caches, memories and facts.

Each keeps the order of a key's rows with a window or a grouped fold; a key's rows are the unit of work. The streaming
counterparts are in ``sedimenta.streaming``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def attempts_in_window(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Adds how many of the key's rows lie in the ``seconds`` before and at each row (all attempts, also refused ones).

    A key's rows are cut into stretches of that length, each with a copy of the one before it as its halo, so a hot key is
    many groups."""
    stretch = F.floor(micros(ts) / (seconds * 1_000_000))
    own = df.withColumns({"_stretch": stretch, "_halo": F.lit(False)})
    both = own.unionByName(df.where(F.col(ts).isNotNull()).withColumns({"_stretch": stretch + 1, "_halo": F.lit(True)}))
    recent = Window.partitionBy(*keys, "_stretch").orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumn("attempts", F.count(F.lit(1)).over(recent)).where("NOT _halo").drop("_halo", "_stretch")


def limit_rate(df: DataFrame, keys: str | Sequence[str], ts: str, record: str, capacity: int, seconds: int, accepted: DataFrame | None = None) -> DataFrame:
    """The exact sliding-window limiter: a row is accepted if fewer than ``capacity`` accepted rows lie in the window.

    Only accepted rows count, which no window function can say. Rows are sorted within partitions by key and time and
    folded in one pass; the fold keeps at most ``capacity`` times of the current key, so a hot key needs no memory.
    ``accepted`` (keys, ts) are rows accepted before.
    """
    window, keys = seconds * 1_000_000, [keys] if isinstance(keys, str) else list(keys)
    parts = [f"k{i}" for i in range(len(keys))]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = object(), []
        for rows in batches:
            verdicts = []
            for *k, at, before in zip(*(rows[p] for p in parts), rows["at"], rows["before"]):
                if k != current:
                    current, kept = k, []
                while kept and kept[0] <= at - window:
                    kept.pop(0)
                allowed = before or len(kept) < capacity
                if allowed:
                    kept.append(at)
                verdicts.append(allowed)
            yield pd.DataFrame({record: rows[record], "allowed": verdicts})[~rows["before"]]

    def shaped(x: DataFrame, before: bool) -> DataFrame:
        own = F.lit(None).cast(df.schema[record].dataType).alias(record) if before else F.col(record)
        return x.where(F.col(ts).isNotNull()).dropna(subset=keys).select(*[F.col(k).alias(p) for k, p in zip(keys, parts)], micros(ts).alias("at"), own, F.lit(before).alias("before"))

    rows = shaped(df, False) if accepted is None else shaped(df, False).unionByName(shaped(accepted, True))
    kind = rows.schema[record].dataType.simpleString()
    return rows.repartition(*parts).sortWithinPartitions(*parts, "at", record).mapInPandas(fold, f"{record} {kind}, allowed boolean")


def first_claims(df: DataFrame, keys: Sequence[str], ts: str, record: str, ttl_seconds: int) -> DataFrame:
    """Idempotency claims (record, claimed): a row wins if no earlier winner of its key is younger than ``ttl_seconds``.
    A refused row doesn't prolong the claim."""
    return limit_rate(df, keys, ts, record, 1, ttl_seconds).withColumnRenamed("allowed", "claimed")


def once(df: DataFrame, keys: Sequence[str], ts: str, record: str) -> DataFrame:
    """The first row of each key."""
    first = F.min(F.struct(ts, record)).alias("s")
    return df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n_seen")).select(*keys, F.col(f"s.{record}").alias(record), "n_seen")


def unexpired(df: DataFrame, ts: str, ttl_hours: int, now: Column) -> DataFrame:
    return df.where(F.expr(f"{ts} + INTERVAL {ttl_hours} HOURS") > now)


def compact_memory(df: DataFrame, key: str, order: Sequence[str], text: str, trigger: int, keep: int) -> DataFrame:
    """Conversations of more than ``trigger`` turns keep the last ``keep`` and one summary row of the older ones."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    rows = df.withColumn("back", F.row_number().over(newest)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(key)))
    kept = rows.where((F.col("size") <= trigger) | (F.col("back") <= keep)).select(key, F.lit("turn").alias("kind"), F.col("back"), F.col(text).alias("text"))
    old = rows.where((F.col("size") > trigger) & (F.col("back") > keep)).groupBy(key).agg(F.concat(F.lit("summary of "), F.count(F.lit(1)).cast("string"), F.lit(" turns")).alias("text"))
    return kept.unionByName(old.select(key, F.lit("summary").alias("kind"), F.lit(keep + 1).alias("back"), "text"))


def active_facts(df: DataFrame, key: str, superseded: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """The newest ``limit`` facts of a key that no other superseded."""
    newest = Window.partitionBy(key).orderBy(*order)
    return df.where(~superseded).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def experience_key(level: Column, route: Column, question: Column, stop: Sequence[str]) -> Column:
    """Cache key: the first 16 hex digits of a digest of level, route and the first five distinct content words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))
    terms = F.array_join(F.slice(F.array_distinct(words), 1, 5), ",")
    return F.substring(F.sha2(F.concat_ws(":", level.cast("string"), route, terms), 256), 1, 16)
