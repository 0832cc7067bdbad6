"""Usage roll-ups: totals per period, running budgets, latency-style percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows of an id are one record."""
    return df.dropDuplicates([key])


def daily(df: DataFrame, keys: Sequence[str], ts: str, amounts: Sequence[str]) -> DataFrame:
    """Sums per key and calendar day (half-open days, so a row at midnight counts once)."""
    sums = [F.sum(F.coalesce(F.col(a).cast("long"), F.lit(0))).alias(f"sum_{a}") for a in amounts]
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, F.to_date(ts).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def total_since(df: DataFrame, key: str, ts: str, since: Column, amount: Column) -> DataFrame:
    """Per key the amount since a moment; keys without rows since then have 0."""
    return df.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col(ts) >= since, amount)), F.lit(0)).alias("total"))


def budget_breaches(df: DataFrame, key: str, ts: str, record: str, amount: Column, budget: int) -> DataFrame:
    """Rows that lift a key's running total of the day above the budget; budget 0 switches the check off.

    The window is per key and day, so its size is bounded by what a key does in a day.
    """
    day = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, record).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.where(F.col(ts).isNotNull()).withColumn("running", F.sum(amount).over(day)).where(F.lit(budget > 0) & (F.col("running") > budget)).select(record, key, "running")


def spread(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean and exact percentiles per key."""
    points = F.percentile(value, F.array(*[F.lit(s) for s in shares]))
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), points.alias("p"))
    return out.select(*keys, "n", "mean", *[F.get("p", F.lit(i)).alias(f"p{round(s * 100)}") for i, s in enumerate(shares)])
