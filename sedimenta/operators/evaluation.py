"""Retrieval quality: per-query metrics against expected items, means, parameter grids, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: k, cut and floor that a search has unless told otherwise.
BASELINE = (8, 4, 0.7)


def query_metrics(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hit@4, hit@8, recall@8, reciprocal rank and precision@4 of (query_id, rank, item) against (query_id, item).

    A query that expects nothing has all ones; one that retrieved nothing all zeros.
    """
    expected = qrels.groupBy("query_id").agg(F.count_distinct("item").alias("n_expected"))
    hits = runs.join(qrels.distinct(), ["query_id", "item"], "left_semi")
    rank = F.col("rank")
    found = hits.groupBy("query_id").agg(F.min("rank").alias("best"), F.count_if(rank <= 4).alias("in4"), F.count_if(rank <= 8).alias("in8"))
    got = runs.where(rank <= 4).groupBy("query_id").agg(F.count_distinct("item").alias("got4"))
    j = expected.join(found, "query_id", "left").join(got, "query_id", "left")
    best = F.col("best")
    return j.select(
        "query_id", F.coalesce(best <= 4, F.lit(False)).cast("double").alias("hit4"), F.coalesce(best <= 8, F.lit(False)).cast("double").alias("hit8"),
        F.coalesce(F.col("in8") / F.col("n_expected"), F.lit(0.0)).alias("recall8"), F.coalesce(1.0 / best, F.lit(0.0)).alias("rr"), F.coalesce(F.col("in4") / F.col("got4"), F.lit(0.0)).alias("precision4"),
    )


def summary(metrics: DataFrame, *keys: str) -> DataFrame:
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("hit4", "hit8", "recall8", "rr", "precision4")]
    out = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means)
    return out.withColumn("composite", F.round(0.35 * F.col("hit4") + 0.25 * F.col("rr") + 0.2 * F.col("recall8") + 0.2 * F.col("precision4"), 6))


def keep_snapshots(runs: DataFrame, at: str, most: int = 50, days: int = 30) -> DataFrame:
    """The newest ``most`` summaries of runs within ``days`` of the newest, each marked if it is the best by composite
    (of equals the newer)."""
    last = runs.agg(F.max(at).alias("last_run"))
    kept = runs.crossJoin(F.broadcast(last)).where(F.col(at) > F.expr(f"last_run - INTERVAL {days} DAYS")).drop("last_run")  # one row
    kept = kept.orderBy(F.col(at).desc()).limit(most)  # the retention itself
    best = kept.agg(F.max(F.struct("composite", at)).alias("top"))
    return kept.crossJoin(F.broadcast(best)).withColumn("best", (F.col("composite") == F.col("top.composite")) & (F.col(at) == F.col(f"top.{at}"))).drop("top")


def grid(spark: SparkSession, ks: Sequence[int], cuts: Sequence[int], floors: Sequence[float]) -> DataFrame:
    """The defaults as ``baseline`` and all combinations; a cut above its k is left out. As many rows as the lists make."""
    rows = [("baseline", *BASELINE)] + [(f"k{k}-n{n}-f{f}", k, n, f) for k in ks for n in cuts for f in floors if n <= k]
    return spark.createDataFrame(rows, "label string, k int, cut int, floor double")


def grid_search(runs: DataFrame, qrels: DataFrame, params: DataFrame) -> DataFrame:
    """Every combination really applied: all runs of all combinations in one plan."""
    best = runs.groupBy("query_id").agg(F.max("score").alias("best"))
    tried = runs.join(best, "query_id").crossJoin(F.broadcast(params)).where((F.col("rank") <= F.col("k")) & (F.col("rank") <= F.col("cut")) & (F.col("score") >= F.col("floor") * F.col("best")))
    every = qrels.crossJoin(F.broadcast(params.select("label"))).select(F.struct("label", "query_id").alias("query_id"), "item")
    metrics = query_metrics(tried.select(F.struct("label", "query_id").alias("query_id"), "rank", "item"), every)
    return summary(metrics.select(F.col("query_id.label").alias("label"), "hit4", "hit8", "recall8", "rr", "precision4"), "label")
