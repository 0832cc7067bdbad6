"""References whose target is missing, deleted, or younger than the record that refers to it.

Parent keys are sorted and compressed into runs of consecutive integers, which carry nothing but their bounds. A
referenced key is matched as of the last run that starts at or before it: beyond the run's end there is no such
parent. Runs are cut at buckets of ``BUCKET`` consecutive keys, and a bucket's runs are one row, so dense keys shrink
to a row for every ``BUCKET`` of them, the match is an equi-join by bucket that Spark broadcasts where it measures
that the runs are small, and a key looks at half a bucket of runs at most. Whether a parent that exists is deleted
or younger is then read by an equi-join on the key, in the partitioning that the distinct keys already have.

References are reduced to distinct keys before they are matched, so a key named by a third of all rows is
matched once. Only keys that can give a finding are joined back to the referring rows, with the rows salted.

Defined results
* A record id that repeats is one record (the latest row of it counts); a key named twice in a record counts once.
* A null reference is none. Text lists are read as the integers written in them; a number beyond 64 bits is none.
* ``missing`` goes before ``deleted``, and that before ``later``; without a time on either side there is no ``later``.
* Empty tables: no parents makes every reference missing, no references gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 256
SALTS = 16


def integers_in(text: str):
    """All integers written in a text column, as array<long>."""
    found = F.regexp_extract_all(F.col(text), F.lit("([0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def key_runs(parents: DataFrame) -> DataFrame:
    """(bucket, runs) from unique (key): the runs of consecutive keys in a bucket, as (run_start, run_end) in order."""
    ordered = Window.partitionBy("bucket").orderBy("key")
    numbered = parents.select(F.floor(F.col("key") / BUCKET).alias("bucket"), "key").withColumn("run", F.col("key") - F.row_number().over(ordered))
    runs = numbered.groupBy("bucket", "run").agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"))
    return runs.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("run_start", "run_end"))).alias("runs"))


def match_as_of(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``present`` to each distinct key: it doesn't lie beyond the end of the last run that starts at or before it."""
    before = F.filter("runs", lambda r: r["run_start"] <= F.col("key"))
    held = F.coalesce(F.element_at(F.when(F.size(before) > 0, before), -1)["run_end"] >= F.col("key"), F.lit(False))
    joined = keys.withColumn("bucket", F.floor(F.col("key") / BUCKET)).join(runs, "bucket", "left")
    return joined.withColumn("present", held).drop("bucket", "runs")


def broken_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Findings (table_name, field, row_id, ref_key, created_at, reason).

    ``refs``: table_name, field, row_id, ref_key, ref_created_at. ``parents``: key, created_at, gone; unique keys.
    """
    refs = refs.where(F.col("ref_key").isNotNull())
    parents = parents.where(F.col("key").isNotNull())
    keys = refs.groupBy(F.col("ref_key").alias("key")).agg(F.min("ref_created_at").alias("oldest"))
    matched = match_as_of(keys, key_runs(parents.select("key")))
    # the times and marks of the parents there are: an equi-join of the keys inside a run
    wide = matched.join(parents.select("key", "created_at", "gone"), "key", "left")
    suspect = wide.where(~F.col("present") | F.col("gone") | (F.col("created_at") > F.col("oldest"))).select("key", "present", "created_at", "gone")
    suspect = suspect.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("table_name", "row_id"), F.lit(SALTS)).cast("int"))
    reason = F.when(~F.col("present"), "missing").when(F.col("gone"), "deleted").when(F.col("created_at") > F.col("ref_created_at"), "later")
    return (
        salted.join(suspect, (salted["ref_key"] == suspect["key"]) & (salted["salt"] == suspect["salt"]))
        .select("table_name", "field", "row_id", "ref_key", "ref_created_at", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
        .withColumnRenamed("ref_created_at", "created_at")
    )


def report(findings: DataFrame) -> DataFrame:
    """Counts per table, field and month of the record; ``month`` is null where the record has no time."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    kinds = [F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}") for r in ("missing", "deleted", "later")]
    return findings.groupBy("table_name", "field", month).agg(F.count(F.lit(1)).alias("n_references"), *kinds)
