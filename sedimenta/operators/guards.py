"""Checks of answers and hits against their sources, caches, and an embedder that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supported_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Per item: its claims that stand verbatim in one of its sources, joined by line ends, and their share.

    ``claims``: item, n, claim; ``sources``: item, content. Without a supported claim the whole answer stays.
    """
    found = claims.join(sources, "item").where(F.contains("content", "claim")).select("item", "n").distinct().withColumn("ok", F.lit(True))
    j = claims.join(found, ["item", "n"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    text = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("n", "claim")))), lambda s: s["claim"]), "\n")
    by = j.groupBy("item").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("ok").alias("n_supported"), text(F.col("ok")).alias("kept"), text(F.lit(True)).alias("whole"))
    return by.select("item", "n_claims", "n_supported", (F.col("n_supported") / F.col("n_claims")).alias("support"), F.when(F.col("n_supported") > 0, F.col("kept")).otherwise(F.col("whole")).alias("answer"))


def strict_score(score: Column, file: Column, content: Column, method: Column, asked_class: Column, holder: Column, seq: Column) -> Column:
    """0.4 base + 0.25 method + 0.15 class + 0.1 body + 0.1 place. The base is cut to 0..1. A method in the file's name
    counts 1, as a word of the content 0.8, inside a word 0.5; a class in the name of the file or the holder 1; what the
    question doesn't name 0.5. Longer bodies and earlier places count more."""
    file, low = F.lower(F.coalesce(file, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    named = lambda x: F.nullif(F.lower(F.trim(x)), F.lit(""))
    m, c = named(method), named(asked_class)
    at = F.call_function("instr", low, m)
    letter = r"[\p{L}\p{N}]"
    whole = ((at == 1) | ~F.substring(low, at - 1, F.lit(1)).rlike(letter)) & ~F.coalesce(F.substring(low, at + F.length(m), F.lit(1)), F.lit("")).rlike(letter)
    by_method = F.when(m.isNull(), 0.5).when(F.contains(file, m), 1.0).when(at > 0, F.when(whole, 0.8).otherwise(0.5)).otherwise(0.0)
    by_class = F.when(c.isNull(), 0.5).when(F.contains(file, c) | F.contains(F.lower(F.coalesce(holder, F.lit(""))), c), 1.0).otherwise(0.0)
    n = F.size(F.split(content, "\n", -1))
    body = F.when(F.trim(F.coalesce(content, F.lit(""))) == "", 0.0).when(n >= 10, 1.0).when(n >= 5, 0.7).when(n >= 3, 0.4).otherwise(0.2)
    place = F.when(F.coalesce(seq, F.lit(0)) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 0.2 * (1 - F.least(F.lit(1.0), (seq - 1) / 20))))
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.floor((0.4 * base + 0.25 * by_method + 0.15 * by_class + 0.1 * body + 0.1 * place) * 10_000 + 0.5) / 10_000


def add_once(rounds: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """Hits of successive rounds, each item at its first appearance, with how many of a round were new."""
    first = F.row_number().over(Window.partitionBy(key, item).orderBy(*order))
    return rounds.withColumn("new", first == 1)


def cache_lookup(queries: DataFrame, hits: DataFrame, entries: DataFrame, least: float, now: Column) -> DataFrame:
    """Per query the best cached entry that is alive and at least ``least`` similar; null where there is none."""
    alive = hits.join(entries.where(F.col("expires_at") > now).select(F.col("entry").alias("chunk_id")), "chunk_id", "left_semi").where(F.col("score") >= least)
    best = alive.groupBy("query_id").agg(F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("entry"))
    return queries.select("query_id").join(best, "query_id", "left")


def invalidate(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries none of whose source documents changed."""
    stale = entries.select("entry", F.explode("sources").alias("doc_id")).join(changed, "doc_id", "left_semi").select("entry").distinct()
    return entries.join(stale, "entry", "left_anti")


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, vector): words hashed into signed dimensions, scaled to length 1; blanks give zeros. A stand-in for a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), dtype=np.float32)
            for i, t in enumerate(batch.column("text").to_pylist()):
                for w in (t or "").lower().split():
                    h = known.get(w)
                    if h is None:
                        if len(known) > 500_000:
                            known.clear()
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    out[i, h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, n, out=out, where=n > 0)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["key", "vector"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<float>").withColumnRenamed("key", key)
