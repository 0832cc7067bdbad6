"""A partitioned index of vectors: lists around centres, of which a query looks at the nearest.

Centres are fitted on a sample of at most ``SAMPLE`` rows (the rows of the smallest hashes of their ids, so the same at
every run); every row is placed in the list of its nearest centre. Centres number the square root of the rows, at most
``CENTRES``, so they are bounded and broadcast in the closures. A query is sent to its ``probes`` nearest lists, as many as
within the sample hold ``TARGET`` of the true neighbours of at most ``TRIED`` sampled queries; lists are
packed into blocks of vectors, so a hot list is many rows, and a block meets the queries of its list only.
Scores are exact; what a query can miss are rows of lists it doesn't look at, and ``recall`` measures that.

Defined results: null vectors are in no list; zero vectors have the score 0; vectors of another length than the centres
are in no list, and queries of another length have no hits; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.retrieval import _unit, by_list, meet_by_list
from sedimenta.sources import materialize

SAMPLE, CENTRES, ROUNDS = 20_000, 4096, 12
TARGET, TRIED, NEIGHBOURS = 0.97, 256, 10


def fit(corpus: DataFrame, seed: int = 1) -> tuple[np.ndarray, int]:
    """(lists, dimensions) unit centres of (chunk_id, vector), by spherical k-means on the bounded sample, and the lists a
    query must look at."""
    rows = corpus.where(F.col("vector").isNotNull())
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(sample):
        return np.empty((0, 0)), 1
    width = int(sample.map(len).mode()[0])
    x = _unit([v for v in sample if len(v) == width])
    k = int(max(1, min(CENTRES, round(n**0.5), len(x))))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres[filled] = _unit(sums[filled])
    tried = x[:: -(-len(x) // TRIED)]
    own, order = np.argmax(x @ centres.T, axis=1), np.argsort(-(tried @ centres.T), axis=1, kind="stable")
    near = np.argsort(-(tried @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    place = np.argsort(order, axis=1)[np.arange(len(tried))[:, None], own[near]]  # how far down a query's lists its neighbours lie
    return centres, int(np.quantile(place, TARGET, method="higher")) + 1


def _nearest(centres: np.ndarray, key: str, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            fits = np.array([len(v) == centres.shape[1] for v in vectors], dtype=bool)
            if not fits.any():
                continue
            at = np.flatnonzero(fits)
            close = _unit([vectors[i] for i in at]) @ centres.T
            lists = np.argsort(-close, axis=1, kind="stable")[:, :probes]
            own = pa.array(np.repeat(at, lists.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(own), batch.column("vector").take(own), pa.array(lists.ravel().astype(np.int32))], [key, "vector", "list"])

    return run


class Index:
    def __init__(self, centres: np.ndarray, probes: int, blocks: DataFrame):
        self.centres, self.probes, self.blocks = centres, probes, blocks


def build(corpus: DataFrame, fitted: tuple[np.ndarray, int]) -> Index:
    """The index of all rows of (chunk_id, vector), written once; blocks lie sorted by list within their files."""
    centres, probes = fitted
    rows = corpus.where(F.col("vector").isNotNull()).select("chunk_id", "vector")
    placed = rows.mapInArrow(_nearest(centres, "chunk_id", 1), "chunk_id long, vector array<float>, list int") if len(centres) else rows.withColumn("list", F.lit(0)).limit(0)
    return Index(centres, probes, materialize(by_list(placed, "chunk_id"), "index"))


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of (query_id, vector); ``probes`` are those of the index unless told."""
    probes = index.probes if probes is None else probes
    rows = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    sent = rows.mapInArrow(_nearest(index.centres, "query_id", max(probes, 1)), "query_id long, vector array<float>, list int") if len(index.centres) else rows.withColumn("list", F.lit(0)).limit(0)
    return meet_by_list(sent, index.blocks, k)


def recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: queries, expected hits and the share of them that was found; a hit of an equal score counts as found."""
    least = expected.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    good = found.join(least, "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    j = least.join(good, "query_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return j.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_expected"), (F.sum("got") / F.sum("n")).alias("recall"))
