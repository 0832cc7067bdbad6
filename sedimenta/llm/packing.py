"""Packs documents into sequences of a fixed token capacity, balancing their attention cost.

A document costs its length plus a share of its length's square. Documents are spread at random over groups of
about ``GROUP`` documents, which are packed in parallel: longest first, each into the sequence of the lowest cost
so far that still has room, over as many sequences as the tokens need at least; where none has room, a new one is
opened. A group is bounded whatever the documents are, and with thousands of documents each wastes about half a
percent of its space, as one group of all documents would.

Defined results: a document above the capacity is cut into full pieces, each a container of its own, and a rest that
is packed like a document; a document without tokens takes a place in a container but no space; every row gets a
place, repeated ids too; ties go to the smaller row number, then to the earlier sequence. Container numbers are
unique, not dense: group * 2^32 + number within the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.sources import materialize

GROUP = 4096
CAPACITY = 2048
QUADRATIC = 1 / 512


def balanced(lengths: np.ndarray, capacity: int, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each length (none above the capacity)."""
    order = np.argsort(-lengths, kind="stable")
    k = max(1, -(-int(lengths.sum()) // capacity))
    room = np.zeros(k + len(lengths), dtype=np.int64)
    room[:k] = capacity
    cost = np.zeros(k + len(lengths))
    out = np.empty(len(lengths), dtype=np.int64)
    for i in order:
        n = lengths[i]
        fits = np.where(room[:k] >= n, cost[:k], np.inf)
        j = int(np.argmin(fits))
        if fits[j] == np.inf:
            j, k = k, k + 1
            room[j] = capacity
        room[j] -= n
        cost[j] += n + quadratic * n * n
        out[i] = j
    return out


def _pack(capacity: int, schema_key: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        n = rows["n_tokens"].to_numpy(np.int64)
        full = np.where(n > capacity, n // capacity, 0)
        rest = n - full * capacity
        packed = np.flatnonzero((rest > 0) | (full == 0))
        place = balanced(rest[packed], capacity)
        own = np.repeat(np.arange(len(n)), full)  # full pieces, one container each
        number = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
        base = int(place.max()) + 1 if len(place) else 0
        at = np.concatenate([own, packed])
        out = pd.DataFrame({"key": rows["key"].to_numpy()[at], "piece_no": np.concatenate([number, full[packed]]).astype(np.int32)})
        out["start"] = out["piece_no"].to_numpy(np.int64) * capacity
        out["n_tokens"] = np.concatenate([np.full(len(own), capacity), rest[packed]])
        out["container"] = (np.int64(rows["part"].iloc[0]) << 32) + np.concatenate([base + np.arange(len(own)), place])
        return out

    return run


def pack_documents(sizes: DataFrame, key: str, n_tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece_no, start, n_tokens, container): where each document, or piece of one, goes."""
    rows = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("n_tokens")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "sizes")
    groups = max(1, -(-rows.count() // GROUP))
    kind = rows.schema["key"].dataType.simpleString()
    packed = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("part").applyInPandas(_pack(capacity, kind), f"key {kind}, piece_no int, start long, n_tokens long, container long")
    return packed.withColumnRenamed("key", key)
