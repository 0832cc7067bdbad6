"""Totals over trailing periods for every entity and day, days without activity included.

Rows are first reduced to one per entity and day with Spark's partial aggregation, so a hot entity shrinks to
its number of days before anything is shuffled. The days are then cut into tiles of ``tile_days``. Each tile of
an entity also receives the daily rows of the days just before it (its halo, the longest window less one day),
so a tile is complete in itself and all tiles run in parallel. Inside a task, as many entity tiles as fit a
bounded block are scattered into a dense (entity tiles x days) matrix and multiplied by one banded 0/1 matrix
per window length.

Defined results
* An id that repeats is one record: the row with the latest time wins, ties by the largest remaining values.
* Rows without entity or time are left out; null amounts count as 0.
* The average is the total divided by the length of the window, also where the entity is younger than it.
* An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.sources import materialize

TILE_DAYS = 64
BLOCK_TILES = 2048


def _day_number(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def latest_rows(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one largest in ``order``, ties by the kept columns themselves."""
    ranked = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"k_{c}") for c in keep])).alias("s")
    return df.groupBy(key).agg(ranked).select(key, *[F.col(f"s.k_{c}").alias(c) for c in keep])


def daily_totals(df: DataFrame, entity: str, ts: str, amounts: Sequence[str], record_id: str | None = None) -> DataFrame:
    """(entity, day, n_rows, one total per amount); day is the number of days since 1970-01-01."""
    if record_id is not None:
        df = latest_rows(df, record_id, [ts], [entity, ts, *amounts])
    return (
        df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(entity).alias("entity"), _day_number(F.col(ts)).alias("day"))
        .agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.coalesce(F.col(a).cast("long"), F.lit(0))).alias(f"a{i}") for i, a in enumerate(amounts)])
    )


def _tiles(daily: DataFrame, n_amounts: int, tile: int, halo: int) -> DataFrame:
    """Daily rows with each tile they are needed in, and one row per entity tile with the entity's first and last day."""
    values = ["n_rows", *[f"a{i}" for i in range(n_amounts)]]
    own = F.floor(F.col("day") / tile).cast("int")
    last_needed = F.floor((F.col("day") + halo) / tile).cast("int")
    needed = daily.select("entity", F.explode(F.sequence(own, last_needed)).alias("tile"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "day", *values)
    spans = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    spans = spans.select("entity", F.explode(F.sequence(F.floor(F.col("first") / tile).cast("int"), F.floor(F.col("last") / tile).cast("int"))).alias("tile"), "first", "last", F.lit(None).cast("int").alias("day"), *[F.lit(0).cast("long").alias(v) for v in values])
    return needed.unionByName(spans)


def _multiply(n_amounts: int, windows: Sequence[int], tile: int, halo: int, block: int):
    """The task's work: a stream of rows sorted by entity and tile in, blocks of finished days out."""
    lag = halo + np.arange(tile)[None, :] - np.arange(halo + tile)[:, None]
    bands = [((lag >= 0) & (lag < w)).astype(np.int64) for w in windows]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        group = ((rows["entity"] != rows["entity"].shift()) | (rows["tile"] != rows["tile"].shift())).cumsum().to_numpy() - 1
        size = int(group[-1]) + 1
        span = rows["first"].notna().to_numpy()
        first, last, start = (np.full(size, fill, dtype=np.int64) for fill in (1, 0, 0))
        first[group[span]], last[group[span]] = rows["first"][span].astype(np.int64), rows["last"][span].astype(np.int64)
        start[group] = rows["tile"].to_numpy(np.int64) * tile
        entity = np.empty(size, dtype=object if rows["entity"].dtype == object else rows["entity"].dtype)
        entity[group] = rows["entity"].to_numpy()
        fact = ~span
        at = (group[fact], rows["day"][fact].astype(np.int64).to_numpy() - start[group[fact]] + halo)
        dense = []
        for name in ("n_rows", *[f"a{i}" for i in range(n_amounts)]):
            grid = np.zeros((size, halo + tile), dtype=np.int64)
            grid[at] = rows[name][fact].to_numpy(np.int64)
            dense.append(grid)
        days = start[:, None] + np.arange(tile)[None, :]
        inside = (days >= first[:, None]) & (days <= last[:, None])
        out = {"entity": np.broadcast_to(entity[:, None], inside.shape)[inside], "day": days[inside].astype(np.int32), "n_rows": dense[0][:, halo:][inside]}
        for w, band in zip(windows, bands):
            for i in range(n_amounts):
                out[f"t{i}_{w}"] = (dense[i + 1] @ band)[inside]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            starts = np.flatnonzero(((rows["entity"] != rows["entity"].shift()) | (rows["tile"] != rows["tile"].shift())).to_numpy())
            cut = int(starts[-1]) if len(starts) else 0  # the last entity tile may go on in the next batch
            for at in range(0, len(starts) - 1, block):
                yield finish(rows.iloc[starts[at] : starts[min(at + block, len(starts) - 1)]].reset_index(drop=True))
            rest = rows.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield finish(rest)

    return run


def trailing_totals(
    df: DataFrame, entity: str, ts: str, amounts: Sequence[str], windows: Sequence[int] = (7, 30), record_id: str | None = None,
    tile_days: int = TILE_DAYS, block_tiles: int = BLOCK_TILES,
) -> DataFrame:
    """Per entity and day from its first to its last: rows on the day, and per amount and window the total and daily average."""
    halo = max(windows) - 1
    daily = materialize(daily_totals(df, entity, ts, amounts, record_id), "daily")  # read as facts and as spans
    packed = _tiles(daily, len(amounts), tile_days, halo).repartition(F.col("entity"), F.col("tile")).sortWithinPartitions("entity", "tile")
    kind = daily.schema["entity"].dataType.simpleString()
    schema = f"entity {kind}, day int, n_rows long, " + ", ".join(f"t{i}_{w} long" for w in windows for i in range(len(amounts)))
    result = packed.mapInPandas(_multiply(len(amounts), windows, tile_days, halo, block_tiles), schema)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd")
    columns = [F.col("entity").alias(entity), day.alias("day"), "n_rows"]
    for w in windows:
        for i, a in enumerate(amounts):
            columns += [F.col(f"t{i}_{w}").alias(f"{a}_total_{w}"), (F.col(f"t{i}_{w}") / F.lit(w)).alias(f"{a}_avg_{w}")]
    return result.select(*columns)


def silent_days(totals: DataFrame, entity: str, amounts: Sequence[str], window: int = 7) -> DataFrame:
    """Days without a row whose trailing total is above zero."""
    total = sum((F.col(f"{a}_total_{window}") for a in amounts[1:]), F.col(f"{amounts[0]}_total_{window}"))
    return totals.where((F.col("n_rows") == 0) & (total > 0)).select(entity, "day")
