"""Document graphs: k-hop neighbourhoods, path lengths, lineage, components and statistics.

Edges are (src, dst, type), nodes (id, level). All searches start from many sources at once and keep, per source, each
reached node once, so a round's join is no larger than the frontier's edges. Rounds that depend on data are written to
the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources import materialize

#: How much of a score a relation passes on.
WEIGHTS = {"REFERENCES": 0.8, "DEPENDS_ON": 0.7, "EXTENDS": 0.6, "SEQUEL_TO": 0.5}
MERGED = 8


def undirected(edges: DataFrame) -> DataFrame:
    pairs = edges.select("src", "dst", "type").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    return pairs.where("src != dst").distinct()


def upsert(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with changes merged in: one edge per (src, dst, type), the latest ``created_at``."""
    return edges.unionByName(changes).groupBy("src", "dst", "type").agg(F.max("created_at").alias("created_at"))


def detach(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that stay when nodes (id) are deleted with all they are tied to."""
    ids = gone.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")


def suggested(judgements: DataFrame, key: str, answer: str, documents: DataFrame) -> DataFrame:
    """(src, dst, type) of a judge's JSON answers, ``[{"targetId": 3, "type": "EXTENDS"}]``: targets that aren't documents,
    the document itself, unknown types and broken answers are dropped."""
    parsed = F.from_json(F.col(answer), "array<struct<targetId:long,type:string>>")
    rows = judgements.select(F.col(key).alias("src"), F.explode(parsed).alias("r")).select("src", F.col("r.targetId").alias("dst"), F.upper("r.type").alias("type"))
    known = rows.where((F.col("src") != F.col("dst")) & F.col("type").isin(list(WEIGHTS))).distinct()
    return known.join(documents.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type")


def shortest_paths(sources: DataFrame, edges: DataFrame, hops: int = 10) -> DataFrame:
    """(source, node, hops, path): a shortest path to every node within ``hops``, as the nodes behind the source; of
    several the smallest. A round looks at the edges of the frontier only."""
    steps = edges.select("src", "dst").distinct()
    frontier = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.array().cast("array<long>").alias("path")).distinct()
    seen = frontier
    for h in range(1, hops + 1):
        met = frontier.join(steps, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = met.groupBy("source", "node").agg(F.min("path").alias("path")).join(seen.select("source", "node"), ["source", "node"], "left_anti")
        frontier = materialize(new.select("source", "node", F.lit(h).alias("hops"), "path"), "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def chain(links: DataFrame, key: str, item: str, width: int = 4096) -> DataFrame:
    """Adds ``before``: the next smaller item of the same key. Neighbours are found within stretches of ``width`` items'
    values, and the first of a stretch follows the last of the key's stretch before it, so a hot key is many groups."""
    rows = links.withColumn("stretch", F.floor(F.col(item) / width))
    ends = rows.groupBy(key, "stretch").agg(F.max(item).alias("last"))
    ends = ends.withColumn("previous", F.lag("last").over(Window.partitionBy(key).orderBy("stretch"))).drop("last")
    near = F.lag(item).over(Window.partitionBy(key, "stretch").orderBy(item))
    return rows.withColumn("near", near).join(ends, [key, "stretch"]).withColumn("before", F.coalesce("near", "previous")).drop("near", "previous", "stretch")


def reach(sources: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(source, node, hops, types): nodes within ``hops`` of each source in the edges' direction, at their least number
    of hops, with the types on the shortest paths. The source itself is left out; cycles end by themselves.

    Without ``hops`` the search goes on until no source reaches a new node. What was seen in ``MERGED`` rounds is then
    written as one, and so on up, so that the plan of a long chain stays short and a row is rewritten seldom.
    """
    steps = edges.groupBy("src", "dst").agg(F.collect_set("type").alias("step"))
    frontier = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.array().cast("array<string>").alias("types")).distinct()
    parts = [(0, frontier)]
    for h in itertools.count(1) if hops is None else range(1, hops + 1):
        seen = functools.reduce(DataFrame.unionByName, (part for _, part in parts))
        met = frontier.join(steps, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), F.array_union("types", "step").alias("types"))
        once = met.groupBy("source", "node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))
        frontier = once.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(h).alias("hops"), "types")
        if hops is None or hops > 2:
            frontier = materialize(frontier, "frontier")
            if frontier.isEmpty():
                break
        parts.append((0, frontier))
        while hops is None and len(parts) > MERGED and parts[-1][0] == parts[-MERGED][0]:
            merged = functools.reduce(DataFrame.unionByName, (part for _, part in parts[-MERGED:]))
            parts[-MERGED:] = [(parts[-1][0] + 1, materialize(merged, "seen"))]
    return functools.reduce(DataFrame.unionByName, (part for _, part in parts)).where("hops > 0")


def direction(source_level: str, level: str):
    return F.when(F.col(level) < F.col(source_level), "UP").when(F.col(level) > F.col(source_level), "DOWN").otherwise("SAME")


def expand_hits(hits: DataFrame, edges: DataFrame, extra: int = 3, hops: int = 2) -> DataFrame:
    """Up to ``extra`` related items per query that aren't hits: score = best hit's score x weight^hops of the best relation."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    near = reach(hits.select(F.col("item").alias("id")).distinct(), undirected(edges), hops)
    near = near.withColumn("weight", F.array_max(F.transform("types", lambda t: F.coalesce(F.element_at(weight, t), F.lit(0.6)))))
    found = hits.join(near, hits["item"] == near["source"]).select("query_id", "node", "hops", "weight", "score").join(hits.select("query_id", F.col("item").alias("node")), ["query_id", "node"], "left_anti")
    best = found.groupBy("query_id", "node").agg(F.max(F.struct((-F.col("hops")).alias("h"), "score", "weight")).alias("b"))
    scored = best.select("query_id", F.col("node").alias("item"), (-F.col("b.h")).alias("hops"), F.round(F.col("b.score") * F.pow(F.col("b.weight"), -F.col("b.h")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= extra)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, key, n): nodes and edges in all, nodes by level above 0, edges by type."""
    kinds = [
        nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("key"), "n"),
        nodes.where("level > 0").groupBy(F.col("level").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("level").alias("what"), "key", "n"),
        edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), F.lit("").alias("key"), "n"),
        edges.groupBy(F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("what"), "key", "n"),
    ]
    out = kinds[0]
    for part in kinds[1:]:
        out = out.unionByName(part)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) of (a, b) links: the component is its least node.

    Every round takes the least label among a node's neighbours and then its label's label, so paths shorten by
    doubling; labels are materialized each round, and only the number of changes comes to the driver.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = lower.join(roots, "label", "left").select("node", F.least("label", F.coalesce("root", "label")).alias("label"), "before")
        after = materialize(jumped, "labels")
        if after.where("label != before").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
