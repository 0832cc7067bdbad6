"""Queries over the graph of knowledge points (prerequisites) and over streams of events.

A point's prerequisites are its edges; their type goes by the point's id, as the tables name none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import graph
from sedimenta.operators.references import integers_in
from sedimenta.plans.retrieval_ranking import PT, VEC, _dense_sql, dense_top_k, points
from sedimenta.plans.text_code import NOW, documents_now

TYPES = ("REFERENCES", "DEPENDS_ON", "EXTENDS", "SEQUEL_TO")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", "title", F.coalesce("difficulty_level", F.lit(0)).alias("level"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select("id", F.explode(integers_in("prerequisite_ids")).alias("dst"), "created_at")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("id") % 4 + 1).cast("int"))
    return rows.select(F.col("id").alias("src"), "dst", kind.alias("type"), "created_at").where("src != dst")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges as of a day, changes since two weeks before merged in a day later, and those of archived points taken out."""
    every = edges(spark, d)
    before = every.where("created_at IS NULL OR created_at < TIMESTAMP_NTZ '2025-12-15 00:00:00'")
    changes = every.where("created_at >= TIMESTAMP_NTZ '2025-12-01 00:00:00'").withColumn("created_at", F.expr("created_at + INTERVAL 1 DAY"))
    return graph.detach(graph.upsert(before, changes), points(spark, d).where(F.upper("status") == "ARCHIVED").select("id"))


def graph_related(spark: SparkSession, d: str) -> DataFrame:
    near = graph.reach(nodes(spark, d).where("id % 20 = 0").select("id"), graph.undirected(edges(spark, d)), 2)
    own = nodes(spark, d)
    wide = near.join(own.select(F.col("id").alias("source"), F.col("level").alias("source_level")), "source").join(own.select(F.col("id").alias("node"), "level"), "node", "left")
    return wide.select("source", "node", "hops", F.array_join("types", " ").alias("relation"), graph.direction("source_level", "level").alias("direction"))


def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths of up to ten hops between asking points and all others, with their nodes."""
    found = graph.shortest_paths(nodes(spark, d).where("id % 20 = 0").select("id"), graph.undirected(edges(spark, d)), 10)
    return found.select("source", "node", "hops", F.array_join("path", ">").alias("path"))


def graph_upstream(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of a lower level along REFERENCES and DEPENDS_ON, however far, for all points."""
    used = edges(spark, d).where(F.col("type").isin("REFERENCES", "DEPENDS_ON"))
    return _lineage(spark, d, used, F.col("level") < F.col("source_level"))


def graph_downstream(spark: SparkSession, d: str) -> DataFrame:
    """Points of a higher level that depend on or extend a point, however far, for all points."""
    used = edges(spark, d).where(F.col("type").isin("DEPENDS_ON", "EXTENDS")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return _lineage(spark, d, used, F.col("level") > F.col("source_level"))


def _lineage(spark: SparkSession, d: str, used: DataFrame, wanted) -> DataFrame:
    own = nodes(spark, d)
    near = graph.reach(own.select("id"), used)
    wide = near.join(own.select(F.col("id").alias("source"), F.col("level").alias("source_level")), "source").join(own.select(F.col("id").alias("node"), "level"), "node")
    return wide.where(wanted).select("source", "node", "hops")


def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(nodes(spark, d), edges(spark, d))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def graph_expanded_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = dense_top_k(spark, d).select("query_id", F.col("chunk_id").alias("item"), "score")
    return graph.expand_hits(hits, edges(spark, d))


def graph_tag_links(spark: SparkSession, d: str) -> DataFrame:
    """Suggested relations: each document and the one before it with the same tag (a chain, not all pairs of a tag)."""
    tags = documents_now(spark, d).where("tags IS NOT NULL AND deleted = 0").select("id", F.explode(F.array_distinct(F.transform(F.split("tags", ","), lambda t: F.trim(t)))).alias("tag")).where("tag != ''")
    return graph.chain(tags, "tag", "id").withColumnRenamed("before", "dst").where("dst IS NOT NULL").groupBy(F.col("id").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n_tags"))


QUERIES = {f.__name__: f for f in (graph_edges, graph_related, graph_paths, graph_upstream, graph_downstream, graph_statistics, graph_components, graph_expanded_hits, graph_tag_links)}

GRAPH = f"""{PT}, nd AS (SELECT id, coalesce(difficulty_level, 0) AS level FROM pt),
 ed AS (SELECT DISTINCT id AS src, dst, ['REFERENCES', 'DEPENDS_ON', 'EXTENDS', 'SEQUEL_TO'][id % 4 + 1] AS type, created_at FROM (SELECT id, created_at, CAST(unnest(regexp_extract_all(prerequisite_ids, '[0-9]+')) AS BIGINT) AS dst FROM pt) t WHERE id <> dst),
 un AS (SELECT src, dst, type FROM ed UNION SELECT dst, src, type FROM ed)"""


def _hops(sources: str) -> str:
    """Two hops from the ids of ``sources``: table near(source, node, hops, types)."""
    return f"""so AS ({sources}), h1 AS (SELECT so.id AS source, dst AS node, list(DISTINCT type) AS types FROM so JOIN un ON un.src = so.id GROUP BY 1, 2),
 s2 AS (SELECT src, dst, list(DISTINCT type) AS step FROM un GROUP BY 1, 2), h2 AS (SELECT source, dst AS node, list_distinct(flatten(list(list_concat(types, step)))) AS types FROM h1 JOIN s2 ON src = node WHERE dst <> source AND (source, dst) NOT IN (SELECT (source, node) FROM h1) GROUP BY 1, 2),
 near AS (SELECT source, node, 1 AS hops, types FROM h1 UNION ALL SELECT source, node, 2, types FROM h2)"""


def _closure(where: str, flip: bool, level: str) -> str:
    a, b = ("dst", "src") if flip else ("src", "dst")
    return f"""WITH RECURSIVE {GRAPH}, us AS (SELECT DISTINCT {a} AS x, {b} AS y FROM ed WHERE type IN ({where})), cl AS (SELECT id AS source, id AS node, 0 AS hops FROM nd UNION SELECT source, y, hops + 1 FROM cl JOIN us ON x = node WHERE hops < (SELECT count(*) FROM nd)),
 mi AS (SELECT source, node, min(hops) AS hops FROM cl GROUP BY 1, 2) SELECT source, node, CAST(hops AS INT) AS hops FROM mi JOIN nd a ON a.id = source JOIN nd b ON b.id = node WHERE hops > 0 AND source <> node AND b.level {level} a.level"""


SQL = {
    "graph_edges": f"""WITH {GRAPH}, x AS (SELECT * FROM ed WHERE created_at IS NULL OR created_at < TIMESTAMP '2025-12-15' UNION ALL SELECT src, dst, type, created_at + INTERVAL 1 DAY FROM ed WHERE created_at >= TIMESTAMP '2025-12-01'),
 gone AS (SELECT id FROM pt WHERE upper(status) = 'ARCHIVED') SELECT src, dst, type, max(created_at) AS created_at FROM x WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1, 2, 3""",
    "graph_related": f"""WITH {GRAPH}, {_hops("SELECT id FROM nd WHERE id % 20 = 0")} SELECT source, node, CAST(hops AS INT) AS hops, array_to_string(list_sort(types), ' ') AS relation,
 CASE WHEN b.level < a.level THEN 'UP' WHEN b.level > a.level THEN 'DOWN' ELSE 'SAME' END AS direction FROM near JOIN nd a ON a.id = source LEFT JOIN nd b ON b.id = node""",
    "graph_paths": f"""WITH RECURSIVE {GRAPH}, cl AS (SELECT id AS source, id AS node, 0 AS hops, []::BIGINT[] AS path FROM nd WHERE id % 20 = 0 UNION ALL SELECT source, dst, hops + 1, list_append(path, dst) FROM cl JOIN (SELECT DISTINCT src, dst FROM un) u ON src = node WHERE hops < 10 AND dst <> source AND NOT list_contains(path, dst)),
 b AS (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY hops, path) AS r FROM cl WHERE hops > 0) SELECT source, node, CAST(hops AS INT) AS hops, array_to_string(path, '>') AS path FROM b WHERE r = 1""",
    "graph_upstream": _closure("'REFERENCES', 'DEPENDS_ON'", False, "<"),
    "graph_downstream": _closure("'DEPENDS_ON', 'EXTENDS'", True, ">"),
    "graph_statistics": f"""WITH {GRAPH} SELECT 'nodes' AS what, '' AS key, count(*) AS n FROM nd UNION ALL SELECT 'level', CAST(level AS VARCHAR), count(*) FROM nd WHERE level > 0 GROUP BY level
 UNION ALL SELECT 'edges', '', count(*) FROM ed UNION ALL SELECT 'type', type, count(*) FROM ed GROUP BY type""",
    "graph_components": f"""WITH RECURSIVE {GRAPH}, cl AS (SELECT DISTINCT src AS node, src AS r FROM un UNION SELECT cl.node, dst FROM cl JOIN un ON un.src = cl.r) SELECT node, min(r) AS component FROM cl GROUP BY node""",
    "graph_expanded_hits": f"""WITH {GRAPH}, {VEC}, dn AS ({_dense_sql(8)}), {_hops("SELECT DISTINCT chunk_id AS id FROM dn")}, w AS (SELECT *, list_max(list_transform(types, lambda t: CASE t WHEN 'REFERENCES' THEN 0.8 WHEN 'DEPENDS_ON' THEN 0.7 WHEN 'EXTENDS' THEN 0.6 ELSE 0.5 END)) AS weight FROM near),
 f AS (SELECT query_id, node, hops, score, weight, row_number() OVER (PARTITION BY query_id, node ORDER BY hops, score DESC, weight DESC) AS r FROM dn JOIN w ON w.source = dn.chunk_id WHERE (query_id, node) NOT IN (SELECT (query_id, chunk_id) FROM dn)),
 g AS (SELECT query_id, node AS item, CAST(hops AS INT) AS hops, round(score * pow(weight, hops), 6) AS score FROM f WHERE r = 1) SELECT query_id, item, hops, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM g) t WHERE rank <= 3""",
    "graph_tag_links": f"""WITH {NOW}, t AS (SELECT DISTINCT id, trim(tag) AS tag FROM (SELECT id, unnest(string_split(tags, ',')) AS tag FROM now WHERE tags IS NOT NULL AND deleted = 0) u WHERE trim(tag) <> '')
 SELECT id AS src, dst, count(*) AS n_tags FROM (SELECT id, lag(id) OVER (PARTITION BY tag ORDER BY id) AS dst FROM t) v WHERE dst IS NOT NULL GROUP BY 1, 2""",
}
