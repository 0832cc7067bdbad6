"""Queries that choose search parameters, and the whole way from a question to the fragments it is answered from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import ranking, retrieval, routing, vector_index
from sedimenta.plans.retrieval_ranking import PT, VEC, _dense_sql, asked, callers, corpus, lexicon, points, projects_asked, vectors
from sedimenta.plans.text_code import CHUNKS, NOW, chunks_once, documents_now
from sedimenta.sources import load, materialize

DEEPEST = 12


def routed_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Search parameters by the features of each question."""
    return points(spark, d).where("source_question IS NOT NULL").select("id", routing.routed(F.col("source_question")).alias("r")).select("id", "r.*")


def strategy_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Search parameters by scenario: a usage record's scene where it names one, else the default's."""
    log = load(spark, d, "token_usage_log").dropDuplicates(["id"]).select("id", F.lower("scene").alias("scene"))
    found = routing.with_strategy(log, "scene")
    return found.groupBy("scene", "chunk_size", "chunk_overlap", "hypothesis", "diversity", "dense_k", "model_weight").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("skipped")).alias("n_skipped"))


def method_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a chunk shows methods, by document."""
    return chunks_once(spark, d).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(routing.method_context(F.col("content"))).alias("of_methods"))


def dense_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Dense top-k through the partitioned index."""
    every = vectors(spark, d)
    index = vector_index.build(every, vector_index.fit(every))
    return vector_index.search(every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), index, 8)


def dense_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds at least nine tenths of what exact search finds, over all asking rows."""
    every = vectors(spark, d)
    queries = every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return vector_index.recall(dense_indexed(spark, d), retrieval.dense_top_k(queries, every, 8)).select("n_queries", "n_expected", (F.col("recall") >= 0.9).alias("enough"))


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Per question: its parameters, the levels it is searched in, and the weight of relevance against diversity."""
    level = F.coalesce(F.col("difficulty_level"), F.lit(0))
    near = F.when(level.between(1, 5), F.sequence(F.greatest(F.lit(1), level - 1), F.least(F.lit(5), level + 1))).otherwise(F.sequence(F.lit(1), F.lit(5)))
    rows = points(spark, d).where("id % 20 = 0 AND source_question IS NOT NULL")
    return rows.select(F.col("id").alias("query_id"), routing.routed(F.col("source_question")).alias("r"), near.alias("levels"), ranking.adaptive_lambda(level, F.lit(0.6)).alias("lam")).select("query_id", "r.*", "levels", "lam")


def _dense_by_level(spark: SparkSession, d: str, settings: DataFrame) -> DataFrame:
    """The best ``dense_k`` hits of a query within its levels."""
    every = vectors(spark, d).withColumnRenamed("level", "list")
    queries = every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector").join(settings.select("query_id", F.explode("levels").alias("list")), "query_id")
    found = retrieval.dense_within(queries, every, DEEPEST).join(settings.select("query_id", "dense_k"), "query_id")
    return found.where(F.col("rank") <= F.col("dense_k")).drop("dense_k")


def _expanded(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    more = retrieval.expand(questions, lexicon(spark, d)).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("more"))
    return questions.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))


def _closeness(spark: SparkSession, d: str, pools: DataFrame) -> DataFrame:
    """Documents of a pool that share their first tag are one hop apart."""
    tag = documents_now(spark, d).select(F.col("id").alias("doc_id"), F.trim(F.get(F.split("tags", ","), F.lit(0))).alias("tag")).where("tag != ''")
    tagged = pools.join(tag, "doc_id").select("query_id", "doc_id", "tag").distinct()
    pairs = tagged.alias("x").join(tagged.alias("y"), ["query_id", "tag"]).where("x.doc_id < y.doc_id").select("query_id", F.array("x.doc_id", "y.doc_id", F.lit(1).cast("long")).alias("p"))
    return pairs.groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("near"))


def _shares(rows: DataFrame, question: str, content: str) -> DataFrame:
    """(query_id, chunk_id, share) of the question's character pairs that a fragment has."""
    # the bare content is a column of its own before the lambda that looks into it, else it would be made for each pair
    bare = rows.select("query_id", "chunk_id", F.col(question).alias("q"), F.regexp_replace(F.lower(F.coalesce(content, F.lit(""))), r"[^\p{L}\p{N}]", "").alias("bare")).repartition("query_id")
    return bare.select("query_id", "chunk_id", ranking.coverage(F.col("q"), F.col("bare")).alias("share"))


def pipeline_stages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Every stage of the way from question to fragments, for all asking points at once.

    Parameters by the question; dense hits of its levels; keyword hits of the expanded question in its levels; weighted
    terms; fusion; a pool; diversity where the route wants it; rerank with the call graph; a judgement mixed in;
    correction with a retry over all levels; the relevance guard. Judgements, which a model would give, go by the share of
    the question's character pairs that a fragment has.
    """
    rows, questions = materialize(corpus(spark, d), "corpus"), asked(spark, d)
    settings = materialize(_settings(spark, d), "settings")
    dense = materialize(_dense_by_level(spark, d, settings), "dense")
    keyword = retrieval.bm25_top_k(_expanded(spark, d, questions).join(settings.select("query_id", "levels"), "query_id"), rows, 8)
    sparse = retrieval.sparse_top_k(retrieval.query_terms(questions, rows), rows, 30)
    levels = rows.select("chunk_id", "level")
    sparse = sparse.join(levels, "chunk_id").join(settings.select("query_id", "levels"), "query_id").where(F.array_contains("levels", F.col("level"))).select("query_id", "chunk_id", "rank")
    fused = materialize(ranking.fuse({"dense": dense, "keyword": keyword, "sparse": sparse}), "fused")
    pooled = materialize(ranking.pool(fused), "pool")
    vec = vectors(spark, d).select("chunk_id", "vector")
    asking = vec.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    meta = rows.withColumnRenamed("text", "content").drop("level")
    wide = pooled.join(settings.select("query_id", "lam", "diversity", "top_n"), "query_id").join(vec, "chunk_id", "left").join(meta.select("chunk_id", "doc_id"), "chunk_id", "left").join(asking, "query_id", "left")
    near = _closeness(spark, d, wide)
    spread = ranking.mmr(wide.where("diversity").join(near, "query_id", "left"), 5, near)
    chosen = spread.unionByName(wide.where("NOT diversity").select("query_id", "chunk_id", F.col("rank").alias("pick")))
    chosen = chosen.join(settings.select("query_id", "top_n"), "query_id").where(F.col("pick") <= F.col("top_n")).join(pooled.select("query_id", "chunk_id", "score", "sources"), ["query_id", "chunk_id"])
    ready = chosen.join(questions.withColumnRenamed("text", "question"), "query_id").join(meta, "chunk_id", "left").join(projects_asked(spark, d), "query_id", "left")
    featured = materialize(ranking.rerank(ready, 5, callers(spark, d)), "featured")
    judged = _shares(featured, "question", "content").select("query_id", "chunk_id", (1 + 4 * F.col("share")).alias("score"))
    ranked = ranking.cross_fuse(featured, judged, 0.7, 5).select("query_id", "chunk_id", "score", "rank", F.col("sources").alias("source"))
    ranked = materialize(ranked, "ranked")
    every = vectors(spark, d)
    retry = retrieval.dense_top_k(every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), every, 2 * 8)
    corrected = materialize(ranking.correct(ranked, retry), "corrected")
    shown = corrected.join(questions, "query_id").join(rows.select("chunk_id", F.col("text").alias("content")), "chunk_id", "left")
    guarded = ranking.keep_relevant(corrected, _shares(shown, "text", "content").select("query_id", "chunk_id", (F.col("share") > 0.05).alias("relevant")))
    return {"settings": settings, "dense": dense, "keyword": keyword, "sparse": sparse, "fused": fused, "pool": pooled, "chosen": chosen, "ranked": ranked, "corrected": corrected, "guarded": guarded}


def retrieval_pipeline(spark: SparkSession, d: str) -> DataFrame:
    docs = chunks_once(spark, d).select(F.col("id").alias("chunk_id"), "doc_id")
    found = pipeline_stages(spark, d)["guarded"]
    return found.join(docs, "chunk_id", "left").select("query_id", "chunk_id", "doc_id", "score", "rank")


QUERIES = {f.__name__: f for f in (routed_parameters, strategy_parameters, method_contexts, dense_indexed, dense_recall, retrieval_pipeline)}

_TABLE = ", ".join(f"('{s}', {size}, {overlap}, {len(skipped)}, {h}, {v}, {k}, {w})" for s, size, overlap, skipped, h, v, _, k, _, w in routing.STRATEGIES)
SQL = {
    "routed_parameters": f"""WITH {PT}, x AS (SELECT id, lower(source_question) AS q, length(source_question) AS n FROM pt WHERE source_question IS NOT NULL),
 y AS (SELECT id, CASE WHEN regexp_matches(q, '{routing.CODE}') AND regexp_matches(q, '{routing.DETAIL}') THEN 1 WHEN regexp_matches(q, '{routing.DESIGN}|{routing.WHY}') THEN 2 WHEN regexp_matches(q, '{routing.OVERVIEW}') THEN 3 WHEN n < 15 THEN 4 WHEN n > 80 THEN 5 ELSE 6 END AS rule FROM x)
 SELECT id, rule, [384, 500, 800, 500, 800, 500][rule] AS chunk_size, rule NOT IN (3, 4) AS hypothesis, rule <> 1 AS diversity, [6, 10, 6, 6, 12, 8][rule] AS dense_k, [3, 5, 3, 4, 4, 4][rule] AS top_n FROM y""",
    "strategy_parameters": f"""WITH s AS (SELECT * FROM (VALUES {_TABLE}) t(scenario, chunk_size, chunk_overlap, n_skipped, hypothesis, diversity, dense_k, model_weight)), l AS (SELECT DISTINCT ON (id) id, lower(scene) AS scene FROM token_usage_log),
 r AS (SELECT scene, CASE WHEN scene IN (SELECT scenario FROM s) THEN scene ELSE 'default' END AS scenario FROM l)
 SELECT scene, CAST(chunk_size AS INT) AS chunk_size, CAST(chunk_overlap AS INT) AS chunk_overlap, hypothesis, diversity, CAST(dense_k AS INT) AS dense_k, CAST(model_weight AS DOUBLE) AS model_weight, count(*) AS n, CAST(max(n_skipped) AS INT) AS n_skipped FROM r JOIN s USING (scenario) GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "method_contexts": f"WITH {CHUNKS} SELECT doc_id, bool_or(coalesce(contains(content, '【方法】') OR contains(content, '【签名】'), false)) AS of_methods FROM ch WHERE doc_id IS NOT NULL GROUP BY 1",
    "dense_recall": f"WITH {VEC}, dn AS ({_dense_sql(8)}) SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_expected, true AS enough FROM dn",
}
