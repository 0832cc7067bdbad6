"""Queries of retrieval, fusion, reranking and evaluation.

By our own convention ``embeddings.vec_id`` is read as the id of a chunk and of a knowledge point: the tables declare no
relation. The asking points are those whose id is divisible by 20; they are searched against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import codebase, evaluation, ranking, retrieval, textual
from sedimenta.operators.references import integers_in
from sedimenta.plans.text_code import CHUNKS, EDGES, LIVE, NOW, chunks_once, documents_now, live_chunks, units_once
from sedimenta.sources import load, materialize


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "knowledge_point").dropDuplicates(["id"])


def asked(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("id % 20 = 0 AND source_question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("source_question").alias("text"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return live_chunks(spark, d).select(F.col("id").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("text"), "level", "doc_id", "seq", "file_name")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), (F.col("label") % 5 + 1).alias("level"))


def _dense(spark: SparkSession, d: str, k: int, levels: list[int] | None = None) -> DataFrame:
    every = vectors(spark, d)
    queries = every.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return retrieval.dense_top_k(queries, every.where(F.col("level").isin(levels)) if levels else every, k)


def dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 8)


def dense_by_levels(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 8, [1, 2])


def dense_pairs_expression(spark: SparkSession, d: str) -> DataFrame:
    """The expression form of cosine: each vector against the centre of its label (one row a label, so broadcast)."""
    every = load(spark, d, "embeddings")
    centres = every.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    return every.join(centres, "label").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))


def vectors_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    live = live_chunks(spark, d).select(F.col("id").alias("chunk_id"), "doc_id")
    return vectors(spark, d).join(live, "chunk_id").select("chunk_id", "doc_id", F.size("vector").alias("dim"))


def keyword_top_k(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(asked(spark, d), corpus(spark, d), 8)


def keyword_by_levels(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(asked(spark, d), corpus(spark, d).where(F.col("level").isin(2, 3)), 8)


def sparse_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.query_terms(asked(spark, d), corpus(spark, d))


def sparse_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    return retrieval.sparse_top_k(retrieval.query_terms(asked(spark, d), rows), rows, 30)


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """(term, synonym) made of the documents' tag lists (first tag: the rest)."""
    tags = F.filter(F.transform(F.split("tags", ","), lambda t: F.trim(t)), lambda t: t != "")
    lists = documents_now(spark, d).where("tags IS NOT NULL").select(tags.alias("tags")).where("size(tags) > 1")
    return lists.select(F.get("tags", F.lit(0)).alias("term"), F.explode(F.expr("slice(tags, 2, size(tags) - 1)")).alias("synonym")).where("term != synonym").distinct()


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Words of the points' titles, widened by the lexicon."""
    return retrieval.expand(points(spark, d).select(F.col("id").alias("query_id"), F.col("title").alias("text")), lexicon(spark, d))


def hypothesis_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text a question is searched by: a given passage, else the question."""
    text = F.coalesce(F.nullif(F.trim("concept"), F.lit("")), F.col("source_question"), F.col("title"))
    return points(spark, d).select("id", text.alias("text"))


def route_back_fill(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.back_fill(_dense(spark, d, 4, [1, 2]), _dense(spark, d, 4, [2, 3]))


def _channels(spark: SparkSession, d: str, k: int) -> dict[str, DataFrame]:
    return {"dense": _dense(spark, d, k), "keyword": retrieval.bm25_top_k(asked(spark, d), corpus(spark, d), k)}


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(_channels(spark, d, 8)).where("rank <= 4")


def explore(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.fuse(_channels(spark, d, 4)).where("rank <= 3")
    return top.withColumn("confidence", F.max("score").over(Window.partitionBy("query_id")))


def three_channels(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    sparse = retrieval.sparse_top_k(retrieval.query_terms(asked(spark, d), rows), rows, 30)
    return ranking.pool(ranking.fuse(_channels(spark, d, 8) | {"sparse": sparse}))


def adaptive_lambdas(spark: SparkSession, d: str) -> DataFrame:
    return documents_now(spark, d).select("id", ranking.adaptive_lambda(F.col("level"), F.col("level_confidence")).alias("lam"))


def _pools(spark: SparkSession, d: str) -> DataFrame:
    fused = ranking.pool(ranking.fuse(_channels(spark, d, 12)))
    vec = vectors(spark, d).select("chunk_id", "vector")
    docs = chunks_once(spark, d).select(F.col("id").alias("chunk_id"), "doc_id")
    asking = vec.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return fused.join(vec, "chunk_id", "left").join(docs, "chunk_id", "left").join(asking, "query_id", "left").withColumn("lam", F.lit(0.6))


def mmr_selected(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mmr(_pools(spark, d))


def mmr_graph(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share their first tag are one hop apart; only pairs within a pool are looked at."""
    pools = _pools(spark, d)
    tag = documents_now(spark, d).select(F.col("id").alias("doc_id"), F.trim(F.get(F.split("tags", ","), F.lit(0))).alias("tag")).where("tag != ''")
    tagged = pools.join(tag, "doc_id").select("query_id", "doc_id", "tag").distinct()
    pairs = tagged.alias("x").join(tagged.alias("y"), ["query_id", "tag"]).where("x.doc_id < y.doc_id").select("query_id", F.array("x.doc_id", "y.doc_id", F.lit(1).cast("long")).alias("p"))
    near = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list("p")).alias("near"))
    return ranking.mmr(pools.join(near, "query_id", "left"), 4, near)


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).withColumnRenamed("text", "content")
    return keyword_top_k(spark, d).join(asked(spark, d).withColumnRenamed("text", "question"), "query_id").join(rows, "chunk_id")


def callers(spark: SparkSession, d: str) -> DataFrame:
    """(project_id, term, file): which file calls a method of a name, in lower case."""
    return codebase.call_edges(units_once(spark, d)).select("project_id", F.lower("method_name").alias("term"), F.lower("caller_file").alias("file")).distinct()


def projects_asked(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select(F.col("id").alias("query_id"), F.col("related_project_id").alias("project_id"))


def feature_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = _questions(spark, d).join(projects_asked(spark, d), "query_id", "left")
    return ranking.rerank(hits, 4, callers(spark, d)).select("query_id", "chunk_id", "score", "rank")


def question_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(F.array_sort(ranking.code_terms(F.col("text"))), " ").alias("terms"))


def _judged(hits: DataFrame) -> DataFrame:
    """Stand-in for a model's judgements: 1..5 by the ids, one in eleven missing."""
    n = F.col("chunk_id") * 7 + F.col("query_id")
    return hits.where(n % 11 != 0).select("query_id", "chunk_id", (n % 5 + 1).alias("score"), (n % 3 != 0).alias("relevant"))


def cross_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = dense_top_k(spark, d)
    return ranking.cross_fuse(hits, _judged(hits), 0.7, 4)


def relevance_guard(spark: SparkSession, d: str) -> DataFrame:
    hits = dense_top_k(spark, d)
    return ranking.keep_relevant(hits, _judged(hits)).select("query_id", "chunk_id", "rank")


def corrective_verdicts(spark: SparkSession, d: str) -> DataFrame:
    hits = dense_top_k(spark, d)
    return ranking.verdicts(hits.withColumn("source", F.when(F.col("rank") % 2 == 0, "B").otherwise("")))


def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return ranking.drop_noise(keyword_top_k(spark, d)).select("query_id", "chunk_id", "rank")


def corrective_retry(spark: SparkSession, d: str) -> DataFrame:
    """Queries of medium confidence search again at twice the depth over all levels, and the better score of a chunk wins;
    those of low confidence end without hits."""
    first = materialize(_dense(spark, d, 4, [1, 2]).withColumn("source", F.lit("")), "first")
    return ranking.correct(first, _dense(spark, d, 8))


def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    docs = chunks_once(spark, d).select(F.col("id").alias("chunk_id"), "doc_id")
    dense = dense_top_k(spark, d).join(docs, "chunk_id", "left")
    return ranking.confidence(dense, keyword_top_k(spark, d).join(docs, "chunk_id"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("id % 20 = 0 AND source_question IS NOT NULL").select(F.col("id").alias("query_id"), F.explode(integers_in("chunk_ids")).alias("item"))


def _without_itself(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of k + 1 hits without the asking row: (query_id, chunk_id, score, rank)."""
    return retrieval.top_k(hits.where("query_id != chunk_id").drop("rank"), k)


def _same_label(spark: SparkSession, d: str) -> DataFrame:
    """Expected items, apart from any run: the ten nearest rows of the asking row's label, without itself."""
    every = load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("list"))
    near = retrieval.dense_within(every.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), every, 11)
    return materialize(_without_itself(near, 10).select("query_id", F.col("chunk_id").alias("item")), "expected")


def eval_queries(spark: SparkSession, d: str) -> DataFrame:
    """Expected: the ten nearest points of the same label and the chunks a point names; retrieved: the dense hits. Neither
    holds the asking point itself."""
    runs = _without_itself(_dense(spark, d, 9), 8).select("query_id", "rank", F.col("chunk_id").alias("item"))
    return evaluation.query_metrics(runs, _same_label(spark, d).union(_qrels(spark, d).where("query_id != item")).distinct())


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(evaluation.query_metrics(keyword_top_k(spark, d).select("query_id", "rank", F.col("chunk_id").alias("item")), _qrels(spark, d)))


def eval_grid(spark: SparkSession, d: str) -> DataFrame:
    runs = materialize(_without_itself(_dense(spark, d, 13), 12).withColumnRenamed("chunk_id", "item"), "runs")
    return evaluation.grid_search(runs, _same_label(spark, d), evaluation.grid(spark, [4, 8, 12], [2, 4, 6], [0.5, 0.7, 0.9]))


def eval_best(spark: SparkSession, d: str) -> DataFrame:
    found = eval_grid(spark, d)
    return found.agg(F.max_by("label", F.struct("composite", F.reverse("label"))).alias("label"), F.max("composite").alias("composite"), F.count(F.lit(1)).alias("n_tried"))


def eval_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A run a day, over the asking points made on it: the summaries that are kept, and which is the best."""
    day = points(spark, d).where("created_at IS NOT NULL").select(F.col("id").alias("query_id"), F.to_date("created_at").alias("day"))
    runs = evaluation.summary(eval_queries(spark, d).join(day, "query_id"), "day")
    return evaluation.keep_snapshots(runs, "day").select(F.col("day").cast("string").alias("day"), "n", "composite", "best")


def level_responses(spark: SparkSession, d: str) -> DataFrame:
    """A classifier's fenced JSON answers parsed back: level outside 1..5 and confidence outside 0..1 become 0."""
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("level", F.col("level_confidence").alias("confidence"))), F.lit("\n```"))
    body = textual.unfence(F.when(F.col("id") % 7 == 0, F.lit("no answer")).otherwise(raw))
    parsed = F.from_json(body, "level int, confidence double")
    level = F.when(parsed["level"].between(1, 5), parsed["level"]).otherwise(0)
    sure = F.when(parsed["confidence"].between(0, 1), parsed["confidence"]).otherwise(0.0)
    return documents_now(spark, d).select("id", F.coalesce(level, F.lit(0)).alias("level"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


def native_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels to search by classified level and confidence: the level, its neighbours, or all."""
    lv, sure = F.col("level"), F.col("level_confidence")
    near = F.sequence(F.greatest(F.lit(1), lv - 1), F.least(F.lit(5), lv + 1))
    levels = F.when(sure >= 0.7, F.array(lv)).when((sure >= 0.4) & (lv > 0), near).otherwise(F.sequence(F.lit(1), F.lit(5)))
    return documents_now(spark, d).select("id", F.array_join(F.transform(levels, lambda x: x.cast("string")), ",").alias("levels"))


def router_features(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("source_question")
    w = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    return points(spark, d).where(q.isNotNull()).select(
        "id", F.length(q).alias("n_chars"), F.lower(q).rlike("why|how|原理|为什么|warum|por qué").alias("explains"), F.lower(q).rlike("which|list|all|every|哪些|每个").alias("lists"),
        q.rlike(r"[A-Za-z]+[A-Z][a-z]+").alias("names_code"), F.round(F.size(F.filter(w, lambda x: F.length(x) > 1)) / F.size(w), 6).alias("density"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        dense_top_k, dense_by_levels, dense_pairs_expression, vectors_of_chunks, keyword_top_k, keyword_by_levels, sparse_terms, sparse_top_k, query_expansion, hypothesis_texts, route_back_fill, hybrid_rrf, explore,
        three_channels, adaptive_lambdas, mmr_selected, mmr_graph, feature_rerank, question_terms, cross_rerank, relevance_guard, corrective_verdicts, noise_floor, corrective_retry, answer_confidence,
        eval_queries, eval_summary, eval_grid, eval_best, eval_snapshots, level_responses, native_levels, router_features,
    )
}

PT = "pt AS (SELECT DISTINCT ON (id) * FROM knowledge_point)"
VEC = "vec AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 5 + 1 AS level FROM embeddings)"


def _dense_sql(k: int, where: str = "true") -> str:
    return f"""SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
 (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM vec q, vec c WHERE q.vec_id % 20 = 0 AND c.{where}) s) r WHERE rank <= {k}""".replace("c.true", "true")


_BARE = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_PAIRS = "list_transform(list_zip(string_split({b}, ''), string_split({b}, '')[2:], true), lambda p: p[1] || p[2])"
ASKED = f"{PT}, asked AS (SELECT id AS query_id, source_question AS text FROM pt WHERE id % 20 = 0 AND source_question IS NOT NULL)"
CORPUS = f"{LIVE}, corpus AS (SELECT id AS chunk_id, coalesce(content, '') AS text, level, doc_id, seq, file_name FROM live)"


def _keyword_sql(k: int, where: str = "true") -> str:
    """The ranked hits; needs ASKED and CORPUS."""
    return f"""WITH qg AS (SELECT DISTINCT query_id, unnest({_PAIRS.format(b=_BARE.format(c="text"))}) AS gram FROM asked),
 cg AS (SELECT chunk_id, len(g) AS size, g FROM (SELECT chunk_id, {_PAIRS.format(b=_BARE.format(c="text"))} AS g FROM corpus WHERE {where}) t WHERE len(g) > 0),
 tot AS (SELECT count(*) AS n, avg(size) AS m FROM cg),
 ps AS (SELECT chunk_id, gram, count(*) AS tf, first(size) AS size FROM (SELECT chunk_id, size, unnest(g) AS gram FROM cg) t WHERE gram IN (SELECT gram FROM qg) GROUP BY 1, 2),
 kn AS (SELECT gram, count(*) AS df FROM ps GROUP BY 1),
 sc AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) AS score FROM qg JOIN kn USING (gram) JOIN ps USING (gram), tot GROUP BY 1, 2)
 SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) r WHERE rank <= {k}"""


_WORDS = r"list_filter(string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"
TERMS = f"""tq AS (SELECT DISTINCT query_id, unnest({_WORDS.format(c="text")}) AS term FROM asked), tc AS (SELECT DISTINCT chunk_id, unnest({_WORDS.format(c="text")}) AS term FROM corpus),
 tdf AS (SELECT term, count(*) AS df FROM tc GROUP BY 1), ti AS (SELECT query_id, term, ln(1 + (SELECT count(*) FROM corpus) / df) AS idf FROM tq JOIN tdf USING (term)),
 tw AS (SELECT query_id, term, round(idf / max(idf) OVER (PARTITION BY query_id), 6) AS weight, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS r FROM ti), terms AS (SELECT query_id, term, weight FROM tw WHERE r <= 8)"""
_TF = "(length(lower(text)) - length(replace(lower(text), term, ''))) / length(term)"
SPARSE = f"""sh AS (SELECT term, chunk_id, CASE WHEN {_TF} = 0 THEN 0.1 ELSE least(1.0, 0.2 + 0.8 * {_TF} / 5) END AS s FROM tc JOIN corpus USING (chunk_id) WHERE term IN (SELECT term FROM terms WHERE weight >= 0.3)),
 sr AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s DESC, chunk_id) AS r FROM sh), ss AS (SELECT query_id, chunk_id, round(sum(weight * s), 6) AS score FROM terms JOIN sr USING (term) WHERE weight >= 0.3 AND r <= 15 GROUP BY 1, 2),
 sparse AS (SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ss) t WHERE rank <= 30)"""


def _fused_sql(channels: dict[str, str]) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, rank, {i} AS ch, '{n}' AS name FROM {t}" for i, (n, t) in enumerate(channels.items()))
    return f"""un AS ({union}), fu AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(name, ',' ORDER BY ch) AS sources FROM un GROUP BY 1, 2),
 fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM fu)"""


def _base(k: int) -> str:
    return f"WITH {VEC}, {ASKED}, {CORPUS}, dn AS ({_dense_sql(k)}), kw AS ({_keyword_sql(k)})"


def _mmr_sql(near: str) -> str:
    """Four greedy picks of pools of sixteen; ``near`` weighs the similarity of related documents."""
    return f"""{_base(12).replace("WITH ", "WITH RECURSIVE ", 1)}, {_fused_sql({"dense": "dn", "keyword": "kw"})}, tg AS (SELECT id, trim(string_split(tags, ',')[1]) AS tag FROM now),
 po AS (SELECT f.query_id, f.chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY rank, f.chunk_id) - 1 AS i, count(*) OVER (PARTITION BY f.query_id) AS n, v.v, q.v AS qv, ch.doc_id, tag
  FROM fused f LEFT JOIN vec v ON v.vec_id = f.chunk_id LEFT JOIN vec q ON q.vec_id = f.query_id AND f.query_id % 20 = 0 LEFT JOIN ch ON ch.id = f.chunk_id LEFT JOIN tg ON tg.id = ch.doc_id WHERE rank <= 16),
 rl AS (SELECT *, CASE WHEN v IS NULL OR qv IS NULL THEN (n - i) / n ELSE list_cosine_similarity(v, qv) END AS rel FROM po),
 sm AS (SELECT query_id, x.chunk_id AS a, y.chunk_id AS b, list_cosine_similarity(x.v, y.v) * CASE WHEN x.doc_id = y.doc_id THEN 0.7{near} ELSE 1 END AS s FROM rl x JOIN rl y USING (query_id) WHERE x.v IS NOT NULL AND y.v IS NOT NULL),
 pk AS (SELECT query_id, [first(chunk_id ORDER BY round(rel, 9) DESC, i)] AS ids, 1 AS k FROM rl WHERE n > 4 GROUP BY 1 UNION ALL
  SELECT query_id, list_append(any_value(ids), first(chunk_id ORDER BY val DESC, i)), any_value(k) + 1 FROM (SELECT p.query_id, p.ids, p.k, r.chunk_id, r.i, round(0.6 * r.rel - 0.4 * greatest(0, coalesce(max(s), 0)), 9) AS val
   FROM pk p JOIN rl r ON r.query_id = p.query_id AND NOT list_contains(p.ids, r.chunk_id) LEFT JOIN sm ON sm.query_id = p.query_id AND sm.a = r.chunk_id AND list_contains(p.ids, sm.b) WHERE p.k < 4 GROUP BY p.query_id, p.ids, p.k, r.chunk_id, r.i, r.rel) t GROUP BY query_id)
 SELECT query_id, ids[j] AS chunk_id, CAST(j AS INT) AS pick FROM (SELECT query_id, ids, unnest(generate_series(1, 4)) AS j FROM pk WHERE k = 4) t UNION ALL SELECT query_id, chunk_id, CAST(i + 1 AS INT) FROM rl WHERE n <= 4"""


_TWO = {"dense": "dn", "keyword": "kw"}
_ROUND4 = "floor(({x}) * 10000 + 0.5) / 10000"
_JUDGED = "jd AS (SELECT query_id, chunk_id, (chunk_id * 7 + query_id) % 5 + 1 AS given, (chunk_id * 7 + query_id) % 3 <> 0 AS relevant FROM dn WHERE (chunk_id * 7 + query_id) % 11 <> 0)"
_CODE_TERMS = r"""list_distinct(list_filter(list_transform(list_concat(list_concat(regexp_extract_all({c}, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1), regexp_extract_all({c}, '([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)', 1)),
 list_concat(flatten(list_transform(regexp_extract_all({c}, '([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)', 1), lambda x: list_filter(string_split(x, '.'), lambda p: length(p) > 1))),
 list_filter(flatten(list_transform(regexp_extract_all({c}, '([A-Za-z0-9]*[a-z0-9][A-Z][A-Za-z0-9]*)', 1), lambda w: string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '))), lambda p: length(p) > 1))),
 lambda t: lower(t)), lambda t: regexp_matches(t, '[a-z]') AND length(t) <= 64))"""
_METRICS = """ex AS (SELECT query_id, count(DISTINCT item) AS n FROM qr GROUP BY 1), hi AS (SELECT ru.* FROM ru WHERE EXISTS (SELECT 1 FROM qr WHERE qr.query_id = ru.query_id AND qr.item = ru.item)),
 fo AS (SELECT query_id, min(rank) AS best, count(*) FILTER (WHERE rank <= 4) AS in4, count(*) FILTER (WHERE rank <= 8) AS in8 FROM hi GROUP BY 1), go AS (SELECT query_id, count(DISTINCT item) AS got FROM ru WHERE rank <= 4 GROUP BY 1),
 me AS (SELECT query_id, CAST(coalesce(best <= 4, false) AS DOUBLE) AS hit4, CAST(coalesce(best <= 8, false) AS DOUBLE) AS hit8, coalesce(in8 / n, 0.0) AS recall8, coalesce(1.0 / best, 0.0) AS rr, coalesce(in4 / got, 0.0) AS precision4
 FROM ex LEFT JOIN fo USING (query_id) LEFT JOIN go USING (query_id))"""
_MEANS = "count(*) AS n, round(avg(hit4), 6) AS hit4, round(avg(hit8), 6) AS hit8, round(avg(recall8), 6) AS recall8, round(avg(rr), 6) AS rr, round(avg(precision4), 6) AS precision4"
_COMPOSITE = "round(0.35 * hit4 + 0.25 * rr + 0.2 * recall8 + 0.2 * precision4, 6) AS composite"
#: Runs and expected items of the evaluation queries: neither holds the asking row itself.
_APART = """{dense}, ru AS (SELECT query_id, item, rank, score FROM (SELECT query_id, chunk_id AS item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn WHERE query_id <> chunk_id) t WHERE rank <= {k}),
 sl AS (SELECT query_id, item FROM (SELECT q.vec_id AS query_id, c.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id) AS rank FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) t WHERE rank <= 10)"""
_QREL = r"SELECT DISTINCT id AS query_id, CAST(unnest(regexp_extract_all(chunk_ids, '[0-9]+')) AS BIGINT) AS item FROM pt WHERE id % 20 = 0 AND source_question IS NOT NULL"
_GRID = f"""WITH {VEC}, dn AS ({_dense_sql(13)}), {_APART.format(dense="r1 AS (SELECT 1)", k=12).replace("ru AS", "r0 AS")}, bs AS (SELECT query_id, max(score) AS best FROM r0 GROUP BY 1),
 pa AS (SELECT 'baseline' AS label, 8 AS k, 4 AS n, 0.7 AS f UNION ALL SELECT 'k' || k || '-n' || n || '-f' || f, k, n, f FROM (SELECT unnest([4, 8, 12]) AS k) a, (SELECT unnest([2, 4, 6]) AS n) b, (SELECT unnest([0.5, 0.7, 0.9]) AS f) c WHERE n <= k),
 ru AS (SELECT label || '/' || query_id AS query_id, label, item, rank FROM r0 JOIN bs USING (query_id), pa WHERE rank <= k AND rank <= n AND score >= f * best), qr AS (SELECT pa.label || '/' || query_id AS query_id, item FROM sl, pa), {_METRICS.replace("SELECT ru.*", "SELECT ru.query_id, ru.rank")},
 gr AS (SELECT string_split(query_id, '/')[1] AS label, {_MEANS} FROM me GROUP BY 1)"""
_KEYWORD = f"WITH {ASKED}, {CORPUS}, kw AS ({_keyword_sql(8)})"
_DENSE8 = f"WITH {VEC}, dn AS ({_dense_sql(8)})"
_LEVELS = "list_contains([1, 2], c.level)"

SQL = {
    "dense_top_k": f"WITH {VEC} {_dense_sql(8)}",
    "dense_by_levels": f"WITH {VEC} {_dense_sql(8, 'level IN (1, 2)')}",
    "dense_pairs_expression": """WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, unnest(embedding::DOUBLE[]) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
 c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(e) AS m FROM x GROUP BY 1, 2) t GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS score FROM embeddings JOIN c USING (label)""",
    "vectors_of_chunks": f"WITH {LIVE} SELECT vec_id AS chunk_id, doc_id, CAST(len(embedding) AS INT) AS dim FROM embeddings JOIN live ON live.id = vec_id",
    "keyword_top_k": f"WITH {ASKED}, {CORPUS}, kw AS ({_keyword_sql(8)}) SELECT * FROM kw",
    "keyword_by_levels": f"WITH {ASKED}, {CORPUS}, kw AS ({_keyword_sql(8, 'level IN (2, 3)')}) SELECT * FROM kw",
    "sparse_terms": f"WITH {ASKED}, {CORPUS}, {TERMS} SELECT * FROM terms",
    "sparse_top_k": f"WITH {ASKED}, {CORPUS}, {TERMS}, {SPARSE} SELECT * FROM sparse",
    "query_expansion": rf"""WITH {NOW}, {PT}, l AS (SELECT list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '') AS g FROM now WHERE tags IS NOT NULL),
 p AS (SELECT DISTINCT a, b FROM (SELECT g[1] AS a, unnest(g[2:]) AS b FROM l WHERE len(g) > 1) t WHERE a <> b), q AS (SELECT DISTINCT id AS query_id, w AS term FROM (SELECT id, unnest(regexp_split_to_array(lower(title), '[\s,，。；;、．.！!？?（）()【】\[\]：:]+')) AS w FROM pt) t WHERE w <> '')
 SELECT * FROM q UNION SELECT query_id, b FROM q JOIN p ON a = term UNION SELECT query_id, a FROM q JOIN p ON b = term""",
    "hypothesis_texts": f"WITH {PT} SELECT id, coalesce(nullif(trim(concept), ''), source_question, title) AS text FROM pt",
    "route_back_fill": f"""WITH {VEC}, a AS ({_dense_sql(4, 'level IN (1, 2)')}), b AS ({_dense_sql(4, 'level IN (2, 3)')}), u AS (SELECT *, 'A' AS route FROM a UNION ALL SELECT query_id, chunk_id, round(score * 0.6, 6), rank, 'B' FROM b WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM a))
 SELECT query_id, chunk_id, score, route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY route, rank) AS INT) AS rank FROM u""",
    "hybrid_rrf": f"{_base(8)}, {_fused_sql(_TWO)} SELECT * FROM fused WHERE rank <= 4",
    "explore": f"{_base(4)}, {_fused_sql(_TWO)} SELECT *, max(score) OVER (PARTITION BY query_id) AS confidence FROM fused WHERE rank <= 3",
    "three_channels": f"{_base(8)}, {TERMS}, {SPARSE}, {_fused_sql(_TWO | {'sparse': 'sparse'})} SELECT * FROM fused WHERE rank <= 16",
    "adaptive_lambdas": f"""WITH {NOW} SELECT id, round(greatest(0.3, least(0.95, CASE level WHEN 1 THEN 0.35 WHEN 2 THEN 0.5 WHEN 3 THEN 0.6 WHEN 4 THEN 0.75 WHEN 5 THEN 0.85 ELSE 0.6 END
 + CASE WHEN level_confidence < 0.5 THEN -0.1 WHEN level_confidence > 0.8 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS lam FROM now""",
    "mmr_selected": _mmr_sql(""),
    "mmr_graph": _mmr_sql(" WHEN x.tag = y.tag AND x.tag <> '' THEN 1 - 0.3 * exp(-1)"),
    "feature_rerank": f"""{_KEYWORD}, {EDGES}, x AS (SELECT kw.query_id, kw.chunk_id, kw.score, asked.text AS question, corpus.text AS content, file_name, seq, {_CODE_TERMS.format(c="asked.text")} AS terms, {_BARE.format(c="asked.text")} AS bq, {_BARE.format(c="corpus.text")} AS bc FROM kw JOIN asked USING (query_id) JOIN corpus USING (chunk_id)),
 y AS MATERIALIZED (SELECT *, CASE WHEN length(bq) <= 2 THEN [bq] ELSE {_PAIRS.format(b="bq")} END AS pairs, lower(content || ' ' || coalesce(file_name, '')) AS t, lower(coalesce(file_name, '')) AS f FROM x),
 ask AS (SELECT query_id, chunk_id, related_project_id AS project_id, f, unnest(terms) AS term FROM y JOIN pt ON pt.id = y.query_id WHERE related_project_id IS NOT NULL), cs AS (SELECT DISTINCT project_id, lower(method_name) AS term, lower(caller_file) AS file FROM edges),
 bo AS (SELECT query_id, chunk_id, least(1.0, 0.5 * count(*)) AS bonus FROM (SELECT query_id, chunk_id, term, 0 AS k FROM ask a WHERE EXISTS (SELECT 1 FROM cs WHERE cs.project_id = a.project_id AND cs.term = a.term AND cs.file = a.f)
  UNION SELECT query_id, chunk_id, term, 1 FROM ask a WHERE EXISTS (SELECT 1 FROM cs WHERE cs.project_id = a.project_id AND cs.term = a.term AND replace(regexp_replace(cs.file, '.*/', ''), '.java', '') <> '' AND contains(a.f, replace(regexp_replace(cs.file, '.*/', ''), '.java', '')))) u GROUP BY 1, 2),
 z AS (SELECT query_id, chunk_id, {_ROUND4.format(x="0.05 * coalesce(bonus, 0) + 0.4 * score + 0.2 * CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda w: contains(t, w))) / len(terms) ELSE 0 END + 0.2 * CASE WHEN len(list_filter(terms, lambda w: contains(lower(coalesce(file_name, '')), w))) > 0 THEN 1 ELSE 0 END + 0.1 * len(list_filter(pairs, lambda w: contains(bc, w))) / len(pairs) + 0.1 * CASE WHEN coalesce(seq, 0) <= 0 THEN 0 ELSE floor(0.2 * greatest(0, 1 - (seq - 1) / 10) * 100 + 0.5) / 100 END")} AS score FROM y LEFT JOIN bo USING (query_id, chunk_id))
 SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z) r WHERE rank <= 4""",
    "question_terms": f"SELECT doc_id, array_to_string(list_sort({_CODE_TERMS.format(c='text')}), ' ') AS terms FROM documents WHERE text IS NOT NULL",
    "cross_rerank": f"""{_DENSE8}, {_JUDGED}, x AS (SELECT dn.query_id, dn.chunk_id, {_ROUND4.format(x="coalesce((given - 1) / 4, 0.5) * 0.7 + score * (1 - 0.7)")} AS score FROM dn LEFT JOIN jd USING (query_id, chunk_id))
 SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x) r WHERE rank <= 4""",
    "relevance_guard": f"""{_DENSE8}, {_JUDGED}, x AS (SELECT dn.query_id, dn.chunk_id, rank, coalesce(relevant, true) AS ok FROM dn LEFT JOIN jd USING (query_id, chunk_id)), y AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(*) FILTER (WHERE ok) OVER (PARTITION BY query_id) AS k FROM x)
 SELECT query_id, chunk_id, rank FROM y WHERE n <= 2 OR ok OR (k = 0 AND rank = 1)""",
    "corrective_verdicts": f"""{_DENSE8}, c AS (SELECT query_id, round(least(1.0, avg(score) FILTER (WHERE rank <= 3) + CASE WHEN count(DISTINCT CASE WHEN rank % 2 = 0 THEN 'B' END) >= 2 THEN 0.1 ELSE 0 END), 4) AS confidence, count(DISTINCT CASE WHEN rank % 2 = 0 THEN 'B' END) AS n_sources FROM dn GROUP BY 1)
 SELECT query_id, n_sources, confidence, CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS verdict FROM c""",
    "noise_floor": f"{_KEYWORD} SELECT query_id, chunk_id, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM kw) t WHERE m <= 0 OR score >= 0.3 * m",
    "corrective_retry": f"""WITH {VEC}, a AS ({_dense_sql(4, 'level IN (1, 2)')}), b AS ({_dense_sql(8)}), m AS (SELECT query_id, round(least(1.0, avg(score) FILTER (WHERE rank <= 3)), 4) AS c FROM a GROUP BY 1),
 u AS (SELECT query_id, chunk_id, score, 0 AS src FROM a JOIN m USING (query_id) WHERE c >= 0.3 UNION ALL SELECT query_id, chunk_id, score, 1 FROM b JOIN m USING (query_id) WHERE c >= 0.3 AND c < 0.7), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, src) AS r FROM u)
 SELECT query_id, chunk_id, score, src, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM x WHERE r = 1) y WHERE m <= 0 OR score >= 0.3 * m""",
    "answer_confidence": f"""{_base(8)}, cf AS (SELECT DISTINCT kw.query_id, ch.doc_id FROM kw JOIN ch ON ch.id = kw.chunk_id), x AS (SELECT dn.*, CASE WHEN cf.doc_id IS NOT NULL THEN 1 ELSE 0 END AS yes FROM dn LEFT JOIN ch ON ch.id = dn.chunk_id LEFT JOIN cf ON cf.query_id = dn.query_id AND cf.doc_id = ch.doc_id),
 y AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, avg(yes) AS sh FROM x GROUP BY 1)
 SELECT query_id, {_ROUND4.format(x="least(1.0, s1 * CASE WHEN s2 IS NULL THEN 1.2 ELSE least(1.2, 1 + 2 * (s1 - s2)) END * (0.5 + 0.5 * sh)) * 0.8 + 0.2")} AS confidence FROM y""",
    "eval_queries": f"""WITH {VEC}, {PT}, dn AS ({_dense_sql(9)}), {_APART.format(dense="r1 AS (SELECT 1)", k=8)}, qr AS (SELECT * FROM sl UNION SELECT * FROM ({_QREL}) t WHERE query_id <> item),
 {_METRICS} SELECT * FROM me""",
    "eval_snapshots": f"""WITH {VEC}, {PT}, dn AS ({_dense_sql(9)}), {_APART.format(dense="r1 AS (SELECT 1)", k=8)}, qr AS (SELECT * FROM sl UNION SELECT * FROM ({_QREL}) t WHERE query_id <> item), {_METRICS},
 s AS (SELECT CAST(created_at AS DATE) AS day, {_MEANS} FROM me JOIN pt ON pt.id = me.query_id WHERE created_at IS NOT NULL GROUP BY 1), k AS (SELECT day, n, {_COMPOSITE} FROM s WHERE day > (SELECT max(day) FROM s) - INTERVAL 30 DAYS ORDER BY day DESC LIMIT 50)
 SELECT CAST(day AS VARCHAR) AS day, n, composite, day = (SELECT first(day ORDER BY composite DESC, day DESC) FROM k) AS best FROM k""",
    "eval_summary": f"{_KEYWORD}, ru AS (SELECT query_id, rank, chunk_id AS item FROM kw), qr AS ({_QREL}), {_METRICS}, s AS (SELECT {_MEANS} FROM me) SELECT *, {_COMPOSITE} FROM s",
    "eval_grid": f"{_GRID} SELECT *, {_COMPOSITE} FROM gr",
    "eval_best": f"{_GRID}, g AS (SELECT *, {_COMPOSITE} FROM gr) SELECT first(label ORDER BY composite DESC, reverse(label) DESC) AS label, max(composite) AS composite, count(*) AS n_tried FROM g",
    "level_responses": f"""WITH {NOW} SELECT id, CASE WHEN id % 7 <> 0 AND level BETWEEN 1 AND 5 THEN level ELSE 0 END AS level, CAST(CASE WHEN id % 7 <> 0 AND level_confidence BETWEEN 0 AND 1 THEN level_confidence ELSE 0 END AS DOUBLE) AS confidence FROM now""",
    "native_levels": f"""WITH {NOW} SELECT id, CASE WHEN level_confidence >= 0.7 THEN CAST(level AS VARCHAR) WHEN level_confidence >= 0.4 AND level > 0 THEN array_to_string(generate_series(greatest(1, level - 1), least(5, level + 1)), ',') ELSE '1,2,3,4,5' END AS levels FROM now""",
    "router_features": rf"""WITH {PT}, x AS (SELECT id, source_question AS q, list_filter(regexp_split_to_array(source_question, '\s+'), lambda w: w <> '') AS w FROM pt WHERE source_question IS NOT NULL)
 SELECT id, CAST(length(q) AS INT) AS n_chars, regexp_matches(lower(q), 'why|how|原理|为什么|warum|por qué') AS explains, regexp_matches(lower(q), 'which|list|all|every|哪些|每个') AS lists, regexp_matches(q, '[A-Za-z]+[A-Z][a-z]+') AS names_code,
 round(len(list_filter(w, lambda v: length(v) > 1)) / len(w), 6) AS density FROM x""",
}
