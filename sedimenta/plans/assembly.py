"""Queries of guards, caches, settings and the remaining code and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import parsing
from sedimenta.operators import codebase, guards, ranking, retrieval
from sedimenta.operators.graph import reach, undirected
from sedimenta.operators.references import integers_in
from sedimenta.plans.graphs import GRAPH, _hops, edges, nodes
from sedimenta.plans.retrieval_ranking import _CODE_TERMS, ASKED, CORPUS, PT, VEC, _dense, _dense_sql, _keyword_sql, _questions, asked, keyword_top_k, points, vectors
from sedimenta.plans.text_code import CHUNKS, EDGES, NOW, UNITS, chunks_once, documents_now, live_chunks, units_once
from sedimenta.sources import load

#: Characters of a name by which it is joined to the calls that may hold it.
HEAD = 4


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON payloads by the first path that has them."""
    events = load(spark, d, "events")
    k = parsing.first_json(F.col("props"), "$.key", "$.k", "$.data.k")
    return events.select("event_id", parsing.to_int(k, -1).alias("k"), parsing.to_bool(k, False).alias("flag"), parsing.to_double(k, 0.5).alias("weight"))


def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    """Units of the projects named by prefixes made from each twentieth project."""
    p = load(spark, d, "code_project").where("id % 20 = 0").select(F.concat(F.lit("vec:"), F.col("id").cast("string"), F.lit(":"), F.lower(F.coalesce("language", F.lit("*"))), F.lit(":*")).alias("prefix"))
    p = p.select("prefix", parsing.prefix_parts(F.col("prefix")).alias("f"))
    units = units_once(spark, d).select("id", "project_id", F.lower("language").alias("language"))
    return units.join(p, (F.col("project_id") == F.col("f.project")) & (F.col("f.source").isNull() | (F.col("f.source") == F.col("language")))).select("prefix", "id")


def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    """Answer or fall back by confidence, and which later checks are skipped."""
    sure = F.col("level_confidence")
    return documents_now(spark, d).select("id", F.when(sure >= 0.45, "answer").otherwise("agent").alias("route"), (F.array_contains(F.array(F.lit(1), F.lit(3)), F.col("level")) | (sure >= 0.85)).alias("skip_checks"))


def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    """Per project: static settings of its language, overridden by values its row sets above zero."""
    p = load(spark, d, "code_project").select("id", F.lower(F.coalesce("language", F.lit("?"))).alias("language"), "total_files", "total_methods")
    base = p.groupBy("language").agg(F.max("total_files").alias("base_files"), F.min("total_methods").alias("base_methods"))
    pick = lambda own, static: F.when(F.coalesce(F.col(own), F.lit(0)) % 3 > 0, F.col(own)).otherwise(F.col(static))
    return p.join(base, "language").select("id", pick("total_files", "base_files").alias("files"), pick("total_methods", "base_methods").alias("methods"))


def question_routes(spark: SparkSession, d: str) -> DataFrame:
    """Where a question belongs, what it asks for, and the method and class it names."""
    q = F.coalesce("source_question", "title")
    return points(spark, d).select(
        "id", parsing.first_label(q, ["code", "doc", "both"], "unknown").alias("route"), parsing.question_intent(F.coalesce(q, F.lit(""))).alias("intent"), parsing.asked_method(q).alias("method"), parsing.asked_class(q).alias("class"),
    )


def level_from_text(spark: SparkSession, d: str) -> DataFrame:
    """A level read from an answer that is no valid JSON."""
    raw = F.concat(F.lit('so {"level" : '), F.col("level").cast("string"), F.lit(", because"))
    n = F.nullif(F.regexp_extract(raw, r'"level"\s*:\s*(\d+)', 1), F.lit("")).try_cast("int")
    return documents_now(spark, d).select("id", F.when(n.between(1, 5), n).otherwise(0).alias("level"))


def claims_supported(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a point's concept and its title that stand verbatim, in any letter case, in the chunks the point names."""
    p = points(spark, d).where(F.col("concept").isNotNull())
    sentences = F.concat(F.split("concept", r"(?<=[.!?。！？])\s*"), F.split(F.coalesce("title", F.lit("")), " "))
    claims = p.select(F.col("id").alias("item"), F.posexplode(F.transform(sentences, lambda s: F.lower(F.trim(s)))).alias("n", "claim")).where("claim != ''")
    named = p.select(F.col("id").alias("item"), F.explode(integers_in("chunk_ids")).alias("chunk")).join(chunks_once(spark, d).select(F.col("id").alias("chunk"), "content"), "chunk")
    found = guards.supported_claims(claims, named.select("item", F.lower(F.coalesce("content", F.lit(""))).alias("content")))
    return found.select("item", "n_claims", "n_supported", F.round("support", 6).alias("support"), F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


def cited_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first 30 characters of a chunk's successor in its document are quoted in it (a verbatim check).

    Chunks without content are passed over; a shorter successor is looked for as a whole."""
    after = Window.partitionBy("doc_id").orderBy(F.coalesce("seq", F.lit(-1)), "id")
    c = chunks_once(spark, d).where("doc_id IS NOT NULL AND length(content) > 0").withColumn("excerpt", F.substring(F.lead("content").over(after), 1, 30))
    return c.where("excerpt IS NOT NULL").select("id", F.contains("content", "excerpt").alias("verbatim"))


def strict_verified(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits checked against the method and class that the question names; the base is the share of the best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = _questions(spark, d).withColumns({"base": F.col("score") / best, "method": parsing.asked_method(F.col("question")), "class": parsing.asked_class(F.col("question"))})
    score = guards.strict_score(F.col("base"), F.col("file_name"), F.col("content"), F.col("method"), F.col("class"), F.lit(None).cast("string"), F.col("seq"))
    return rows.select("query_id", "chunk_id", score.alias("strict")).withColumn("passed", F.col("strict") >= 0.6)


def hits_added(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of search for a question: what the second adds to the first."""
    rounds = _dense(spark, d, 4, [1, 2]).withColumn("round", F.lit(1)).unionByName(_dense(spark, d, 6).withColumn("round", F.lit(2)))
    return guards.add_once(rounds, "query_id", "chunk_id", ["round", "rank"]).groupBy("query_id", "round").agg(F.count_if("new").alias("n_added"), F.count(F.lit(1)).alias("n_hits"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries: points with the documents of the chunks they were answered from."""
    docs = points(spark, d).select("id", F.explode(integers_in("chunk_ids")).alias("chunk")).join(chunks_once(spark, d).select(F.col("id").alias("chunk"), "doc_id"), "chunk").where("doc_id IS NOT NULL")
    return docs.groupBy(F.col("id").alias("entry")).agg(F.array_sort(F.collect_set("doc_id")).alias("sources")).join(points(spark, d).select(F.col("id").alias("entry"), F.expr("updated_at + INTERVAL 90 DAYS").alias("expires_at")), "entry")


def cache_found(spark: SparkSession, d: str) -> DataFrame:
    hits = _dense(spark, d, 10).where("query_id != chunk_id")
    queries = vectors(spark, d).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"))
    return guards.cache_lookup(queries, hits, _entries(spark, d), 0.3, F.lit("2026-02-01").cast("timestamp_ntz"))


def cache_kept(spark: SparkSession, d: str) -> DataFrame:
    changed = documents_now(spark, d).where("deleted = 1 OR status = 'FAILED'").select(F.col("id").alias("doc_id"))
    return guards.invalidate(_entries(spark, d), changed).select("entry", F.size("sources").alias("n_sources"))


def call_graph_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per unit: half a point for each other file that calls a method of its name, at most one."""
    called = codebase.call_edges(units_once(spark, d)).select("method_name", "caller_file").distinct()
    units = units_once(spark, d).where(F.col("method_name").isNotNull()).select("id", "method_name", "file_path")
    n = units.join(called, "method_name").where("caller_file != file_path").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("id", F.least(F.lit(1.0), 0.5 * F.col("n")).alias("score"))


def callers_by_substring(spark: SparkSession, d: str) -> DataFrame:
    """Callers within a project whose call texts contain the method's name anywhere (over-matching by design).

    A name stands in a call only if its first ``HEAD`` characters do: distinct names meet distinct calls of a project by
    those, and only pairs that hold are widened to units and callers. The distinct heads of all names are few, so
    they are broadcast to drop the other windows of a call before it is shuffled."""
    units = units_once(spark, d)
    asked_for = units.where("id % 20 = 0 AND length(method_name) > 0").select("project_id", F.col("id").alias("unit_id"), F.lower("method_name").alias("m"))
    calls = units.select("project_id", F.col("id").alias("caller_id"), F.explode("calls").alias("call")).select("project_id", "caller_id", F.lower("call").alias("call")).distinct()
    names = asked_for.select("project_id", "m", F.substring("m", 1, HEAD).alias("head")).distinct()
    heads = names.select("head").distinct()
    lengths = F.array(*[F.lit(r.n) for r in heads.select(F.length("head").alias("n")).distinct().collect()]).cast("array<int>")
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.length("call")), lambda i: F.transform(lengths, lambda n: F.substring(F.col("call"), i, n))))
    texts = calls.where("length(call) > 0").select("project_id", "call").distinct().select("project_id", "call", F.explode(F.array_distinct(windows)).alias("head")).join(F.broadcast(heads), "head", "left_semi")
    held = names.join(texts, ["project_id", "head"]).where(F.contains("call", "m")).select("project_id", "m", "call")
    wide = held.join(asked_for, ["project_id", "m"]).join(calls, ["project_id", "call"])
    return wide.where(F.col("unit_id") != F.col("caller_id")).select("unit_id", "caller_id").distinct()


def units_from_two_indexes(spark: SparkSession, d: str) -> DataFrame:
    """The exact index where it has a file, else the parsed one: enriched units win by file."""
    units = units_once(spark, d)
    exact = units.where("size(enriched_calls) > 0").select("project_id", "file_path", F.lit("exact").alias("index"), "id")
    parsed = units.select("project_id", "file_path", F.lit("parsed").alias("index"), "id").join(exact.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")
    return exact.unionByName(parsed).groupBy("project_id", "index").agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct("file_path").alias("n_files"))


def changed_since(spark: SparkSession, d: str) -> DataFrame:
    """Files changed after each project's watermark: the moment three quarters of its units were there."""
    units = units_once(spark, d).where("created_at IS NOT NULL").withColumn("share", F.percent_rank().over(Window.partitionBy("project_id").orderBy("created_at", "id")))
    return units.where("share > 0.75").groupBy("project_id").agg(F.count_distinct("file_path").alias("n_files"), F.min("created_at").alias("since"))


def repository_sizes(spark: SparkSession, d: str) -> DataFrame:
    kb = F.floor(F.sum(F.coalesce(F.octet_length("body"), F.lit(0))) / 1024)
    by = units_once(spark, d).groupBy("project_id").agg(kb.alias("kb"), F.count_distinct("file_path").alias("n_files"))
    mb, n = F.floor(F.col("kb") / 1024), F.col("n_files")
    return by.withColumn("gate", F.when((mb > 2000) | (n > 50_000), "REJECT").when((mb > 500) | (n > 10_000), "WARN").otherwise("OK"))


def knowledge_counts(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("related_project_id IS NOT NULL")
    newest = F.max_by("id", F.struct(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp_ntz")), "id"))
    return p.groupBy("related_project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper("status") == "ACTIVE").alias("n_active"), newest.alias("newest_id"))


def snapshots_kept(spark: SparkSession, d: str) -> DataFrame:
    """The newest three states of each document, and the best of them by confidence."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("updated_at").desc(), "status", "chunk_count"))
    kept = load(spark, d, "knowledge_document").distinct().withColumn("rn", rank).where("rn <= 3")
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_kept"), F.max_by("status", F.struct("chunk_count", "rn")).alias("largest_status"))


def relation_map(spark: SparkSession, d: str) -> DataFrame:
    """Per asking node the related nodes and their hops as one JSON map."""
    near = reach(nodes(spark, d).where("id % 20 = 0").select("id"), undirected(edges(spark, d)), 2)
    entries = F.array_sort(F.collect_list(F.struct(F.col("node").cast("string").alias("key"), F.col("hops").alias("value"))))
    return near.groupBy("source").agg(F.to_json(F.map_from_entries(entries)).alias("related"))


def nodes_synced(spark: SparkSession, d: str) -> DataFrame:
    """Documents as graph nodes; those without a level get 0."""
    return documents_now(spark, d).where("deleted = 0").select("id", "file_name", F.coalesce("level", F.lit(0)).alias("level"), F.size(F.filter(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t) != "")).alias("n_tags"))


def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of a question's words of five letters or more that its best five keyword hits contain; 0 without a hit."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^a-z]+", " "), " "), lambda w: F.length(w) >= 5))
    expected = asked(spark, d).select("query_id", words.alias("expected")).where("size(expected) > 0")
    shown = keyword_top_k(spark, d).where("rank <= 5").join(live_chunks(spark, d).select(F.col("id").alias("chunk_id"), "content"), "chunk_id").groupBy("query_id").agg(F.lower(F.array_join(F.collect_list("content"), " ")).alias("shown"))
    share = F.size(F.filter("expected", lambda w: F.contains(F.coalesce("shown", F.lit("")), w))) / F.size("expected")
    return expected.join(shown, "query_id", "left").select("query_id", F.round(share, 6).alias("coverage"), (share >= 0.3).alias("hit"))


def embedded_code(spark: SparkSession, d: str) -> DataFrame:
    """Questions against code by hashed words: the model-free form of code retrieval."""
    units = units_once(spark, d)
    code = guards.hash_embedding(units.select(F.col("id").alias("chunk_id"), F.regexp_replace(codebase.vector_text(units), r"([a-z0-9])([A-Z])|[^A-Za-z0-9]+", "$1 $2").alias("text")), "chunk_id", "text")
    return retrieval.dense_top_k(guards.hash_embedding(asked(spark, d), "query_id", "text"), code, 8)


QUERIES = {
    f.__name__: f
    for f in (
        json_fields, prefix_filter, answer_gate, settings_merged, question_routes, level_from_text, claims_supported, cited_excerpts, strict_verified, hits_added, cache_found, cache_kept, call_graph_scores,
        callers_by_substring, units_from_two_indexes, changed_since, repository_sizes, knowledge_counts, snapshots_kept, relation_map, nodes_synced, keyword_coverage, embedded_code,
    )
}

ENTRIES = f"""{PT}, {CHUNKS}, en AS (SELECT p.id AS entry, list(DISTINCT ch.doc_id) AS sources, first(p.updated_at + INTERVAL 90 DAYS) AS expires_at FROM
 (SELECT DISTINCT id, updated_at, CAST(unnest(regexp_extract_all(chunk_ids, '[0-9]+')) AS BIGINT) AS chunk FROM pt) p JOIN ch ON ch.id = p.chunk WHERE ch.doc_id IS NOT NULL GROUP BY p.id)"""
#: The names in a question q of table t: what is called, the dotted name, the method and the class.
_NAMED = r"""nm0 AS (SELECT *, nullif(regexp_extract(q, '([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1), '') AS called, nullif(regexp_extract(q, '([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+)', 1), '') AS chain FROM {t}),
 named AS (SELECT *, coalesce(called, string_split(chain, '.')[-1]) AS method, coalesce(string_split(chain, '.')[1], list_filter(regexp_extract_all(q, '[a-z]+|[A-Z][a-z]*'), lambda w: regexp_matches(w, '^[A-Z]'))[1]) AS class FROM nm0)"""

SQL = {
    "json_fields": "WITH x AS (SELECT event_id, nullif(trim(coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k'), json_extract_string(props, '$.data.k'))), '') AS k FROM events) SELECT event_id, coalesce(TRY_CAST(k AS INT), -1) AS k, coalesce(lower(k) IN ('true', '1', 'yes'), false) AS flag, coalesce(TRY_CAST(k AS DOUBLE), 0.5) AS weight FROM x",
    "prefix_filter": f"WITH {UNITS}, p AS (SELECT 'vec:' || id || ':' || lower(coalesce(language, '*')) || ':*' AS prefix, id, lower(language) AS language FROM code_project WHERE id % 20 = 0) SELECT prefix, cu.id FROM cu JOIN p ON p.id = cu.project_id AND (p.language IS NULL OR p.language = lower(cu.language))",
    "answer_gate": f"WITH {NOW} SELECT id, CASE WHEN level_confidence >= 0.45 THEN 'answer' ELSE 'agent' END AS route, level IN (1, 3) OR level_confidence >= 0.85 AS skip_checks FROM now",
    "settings_merged": """WITH p AS (SELECT id, lower(coalesce(language, '?')) AS language, total_files, total_methods FROM code_project), b AS (SELECT language, max(total_files) AS f, min(total_methods) AS m FROM p GROUP BY 1)
 SELECT id, CASE WHEN coalesce(total_files, 0) % 3 > 0 THEN total_files ELSE f END AS files, CASE WHEN coalesce(total_methods, 0) % 3 > 0 THEN total_methods ELSE m END AS methods FROM p JOIN b USING (language)""",
    "question_routes": f"""WITH {PT}, x AS (SELECT id, coalesce(source_question, title) AS q FROM pt), {_NAMED.format(t="x")} SELECT id, CASE WHEN contains(lower(q), 'code') THEN 'code' WHEN contains(lower(q), 'doc') THEN 'doc' WHEN contains(lower(q), 'both') THEN 'both' ELSE 'unknown' END AS route,
 CASE WHEN regexp_matches(lower(coalesce(q, '')), '{parsing.CALL_CHAIN}') THEN 'CALL_CHAIN' WHEN regexp_matches(lower(coalesce(q, '')), '{parsing.METHOD}') THEN CASE WHEN called IS NULL AND chain IS NOT NULL THEN 'CALL_CHAIN' ELSE 'METHOD_LOOKUP' END
 WHEN regexp_matches(lower(coalesce(q, '')), '{parsing.IMPLEMENTATION}') THEN 'IMPLEMENTATION' WHEN called IS NOT NULL THEN 'METHOD_LOOKUP' ELSE 'UNKNOWN' END AS intent, method, class FROM named""",
    "level_from_text": f"WITH {NOW} SELECT id, CASE WHEN level BETWEEN 1 AND 5 THEN level ELSE 0 END AS level FROM now",
    "cited_excerpts": f"WITH {CHUNKS}, c AS (SELECT id, content, substring(lead(content) OVER (PARTITION BY doc_id ORDER BY coalesce(seq, -1), id), 1, 30) AS e FROM ch WHERE doc_id IS NOT NULL AND length(content) > 0) SELECT id, contains(content, e) AS verbatim FROM c WHERE e IS NOT NULL",
    "strict_verified": f"""WITH {ASKED}, {CORPUS}, kw AS ({_keyword_sql(8)}), x AS (SELECT kw.*, lower(coalesce(file_name, '')) AS file, seq, corpus.text AS content, lower(corpus.text) AS low, asked.text AS q FROM kw JOIN asked USING (query_id) JOIN corpus USING (chunk_id)), {_NAMED.format(t="x")},
 z AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS base, lower(method) AS m, lower(class) AS c, instr(low, lower(method)) AS p, len(string_split(content, chr(10))) AS n FROM named),
 y AS (SELECT query_id, chunk_id, floor((0.4 * base + 0.25 * CASE WHEN m IS NULL THEN 0.5 WHEN contains(file, m) THEN 1 WHEN p > 0 THEN CASE WHEN (p = 1 OR NOT regexp_matches(substring(low, p - 1, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substring(low, p + length(m), 1), '[\\p{{L}}\\p{{N}}]') THEN 0.8 ELSE 0.5 END ELSE 0 END
 + 0.15 * CASE WHEN c IS NULL THEN 0.5 WHEN contains(file, c) THEN 1 ELSE 0 END + 0.1 * CASE WHEN trim(content) = '' THEN 0 WHEN n >= 10 THEN 1 WHEN n >= 5 THEN 0.7 WHEN n >= 3 THEN 0.4 ELSE 0.2 END
 + 0.1 * CASE WHEN coalesce(seq, 0) <= 0 THEN 0 ELSE greatest(0, 0.2 * (1 - least(1, (seq - 1) / 20))) END) * 10000 + 0.5) / 10000 AS strict FROM z) SELECT *, strict >= 0.6 AS passed FROM y""",
    "claims_supported": f"""WITH {PT}, {CHUNKS}, s AS (SELECT id AS item, list_concat(regexp_extract_all(concept, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), string_split(coalesce(title, ''), ' ')) AS l FROM pt WHERE concept IS NOT NULL),
 c AS (SELECT item, n - 1 AS n, lower(trim(l[n])) AS claim FROM (SELECT item, l, unnest(generate_series(1, len(l))) AS n FROM s) t WHERE trim(l[n]) <> ''),
 r AS (SELECT DISTINCT id AS item, CAST(unnest(regexp_extract_all(chunk_ids, '[0-9]+')) AS BIGINT) AS chunk FROM pt WHERE concept IS NOT NULL),
 f AS (SELECT DISTINCT c.item, n FROM c JOIN r USING (item) JOIN ch ON ch.id = r.chunk WHERE contains(lower(coalesce(content, '')), claim)),
 g AS (SELECT c.item, count(*) AS n_claims, count(f.n) AS n_supported, string_agg(claim, chr(10) ORDER BY c.n) FILTER (WHERE f.n IS NOT NULL) AS kept, string_agg(claim, chr(10) ORDER BY c.n) AS whole FROM c LEFT JOIN f ON f.item = c.item AND f.n = c.n GROUP BY 1)
 SELECT item, n_claims, n_supported, round(n_supported / n_claims, 6) AS support, md5(coalesce(kept, whole)) AS answer_md5 FROM g""",
    "hits_added": f"""WITH {VEC}, a AS ({_dense_sql(4, 'level IN (1, 2)')}), b AS ({_dense_sql(6)}), u AS (SELECT *, 1 AS round FROM a UNION ALL SELECT *, 2 FROM b), x AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round, rank) AS r FROM u)
 SELECT query_id, CAST(round AS INT) AS round, count(*) FILTER (WHERE r = 1) AS n_added, count(*) AS n_hits FROM x GROUP BY 1, 2""",
    "cache_found": f"""WITH {VEC}, {ENTRIES}, dn AS ({_dense_sql(10)}), a AS (SELECT dn.* FROM dn JOIN en ON en.entry = dn.chunk_id WHERE query_id <> chunk_id AND score >= 0.3 AND expires_at > TIMESTAMP '2026-02-01'),
 b AS (SELECT query_id, first(chunk_id ORDER BY score DESC, chunk_id) AS entry FROM a GROUP BY 1) SELECT vec_id AS query_id, entry FROM vec LEFT JOIN b ON b.query_id = vec_id WHERE vec_id % 20 = 0""",
    "cache_kept": f"WITH {ENTRIES}, {NOW}, bad AS (SELECT id FROM now WHERE deleted = 1 OR status = 'FAILED') SELECT entry, CAST(len(sources) AS INT) AS n_sources FROM en WHERE entry NOT IN (SELECT entry FROM (SELECT entry, unnest(sources) AS s FROM en) t WHERE s IN (SELECT id FROM bad))",
    "call_graph_scores": f"WITH {EDGES}, c AS (SELECT DISTINCT method_name, caller_file FROM edges) SELECT cu.id, CAST(least(1.0, 0.5 * count(*)) AS DOUBLE) AS score FROM cu JOIN c USING (method_name) WHERE caller_file <> file_path GROUP BY cu.id",
    "callers_by_substring": f"""WITH {UNITS}, a AS (SELECT project_id, id AS unit_id, lower(method_name) AS m FROM cu WHERE id % 20 = 0 AND length(method_name) > 0), c AS (SELECT project_id, id AS caller_id, lower(unnest(calls)) AS call FROM cu)
 SELECT DISTINCT unit_id, caller_id FROM a JOIN c USING (project_id) WHERE m <> '' AND contains(call, m) AND unit_id <> caller_id""",
    "units_from_two_indexes": f"""WITH {UNITS}, e AS (SELECT project_id, file_path, 'exact' AS index, id FROM cu WHERE len(enriched_calls) > 0), u AS (SELECT * FROM e UNION ALL SELECT project_id, file_path, 'parsed', id FROM cu WHERE (project_id, file_path) NOT IN (SELECT (project_id, file_path) FROM e))
 SELECT project_id, index, count(*) AS n_units, count(DISTINCT file_path) AS n_files FROM u GROUP BY 1, 2""",
    "changed_since": f"WITH {UNITS}, x AS (SELECT *, percent_rank() OVER (PARTITION BY project_id ORDER BY created_at, id) AS s FROM cu WHERE created_at IS NOT NULL) SELECT project_id, count(DISTINCT file_path) AS n_files, min(created_at) AS since FROM x WHERE s > 0.75 GROUP BY 1",
    "repository_sizes": f"WITH {UNITS}, b AS (SELECT project_id, CAST(floor(sum(coalesce(strlen(body), 0)) / 1024) AS BIGINT) AS kb, count(DISTINCT file_path) AS n_files FROM cu GROUP BY 1) SELECT *, CASE WHEN kb // 1024 > 2000 OR n_files > 50000 THEN 'REJECT' WHEN kb // 1024 > 500 OR n_files > 10000 THEN 'WARN' ELSE 'OK' END AS gate FROM b",
    "knowledge_counts": f"WITH {PT} SELECT related_project_id, count(*) AS n, count(*) FILTER (WHERE upper(status) = 'ACTIVE') AS n_active, first(id ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01') DESC, id DESC) AS newest_id FROM pt WHERE related_project_id IS NOT NULL GROUP BY 1",
    "snapshots_kept": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, status, chunk_count) AS rn FROM (SELECT DISTINCT * FROM knowledge_document) t)
 SELECT id, count(*) AS n_kept, first(status ORDER BY chunk_count DESC, rn DESC) AS largest_status FROM x WHERE rn <= 3 GROUP BY id""",
    "relation_map": f"""WITH {GRAPH}, {_hops("SELECT id FROM nd WHERE id % 20 = 0")} SELECT source, '{{' || string_agg('"' || node || '":' || hops, ',' ORDER BY CAST(node AS VARCHAR)) || '}}' AS related FROM near GROUP BY source""",
    "nodes_synced": f"WITH {NOW} SELECT id, file_name, coalesce(level, 0) AS level, CAST(len(list_filter(string_split(coalesce(tags, ''), ','), lambda t: trim(t) <> '')) AS INT) AS n_tags FROM now WHERE deleted = 0",
    "keyword_coverage": f"""WITH {ASKED}, {CORPUS}, kw AS ({_keyword_sql(8)}), e AS (SELECT query_id, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 5)) AS expected FROM asked),
 s AS (SELECT query_id, lower(string_agg(text, ' ')) AS shown FROM kw JOIN corpus USING (chunk_id) WHERE rank <= 5 GROUP BY 1), x AS (SELECT query_id, len(list_filter(expected, lambda w: contains(coalesce(shown, ''), w))) / len(expected) AS c FROM e LEFT JOIN s USING (query_id) WHERE len(expected) > 0)
 SELECT query_id, round(c, 6) AS coverage, c >= 0.3 AS hit FROM x""",
}
