"""Queries over documents, chunks and code metadata: ingest, splitting, masking, call graphs, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import codebase, textual
from sedimenta.operators.rolling import latest_rows
from sedimenta.sources import load
from sedimenta.sources.files import upsert

WORDS = ("secret-store", "token", "signature", "password", "secret")
DOCUMENT_FIELDS = ["user_id", "file_name", "file_md5", "status", "version", "deleted", "chunk_count", "created_at", "updated_at", "level", "tags", "level_confidence"]


def documents_now(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each knowledge document."""
    return latest_rows(load(spark, d, "knowledge_document"), "id", ["updated_at"], DOCUMENT_FIELDS)


def chunks_once(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "document_chunk").dropDuplicates(["id"])


def live_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the current version of documents that aren't deleted, with the document's level and file name."""
    docs = documents_now(spark, d).where("deleted = 0").select(F.col("id").alias("doc_id"), F.col("version").alias("doc_version"), "level", "file_name")
    return chunks_once(spark, d).join(docs, ["doc_id", "doc_version"])


def units_once(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_unit").dropDuplicates(["id"])


def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent upload: documents of the same content are the first one's."""
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("content_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_uploads"))


def ingest_new(spark: SparkSession, d: str) -> DataFrame:
    """Uploads whose digest no live document has."""
    known = documents_now(spark, d).where("deleted = 0").select("file_md5")
    uploads = load(spark, d, "code_unit").select(F.col("checksum").alias("file_md5")).where(F.col("file_md5").isNotNull()).distinct()
    docs = load(spark, d, "knowledge_document").select("file_md5").distinct()
    return uploads.union(docs).distinct().join(known, "file_md5", "left_anti")


def sink_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Document states as of a day with the later ones merged in."""
    fields = ["id", "status", "version", "deleted", "chunk_count", "updated_at"]
    states = load(spark, d, "knowledge_document").select(*fields)
    day = F.lit("2025-12-01").cast("timestamp_ntz")
    return upsert(states.where(F.col("updated_at") < day), states.where(F.col("updated_at") >= day), ["id"], ["updated_at"])


def sink_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stay when deleted documents take theirs along."""
    gone = documents_now(spark, d).where("deleted = 1").select(F.col("id").alias("doc_id"))
    return chunks_once(spark, d).join(gone, "doc_id", "left_anti").select("id", "doc_id")


def filter_live(spark: SparkSession, d: str) -> DataFrame:
    return live_chunks(spark, d).select("id", "doc_id", "doc_version", "level")


def filter_levels(spark: SparkSession, d: str) -> DataFrame:
    return live_chunks(spark, d).where(F.col("level").isin(1, 2, 3)).groupBy("level").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))


def first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of each document by seq."""
    best = F.min(F.struct(F.coalesce("seq", F.lit(2**31 - 1)).alias("s"), "id")).alias("b")
    return chunks_once(spark, d).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(best).select("doc_id", F.col("b.id").alias("chunk_id"))


def page_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents_now(spark, d).where("deleted = 0").orderBy(F.col("created_at").desc(), "id").offset(20).limit(20).select("id", "file_name", "created_at")


def text_types(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", textual.detect_type(F.col("file_name"), F.coalesce("text", F.lit(""))).alias("kind"))


def text_hard_split(spark: SparkSession, d: str) -> DataFrame:
    pieces = textual.hard_split(load(spark, d, "documents"), "doc_id", "text", 1000, 100)
    return pieces.select("doc_id", "piece_no", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


def text_semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return textual.chunk_documents(load(spark, d, "documents"), "doc_id", "text")


def text_heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts by headings and packed paragraphs with overlap: chunks and characters of each document."""
    chunks = textual.heading_documents(load(spark, d, "documents"), "doc_id", "text")
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), F.max(F.length("content")).alias("longest"))


def text_contexts(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunks_once(spark, d).where(F.col("content").isNotNull())
    description = textual.context_description(textual.first_heading(F.col("content")), F.col("content"), F.col("context_description"))
    rows = chunks.select("id", description.alias("description"), "content")
    return rows.select("id", "description", F.md5(textual.embedding_text(F.col("description"), F.col("content")).cast("binary")).alias("embedding_text_md5"))


def text_masked(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunks_once(spark, d).where("content IS NOT NULL")
    return chunks.select("id", textual.contains_any(F.col("content"), WORDS).alias("found"), F.md5(textual.mask(F.col("content"), WORDS).cast("binary")).alias("masked_md5"))


def text_of_html(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", textual.html_text(F.col("text")).alias("plain"))


def text_unfenced(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunks_once(spark, d).where("content IS NOT NULL")
    return chunks.select("id", F.md5(textual.unfence(F.col("content")).cast("binary")).alias("body_md5"))


def text_truncated(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunks_once(spark, d).where(F.col("content").isNotNull())
    return chunks.select("id", (F.length("content") > 600).alias("compress"), F.md5(textual.truncate(F.col("content"), 500).cast("binary")).alias("cut_md5"))


def text_context_shown(spark: SparkSession, d: str) -> DataFrame:
    """The first five chunks of each document as one numbered context."""
    rows = live_chunks(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("seq", F.lit(2**31 - 1)), "id"))).where("rank <= 5")
    return textual.shown_context(rows, "doc_id", "rank", "file_name", "seq", "content").select("doc_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def text_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = live_chunks(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("seq", F.lit(2**31 - 1)), "id"))).where("rank <= 5")
    return textual.citations(rows, "doc_id", "rank", "file_name", "seq")


def tags_exploded(spark: SparkSession, d: str) -> DataFrame:
    tags = documents_now(spark, d).select(F.explode(F.split(F.coalesce("tags", F.lit("")), ",")).alias("tag"))
    return tags.select(F.trim("tag").alias("tag")).where("tag != ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    return codebase.call_edges(units_once(spark, d))


def code_callers(spark: SparkSession, d: str) -> DataFrame:
    calls = load(spark, d, "code_method_call")
    return codebase.callers(calls.where("id % 20 = 0"), calls.select("project_id", "caller_file", "method_name").distinct())


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Files with a unit created since the watermark."""
    return units_once(spark, d).where("created_at >= TIMESTAMP_NTZ '2025-12-15 00:00:00'").select("project_id", "file_path").distinct()


def code_ripple(spark: SparkSession, d: str) -> DataFrame:
    before = units_once(spark, d).where("created_at < TIMESTAMP_NTZ '2025-12-15 00:00:00'")
    return codebase.ripple(_changed(spark, d), units_once(spark, d), codebase.call_edges(units_once(spark, d)), before)


def code_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Units by file that stay when the files of archived projects are deleted, and the files that called into those."""
    units = units_once(spark, d)
    archived = load(spark, d, "code_project").where(F.upper("status") == "ARCHIVED").select(F.col("id").alias("project_id"))
    gone = units.join(archived, "project_id", "left_semi").select("project_id", "file_path").distinct()
    kept = codebase.without_files(units, gone)
    called = codebase.callers(units.join(gone, ["project_id", "file_path"], "left_semi").where("method_name IS NOT NULL"), codebase.call_edges(units)).groupBy("project_id").agg(F.count_distinct("caller_file").alias("n_callers"))
    by = kept.groupBy("project_id", F.lit("kept").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(called.select("project_id", F.lit("called").alias("what"), F.col("n_callers").alias("n")))


def code_stacks(spark: SparkSession, d: str) -> DataFrame:
    """Build tool, framework and number of files with an entry point of each project."""
    return codebase.stacks(units_once(spark, d).select("project_id", F.col("file_path").alias("path"), F.coalesce("body", F.lit("")).alias("text")))


def code_impact(spark: SparkSession, d: str) -> DataFrame:
    return codebase.impact(_changed(spark, d), units_once(spark, d), codebase.call_edges(units_once(spark, d)))


def code_enclosing(spark: SparkSession, d: str) -> DataFrame:
    units = units_once(spark, d).where("start_line IS NOT NULL AND end_line IS NOT NULL")
    points = units.select("project_id", "file_path", F.col("id").alias("point_id"), ((F.col("start_line") + F.col("end_line")) / 2).cast("int").alias("line"))
    return codebase.enclosing(units.select("project_id", "file_path", F.col("id").alias("unit_id"), "start_line", "end_line"), points)


def code_languages(spark: SparkSession, d: str) -> DataFrame:
    files = units_once(spark, d).select("project_id", "file_path").distinct().where(codebase.is_source(F.col("file_path")))
    counted = files.groupBy("project_id", codebase.language_of(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("project_id").agg(F.sum("n").alias("n_files"), F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("main_language"))


def code_modules(spark: SparkSession, d: str) -> DataFrame:
    files = units_once(spark, d).select("project_id", "file_path").distinct()
    module = F.coalesce(codebase.module_of(F.col("file_path")), codebase.module_of(F.col("file_path"), "src/app"))
    counted = files.groupBy("project_id", module.alias("module")).agg(F.count(F.lit(1)).alias("n")).where("module IS NOT NULL AND n >= 3")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("n").desc(), "module"))
    return counted.withColumn("rank", rank).where("rank <= 10")


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """Units by file with the first five methods by line."""
    units = units_once(spark, d).where(F.col("method_name").isNotNull())
    methods = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), "method_name"))), 1, 5), lambda s: s["method_name"])
    return units.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("n_methods"), F.array_join(methods, ", ").alias("methods"))


def code_vector_texts(spark: SparkSession, d: str) -> DataFrame:
    units = units_once(spark, d)
    return units.select("id", F.md5(codebase.vector_text(units).cast("binary")).alias("text_md5"))


def code_incidents(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("source", codebase.incident_severity(F.col("text")).alias("severity")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("severity").alias("n_incidents"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"))


def code_line_slices(spark: SparkSession, d: str) -> DataFrame:
    units = units_once(spark, d).where(F.col("body").isNotNull())
    return units.select("id", codebase.line_slice(F.col("body"), F.lit(2), F.lit(4)).alias("lines"))


def code_indexable(spark: SparkSession, d: str) -> DataFrame:
    units = units_once(spark, d).where(codebase.is_source(F.col("file_path")) & codebase.extension(F.col("file_path")).isin(list(codebase.LANGUAGES)) & F.length(F.trim("body")).between(1, 500_000))
    return units.groupBy(codebase.extension(F.col("file_path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("n_chars"))


def code_grep(spark: SparkSession, d: str) -> DataFrame:
    return units_once(spark, d).where(F.col("body").contains("log.warn")).select("id", "file_path")


def code_project_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules and repository names out of the projects' JSON columns."""
    projects = load(spark, d, "code_project")
    name = F.regexp_extract(F.get(F.from_json("repo_urls", "array<string>"), F.lit(0)), r"([^/]+?)(?:\.git)?$", 1)
    files = F.aggregate(F.from_json("modules", "array<struct<name:string,files:int>>"), F.lit(0), lambda a, m: a + F.coalesce(m["files"], F.lit(0)))
    return projects.select("id", F.nullif(name, F.lit("")).alias("repo"), files.alias("n_files"), F.initcap(F.regexp_replace("name", "-", " ")).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_dedup, ingest_new, sink_upsert, sink_delete, filter_live, filter_levels, first_chunks, page_of_documents, text_types, text_hard_split, text_semantic_chunks, text_heading_chunks, text_contexts, text_masked,
        text_of_html, text_unfenced, text_truncated, text_context_shown, text_citations, tags_exploded, code_edges, code_callers, code_ripple, code_impact, code_enclosing, code_languages, code_modules,
        code_files, code_vector_texts, code_incidents, code_line_slices, code_indexable, code_grep, code_project_modules, code_deleted, code_stacks,
    )
}

NOW = """now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM knowledge_document) t WHERE rn = 1)"""
CHUNKS = "ch AS (SELECT DISTINCT ON (id) * FROM document_chunk)"
LIVE = f"{NOW}, {CHUNKS}, live AS (SELECT ch.*, now.level, now.file_name FROM ch JOIN now ON now.id = ch.doc_id AND now.version = ch.doc_version AND now.deleted = 0)"
UNITS = "cu AS (SELECT DISTINCT ON (id) * FROM code_unit)"
EDGES = UNITS + r""", edges AS (SELECT DISTINCT project_id, caller_file, method_name FROM (SELECT project_id, file_path AS caller_file, string_split(string_split(c, '(')[1], '.')[-1] AS method_name
FROM (SELECT project_id, file_path, unnest(CASE WHEN len(enriched_calls) > 0 THEN enriched_calls ELSE calls END) AS c FROM cu) t) u WHERE length(method_name) > 0)"""
CHANGED = "changed AS (SELECT DISTINCT project_id, file_path FROM cu WHERE created_at >= TIMESTAMP '2025-12-15')"
FIVE = "five AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(seq, 2147483647), id) AS rank FROM live)"
_EXT = r"lower(regexp_extract({c}, '\.([A-Za-z0-9]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_EXT.format(c='file_path')} = '{k}' THEN '{v}'" for k, v in codebase.LANGUAGES.items()) + f" ELSE {_EXT.format(c='file_path')} END"
_RANK = "CASE name " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(codebase.BUILD_FILES)) + " END"
_SOURCE = r"NOT regexp_matches(file_path, '(^|/)(\.[^/]+|node_modules|target|dist|build|\.next|vendor|__pycache__)(/|$)')"
_MASK = "content"
for _w in sorted(WORDS, key=lambda w: (-len(w), w)):
    _MASK = f"replace({_MASK}, '{_w}', '{'*' * len(_w)}')"
_HTML = r"regexp_replace(regexp_replace(text, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"
_HEAD = r"regexp_extract(content, '(?m)^#{1,4}[ \t]+(\S[^\r\n]*)$', 1)"

SQL = {
    "ingest_dedup": "SELECT md5(text) AS content_md5, min(doc_id) AS doc_id, count(*) AS n_uploads FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "ingest_new": f"WITH {NOW} SELECT DISTINCT file_md5 FROM (SELECT checksum AS file_md5 FROM code_unit WHERE checksum IS NOT NULL UNION ALL SELECT file_md5 FROM knowledge_document) t WHERE file_md5 NOT IN (SELECT file_md5 FROM now WHERE deleted = 0)",
    "sink_upsert": f"WITH {NOW} SELECT id, status, version, deleted, chunk_count, updated_at FROM now",
    "sink_delete": f"WITH {NOW}, {CHUNKS} SELECT id, doc_id FROM ch WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.id = ch.doc_id AND now.deleted = 1)",
    "filter_live": f"WITH {LIVE} SELECT id, doc_id, doc_version, level FROM live",
    "filter_levels": f"WITH {LIVE} SELECT level, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM live WHERE level IN (1, 2, 3) GROUP BY level",
    "first_chunks": f"WITH {CHUNKS} SELECT doc_id, first(id ORDER BY coalesce(seq, 2147483647), id) AS chunk_id FROM ch WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "page_of_documents": f"WITH {NOW} SELECT id, file_name, created_at FROM now WHERE deleted = 0 ORDER BY created_at DESC, id LIMIT 20 OFFSET 20",
    "text_types": r"""SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(file_name, '')), '\.(md|markdown|rst)$') THEN 'MARKDOWN'
  WHEN (regexp_matches(lower(coalesce(file_name, '')), '\.txt$') OR NOT contains(lower(coalesce(file_name, '')), '.')) AND length(coalesce(text, '')) >= 20
   AND (regexp_matches(coalesce(text, ''), '(?m)^#{1,6}\s+\S') OR contains(coalesce(text, ''), '```') OR contains(coalesce(text, ''), '|')) THEN 'MARKDOWN' ELSE 'TEXT' END AS kind FROM documents""",
    "text_hard_split": """SELECT doc_id, CAST(k AS INT) AS piece_no, CAST(length(p) AS INT) AS n_chars, md5(p) AS piece_md5 FROM (SELECT doc_id, k, substring(text, CAST(k * 900 + 1 AS BIGINT), 1000) AS p
  FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT))) AS k FROM documents WHERE length(text) > 0) t) u""",
    "text_contexts": f"""WITH {CHUNKS}, x AS (SELECT id, content, coalesce(CASE WHEN trim(context_description) <> '' THEN context_description END, CASE WHEN trim({_HEAD}) <> '' THEN '文档章节：' || {_HEAD} END,
  CASE WHEN length(content) > 50 THEN substring(content, 1, 50) || '...' ELSE content END) AS description FROM ch WHERE content IS NOT NULL)
SELECT id, description, md5(CASE WHEN coalesce(trim(description), '') <> '' THEN description || chr(10) || chr(10) || content ELSE content END) AS embedding_text_md5 FROM x""",
    "text_masked": f"WITH {CHUNKS} SELECT id, regexp_matches(content, '{'|'.join(sorted(WORDS, key=len, reverse=True))}') AS found, md5({_MASK}) AS masked_md5 FROM ch WHERE content IS NOT NULL",
    "text_of_html": rf"SELECT doc_id, trim(regexp_replace({_HTML}, '\s+', ' ', 'g'), ' ') AS plain FROM documents",
    "text_unfenced": rf"""WITH {CHUNKS}, x AS (SELECT id, content, regexp_extract(content, '(?s)```[A-Za-z]*\s*(.*?)```', 1) AS f FROM ch WHERE content IS NOT NULL)
SELECT id, md5(regexp_replace(CASE WHEN f <> '' THEN f ELSE content END, '^\s+|\s+$', '', 'g')) AS body_md5 FROM x""",
    "text_truncated": f"WITH {CHUNKS} SELECT id, length(content) > 600 AS compress, md5(CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END) AS cut_md5 FROM ch WHERE content IS NOT NULL",
    "text_context_shown": f"""WITH {LIVE}, {FIVE} SELECT doc_id, md5(string_agg('[片段' || rank || ' 来源:' || coalesce(file_name, '') || ' #' || coalesce(CAST(seq AS VARCHAR), '') || ']' || chr(10) || coalesce(content, '') || chr(10) || chr(10), '' ORDER BY rank)) AS context_md5
FROM five WHERE rank <= 5 GROUP BY doc_id""",
    "text_citations": f"""WITH {LIVE}, {FIVE} SELECT doc_id, '[' || string_agg('{{"index":' || rank || ',"file":"' || replace(coalesce(file_name, ''), '"', '') || '","seq":' || coalesce(seq, -1) || '}}', ',' ORDER BY rank) || ']' AS sources FROM five WHERE rank <= 5 GROUP BY doc_id""",
    "tags_exploded": f"WITH {NOW} SELECT trim(tag) AS tag, count(*) AS n FROM (SELECT unnest(string_split(coalesce(tags, ''), ',')) AS tag FROM now) t WHERE trim(tag) <> '' GROUP BY 1",
    "code_edges": f"WITH {EDGES} SELECT * FROM edges",
    "code_callers": "SELECT DISTINCT m.project_id, m.method_name, e.caller_file FROM code_method_call m JOIN code_method_call e ON e.project_id = m.project_id AND e.method_name = m.method_name WHERE m.id % 20 = 0",
    "code_ripple": f"""WITH {EDGES}, {CHANGED} SELECT project_id, file_path AS file FROM changed UNION
SELECT e.project_id, e.caller_file FROM cu JOIN changed USING (project_id, file_path) JOIN edges e ON e.project_id = cu.project_id AND e.method_name = cu.method_name""",
    "code_impact": f"""WITH {EDGES}, {CHANGED}, m AS (SELECT DISTINCT cu.project_id, cu.file_path, cu.method_name FROM cu JOIN changed USING (project_id, file_path) WHERE cu.method_name IS NOT NULL)
SELECT project_id, file_path || '#' || method_name AS changed_method, CAST(count(*) AS INT) AS n_callers, array_to_string(list(caller_file ORDER BY caller_file)[1:5], '|') AS first_callers
FROM m JOIN (SELECT DISTINCT method_name, caller_file FROM edges) e USING (method_name) GROUP BY project_id, file_path, method_name""",
    "code_enclosing": f"""WITH {UNITS}, u AS (SELECT * FROM cu WHERE start_line IS NOT NULL AND end_line IS NOT NULL), p AS (SELECT project_id, file_path, id AS point_id, CAST(floor((start_line + end_line) / 2.0) AS INT) AS line FROM u)
SELECT project_id, file_path, point_id, line, unit_id FROM (SELECT p.*, u.id AS unit_id, row_number() OVER (PARTITION BY p.point_id ORDER BY u.end_line - u.start_line, -u.start_line, u.id) AS rn
 FROM p JOIN u ON u.project_id = p.project_id AND u.file_path = p.file_path AND p.line BETWEEN u.start_line AND u.end_line) t WHERE rn = 1""",
    "code_languages": f"""WITH {UNITS}, f AS (SELECT DISTINCT project_id, file_path FROM cu WHERE {_SOURCE}), c AS (SELECT project_id, {_LANG} AS language, count(*) AS n FROM f GROUP BY 1, 2)
SELECT project_id, CAST(sum(n) AS BIGINT) AS n_files, first(language ORDER BY -n, language) AS main_language FROM c GROUP BY project_id""",
    "code_modules": f"""WITH {UNITS}, c AS (SELECT project_id, coalesce(nullif(regexp_extract(file_path, '(?:^|/)src/(?:main|test)/[^/]+/[^/]+/([^/]+)(?:/|$)', 1), ''), nullif(regexp_extract(file_path, '(?:^|/)(cmd/[^/]+)', 1), ''), nullif(regexp_extract(file_path, '(?:^|/)src/app/([^/]+)/', 1), '')) AS module, count(*) AS n FROM (SELECT DISTINCT project_id, file_path FROM cu) t GROUP BY 1, 2)
SELECT * FROM (SELECT project_id, module, n, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, module) AS INT) AS rank FROM c WHERE module IS NOT NULL AND n >= 3) t WHERE rank <= 10""",
    "code_files": f"WITH {UNITS} SELECT project_id, file_path, count(*) AS n_methods, array_to_string(list(method_name ORDER BY coalesce(start_line, 0), method_name)[1:5], ', ') AS methods FROM cu WHERE method_name IS NOT NULL GROUP BY 1, 2",
    "code_vector_texts": f"""WITH {UNITS}, x AS (SELECT *, coalesce(signature, method_name) AS s, substring(body, 1, 200) AS b FROM cu)
SELECT id, md5(CASE WHEN coalesce(trim(comment), '') <> '' THEN comment || chr(10) ELSE '' END || CASE WHEN coalesce(trim(s), '') <> '' THEN s || chr(10) ELSE '' END
 || CASE WHEN len(calls) > 0 THEN 'calls: ' || array_to_string(calls, ', ') || chr(10) ELSE '' END || CASE WHEN coalesce(trim(b), '') <> '' THEN b || chr(10) ELSE '' END) AS text_md5 FROM x""",
    "code_incidents": f"""WITH x AS (SELECT source, CASE WHEN regexp_matches(lower(text), '{"|".join(codebase.INCIDENT_WORDS)}') THEN CASE WHEN regexp_matches(lower(text), 'critical|urgent|p0|严重|紧急') THEN 'CRITICAL'
 WHEN regexp_matches(lower(text), 'typo|minor|docs|style|轻微') THEN 'MINOR' ELSE 'MAJOR' END END AS severity FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS n, count(severity) AS n_incidents, count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical FROM x GROUP BY source""",
    "code_line_slices": f"WITH {UNITS}, x AS (SELECT id, string_split(body, chr(10)) AS l FROM cu WHERE body IS NOT NULL) SELECT id, CASE WHEN len(l) >= 2 THEN array_to_string(l[2:4], chr(10)) END AS lines FROM x",
    "code_indexable": f"""WITH {UNITS} SELECT {_EXT.format(c="file_path")} AS extension, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM cu
WHERE {_SOURCE} AND {_EXT.format(c="file_path")} IN ({", ".join(f"'{k}'" for k in codebase.LANGUAGES)}) AND length(trim(body)) BETWEEN 1 AND 500000 GROUP BY 1""",
    "code_grep": f"WITH {UNITS} SELECT id, file_path FROM cu WHERE contains(body, 'log.warn')",
    "code_deleted": f"""WITH {EDGES}, gone AS (SELECT id FROM code_project WHERE upper(status) = 'ARCHIVED') SELECT project_id, 'kept' AS what, count(*) AS n FROM cu WHERE project_id NOT IN (SELECT id FROM gone) OR project_id IS NULL OR file_path IS NULL GROUP BY 1
 UNION ALL SELECT e.project_id, 'called', count(DISTINCT e.caller_file) FROM edges e JOIN (SELECT DISTINCT project_id, method_name FROM cu WHERE project_id IN (SELECT id FROM gone) AND method_name IS NOT NULL) m USING (project_id, method_name) GROUP BY 1""",
    "code_stacks": f"""WITH {UNITS}, f AS (SELECT project_id, file_path AS path, coalesce(body, '') AS text, regexp_extract(file_path, '([^/]+)$', 1) AS name, {_LANG} AS language, {_EXT.format(c="file_path")} AS ext FROM cu),
 g AS (SELECT *, {_RANK} AS rank, regexp_matches(lower(name), 'springbootapplication|springapplication') OR (name = 'pom.xml' AND contains(text, 'spring-boot-starter')) AS boot,
  CASE WHEN ext = 'go' THEN CASE WHEN contains(text, 'gin') THEN 0 WHEN contains(text, 'beego') THEN 1 WHEN contains(text, 'fiber') THEN 2 WHEN contains(text, 'echo') THEN 3 END END AS go,
  CASE WHEN language = 'java' AND (contains(text, 'public static void main') OR contains(text, '@SpringBootApplication')) OR language = 'go' AND contains(text, 'func main()') THEN path END AS entry FROM f),
 l AS (SELECT project_id, first(language ORDER BY -n, language) AS language FROM (SELECT project_id, language, count(DISTINCT path) AS n FROM g WHERE language IS NOT NULL GROUP BY 1, 2) t GROUP BY 1),
 b AS (SELECT project_id, [{", ".join(f"'{t}'" for t in codebase.BUILD_FILES.values())}][min(rank) + 1] AS build_tool, coalesce(bool_or(boot), false) AS boot, min(go) AS go, count(DISTINCT entry) AS entry_points FROM g GROUP BY 1)
SELECT project_id, build_tool, CASE WHEN build_tool IN ('Maven', 'Gradle') THEN CASE WHEN boot THEN 'Spring Boot' ELSE 'Java' END WHEN build_tool = 'Go Mod' THEN coalesce(['Gin', 'Beego', 'Fiber', 'Echo'][go + 1], 'Go')
 WHEN build_tool IS NULL THEN CASE language WHEN 'java' THEN CASE WHEN boot THEN 'Spring Boot' ELSE 'Java' END WHEN 'python' THEN 'Python' WHEN 'javascript' THEN 'Node.js' WHEN 'typescript' THEN 'Node.js' WHEN 'go' THEN 'Go' END END AS framework, entry_points FROM b JOIN l USING (project_id)""",
    "code_project_modules": r"""SELECT id, nullif(regexp_extract(json_extract_string(repo_urls, '$[0]'), '([^/]+?)(?:\.git)?$', 1), '') AS repo,
 CAST(coalesce(list_sum(list_transform(CAST(json_extract(modules, '$[*].files') AS BIGINT[]), lambda f: coalesce(f, 0))), 0) AS INT) AS n_files,
 array_to_string(list_transform(string_split(name, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM code_project""",
}
