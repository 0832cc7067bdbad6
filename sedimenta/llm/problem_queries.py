"""Queries of the training-text problems over the given tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.byte_bpe import count_tokens, decode, encode
from sedimenta.llm.function_docs import function_docs, functions_in_sources
from sedimenta.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from sedimenta.llm.packing import CAPACITY, QUADRATIC, pack_documents
from sedimenta.llm.pieces import cut_oversized
from sedimenta.llm.quality import COMMON, quality
from sedimenta.sources import load, materialize


def _texts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"document_chunk": load(spark, d, "document_chunk").select("id", "content"), "code_unit": load(spark, d, "code_unit").select("id", "body")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(_texts(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(_texts(spark, d))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cut_oversized(load(spark, d, "document_chunk"), "id", "content", ["doc_id", "seq"], "created_at").withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece_no = 0").select("chunk_id")


def p3_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per cut chunk: its characters, whether all its pieces keep the limits, and a digest of the pieces put together again."""
    by = Window.partitionBy("chunk_id").orderBy("piece_no")
    pieces = p3_pieces(spark, d).withColumn("before", F.lag("piece").over(by))
    pieces = pieces.withColumn("fits", (F.length("piece") <= 1000) & F.coalesce(F.right("before", F.lit(100)) == F.left("piece", F.lit(100)), F.col("piece_no") == 0))
    new = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 101)"))
    whole = pieces.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new")))), lambda s: s["new"]), "").alias("text"), F.bool_and("fits").alias("fits"))
    return whole.select("chunk_id", F.length("text").alias("n_chars"), "fits", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return function_docs(load(spark, d, "code_unit")).where("verdict = 'described'").drop("verdict")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return function_docs(load(spark, d, "code_unit"), texts=False).where("verdict != 'described'").select("unit_id")


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    """Functions with their documentation out of the source files among the documents."""
    return functions_in_sources(load(spark, d, "documents"), "doc_id", "text").where("verdict = 'described'").drop("verdict")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(load(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each document's text, decoded from its token ids."""
    return decode(p6_ids(spark, d), "doc_id", "ids").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(count_tokens(load(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per container: its items, tokens, unused space and attention cost."""
    n = F.col("n_tokens")
    return p7_containers(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum(n).alias("n_tokens"), (F.lit(CAPACITY) - F.sum(n)).alias("unused"), F.sum(n + n * n * QUADRATIC).alias("cost"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per document whether it is whole unless above the capacity, and whether no container it is in holds more than that."""
    placed = materialize(p7_containers(spark, d), "placed")
    full = placed.groupBy("container").agg(F.sum("n_tokens").alias("filled"))
    by = placed.join(full, "container").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"), F.max("filled").alias("filled"))
    return by.select("doc_id", (F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))).alias("whole"), (F.col("filled") <= CAPACITY).alias("fits"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality(load(spark, d, "documents"), "doc_id", "text").drop("running_share", "prose")


def p8_prose(spark: SparkSession, d: str) -> DataFrame:
    return quality(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "running_share", "prose")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_prose(spark, d).where("NOT prose").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_whole": p3_whole, "p5_found": p5_found, "p5_pairs": p5_pairs, "p5_sources": p5_sources, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_kept": p7_kept, "p8_found": p8_found, "p8_prose": p8_prose, "p8_statistics": p8_statistics}

_BLANK = r"\p{Z}\s\x{85}\x0b\x1c-\x1f"
_STATISTICS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, lower(coalesce(text, '')) AS low FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(regexp_replace(low, '([\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+') AS words,
  list_filter(regexp_split_to_array(x, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS lines,
  length(low) - length(regexp_replace(low, '[^\\p{{L}}\\p{{N}}_{_BLANK}]', '', 'g')) AS symbols FROM t)
SELECT doc_id, CAST(length(x) AS BIGINT) AS n_chars, CAST(len(words) AS BIGINT) AS n_words, list_sum(list_transform(words, lambda v: length(v))) / nullif(len(words), 0) AS mean_word_length,
  symbols / nullif(length(x), 0) AS symbol_ratio, CAST(len(lines) AS BIGINT) AS n_lines,
  len(list_filter(lines, lambda l: regexp_matches(l, '[.!?。！？…][{_BLANK}]*$'))) / nullif(len(lines), 0) AS ended_share,
  len(list_filter(words, lambda v: v IN ({", ".join(f"'{c}'" for c in sorted(COMMON) if "'" not in c)}))) / nullif(len(words), 0) AS common_share
FROM w"""

_PAIRS = """
WITH t AS (SELECT 'document_chunk' AS table_name, id, content AS x FROM document_chunk UNION ALL SELECT 'code_unit', id, body FROM code_unit),
w AS (SELECT DISTINCT table_name, id, words FROM (SELECT table_name, id, regexp_extract_all(regexp_replace(lower(x), '([\\x{4E00}-\\x{9FFF}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}_]+') AS words FROM t) u WHERE len(words) >= 20),
s AS (SELECT table_name, id, unnest(list_distinct(list_transform(list_zip(words, words[2:], words[3:], true), lambda p: p[1] || ' ' || p[2] || ' ' || p[3]))) AS g FROM w),
n AS (SELECT table_name, id, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.table_name, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.table_name = b.table_name AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3)
SELECT p.table_name, id_a, id_b FROM p JOIN n a ON a.table_name = p.table_name AND a.id = id_a JOIN n b ON b.table_name = p.table_name AND b.id = id_b WHERE shared >= 0.5 * (a.n + b.n - shared)"""

#: Texts with the same words are one class; groups are what links between classes connect.
_GROUPS = _PAIRS.replace("\nWITH ", "\nWITH RECURSIVE ").split("SELECT p.table_name")[0] + """,
l AS (SELECT DISTINCT p.table_name, id_a AS a, id_b AS b FROM p JOIN n a ON a.table_name = p.table_name AND a.id = id_a JOIN n b ON b.table_name = p.table_name AND b.id = id_b WHERE shared >= 0.5 * (a.n + b.n - shared)),
u AS (SELECT table_name, a, b FROM l UNION SELECT table_name, b, a FROM l UNION SELECT table_name, id, id FROM w),
c AS (SELECT table_name, a AS id, b AS r FROM u UNION SELECT c.table_name, c.id, u.b FROM c JOIN u ON u.table_name = c.table_name AND u.a = c.r),
o AS (SELECT table_name, id, min(md5(words::VARCHAR)) AS cls FROM w GROUP BY 1, 2),
d AS (SELECT u.table_name, u.a AS id, count(DISTINCT y.cls) - 1 AS n_links FROM u JOIN o x ON x.table_name = u.table_name AND x.id = u.a JOIN o y ON y.table_name = u.table_name AND y.id = u.b GROUP BY 1, 2)
SELECT c.table_name, c.id, min(r) AS group_id, any_value(n_links) AS n_links FROM c JOIN d USING (table_name, id) GROUP BY 1, 2"""

SQL = {"p1_found": _PAIRS, "p1_groups": _GROUPS,
    "p3_whole": "SELECT DISTINCT id AS chunk_id, CAST(length(content) AS INT) AS n_chars, true AS fits, md5(content) AS text_md5 FROM document_chunk WHERE length(content) > 2000",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents", "p7_kept": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p3_found": "SELECT DISTINCT id AS chunk_id FROM document_chunk WHERE length(content) > 2000", "p8_statistics": _STATISTICS}
