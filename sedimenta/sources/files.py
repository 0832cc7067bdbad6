"""Files as tables: uploads, source trees, lexicons and evaluation sets; and tables with changes merged in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators.codebase import LANGUAGES, extension, is_source

LARGEST_SOURCE = 500_000


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, file_name, length, content_md5, text) of text files; the digest is of the bytes, so equal files are equal."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", F.md5("content").alias("content_md5"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads no known document equals, each content once (the first path)."""
    first = F.row_number().over(Window.partitionBy("content_md5").orderBy("path"))
    return uploads.join(known.select("content_md5").distinct(), "content_md5", "left_anti").withColumn("rn", first).where("rn = 1").drop("rn")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, text) of a source tree: known extensions, no build and dot folders, neither blank nor oversized."""
    files = read_uploads(spark, root)
    below = F.regexp_replace("path", "^(file:)?/+", "/")
    base = root.removeprefix("file:").rstrip("/")
    files = files.withColumn("path", F.expr(f"substring(regexp_replace(path, '^(file:)?/+', '/'), {len(base) + 2})") if base else below)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    kept = files.where(extension(F.col("path")).isin(list(LANGUAGES)) & is_source(F.col("path")) & (F.trim("text") != "") & (F.length("text") <= LARGEST_SOURCE))
    return kept.select("path", F.element_at(known, extension(F.col("path"))).alias("language"), "text")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonym) of ``term: a, b`` lines; lines that begin with # are comments."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").contains(":"))
    parts = F.split("value", ":", 2)
    pairs = lines.select(F.lower(F.trim(parts[0])).alias("term"), F.explode(F.split(parts[1], "[,，]")).alias("synonym"))
    return pairs.select("term", F.lower(F.trim("synonym")).alias("synonym")).where("synonym != '' AND term != ''").distinct()


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line; blank lines and # comments are none."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word != '' AND NOT startswith(word, '#')").distinct()


def read_evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, item) of a JSON array of samples with ``expectedDocIds``; samples that expect nothing have a null item."""
    schema = "id string, question string, expectedDocIds array<long>, expectedChunkIds array<long>, expectedScenario string, expectedLevel int"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.col("id").alias("query_id"), "question", F.explode_outer("expectedDocIds").alias("item"))


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows with changes merged in: per key the row latest in ``order``, of equals the largest."""
    rest = [c for c in current.columns if c not in {*key, *order}]
    latest = F.max(F.struct(*order, *rest)).alias("s")
    return current.unionByName(changes).groupBy(*key).agg(latest).select(*key, *[F.col(f"s.{c}").alias(c) for c in (*order, *rest)]).select(*current.columns)
