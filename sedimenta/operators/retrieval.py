"""Retrieval for whole tables of queries: exact dense top-k in blocks, bigram BM25, weighted terms.

Hits are (query_id, chunk_id, score, rank); scores are rounded to six digits and ties go to the smaller chunk_id, so
ranks don't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources import materialize

QUERY_BLOCK, CORPUS_BLOCK = 512, 4096
TEXT_BLOCK, TEXT_CHARACTERS, PAIR_COLUMNS = 1024, 1 << 21, 4096
BROADCAST_BYTES = 64 << 20


def top_k(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best ``k`` rows per query, with their rank; Catalyst limits each partition before the shuffle."""
    keys = keys or ("query_id",)
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double precision; 0 for nulls, different lengths and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def _unit(rows: list) -> np.ndarray:
    m = np.asarray(rows, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _packed(ids: str, vectors: str, size: int):
    """Rows packed into blocks: ids and unit vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                matrix = _unit(part.column(vectors).to_pylist())
                numbers = np.asarray(part.column(ids).to_pylist(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32())], ["ids", "matrix", "dim"])

    return run


def _best_of_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, c = (np.frombuffer(row[f"{s}_matrix"], dtype=np.float64).reshape(-1, row[f"{s}_dim"]) for s in "qc")
                qi, ci = (np.frombuffer(row[f"{s}_ids"], dtype=np.int64) for s in "qc")
                if q.shape[1] != c.shape[1]:
                    continue
                score = np.round(q @ c.T, 6)
                order = np.lexsort((np.broadcast_to(ci, score.shape), -score), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, order.shape[1])), pa.array(ci[order].ravel()), pa.array(np.take_along_axis(score, order, 1).ravel())], ["query_id", "chunk_id", "score"])

    return run


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of (query_id, vector) against (chunk_id, vector), blocks against blocks by matrix product.

    Each pair of blocks gives its best ``k`` per query, so what is shuffled is k rows a query and corpus block. The
    query blocks are broadcast where they fit ``BROADCAST_BYTES``; else Spark pairs the blocks by a shuffle.
    """
    schema = "ids binary, matrix binary, dim int"
    wanted = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    q = wanted.mapInArrow(_packed("query_id", "vector", QUERY_BLOCK), schema).toDF("q_ids", "q_matrix", "q_dim")
    size = q.agg(F.coalesce(F.sum(F.length("q_matrix")), F.lit(0))).first()[0]
    q = F.broadcast(q) if size <= BROADCAST_BYTES else q
    c = corpus.where(F.col("vector").isNotNull()).select("chunk_id", "vector").mapInArrow(_packed("chunk_id", "vector", CORPUS_BLOCK), schema).toDF("c_ids", "c_matrix", "c_dim")
    best = c.crossJoin(q).mapInArrow(_best_of_blocks(k), "query_id long, chunk_id long, score double")
    return top_k(best, k)


def _blocks(key: str, size: int):
    """Rows sorted by ``list`` packed into blocks of one list each."""
    pack = _packed(key, "vector", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = np.asarray(batch.column("list").to_pylist(), dtype=np.int32)
            starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else []
            for a, b in zip(starts, [*starts[1:], len(lists)]):
                for block in pack(iter([batch.slice(a, b - a)])):
                    yield block.append_column("list", pa.array(np.full(block.num_rows, lists[a], dtype=np.int32)))

    return run


LIST_BLOCK = "ids binary, matrix binary, dim int, list int"
SALTS = 16


def by_list(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector, list) packed into blocks of one list each; a hot list is spread over ``SALTS`` tasks."""
    spread = rows.repartition(F.col("list"), F.pmod(F.xxhash64(key), F.lit(SALTS))).sortWithinPartitions("list", key)
    return spread.mapInArrow(_blocks(key, CORPUS_BLOCK), LIST_BLOCK)


def meet_by_list(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Top-k of (query_id, vector, list), a query in as many lists as it may look at, against blocks of the same lists."""
    packed = queries.repartition("list").sortWithinPartitions("list", "query_id").mapInArrow(_blocks("query_id", QUERY_BLOCK), LIST_BLOCK).toDF("q_ids", "q_matrix", "q_dim", "list")
    met = blocks.toDF("c_ids", "c_matrix", "c_dim", "list").join(packed, "list").drop("list")
    return top_k(met.mapInArrow(_best_of_blocks(k), "query_id long, chunk_id long, score double"), k)


def dense_within(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of (query_id, vector, list) against the rows (chunk_id, vector, list) of the query's lists."""
    kept = lambda x, key: x.where(F.col("vector").isNotNull() & F.col("list").isNotNull()).select(key, F.col("vector").cast("array<float>").alias("vector"), F.col("list").cast("int").alias("list"))
    return meet_by_list(kept(queries, "query_id"), by_list(kept(corpus, "chunk_id"), "chunk_id"), k)


def bigrams(text: Column) -> Column:
    """Character pairs of the lower-cased text without white space and punctuation."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", ""), F.lit("(?s)(?=(..))"), F.lit(1))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def _pair_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character pairs of all texts: the text's number and both code points in one integer."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    within = rows[:-1] == rows[1:]
    return rows[:-1][within], (codes[:-1] << 21 | codes[1:])[within]


def _asked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys = _pair_keys(batch.column("bare").to_pylist())
        ids = np.asarray(batch.column("query_id").to_pylist(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(keys)], ["query_id", "gram"])


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Ids, bare texts and levels of at most ``TEXT_BLOCK`` chunks and, but for one longer text, ``TEXT_CHARACTERS`` characters."""
    for batch in batches:
        ids, texts, levels = np.asarray(batch.column("chunk_id").to_pylist(), dtype=np.int64), batch.column("bare").to_pylist(), np.asarray(batch.column("level").to_pylist(), dtype=np.int64)
        at = size = 0
        for i, text in enumerate(texts):
            if i > at and (i - at == TEXT_BLOCK or size + len(text) > TEXT_CHARACTERS):
                yield ids[at:i], texts[at:i], levels[at:i]
                at, size = i, 0
            size += len(text)
        if texts:
            yield ids[at:], texts[at:], levels[at:]


def _held_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, df): in how many chunks of a block each pair stands."""
    for _, texts, _ in _text_blocks(batches):
        rows, keys = _pair_keys(texts)
        grams, held = np.unique(keys, return_inverse=True)
        df = np.bincount(np.unique(rows * len(grams) + held) % max(len(grams), 1), minlength=len(grams))
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(df.astype(np.int64))], ["gram", "df"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks: ids, sizes, distinct pairs, and each pair's count in a chunk as (row, position, tf)."""
    for ids, texts, levels in _text_blocks(batches):
        rows, keys = _pair_keys(texts)
        grams, held = np.unique(keys, return_inverse=True)
        cells, tf = np.unique(rows * len(grams) + held, return_counts=True)
        row, at = np.divmod(cells, max(len(grams), 1))
        sizes = np.asarray([len(t) - 1 for t in texts], dtype=np.int64)
        yield _as_row({"ids": ids, "sizes": sizes, "grams": grams, "rows": row.astype(np.int32), "at": at.astype(np.int32), "tf": tf.astype(np.int32), "levels": levels})


def _packed_questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries: ids, distinct pairs, and each pair's idf in a query as (row, position, idf)."""
    for batch in batches:
        for start in range(0, batch.num_rows, QUERY_BLOCK):
            part = batch.slice(start, QUERY_BLOCK).to_pydict()
            masks = np.asarray(part["mask"], dtype=np.int64)
            grams, at = np.unique(np.concatenate([np.asarray(g, dtype=np.int64) for g in part["grams"]]), return_inverse=True)
            row = np.repeat(np.arange(len(part["grams"]), dtype=np.int32), [len(g) for g in part["grams"]])
            yield _as_row({"ids": np.asarray(part["query_id"], dtype=np.int64), "grams": grams, "rows": row, "at": at.astype(np.int32), "idf": np.concatenate([np.asarray(x, dtype=np.float64) for x in part["idf"]]), "masks": masks})


def _as_row(parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts.values()], list(parts))


def _best_by_pairs(k: int, k1: float, b: float, mean_size: float):
    kinds = {"q_ids": np.int64, "q_grams": np.int64, "q_rows": np.int32, "q_at": np.int32, "q_idf": np.float64, "c_ids": np.int64, "c_sizes": np.int64, "c_grams": np.int64, "c_rows": np.int32, "c_at": np.int32, "c_tf": np.int32, "q_masks": np.int64, "c_levels": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                x = {name: np.frombuffer(batch.column(name)[n].as_buffer(), dtype=kind) for name, kind in kinds.items()}
                shared, q_to, c_to = np.intersect1d(x["q_grams"], x["c_grams"], assume_unique=True, return_indices=True)
                q_column, c_column = np.full(len(x["q_grams"]), -1), np.full(len(x["c_grams"]), -1)
                q_column[q_to] = c_column[c_to] = np.arange(len(shared))
                q_column, c_column = q_column[x["q_at"]], c_column[x["c_at"]]
                weight = x["c_tf"] * (k1 + 1) / (x["c_tf"] + k1 * (1 - b + b * x["c_sizes"][x["c_rows"]] / mean_size))
                score = np.zeros((len(x["q_ids"]), len(x["c_ids"])))
                for first in range(0, len(shared), PAIR_COLUMNS):  # dense matrices of bounded width, whatever the alphabet
                    width = min(PAIR_COLUMNS, len(shared) - first)
                    q, c = np.zeros((len(x["q_ids"]), width)), np.zeros((len(x["c_ids"]), width))
                    of_q, of_c = (q_column >= first) & (q_column < first + width), (c_column >= first) & (c_column < first + width)
                    q[x["q_rows"][of_q], q_column[of_q] - first] = x["q_idf"][of_q]
                    c[x["c_rows"][of_c], c_column[of_c] - first] = weight[of_c]
                    score += q @ c.T
                score *= x["q_masks"][:, None] >> x["c_levels"][None, :] & 1
                rounded = np.where(score > 0, np.round(score, 6), -1.0)
                least = np.partition(rounded, -k, axis=1)[:, -k, None] if rounded.shape[1] > k else -1.0
                qi, ci = np.nonzero((rounded >= least) & (score > 0))
                order = np.lexsort((x["c_ids"][ci], -rounded[qi, ci], qi))
                qi, ci = qi[order], ci[order]
                kept = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                qi, ci = qi[kept], ci[kept]
                yield pa.RecordBatch.from_arrays([pa.array(x["q_ids"][qi]), pa.array(x["c_ids"][ci]), pa.array(rounded[qi, ci])], ["query_id", "chunk_id", "score"])

    return run


def bm25_top_k(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Keyword top-k of (query_id, text) against (chunk_id, text), BM25 over character bigrams.

    Every gram counts, however many chunks hold it. No postings are joined: blocks of queries meet blocks of chunks, and
    their scores are a matrix product over the grams both hold. Each pair of blocks gives its best ``k`` per query, so
    what is shuffled is k rows a query and block of chunks, and a gram that stands in every chunk is one column like any.
    With ``levels`` (array<int>) at the queries, a query's hits are of these levels (1 to 62) of the corpus only.
    """
    masked = "levels" in queries.columns
    mask = F.aggregate("levels", F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v))) if masked else F.lit(1).cast("long")
    masks = queries.select("query_id", F.coalesce(mask, F.lit(0)).alias("mask"))
    level = F.coalesce(F.col("level").cast("long"), F.lit(0)) if masked else F.lit(0).cast("long")
    asked = queries.where(F.col("text").isNotNull()).select("query_id", _bare(F.col("text")).alias("bare")).mapInArrow(_asked_pairs, "query_id long, gram long").distinct()
    # spread before the scan's few partitions meet all query blocks, and written once as it is read three times
    texts = materialize(corpus.select("chunk_id", _bare(F.col("text")).alias("bare"), level.alias("level")).where("length(bare) > 1").repartition("chunk_id"), "texts")
    n, mean_size = texts.agg(F.count(F.lit(1)), F.avg(F.length("bare") - 1)).first()
    held = texts.mapInArrow(_held_pairs, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(held, "gram").groupBy("query_id").agg(F.collect_list(F.struct("gram", idf.alias("idf"))).alias("g")).select("query_id", F.col("g.gram").alias("grams"), F.col("g.idf").alias("idf")).join(masks, "query_id")
    q = materialize(known.mapInArrow(_packed_questions, "ids binary, grams binary, rows binary, at binary, idf binary, masks binary").toDF("q_ids", "q_grams", "q_rows", "q_at", "q_idf", "q_masks"), "questions")
    size = q.agg(F.coalesce(F.sum(sum(F.length(c) for c in q.columns)), F.lit(0))).first()[0]
    q = F.broadcast(q) if size <= BROADCAST_BYTES else q
    c = texts.mapInArrow(_packed_texts, "ids binary, sizes binary, grams binary, rows binary, at binary, tf binary, levels binary").toDF("c_ids", "c_sizes", "c_grams", "c_rows", "c_at", "c_tf", "c_levels")
    best = c.crossJoin(q).mapInArrow(_best_by_pairs(k, k1, b, mean_size or 1.0), "query_id long, chunk_id long, score double")
    return top_k(best, k)


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: F.length(w) >= 3)


def query_terms(queries: DataFrame, corpus: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, term, weight): the ``most`` rarest words of each query; weight 1 for the rarest, in proportion to idf."""
    asked = materialize(queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")), "asked")
    held = corpus.select("chunk_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(n)).withColumn("idf", F.log1p(F.col("n") / F.col("df")))  # n: one row
    by = Window.partitionBy("query_id")
    rank = F.row_number().over(by.orderBy(F.col("idf").desc(), "term"))
    return weighed.withColumn("r", rank).withColumn("weight", F.round(F.col("idf") / F.max("idf").over(by), 6)).where(F.col("r") <= most).select("query_id", "term", "weight")


def term_frequency(content: Column, term: Column) -> Column:
    """0.1 without the term, else 0.2 + 0.8 * count / 5, at most 1; ``content`` and ``term`` are in lower case, counts don't
    overlap."""
    n = (F.length(content) - F.length(F.replace(content, term, F.lit("")))) / F.length(term)
    return F.when(n == 0, F.lit(0.1)).otherwise(F.least(F.lit(1.0), 0.2 + 0.8 * n / 5))


def sparse_top_k(terms: DataFrame, corpus: DataFrame, k: int, least: float = 0.3, per_term: int = 15) -> DataFrame:
    """Weighted terms: each term's best ``per_term`` chunks by frequency, summed as weight * frequency per chunk.

    Only the words are exploded; a chunk's text meets its asked words as one row, and what leaves is a word and a number."""
    used = materialize(terms.where(F.col("weight") >= least), "terms")
    asked = corpus.select("chunk_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(used.select("term").distinct(), "term", "left_semi")
    held = corpus.select("chunk_id", F.lower("text").alias("low")).join(asked.groupBy("chunk_id").agg(F.collect_set("term").alias("terms")), "chunk_id")
    counted = held.select("chunk_id", F.explode(F.transform("terms", lambda t: F.struct(t.alias("term"), term_frequency(F.col("low"), t).alias("score")))).alias("s")).select("chunk_id", "s.term", "s.score")
    summed = used.join(top_k(counted, per_term, "term"), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("score")), 6).alias("score"))
    return top_k(summed, k)


def expand(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, term): the query's words and, both ways, their synonyms from (term, synonym)."""
    split = F.split(F.lower("text"), r"[\s,，。；;、．.！!？?（）()【】\[\]：:]+")
    own = queries.select("query_id", F.explode(F.filter(F.array_distinct(split), lambda w: w != "")).alias("term"))
    pairs = lexicon.select("term", "synonym").union(lexicon.select("synonym", "term")).distinct()
    return own.union(own.join(pairs, "term").select("query_id", F.col("synonym").alias("term"))).distinct()


def back_fill(hits: DataFrame, second: DataFrame, factor: float = 0.6) -> DataFrame:
    """Hits of a second route appended behind the first, at reduced scores, without chunks already there."""
    new = second.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.round(F.col("score") * factor, 6))
    both = hits.withColumn("route", F.lit("A")).unionByName(new.withColumn("route", F.lit("B")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("route", "rank")))
