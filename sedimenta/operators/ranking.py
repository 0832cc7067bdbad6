"""Fusion, diversity, reranking and confidence over tables of hits; every function keeps all queries in one plan.

A query's hits number some tens at most, so a window or group by query_id is small whatever the corpus is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.retrieval import top_k


def round4(x: Column) -> Column:
    return F.floor(x * 10_000 + 0.5) / 10_000


def fuse(channels: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank) channels; ``sources`` in the channels' order."""
    union = None
    for order, (name, hits) in enumerate(channels.items()):
        part = hits.select("query_id", "chunk_id", "rank", F.lit(order).alias("channel"), F.lit(name).alias("name"))
        union = part if union is None else union.unionByName(part)
    names = F.transform(F.array_sort(F.collect_list(F.struct("channel", "name"))), lambda s: s["name"])
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.array_join(names, ",").alias("sources"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def pool(hits: DataFrame, top_n: int = 4, multiplier: int = 4) -> DataFrame:
    return hits.where(F.col("rank") <= top_n * max(multiplier, 4))


def adaptive_lambda(level: Column, confidence: Column) -> Column:
    """Weight of relevance against diversity, by level and classification confidence."""
    base = F.when(level == 1, 0.35).when(level == 2, 0.5).when(level == 3, 0.6).when(level == 4, 0.75).when(level == 5, 0.85).otherwise(0.6)
    moved = base + F.when(confidence < 0.5, -0.1).when(confidence > 0.8, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), moved)), 6)


def mmr(pools: DataFrame, top_n: int = 4, closeness: DataFrame | None = None) -> DataFrame:
    """Maximal marginal relevance: (query_id, chunk_id, pick) of pools (query_id, chunk_id, rank, lam, query_vector, vector).

    Greedy and sequential within a query's pool, so a pool is one small group. A pool of at most ``top_n`` stays as it
    is. A chunk without a vector has the relevance of its place and no similarity to others; negative similarities count
    0. ``doc_id`` equal in two chunks weighs their similarity by 0.7, h hops between their documents by 1 - 0.3 e^-h where
    ``closeness`` (doc_a, doc_b, hops) tells.
    """
    near = {} if closeness is None else None

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
        n = len(rows)
        if n <= top_n:
            return pd.DataFrame({"query_id": rows["query_id"], "chunk_id": rows["chunk_id"], "pick": np.arange(1, n + 1)})
        vectors = [None if v is None else np.asarray(v, dtype=np.float64) for v in rows["vector"]]
        unit = [None if v is None or not np.linalg.norm(v) else v / np.linalg.norm(v) for v in vectors]
        q = rows["query_vector"].iloc[0]
        q = None if q is None else np.asarray(q, dtype=np.float64) / (np.linalg.norm(q) or 1)
        rel = np.array([(n - i) / n if u is None or q is None else float(u @ q) for i, u in enumerate(unit)])
        lam = float(rows["lam"].iloc[0])
        listed = rows["near"].iloc[0] if near is None else None
        near_docs = {} if listed is None else {(int(a), int(b)): int(h) for a, b, h in listed}
        docs = rows["doc_id"].tolist()

        def alpha(i: int, j: int) -> float:
            if docs[i] is not None and docs[i] == docs[j]:
                return 0.7
            hops = near_docs.get((docs[i], docs[j]), near_docs.get((docs[j], docs[i])))
            return 1 - 0.3 * float(np.exp(-hops)) if hops is not None else 1.0

        chosen = [int(np.argmax(np.round(rel, 9)))]
        most = np.zeros(n)
        while len(chosen) < top_n:
            last = chosen[-1]
            for i in range(n):
                if unit[i] is not None and unit[last] is not None:
                    most[i] = max(most[i], float(unit[i] @ unit[last]) * alpha(i, last))
            value = np.round(lam * rel - (1 - lam) * most, 9)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[chosen].to_numpy(), "chunk_id": rows["chunk_id"].iloc[chosen].to_numpy(), "pick": np.arange(1, top_n + 1)})

    rows = pools.select("query_id", "chunk_id", "rank", "lam", "query_vector", "vector", "doc_id", *(["near"] if closeness is not None else []))
    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, pick int")


def code_terms(text: Column) -> Column:
    """Names a question mentions: called names, dotted chains and their parts, camel-case parts; lower-cased, each once."""
    called = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    chains = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"), F.lit(1))
    humps = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]*[a-z0-9][A-Z][A-Za-z0-9]*)"), F.lit(1))
    camel = F.flatten(F.transform(humps, lambda w: F.split(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2"), " ")))
    parts = F.flatten(F.transform(chains, lambda c: F.filter(F.split(c, r"\."), lambda p: F.length(p) > 1)))
    every = F.transform(F.concat(called, chains, parts, F.filter(camel, lambda p: F.length(p) > 1)), lambda t: F.lower(t))
    return F.array_distinct(F.filter(every, lambda t: t.rlike("[a-z]") & (F.length(t) <= 64)))


def share_in(terms: Column, text: Column) -> Column:
    n = F.size(terms)
    return F.when(n > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / n).otherwise(0.0)


def coverage(question: Column, content: Column) -> Column:
    """Share of the question's character pairs that the content, already bare, has."""
    bare = F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]", "")
    pairs = F.when(F.length(bare) <= 2, F.array(bare)).otherwise(F.regexp_extract_all(bare, F.lit("(?s)(?=(..))"), F.lit(1)))
    return share_in(pairs, content)


def position_bonus(seq: Column) -> Column:
    return F.when(F.coalesce(seq, F.lit(0)) <= 0, 0.0).otherwise(F.floor(0.2 * F.greatest(F.lit(0.0), 1 - (seq - 1) / 10) * 100 + 0.5) / 100)


def call_bonus(hits: DataFrame, callers: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bonus): half a point for each asked term whose callers are in the hit's file, and for each whose
    callers' file is named in it; at most one. ``hits``: query_id, chunk_id, project_id, file_text, terms; ``callers``:
    project_id, term, file, in lower case."""
    asked = hits.where(F.col("project_id").isNotNull()).select("query_id", "chunk_id", "project_id", F.col("file_text").alias("file"), F.explode("terms").alias("term"))
    exact = asked.join(callers.select("project_id", "term", "file").distinct(), ["project_id", "term", "file"], "left_semi").select("query_id", "chunk_id")
    base = F.regexp_replace(F.regexp_replace("file", r".*/", ""), r"\.java", "").alias("base")
    bases = callers.select("project_id", "term", base).where("base != ''").distinct()
    named = asked.join(bases, ["project_id", "term"]).where(F.contains("file", "base")).select("query_id", "chunk_id", "term").distinct().drop("term")
    return exact.unionByName(named).groupBy("query_id", "chunk_id").agg(F.least(F.lit(1.0), 0.5 * F.count(F.lit(1))).alias("bonus"))


def rerank(hits: DataFrame, top_n: int, callers: DataFrame | None = None) -> DataFrame:
    """Feature rerank of (query_id, chunk_id, score, question, content, file_name, seq); with ``callers`` (project_id, term,
    file) and a project_id, what calls the asked names adds up to 0.05."""
    # what a lambda refers to is computed before it, in a projection of its own, else it would be computed per element
    content, file = F.coalesce("content", F.lit("")), F.lower(F.coalesce("file_name", F.lit("")))
    hits = hits.withColumns({"terms": code_terms(F.col("question")), "all_text": F.lower(F.concat_ws(" ", content, F.coalesce("file_name", F.lit("")))), "file_text": file, "bare": F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]", "")})
    hits = hits.repartition("query_id")
    terms, text = F.col("terms"), F.col("all_text")
    path = F.when(F.exists(terms, lambda t: F.contains(F.col("file_text"), t)), 1.0).otherwise(0.0)
    score = 0.4 * F.col("score") + 0.2 * share_in(terms, text) + 0.2 * path + 0.1 * coverage(F.col("question"), F.col("bare")) + 0.1 * position_bonus(F.col("seq"))
    if callers is not None:
        hits = hits.join(call_bonus(hits, callers), ["query_id", "chunk_id"], "left")
        score = score + 0.05 * F.coalesce("bonus", F.lit(0.0))
    return top_k(hits.withColumn("score", round4(score)).drop("rank", "terms", "all_text", "file_text", "bare", "bonus"), top_n)


def cross_fuse(hits: DataFrame, judgements: DataFrame, weight: float, top_n: int) -> DataFrame:
    """Model judgements of 1..5 mixed with the scores; a missing judgement counts as 0.5; a lone hit stays as it is."""
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    joined = hits.drop("rank").join(judgements.select("query_id", "chunk_id", F.col("score").alias("given")), ["query_id", "chunk_id"], "left").withColumn("size", size)
    fused = F.coalesce((F.col("given") - 1) / 4, F.lit(0.5)) * weight + F.col("score") * (1 - weight)
    return top_k(joined.withColumn("score", F.when(F.col("size") <= 1, F.col("score")).otherwise(round4(fused))).drop("given", "size"), top_n)


def verdicts(hits: DataFrame) -> DataFrame:
    """Corrective evaluation per query: confidence from the best three scores and the number of sources, and what to do."""
    by = hits.groupBy("query_id").agg(F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("top3"), F.count_distinct(F.when(F.col("source") != "", F.col("source"))).alias("n_sources"))
    confidence = F.round(F.least(F.lit(1.0), F.col("top3") + F.when(F.col("n_sources") >= 2, 0.1).otherwise(0.0)), 4)
    return by.withColumn("confidence", confidence).withColumn("verdict", F.when(F.col("confidence") >= 0.7, "HIGH").when(F.col("confidence") >= 0.3, "MEDIUM").otherwise("LOW")).drop("top3")


def drop_noise(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """Without hits of less than ``share`` of the query's best score; all stay where no score is above zero."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).where((F.col("best") <= 0) | (F.col("score") >= share * F.col("best"))).drop("best")


def merge_best(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables' hits, each chunk once at its higher score (ties: the first table), ranked anew."""
    both = first.select("query_id", "chunk_id", "score", F.lit(0).alias("src")).unionByName(second.select("query_id", "chunk_id", "score", F.lit(1).alias("src")))
    best = both.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("src")).alias("s"))).alias("b")).select("query_id", "chunk_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("src"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def correct(hits: DataFrame, retry: DataFrame, share: float = 0.3) -> DataFrame:
    """The corrective step on (query_id, chunk_id, score, rank, source): hits of high confidence stay, those of medium are
    merged with the retried search's, those of low are dropped; then noise goes."""
    judged = verdicts(hits).select("query_id", "verdict")
    kept = hits.join(judged.where("verdict != 'LOW'"), "query_id", "left_semi")
    again = retry.join(judged.where("verdict = 'MEDIUM'"), "query_id", "left_semi")
    best = drop_noise(merge_best(kept, again).drop("rank"), share)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def confidence(dense: DataFrame, keyword: DataFrame, role: float = 1.0) -> DataFrame:
    """Per query: best dense score x lead over the second x share of dense hits whose document the keywords confirm."""
    confirmed = keyword.select("query_id", "doc_id").distinct().withColumn("yes", F.lit(1))
    d = dense.join(confirmed, ["query_id", "doc_id"], "left")
    by = d.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.avg(F.coalesce("yes", F.lit(0))).alias("share"))
    gap = F.when(F.col("s2").isNull(), 1.2).otherwise(F.least(F.lit(1.2), 1 + 2 * (F.col("s1") - F.col("s2"))))
    value = F.least(F.lit(1.0), F.col("s1") * gap * (0.5 + 0.5 * F.col("share"))) * 0.8 + role * 0.2
    return by.select("query_id", round4(value).alias("confidence"))


def keep_relevant(hits: DataFrame, judgements: DataFrame) -> DataFrame:
    """Relevance guard: two hits or fewer pass; of more, those judged relevant; if none is, the first alone."""
    by = Window.partitionBy("query_id")
    j = hits.join(judgements.select("query_id", "chunk_id", "relevant"), ["query_id", "chunk_id"], "left").withColumn("ok", F.coalesce("relevant", F.lit(True)))
    j = j.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("n_ok", F.sum(F.col("ok").cast("int")).over(by))
    return j.where((F.col("n") <= 2) | F.col("ok") | ((F.col("n_ok") == 0) & (F.col("rank") == 1))).drop("relevant", "ok", "n", "n_ok")
