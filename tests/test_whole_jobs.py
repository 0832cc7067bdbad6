"""Operators do their whole job: cases that a cut by frequency, prefix, distance or share of ids would miss."""

from pyspark.sql import functions as F

from sedimenta.operators import retrieval
from sedimenta.plans import assembly, registry, retrieval_ranking


def test_keyword_hits_by_pairs_that_most_chunks_hold(spark):
    queries = spark.createDataFrame([(1, "Boiler"), (2, "zz"), (3, "x"), (4, None)], "query_id long, text string")
    chunks = [(i, "boilerplate " + "q" * i) for i in range(1, 10)] + [(20, "other words"), (21, ""), (22, "\U0001f600aé\U00020000zz")]
    found = retrieval.bm25_top_k(queries, spark.createDataFrame(chunks, "chunk_id long, text string"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in found] == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 22, 1)]
    assert retrieval.bm25_top_k(queries, spark.createDataFrame([], "chunk_id long, text string"), 3).count() == 0


def test_keyword_ties_go_to_the_smaller_id_across_blocks(spark):
    queries = spark.createDataFrame([(1, "same words")], "query_id long, text string")
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.lit("the same words").alias("text"))
    assert [r.chunk_id for r in retrieval.bm25_top_k(queries, chunks, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def points_of(spark, folder, prerequisites):
    rows = spark.createDataFrame([(i, f"p{i}", level, names) for i, level, names in prerequisites], "id long, title string, difficulty_level int, prerequisite_ids string")
    rows.withColumn("created_at", F.lit("2025-01-01").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/knowledge_point.parquet")
    return str(folder)


def test_paths_go_to_every_node_and_ten_hops(spark, tmp_path):
    d = points_of(spark, tmp_path, [(20 + i, 1, f"[{21 + i}]" if i < 12 else None) for i in range(13)])
    assert {(r.source, r.node, r.hops) for r in registry.queries()["graph_paths"](spark, d).collect()} == {(20, 20 + i, i) for i in range(1, 11)}


def test_lineage_ends_where_the_chain_ends(spark, tmp_path):
    chain = [4 * i + 1 for i in range(67)]  # all DEPENDS_ON
    d = points_of(spark, tmp_path, [(n, 3 if n == 1 else 2 if n < chain[-1] else 1, f"[{n + 4}]" if n < chain[-1] else None) for n in chain])
    found = {(r.source, r.node): r.hops for r in registry.queries()["graph_upstream"](spark, d).collect()}
    assert found == {(1, n): i for i, n in enumerate(chain) if i} | {(n, chain[-1]): 66 - i for i, n in enumerate(chain[1:-1], 1)}


def test_callers_of_any_name_by_its_whole_text(spark, monkeypatch):
    rows = [(20, 1, "getUserById", []), (40, 1, "_Do", []), (60, 1, "go", []), (1, 1, "a", ["x.GETUSERBYIDS()", "x.getUser()"]), (2, 1, "b", ["this._do(1)", "let.it.go"]), (3, 2, "c", ["getUserById()"]), (5, 1, "d", ["get()", ""])]
    monkeypatch.setattr(assembly, "units_once", lambda *_: spark.createDataFrame(rows, "id long, project_id long, method_name string, calls array<string>"))
    assert {tuple(r) for r in assembly.callers_by_substring(spark, "").collect()} == {(20, 1), (40, 2), (60, 2)}


def test_expected_items_do_not_come_from_the_run(spark, tmp_path):
    far = [(40 + i, [0.1, 1.0 + i], 1) for i in range(1, 12)]  # of the asking row's label, behind the others
    rows = [(20, [1.0, 0.0], 1)] + [(i, [1.0, i / 100], 2) for i in range(1, 9)] + far
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "id long, source_question string, chunk_ids string").coalesce(1).write.parquet(f"{tmp_path}/knowledge_point.parquet")
    found = registry.queries()["eval_queries"](spark, str(tmp_path)).collect()
    assert [(r.query_id, r.hit8, r.recall8, r.rr) for r in found] == [(20, 0.0, 0.0, 0.0)]
    assert {r.item for r in retrieval_ranking._same_label(spark, str(tmp_path)).collect()} == {r[0] for r in far[:10]}
    assert {(r.hit8, r.recall8) for r in registry.queries()["eval_grid"](spark, str(tmp_path)).collect()} == {(0.0, 0.0)}
