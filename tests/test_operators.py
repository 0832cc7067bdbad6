"""Operators on small hand-made tables: edge cases, brute force and goldens."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sedimenta import streaming
from sedimenta.operators import evaluation, graph, ranking, references, retrieval, rolling, state, textual

LOG = "id long, user_id long, input_tokens int, output_tokens int, created_at timestamp_ntz, n_rows string, entity int"


def test_rolling_totals_match_brute_force(spark):
    rng, start = random.Random(1), datetime(2025, 1, 1)
    rows = [(i, rng.choice([1, 2, 3]), rng.choice([None, 0, 5, 2_000_000_000]), rng.choice([None, 7]), start + timedelta(days=rng.randint(0, 200), hours=rng.randint(0, 23)), "x", 1) for i in range(120)]
    rows += [rows[0], rows[1], (900, None, 1, 1, start, "x", 1), (901, 1, 1, 1, None, "x", 1), (902, 9, 4, None, start, None, None)]
    df = spark.createDataFrame(rows, LOG)
    for tile in (16, 64):
        found = {(r.user_id, r.day): r for r in rolling.trailing_totals(df, "user_id", "created_at", ["input_tokens", "output_tokens"], record_id="id", tile_days=tile, block_tiles=2).collect()}
        days = defaultdict(lambda: [0, 0, 0])
        for r in {r[0]: r for r in rows}.values():
            if r[1] is not None and r[4] is not None:
                cell = days[r[1], r[4].date()]
                cell[0] += 1
                cell[1] += r[2] or 0
                cell[2] += r[3] or 0
        seen = 0
        for user in {u for u, _ in days}:
            own = [d for u, d in days if u == user]
            day = min(own)
            while day <= max(own):
                r = found[user, day.isoformat()]
                for w in (7, 30):
                    back = [days.get((user, day - timedelta(days=k)), [0, 0, 0]) for k in range(w)]
                    assert r[f"input_tokens_total_{w}"] == sum(b[1] for b in back) and r[f"output_tokens_avg_{w}"] == pytest.approx(sum(b[2] for b in back) / w)
                assert r.n_rows == days.get((user, day), [0])[0]
                seen += 1
                day += timedelta(days=1)
        assert seen == len(found)
    assert rolling.trailing_totals(df.limit(0), "user_id", "created_at", ["input_tokens"]).count() == 0


REFS = "table_name string, field string, row_id long, ref_key long, ref_created_at timestamp_ntz"
PARENTS = "key long, created_at timestamp_ntz, gone boolean"


def test_broken_references(spark):
    t = datetime(2025, 1, 1)
    parents = [(k, t, False) for k in (*range(1, 5000), -3)] + [(6000, t, True), (6001, t + timedelta(days=9), False), (6002, None, False), (6003, t + timedelta(days=9), True)]
    refs = [(1, 3, t), (2, 5000, t), (3, 6000, t), (4, 6001, t), (5, 6001, None), (6, 6002, t), (7, None, t), (8, -3, t), (9, -4, t), (10, 10**15, None), (11, 6003, t), (12, 0, t)] + [(100 + i, 777777, t) for i in range(50)]
    found = references.broken_references(spark.createDataFrame([("r", "f", *r) for r in refs], REFS), spark.createDataFrame(parents, PARENTS))
    got = {(r.row_id, r.reason) for r in found.collect()}
    assert got == {(2, "missing"), (3, "deleted"), (4, "later"), (9, "missing"), (10, "missing"), (11, "deleted"), (12, "missing")} | {(100 + i, "missing") for i in range(50)}
    assert references.report(found).first().n_references >= 1
    none = spark.createDataFrame([], PARENTS)
    assert references.broken_references(spark.createDataFrame([("r", "f", 1, 3, t)], REFS), none).first().reason == "missing"
    assert references.broken_references(spark.createDataFrame([], REFS), none).count() == 0


def test_integers_in_any_spelling(spark):
    texts = ["[1,2]", '["3","4"]', "5,6", " [ 7 , null , 7\n]", "", None, "null", "[8,]", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(references.integers_in("t").alias("x")).collect()] == [[1, 2], [3, 4], [5, 6], [7], [], None, [], [8], []]


def hits(spark, *rows):
    return spark.createDataFrame([(1, c, r) for r, c in enumerate(rows, 1)], "query_id long, chunk_id long, rank int")


@pytest.mark.parametrize("dense, keyword, first, n", [((), (), None, 0), ((1, 2), (), 1, 2), ((), (3, 4), 3, 2), ((1, 2), (2, 3), 2, 3), ((1, 2), (2,), 2, 2)])
def test_fusion_goldens(spark, dense, keyword, first, n):
    fused = ranking.fuse({"dense": hits(spark, *dense), "keyword": hits(spark, *keyword)}).orderBy("rank").collect()
    assert len(fused) == n and (fused[0].chunk_id if fused else None) == first


def test_rerank_goldens(spark):
    schema = "query_id long, chunk_id long, score double, rank int, question string, content string, file_name string, seq int"
    rows = [(1, 1, 0.5, 1, "how does the cache expire", "unrelated words", "test.txt", 0), (1, 2, 0.5, 2, "how does the cache expire", "this says how does the cache expire soon", "test.txt", 0), (1, 3, 0.4, 3, "how does the cache expire", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    best = ranking.rerank(df, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == [2, 1]
    assert ranking.rerank(df.limit(0), 5).count() == 0


def test_mmr_is_top_k_without_diversity_and_spreads_with_it(spark):
    vec = {1: [1.0, 0.0], 2: [0.999, 0.01], 3: [0.7, 0.7], 4: [0.0, 1.0], 5: None}
    schema = "query_id long, chunk_id long, rank int, lam double, query_vector array<double>, vector array<double>, doc_id long"
    pools = lambda lam: spark.createDataFrame([(7, c, i, lam, [1.0, 0.1], v, c) for i, (c, v) in enumerate(vec.items(), 1)], schema)
    order = lambda df: [r.chunk_id for r in df.orderBy("pick").collect()]
    assert order(ranking.mmr(pools(1.0), 3)) == [2, 1, 3]
    assert order(ranking.mmr(pools(0.3), 3))[:2] == [2, 5]  # no vector: relevance 1/5, near to nothing
    assert order(ranking.mmr(pools(0.3).where("chunk_id < 5"), 3))[:2] == [2, 4]
    assert len(order(ranking.mmr(pools(0.5).where("chunk_id <= 2"), 3))) == 2


def test_rate_limiter_counts_accepted_rows_only(spark):
    rng, start = random.Random(4), datetime(2025, 1, 1)
    rows = sorted((start + timedelta(seconds=rng.randint(0, 400)), i, rng.choice("ab")) for i in range(120))
    want, accepted = {}, defaultdict(list)
    for at, i, k in rows:
        recent = [t for t in accepted[k] if t > at - timedelta(seconds=60)]
        want[i] = len(recent) < 3
        if want[i]:
            accepted[k].append(at)
    df = spark.createDataFrame([(i, k, at) for at, i, k in rows], "id long, k string, ts timestamp_ntz")
    assert {r.id: r.allowed for r in state.limit_rate(df, "k", "ts", "id", 3, 60).collect()} == want


def test_streamed_limiter_equals_batch(spark, tmp_path):
    start = datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, i % 3, start + timedelta(seconds=7 * i)) for i in range(60)], "id long, k long, ts timestamp_ntz")
    for n in range(3):  # three files in order, a micro-batch each
        df.where(F.col("id").between(20 * n, 20 * n + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from sedimenta.streaming.events import read_stream

    live = streaming.rate_limited(read_stream(spark, str(tmp_path / "in/*.parquet"), "ts", 1), "ts", "k", "id", 2, 60)
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in state.limit_rate(df, "k", "ts", "id", 2, 60).collect()}


def test_ingest_survives_a_repeated_batch(spark, tmp_path):
    spark.range(10).withColumn("ts", F.lit(datetime(2025, 1, 1))).coalesce(1).write.parquet(str(tmp_path / "in"))
    from sedimenta.streaming.events import read_stream

    for checkpoint in ("a", "b"):  # a lost checkpoint reads everything again
        stream = read_stream(spark, str(tmp_path / "in/*.parquet"), "ts")
        streaming.ingest(stream, str(tmp_path / "out"), lambda b: b.where("id > 3"), str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_graph_with_cycle_and_parallel_edges(spark):
    edges = spark.createDataFrame([(1, 2, "REFERENCES"), (1, 2, "EXTENDS"), (2, 3, "DEPENDS_ON"), (3, 1, "REFERENCES"), (4, 5, "SEQUEL_TO")], "src long, dst long, type string")
    near = {(r.node, r.hops): r.types for r in graph.reach(spark.createDataFrame([(1,)], "id long"), edges, 10).collect()}
    assert near == {(2, 1): ["EXTENDS", "REFERENCES"], (3, 2): ["DEPENDS_ON", "EXTENDS", "REFERENCES"]}
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100)], "a long, b long")
    found = {r.node: r.component for r in graph.components(chain).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_metrics_of_empty_expectations_and_results(spark):
    runs = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 5, 12)], "query_id long, rank int, item long")
    qrels = spark.createDataFrame([(1, 11), (1, 12), (2, 5)], "query_id long, item long")
    m = {r.query_id: r for r in evaluation.query_metrics(runs, qrels).collect()}
    assert (m[1].hit4, m[1].recall8, m[1].rr, m[1].precision4) == (1.0, 1.0, 0.5, 0.5) and (m[2].hit8, m[2].rr) == (0.0, 0.0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("my secret token is secret", "<p>a &lt; b</p><script>x</script>", "```json\n{\"a\": 1}\n```")], "t string, h string, j string")
    r = df.select(textual.mask(F.col("t"), ["secret token", "secret"]).alias("m"), textual.html_text(F.col("h")).alias("h"), textual.unfence(F.col("j")).alias("j")).first()
    assert (r.m, r.h, r.j) == ("my ************ is ******", "a < b", '{"a": 1}')
    assert [c[0] for c in textual.semantic_chunks("# A\n\n" + "x" * 150 + "\n\n```\ncode\n\nmore\n```\n## B\n\n" + "y" * 120)] == ["A", "A", "B"]


def test_dense_top_k_of_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0, 0.0])], "chunk_id long, vector array<float>")
    found = retrieval.dense_top_k(spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<float>"), corpus, 3)
    assert [(r.chunk_id, r.score) for r in found.orderBy("rank").collect()] == [(1, 1.0), (5, 1.0), (4, 0.707107)]


def test_runs_carry_bounds_only_and_shrink_dense_keys(spark):
    keys = spark.range(-500, 3000).select(F.col("id").alias("key")).where("key != 700")
    runs = references.key_runs(keys)
    assert runs.columns == ["bucket", "runs"] and [f.name for f in runs.schema["runs"].dataType.elementType.fields] == ["run_start", "run_end"]
    assert runs.count() == 14 and runs.select(F.sum(F.size("runs"))).first()[0] == 15
    asked = spark.createDataFrame([(-501,), (-500,), (700,), (699,), (2999,), (3000,), (10**15,)], "key long")
    assert {r.key: r.present for r in references.match_as_of(asked, runs).collect()} == {-501: False, -500: True, 700: False, 699: True, 2999: True, 3000: False, 10**15: False}


def test_refused_claims_do_not_prolong(spark):
    start = datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, "k", start + timedelta(hours=h)) for i, h in enumerate((0, 20, 30, 53, 54))], "id long, k string, ts timestamp_ntz")
    assert [r.claimed for r in state.first_claims(df, ["k"], "ts", "id", 86_400).orderBy("id").collect()] == [True, False, True, False, True]


def test_corrective_step(spark):
    schema = "query_id long, chunk_id long, score double, rank int, source string"
    first = spark.createDataFrame([(1, 1, 0.9, 1, ""), (1, 2, 0.8, 2, ""), (1, 3, 0.2, 3, "B"), (2, 1, 0.5, 1, ""), (2, 2, 0.4, 2, ""), (3, 1, 0.1, 1, "")], schema)
    retry = spark.createDataFrame([(q, c, s) for q in (1, 2, 3) for c, s in ((2, 0.45), (9, 0.6), (8, 0.05))], "query_id long, chunk_id long, score double")
    found = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in ranking.correct(first, retry).collect())
    # 1: medium (0.63), 2: medium; 3: low; noise below 0.3 of the best goes
    assert found == [(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 9, 0.6), (2, 1, 9, 0.6), (2, 2, 1, 0.5), (2, 3, 2, 0.45)]


def test_call_bonus(spark):
    hits = spark.createDataFrame([(1, 1, 7, "src/Order.java", ["save"]), (1, 2, 7, "docs/orderservice.md", ["save", "load"]), (1, 3, 7, "x.md", ["save"]), (2, 1, None, "src/order.java", ["save"])], "query_id long, chunk_id long, project_id long, file_text string, terms array<string>")
    callers = spark.createDataFrame([(7, "save", "src/order.java"), (7, "load", "a/orderservice.java"), (8, "save", "x.md")], "project_id long, term string, file string")
    found = {(r.query_id, r.chunk_id): r.bonus for r in ranking.call_bonus(hits.withColumn("file_text", F.lower("file_text")), callers).collect()}
    assert found == {(1, 1): 1.0, (1, 2): 1.0}


def test_leftmost_longest_mask(spark):
    df = spark.createDataFrame([("a secret-store, abcd SECRET",), ("bcd",), ("",), (None,)], "t string")
    words = ["secret", "secret-store", "abc", "bcd"]
    assert [r.m for r in df.select(textual.mask(F.col("t"), words).alias("m")).collect()] == ["a ************, ***d SECRET", "***", "", None]
    assert df.select(textual.mask(F.col("t"), words, True).alias("m")).first().m.endswith("******")


def test_blocks_and_packed_paragraphs():
    body = "Short one.\n\nA" + "x" * 80 + "\n\nshort two\n\n```\ncode\n\nmore\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\ntail"
    assert textual.block_chunks(body) == ["Short one.", "A" + "x" * 80 + "\n\nshort two", "```\ncode\n\nmore\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |\n\ntail"]
    assert textual.packed_paragraphs("aaaa\n\nbbbb\n\ncccc", 10, 3) == ["aaaa\nbbbb", "bbbcccc"]
    assert textual.packed_paragraphs("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9] and textual.packed_paragraphs(" ", 10, 2) == []
    assert textual.heading_chunks("# A\none\n# B\ntwo") == ["# A\n# A\none", "# B\ntwo"]


def test_shortest_paths_and_detached_edges(spark):
    edges = spark.createDataFrame([(1, 2, "R"), (1, 3, "R"), (2, 4, "R"), (3, 4, "E"), (4, 1, "R"), (4, 5, "R")], "src long, dst long, type string")
    found = {r.node: (r.hops, r.path) for r in graph.shortest_paths(spark.createDataFrame([(1,)], "id long"), edges).collect()}
    assert found == {2: (1, [2]), 3: (1, [3]), 4: (2, [2, 4]), 5: (3, [2, 4, 5])}
    assert sorted((r.src, r.dst) for r in graph.detach(edges, spark.createDataFrame([(4,), (9,)], "id long")).collect()) == [(1, 2), (1, 3)]
    chained = graph.chain(spark.createDataFrame([(i, "t") for i in (1, 5, 9000, 9001, 50_000)] + [(7, "u")], "id long, tag string"), "tag", "id")
    assert sorted((r.tag, r.id, r.before) for r in chained.collect()) == [("t", 1, None), ("t", 5, 1), ("t", 9000, 5), ("t", 9001, 9000), ("t", 50_000, 9001), ("u", 7, None)]


def test_ripple_has_the_old_side(spark):
    from sedimenta.operators import codebase

    schema = "project_id long, file_path string, method_name string"
    new, old = spark.createDataFrame([(1, "a.py", "kept")], schema), spark.createDataFrame([(1, "a.py", "gone")], schema)
    edges = spark.createDataFrame([(1, "b.py", "gone"), (1, "c.py", "kept"), (1, "d.py", "other")], "project_id long, caller_file string, method_name string")
    changed = spark.createDataFrame([(1, "a.py")], "project_id long, file_path string")
    assert {r.file for r in codebase.ripple(changed, new, edges, old).collect()} == {"a.py", "b.py", "c.py"}
    assert codebase.without_files(new, changed).count() == 0


def test_enclosing_unit_over_stretches(spark):
    from sedimenta.operators import codebase

    units = spark.createDataFrame([(1, 1, 1000), (2, 60, 70), (3, 65, 65), (4, 900, 999)], "unit_id long, start_line int, end_line int").withColumns({"project_id": F.lit(1), "file_path": F.lit("f")})
    points = spark.createDataFrame([(10, 65), (11, 64), (12, 500), (13, 950), (14, 2000)], "point_id long, line int").withColumns({"project_id": F.lit(1), "file_path": F.lit("f")})
    assert {r.point_id: r.unit_id for r in codebase.enclosing(units, points).collect()} == {10: 3, 11: 2, 12: 1, 13: 4}


def test_names_and_intents_of_questions(spark):
    from sedimenta.functions import parsing

    rows = {"who calls OrderService.createOrder?": ("UNKNOWN", "createOrder", "OrderService"), "signature of save(x)": ("METHOD_LOOKUP", "save", None), "which method is a.b.C": ("CALL_CHAIN", "C", "a"), "run(1)": ("METHOD_LOOKUP", "run", None), "怎么实现缓存": ("IMPLEMENTATION", None, None), "call chain of x": ("CALL_CHAIN", None, None)}
    df = spark.createDataFrame([(q,) for q in rows], "q string")
    q = F.col("q")
    assert {r.q: (r.i, r.m, r.c) for r in df.select("q", parsing.question_intent(q).alias("i"), parsing.asked_method(q).alias("m"), parsing.asked_class(q).alias("c")).collect()} == rows
    hooks = ['{"repository": {"clone_url": " ", "html_url": "h"}}', '{"project": {"git_http_url": "g"}}', '{"project": {"web_url": "w"}}', '{"repository": {"clone_url": "c"}}', "{}", "no json"]
    found = [r.u for r in spark.createDataFrame([(h,) for h in hooks], "h string").select(parsing.clone_url(F.col("h")).alias("u")).collect()]
    assert found == ["h.git", "g", "w.git", "c", None, None]


def test_strict_score(spark):
    from sedimenta.operators import guards

    schema = "score double, file string, content string, method string, class string, holder string, seq int"
    rows = [(1.0, "Save.java", "a\n" * 12, "save", None, None, 1), (0.5, "x.md", "the saved one", "save", "Order", "OrderService", 21), (0.0, None, None, None, None, None, None), (2.0, "x", "call save now", "save", "Order", None, 0)]
    df = spark.createDataFrame(rows, schema)
    found = [r.s for r in df.select(guards.strict_score(*[F.col(c) for c in ("score", "file", "content", "method", "class", "holder", "seq")]).alias("s")).collect()]
    assert found == pytest.approx([0.4 + 0.25 + 0.075 + 0.1 + 0.02, 0.2 + 0.125 + 0.15 + 0.02, 0.125 + 0.075, 0.4 + 0.2 + 0.02])


def test_index_of_vectors(spark):
    from sedimenta.operators import vector_index

    rng = random.Random(3)
    rows = [(i, [rng.gauss(c, 0.3) for c in ((i % 7) - 3, i % 3, 1 - i % 2, 0.2)]) for i in range(900)] + [(1000, None), (1001, [0.0] * 4), (1002, [1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, vector array<float>")
    queries = corpus.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(corpus, vector_index.fit(corpus))
    exact = retrieval.dense_top_k(queries.where("size(vector) = 4"), corpus.where("size(vector) = 4"), 5)
    assert vector_index.recall(vector_index.search(queries, index, 5), exact).first().recall >= 0.9
    assert vector_index.recall(vector_index.search(queries, index, 5, probes=len(index.centres)), exact).first().recall == 1.0
    empty = corpus.limit(0)
    assert vector_index.search(queries, vector_index.build(empty, vector_index.fit(empty)), 5).count() == 0


def test_keyword_hits_of_given_levels_only(spark):
    queries = spark.createDataFrame([(1, "same words", [2, 3]), (2, "same words", [1])], "query_id long, text string, levels array<int>")
    chunks = spark.createDataFrame([(i, "the same words", i % 5) for i in range(1, 11)], "chunk_id long, text string, level int")
    found = retrieval.bm25_top_k(queries, chunks, 9).collect()
    assert {q: sorted(r.chunk_id for r in found if r.query_id == q) for q in (1, 2)} == {1: [2, 3, 7, 8], 2: [1, 6]}


def test_rules_and_strategies(spark):
    from sedimenta.operators import routing

    asked = {"how do I implement this class": 1, "which architecture do we have": 2, "what is Spark, in a nutshell?": 3, "go on": 4, "x" * 90: 5, "tell me more of the second one": 6}
    df = spark.createDataFrame([(q,) for q in asked], "q string").select("q", routing.routed(F.col("q")).alias("r"))
    assert {r.q: r.r.rule for r in df.collect()} == asked
    found = {r.s: (r.chunk_size, r.model_weight, len(r.skipped)) for r in routing.with_strategy(spark.createDataFrame([("learn",), ("no such",), (None,)], "s string"), "s").collect()}
    assert found == {"learn": (1024, 0.5, 2), "no such": (500, 0.7, 0), None: (500, 0.7, 0)}


def test_suggested_relations_and_snapshots(spark):
    rows = [(1, '[{"targetId": 2, "type": "extends"}, {"targetId": 9, "type": "EXTENDS"}, {"targetId": 1, "type": "EXTENDS"}, {"targetId": 3, "type": "LIKES"}]'), (2, "none"), (3, None)]
    found = graph.suggested(spark.createDataFrame(rows, "id long, answer string"), "id", "answer", spark.range(1, 4)).collect()
    assert [tuple(r) for r in found] == [(1, 2, "EXTENDS")]
    days = spark.createDataFrame([(datetime(2025, 1, 1) + timedelta(days=i), c) for i, c in enumerate([0.9, 0.1, 0.5, 0.5, 0.2])], "day timestamp_ntz, composite double")
    kept = evaluation.keep_snapshots(days, "day", 3, 30).orderBy("day").collect()
    assert [(r.composite, r.best) for r in kept] == [(0.5, False), (0.5, True), (0.2, False)]
    assert [r.best for r in evaluation.keep_snapshots(days, "day", 50, 2).orderBy("day").collect()] == [True, False]


def test_stages_of_the_pipeline(spark, tmp_path):
    from sedimenta.plans import answering

    at = datetime(2025, 1, 1)
    tables = {
        "knowledge_document": ([(1, "cache.md", 1, 0, 1, "a,b", 0.9, at, at), (2, "other.md", 1, 0, 3, "a", 0.9, at, at), (3, "gone.md", 1, 1, 1, None, 0.1, at, at)], "id long, file_name string, version int, deleted int, level int, tags string, level_confidence double, created_at timestamp_ntz, updated_at timestamp_ntz"),
        "document_chunk": ([(1, 1, 1, 0, "The cache expires entries after a day.", at), (2, 1, 1, 1, "Something else about nothing.", at), (3, 2, 1, 0, "The cache is described at level three.", at), (4, 3, 1, 0, "The cache expires: deleted.", at)], "id long, doc_id long, doc_version int, seq int, content string, created_at timestamp_ntz"),
        "knowledge_point": ([(20, "Cache", "When does the cache expire its entries?", 1, None, at)], "id long, title string, source_question string, difficulty_level int, related_project_id long, created_at timestamp_ntz"),
        "embeddings": ([(20, [1.0, 0.0], 0), (1, [1.0, 0.1], 0), (3, [0.9, 0.2], 2), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int"),
        "code_unit": ([], "id long, project_id long, file_path string, calls array<string>, enriched_calls array<string>"),
    }
    for name, (rows, schema) in tables.items():
        frame = spark.createDataFrame(rows, schema)
        for c in {"knowledge_document": ("user_id", "file_md5", "status", "chunk_count")}.get(name, ()):
            frame = frame.withColumn(c, F.lit(None).cast("string"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    s = answering.pipeline_stages(spark, str(tmp_path))
    ids = lambda name: [r.chunk_id for r in s[name].orderBy("rank").collect()]
    settings = s["settings"].first()
    assert (settings.levels, settings.rule, settings.lam) == ([1, 2], 6, 0.35)
    assert ids("dense") == [20, 1, 2]  # chunk 3 is of level 3
    assert ids("keyword") == [1, 2] and set(ids("sparse")) <= {1, 2}
    assert ids("fused")[0] in (1, 20) and 4 not in ids("fused")
    assert {r.chunk_id for r in s["guarded"].collect()} and 4 not in ids("guarded")
    assert ids("ranked")[0] == 1


def test_stacks_of_projects(spark):
    from sedimenta.operators import codebase

    rows = [(1, "pom.xml", "spring-boot-starter"), (1, "src/A.java", "public static void main(x)"), (2, "go.mod", ""), (2, "cmd/a/m.go", "import gin\nfunc main() {}"), (3, "x.py", ""), (4, "README.md", "")]
    found = {r.project_id: (r.build_tool, r.framework, r.entry_points) for r in codebase.stacks(spark.createDataFrame(rows, "project_id long, path string, text string")).collect()}
    assert found == {1: ("Maven", "Spring Boot", 1), 2: ("Go Mod", "Gin", 1), 3: (None, "Python", 0), 4: (None, None, 0)}
    paths = ["src/main/java/com/acme/pay/A.java", "backend/src/test/java/com/x/B.java", "cmd/tool/main.go", "src/main/A.java", "a/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.m for r in df.select(codebase.module_of(F.col("p")).alias("m")).collect()] == ["acme", "x", "cmd/tool", None, None]


def test_attempts_are_counted_across_stretches(spark):
    rng, start = random.Random(6), datetime(2025, 1, 1)
    rows = [(i, rng.choice("ab"), start + timedelta(seconds=rng.choice([0, 60, 120, rng.randint(0, 400)]))) for i in range(90)] + [(90, "a", None)]
    found = {r.id: r.attempts for r in state.attempts_in_window(spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz"), ["k"], "ts", 60).collect()}
    want = {i: sum(1 for _, k2, t2 in rows if k2 == k and t2 is not None and timedelta(0) <= t - t2 <= timedelta(seconds=60)) for i, k, t in rows if t is not None}
    assert {i: n for i, n in found.items() if i != 90} == want and found[90] == 1


def test_term_search_counts_in_whole_texts(spark):
    terms = spark.createDataFrame([(1, "cache", 1.0), (1, "rare", 0.5), (1, "weak", 0.1)], "query_id long, term string, weight double")
    chunks = spark.createDataFrame([(1, "Cache cache CACHED cache"), (2, "rare weak"), (3, None), (4, "weak")], "chunk_id long, text string")
    found = [(r.chunk_id, r.score) for r in retrieval.sparse_top_k(terms, chunks, 5).orderBy("rank").collect()]
    assert found == [(1, 0.84), (2, 0.18)]
