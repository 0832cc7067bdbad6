"""Readers and merges, on small files."""

import json

from sedimenta.sources import files


def test_uploads_and_source_tree(spark, tmp_path):
    for name, text in {"a/B.java": "class B {}", "a/C.java": "class B {}", "node_modules/x.js": "x()", ".git/y.py": "y", "b.py": "  ", "d.txt": "note", "e.go": "package e"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    uploads = files.read_uploads(spark, str(tmp_path))
    assert uploads.count() == 6  # dot folders are hidden
    known = uploads.where("file_name = 'd.txt'")
    assert {r.file_name for r in files.new_uploads(uploads.where("file_name LIKE '%.java' OR file_name = 'd.txt'"), known).collect()} == {"B.java"}
    assert {(r.path, r.language) for r in files.read_sources(spark, str(tmp_path)).collect()} == {("a/B.java", "java"), ("a/C.java", "java"), ("e.go", "go")}


def test_lexicon_words_and_evaluation_set(spark, tmp_path):
    (tmp_path / "syn.yml").write_text("# words\nCache: buffer, store\n\nbroken line\nindex: , catalog\n")
    assert {tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "syn.yml")).collect()} == {("cache", "buffer"), ("cache", "store"), ("index", "catalog")}
    (tmp_path / "w.txt").write_text("# comment\nsecret\n\nsecret\napi key\n")
    assert {r.word for r in files.read_words(spark, str(tmp_path / "w.txt")).collect()} == {"secret", "api key"}
    (tmp_path / "eval.json").write_text(json.dumps([{"id": "q1", "question": "how", "expectedDocIds": [3, 4]}, {"id": "q2", "question": "why", "expectedDocIds": []}]))
    assert {tuple(r) for r in files.read_evaluation_set(spark, str(tmp_path / "eval.json")).collect()} == {("q1", "how", 3), ("q1", "how", 4), ("q2", "why", None)}


def test_upsert_keeps_the_latest(spark):
    schema = "id long, at int, v string"
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema)
    now = files.upsert(first, spark.createDataFrame([(2, 3, "c"), (1, 0, "late"), (3, 1, None)], schema), ["id"], ["at"])
    assert {tuple(r) for r in now.collect()} == {(1, 1, "a"), (2, 3, "c"), (3, 1, None)}


def test_materialized_tables_lie_in_one_folder_and_go_together(spark):
    from sedimenta.sources import clear_scratch, materialize, scratch_dir

    assert scratch_dir(spark) == scratch_dir(spark)
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3 and f"{scratch_dir(spark).removeprefix('file:').rstrip('/').lstrip('/')}/sedimenta-" in kept.inputFiles()[0]
    clear_scratch(spark)
    assert materialize(spark.range(2), "again").count() == 2


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from sedimenta.sources import scratch_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_dir(cluster)
