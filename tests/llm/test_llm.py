"""Training-text operators against brute force, exact round trips and hand-made edge cases."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import byte_bpe, function_docs, near_duplicates, packing, pieces, quality
from sedimenta.llm.gll import Grammar
from sedimenta.llm.words import WORD, WordHashes

needs_vocabulary = pytest.mark.skipif(not Path(byte_bpe.VOCABULARY).exists(), reason="no vocabulary file")


def words_set(text):
    w = WORD.findall(text.lower())
    return set(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma", w]) if rng.random() < share else w for w in words]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(15, 120))]
        for share in (0, 0, 0.02, 0.1, 0.2):
            n += 3
            rows.append((n, " ".join(edited(rng, base, share))))
    rows += [(1, None), (2, ""), (4, "短い"), (rows[0][0], rows[0][1]), (5, "好" * 30), (7, "好" * 31), (10**12, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("tag", F.lit("x")).withColumn("cls", F.lit(1))
    found = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs({"t": df.select("id", "text")}).collect()}
    sets = {i: s for i, t in rows if t and (s := words_set(t))}
    true = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert found == true


def test_large_class_of_copies_is_a_star(spark):
    text = " ".join(f"v{i}" for i in range(30))
    near = text + " tail end"
    df = spark.range(1, 101).select("id", F.lit(text).alias("text")).union(spark.range(500, 501).select("id", F.lit(near)))
    found = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs({"t": df}).collect()}
    assert found == {(1, i) for i in range(2, 101)} | {(1, 500)}


def test_texts_of_one_class_that_differ_give_all_their_pairs(spark):
    words = [f"v{i}" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(words) + "." * i) for i in range(70)] + [(1000 + i, " ".join(words) + "!") for i in range(70)], "id long, text string")
    found = {(r.id_a, r.id_b) for r in near_duplicates.near_duplicate_pairs({"t": df}).collect()}
    shown = [*range(70), 1000]
    assert found == set(itertools.combinations(shown, 2)) | {(1000, 1000 + i) for i in range(1, 70)}


def test_hot_lists_are_split_and_lose_nothing(spark):
    rng = random.Random(9)
    header = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join(header + [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.choice([20, 55, 90]))])) for i in range(150)]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("tag", F.lit(0)).select("tag", "id", "text")
    classes = texts.mapInArrow(near_duplicates._membership(20), "tag int, id long, cls long, copy long").groupBy("cls").agg(F.min("tag").alias("tag"), F.min("id").alias("head"))
    of = {r.cls: r.head for r in classes.collect()}
    sets = {i: words_set(t) for i, t in rows}
    true = {(a, b) for a, b in itertools.combinations(sorted(of.values()), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert len(true) > 500
    for limits in ({}, {"hot": 8, "segment": 4}, {"hot": 10**6, "hot_in_buffer": 10, "segment": 7}):
        found = {tuple(sorted((of[r.a], of[r.b]))) for r in near_duplicates.class_links(texts, classes, 3, 20, 0.5, **limits).collect()}
        assert found == true, limits


def test_classes_that_share_half_of_their_name_are_told_apart():
    import pyarrow as pa

    names = np.array([7 << 32 | 1, 7 << 32 | 2, 9 << 32], dtype=np.uint64)
    row = [pa.array([0], pa.int32()), *(pa.array([x.tobytes()]) for x in (np.zeros(3, np.uint32), np.empty(0, np.uint16), names, np.full(3, 40, np.uint8)))]
    out = list(near_duplicates._shared_blocks(0.5, 1, 2048)(iter([pa.RecordBatch.from_arrays(row, list(near_duplicates.POSTINGS))])))
    assert {(r["a"], r["b"], r["n"]) for b in out for r in b.to_pylist()} == {(int(a), int(b), 1) for a, b in itertools.combinations(names, 2)}


def test_missed_share_is_as_stated():
    assert near_duplicates.missed(0.5, 50_000) < 6e-4 and near_duplicates.missed(0.6, 50_000) == 0
    assert near_duplicates.least_matches(0.5) == 128


def test_groups_follow_links(spark):
    base = [f"v{i}" for i in range(60)]
    rows = [(9, base), (4, base[:45] + ["x"] * 3), (7, base[:45] + ["x"] * 3), (5, ["far"] * 5 + [f"u{i}" for i in range(30)]), (6, ["short"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, text string")
    found = {r.id: (r.group_id, r.n_links) for r in near_duplicates.near_duplicate_groups({"t": df}).collect()}
    assert found == {9: (4, 1), 4: (4, 1), 7: (4, 1), 5: (5, 0)}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicate_pairs({"t": spark.createDataFrame([], "id long, text string")}).count() == 0


def test_pieces_add_up_and_stay_in_limits():
    rng = random.Random(3)
    for kind in ("word word. ", "字", "a\r\n", "x"):
        for n in (1001, 2001, 7777):
            text = "".join(rng.choice([kind, kind, "b ", "Ω"]) for _ in range(n))[:n]
            ends = pieces.cuts(text, 350, 900)
            assert ends[-1] == len(text) and all(b - a <= 900 for a, b in zip([0, *ends], ends))
            assert all(text[e - 1 : e + 1] != "\r\n" for e in ends[:-1])


def test_an_edit_changes_only_pieces_near_it():
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + (". " if rng.random() < 0.1 else "") for _ in range(6000))
    other = text[:15000] + "INSERTED WORDS HERE " + text[15000:]

    def cut(t):
        ends = pieces.cuts(t, 350, 900)
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    assert len(cut(text) - cut(other)) <= 6


def test_cut_oversized(spark):
    rows = [(1, "a b. " * 500, 3, 1), (1, "a b. " * 500, 3, 1), (2, "x" * 2000, 1, 1), (3, None, 1, 1), (4, "", None, None), (5, "é" * 2001, None, 2), (6, "z" * 3000, 1, 1), (6, "short now", 1, 2), (7, "y" * 2500, 1, None), (None, "n" * 2500, 1, 1)]
    df = spark.createDataFrame(rows, "id long, content string, seq int, at int").withColumn("key", F.lit(0)).withColumn("piece", F.lit("clash"))
    found = pieces.cut_oversized(df.drop("key", "piece"), "id", "content", ["seq"], "at").toPandas()
    assert set(found.id) == {1, 5, 7} and found.piece.str.len().max() <= 1000
    for i, text in ((1, "a b. " * 500), (5, "é" * 2001)):
        own = found[found.id == i].sort_values("piece_no")
        assert "".join(p if k == 0 else p[100:] for k, p in enumerate(own.piece)) == text


@needs_vocabulary
def test_encoder_equals_the_public_library():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(byte_bpe.VOCABULARY)
    theirs.encode_special_tokens = True
    texts = ["", None, " ", "Hello world's <|endoftext|>", "中文没有空格" * 40, "a" * 3000, "\r\n\t  x ", "🏳️‍🌈 naïve", "".join(map(chr, range(1, 0x800)))]
    ids, sizes = byte_bpe.Encoder().encode(texts)
    ends = np.cumsum(sizes)
    for text, n, end in zip(texts, sizes, ends):
        assert ids[end - n : end].tolist() == theirs.encode(text or "", add_special_tokens=False).ids


@needs_vocabulary
def test_long_texts_split_without_a_trace(monkeypatch):
    own = byte_bpe.Encoder()
    text = "some words, 中文 and\n  spaces  " * 200
    whole, _ = own.encode([text])
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    parts, _ = byte_bpe.Encoder().encode([text])
    assert whole.tolist() == parts.tolist()


def test_packing_respects_capacity_and_wastes_little(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 5, 90, 300, 700, 2048, 2049, 9000])) for i in range(3000)] + [(0, 17), (0, None)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "key long, n long"), "key", "n").toPandas()
    fill = packed.groupby("container").n_tokens.sum()
    assert fill.max() <= 2048 and packed.n_tokens.sum() == sum(n or 0 for _, n in rows)
    assert len(packed) >= len(rows) and fill.sum() / (2048 * len(fill)) > 0.97
    assert (packed[packed.piece_no > 0].groupby(["key", "piece_no"]).size() > 0).all()


def test_gll_takes_left_recursion_and_ambiguity():
    g = Grammar("E", {"E": [(0, ("E", frozenset("+"), "E")), (0, (frozenset("n"),)), (0, ())]})
    assert g.parse("n+n+n")[1][1:3] == [0, 5]
    assert g.parse("x")[1][1:3] == [0, 0]


@pytest.mark.parametrize(
    "body, doc",
    [
        ("/** Adds two. */\npublic int add(int a, Map<String, List<T>> b) throws E {\n return 1; }", "/** Adds two. */"),
        ("def f(a, b=(1, 2)) -> int:\n    '''Says it.'''\n    return 1", "'''Says it.'''"),
        ("// one\n// two\nfunc (r *T) Name(x int) (int, error) {\n}", "// one\n// two"),
        ("async loadAll(q: Promise<X>): Promise<Y> {\n // inner\n}", ""),
        ("}} ;\n/* broken */ private void go(int a {\n", "/* broken */"),
        ("@Override\n/** Late. */ void x() {}", "/** Late. */"),
        ("", ""),
    ],
)
def test_opening_documentation(body, doc):
    assert function_docs.Heads().read(body)[0] == doc


def functions(source):
    import time

    began = time.perf_counter()
    found = function_docs.Heads().functions(source)
    assert time.perf_counter() - began < 1
    return [(f["name"], f["doc"]) for f in found]


def test_long_heads_and_files_parse_in_no_time():
    one = [("f", "/** Doc. */")]
    assert functions("".join(f"import a.b.C{i};\n" for i in range(1000)) + "/** Doc. */\npublic int f(int x) { return 1; }") == one
    assert functions("".join(f"import a.b{i}\n" for i in range(1000)) + "def f(x):\n    'Doc.'\n    return 1") == [("f", "'Doc.'")]
    assert functions("/** Doc. */\npublic int f(" + ", ".join(f"Map<String, List<T{i}>> p{i}" for i in range(500)) + ") throws E {\n}") == one
    assert functions("\n".join("words in a line (with brackets) and so on; more (text" for _ in range(1500))) == []
    assert functions("(" * 20_000) == [] and functions("foo(x)\n" * 5000) == [] and functions("void foo(x " * 5000) == []
    assert len(functions("int f(){" * 3000)) == 3000 and len(functions("function a(b){return c(b)}" * 2000)) == 2000
    assert functions("// c\n" * 3000 + "void f() {}") == [("f", "\n".join(["// c"] * 3000))]


def test_all_methods_of_a_broken_class():
    methods = []
    for i in range(100):
        m = f"    /** Doc {i}. */\n    public int m{i}(int a, String b) {{\n        if (a > {i}) {{ return g(b); }}\n        for (int k = 0; k < 3; k++) {{ x.run(k); }}\n        return a;\n    }}\n"
        m = m.replace("String b)", "String b") if i % 10 == 3 else m
        m = m[:-6] if i % 10 == 6 else m
        methods.append(m.replace("return g(b);", "return g(b;") if i % 10 == 8 else m)
    found = function_docs.Heads().functions('package p;\n@Foo("x")\npublic class A {\n    private final int z = h(3);\n' + "\n".join(methods) + "}\n")
    assert [(f["name"], f["doc"]) for f in found] == [(f"m{i}", f"/** Doc {i}. */") for i in range(100)]
    assert all(f["code"].rstrip().endswith(("}", "return a;")) and "Doc" not in f["code"] for f in found)


@pytest.mark.parametrize(
    "source, want",
    [
        ("class A { /** doc */ int f(int a) { return 1; } /** other */ int g() { return 2; } }", [("f", "/** doc */"), ("g", "/** other */")]),
        ("class A(B):\n    @prop(1)\n    def a(self):\n        'One line.'\n        return foo(1)\n\n    async def b(self, x=(1, 2)):\n        pass\n", [("a", "'One line.'"), ("b", "")]),
        ("package x\n\n// Name says.\nfunc (r *T) Name(x int) (int, error) {\n\tif v := f(x); v {\n\t}\n\tfor _, q := range g(x) {\n\t}\n}\n\nfunc Map[K comparable, V any](m map[K]V) []K {\n}\n", [("Name", "// Name says."), ("Map", "")]),
        ("import {a} from 'b'\n/** Loads. */\nexport const load = async (q: Q<X>): Promise<Y> => {\n  it('x', () => { y() })\n}\nclass Z {\n  constructor(private a: A) {}\n  // gets\n  get(x?: number): void {\n    foo(x)\n  }\n}\n", [("load", "/** Loads. */"), ("constructor", ""), ("get", "// gets")]),
        ("int x = 3; // a note\nvoid f() {}", [("f", "")]), ("", []),
    ],
)
def test_functions_of_files(source, want):
    assert functions(source) == want


def test_functions_in_sources_edges(spark):
    rows = [(1, None), (2, ""), (3, "just words (in brackets), nothing else."), (4, "/** Counts open files per owner. */\nint f() { return 1; }\n// noqa\nint g() { return 2; }"), (4, "int h() {}")]
    found = function_docs.functions_in_sources(spark.createDataFrame(rows, "id long, text string").withColumn("name", F.lit("clash")), "id", "text")
    assert sorted((r.id, r.n, r.name, r.verdict) for r in found.collect()) == [(4, 0, "f", "described"), (4, 0, "h", "empty"), (4, 1, "g", "trivial")]
    assert function_docs.functions_in_sources(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


@pytest.mark.parametrize(
    "doc, verdict",
    [
        ("/** loads the file */", "trivial"), ("// TODO later", "trivial"), ("# noqa", "trivial"), ("/** @param path the path\n * @return the result */", "trivial"), ("", "empty"), ("/** */", "empty"), ("// x.load(path);", "trivial"),
        ("/** Copyright (c) 2020 Foo. All rights reserved. */", "trivial"), ("/** Reads bytes until the stream closes. */", "described"), ("/** @param path must exist before the call starts */", "described"), ("// 返回第一个可用的条目", "described"), ("// 无", "trivial"), ("/** loadFile: walks the stream from its end. */", "described"), ("/** loadFile: reads the input and stops\n * as soon as a line repeats. */", "described"), ("/** path : str, optional */", "trivial"), ("/** @param otherThing\n * @throws SomeError */", "trivial"),
    ],
)
def test_verdicts(doc, verdict):
    assert function_docs.judge("loadFile", "void loadFile(String path)", doc)[0] == verdict


def test_function_docs_edges(spark):
    schema = "id long, method_name string, signature string, comment string, body string, created_at timestamp"
    rows = [(1, "f", None, None, None, None), (1, "f", None, None, None, None), (2, None, "class A", "x", "class A {", None), (3, "g", "g()", "  ", "def g():\n  '''Counts open files per owner.'''", None)]
    found = {r.unit_id: r.verdict for r in function_docs.function_docs(spark.createDataFrame(rows, schema)).collect()}
    assert found == {1: "empty", 3: "described"}
    assert function_docs.function_docs(spark.createDataFrame([], schema)).count() == 0


def test_a_description_of_the_whole_corpus_is_a_template(spark):
    rows = [(i, f"name{i}", "", "Generated binding for the remote endpoint.", "", None) for i in range(80)] + [(99, "own", "", "Counts the open files of an owner.", "", None)]
    df = spark.createDataFrame(rows, "id long, method_name string, signature string, comment string, body string, created_at timestamp")
    found = {r.unit_id: r.verdict for r in function_docs.function_docs(df).collect()}
    assert found.pop(99) == "described" and set(found.values()) == {"template"}


def test_cuts_anywhere_give_the_counts_of_the_whole():
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "wörd", "中", " ", "\n", "\r\n", ".", "x_1", "，", "!"]) for _ in range(400))
    exact = [c for c in quality.COUNTS if c.startswith("n_") or c == "visible"]
    whole, _ = quality.measure(text, WordHashes())
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, len(text)), rng.randint(1, 60)))
        parts = [quality.measure(text[a:b], WordHashes())[0] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert {c: v for c, v in merged(parts).items() if c in exact} == {c: whole[c] for c in exact}


def merged(parts):
    total = parts[0]
    for p in parts[1:]:
        total = quality.merge(total, p)
    return total


def long_texts():
    prose = "The reader of this note should know that the tool is not finished, and that we will change it when there is time for it. "
    other = "When the old house was sold, nobody in the village knew who had bought it, but the lights were on in the night. "
    comment = "/* " + prose + "\n" + other + "\n" + prose + "\n*/\n"
    rng = random.Random(8)
    mixed = "".join(rng.choice([prose, other, "\n", "\r\n", "x = f(1);\n", comment, '"""\n', "# " + other + "\n", "a | b | c\n", "在这里我们把所有的东西都先看了一下，然后就没有再说什么。\n", "word " * 40]) for _ in range(200))
    passage = "".join(f"{prose[:-2]} {i}.\n" for i in range(40))
    return [mixed, passage * 6, comment + passage + "x = f(1);\n", comment + passage, (prose + other) * 30, prose * 3 + "\n" + other]


@pytest.mark.parametrize("line", [64, 1 << 13])
def test_chunks_of_any_size_give_all_counts_of_the_whole(monkeypatch, line):
    monkeypatch.setattr(quality, "LINE", line)
    for text in long_texts():
        whole, _ = quality.measure(text, WordHashes(), sure=True)
        for chunk in (50, 333, 1000, 4096):
            pieces = quality.cut(text, chunk)
            assert "".join(p for p, _ in pieces) == text and all(len(p) <= max(chunk, line) + 2 for p, _ in pieces)
            parts = [quality.measure(p, WordHashes(), c, sure=True) for p, c in pieces]
            total = merged([x for x, _ in parts])
            for where in ("", "in_"):
                total[f"{where}distinct"] = len(np.unique(np.concatenate([h[where] for _, h in parts])))
            total["code"] = int(total["code"] > 0)
            assert {c: total[c] for c in quality.COUNTS} == {c: whole[c] for c in quality.COUNTS}


def test_a_verdict_does_not_depend_on_the_chunk(spark):
    rows = [(i, t) for i, t in enumerate([*long_texts(), None, "", "short"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "part": F.lit("x"), "key": F.lit(None), "comment": F.lit("y")})
    whole, cut = (sorted(map(tuple, quality.quality(df, "doc_id", "text", chunk).collect())) for chunk in (1 << 16, 300))
    assert whole == cut and len(whole) == len(rows)


def test_a_repeated_passage_is_no_prose_at_any_length(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("bar", "tel", "mon", "gri", "sal") for b in ("ten", "low", "ing", "er", "ade")]
    sentence = lambda: f"The {rng.choice(words)} of the {rng.choice(words)} was {rng.choice(words)} when the {rng.choice(words)} had a {rng.choice(words)} in it, and the {rng.choice(words)} knew. "
    passage = "".join(sentence() for _ in range(900))[:65_490] + "\n"
    df = spark.createDataFrame([(1, passage), (2, passage * 4), (3, "".join(sentence() for _ in range(900)) + "\n" + passage)], "doc_id long, text string")
    assert {r.doc_id: r.prose for r in quality.quality(df, "doc_id", "text").collect()} == {1: True, 2: False, 3: True}



def test_quality_edges(spark, monkeypatch):
    prose = "The reader of this note should know that the tool is not finished, and that we will change it. " * 3
    rows = [(1, None), (2, ""), (3, " \n "), (4, "We saw the fox near the old house, and it ran to the wood. But nobody knows why it did so."), (5, "a,b,c\n1,2,3\n" * 40), (6, prose), (6, prose), (7, "word " * 60_000)]
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(3)), "doc_id", "text").collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 8 and by[4].prose and not any(by[i].prose for i in (1, 2, 3, 5, 6, 7))
    assert by[1].mean_word_length is None and by[7].n_words == 60_000 and by[7].n_lines == 1
