"""A small test for each finding of the second round that led to a change."""

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import embedding_dedup
from lodestrata.operators import dead, diff, dup, search, smells
from lodestrata.sources import lexers, python_facts, script_facts
from lodestrata.streaming import log

SOURCES = [(f"p{i}.py", "python", f"import json\ndef f{i}(a):\n    return json.dumps(a)\n") for i in range(40)] + [(f"s{i}.ts", "typescript", f"function g{i}(a) {{ return a; }}\n") for i in range(40)]


def test_sources_of_one_partition_are_read_by_many_tasks(spark):  # F1 to F12, F24
    files = spark.createDataFrame(SOURCES, "file string, language string, text string").coalesce(1)
    for facts, names in ((python_facts.facts(files), {f"f{i}" for i in range(40)}), (script_facts.facts(files), {f"g{i}" for i in range(40)})):
        rows = facts["functions"]
        assert {r["name"] for r in rows.select("name").collect()} == names
        assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_facts_of_some_kinds_are_those_of_all(spark):  # F1 to F12
    files = spark.createDataFrame(SOURCES, "file string, language string, text string")
    every = python_facts.facts(files)
    for kinds in (["names"], ["functions", "tokens"], ["imports"], ["calls", "attributes"]):
        some = python_facts.facts(files, kinds)
        assert set(some) == set(kinds)
        for k in kinds:
            assert sorted(map(str, some[k].collect())) == sorted(map(str, every[k].collect()))


def test_sizes_at_exactly_the_ratio_are_alike(spark):  # 55 is 0.55 of 100, whose product as doubles is more than 55
    rows = [(1, [100, 0], 100), (2, [55, 0], 55), (3, [54, 0], 54), (4, [55, 0], 55), (None, [55, 0], 55)]
    got = dup.shape_pairs(spark.createDataFrame(rows, "unit long, shape array<long>, size long"), 0.995, 0.55)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1.0), (1, 4, 1.0), (2, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0)]


def test_units_of_one_shape_are_compared_once(spark):  # F14
    rows = [(i, i % 3, [3, 4], 30, [1.0, 0.0], 9) for i in range(60)] + [(i, i % 3, [4, 3], 30, [0.0, 1.0], 9) for i in range(60, 70)]
    units = spark.createDataFrame(rows, "unit long, file long, shape array<long>, size long, vector array<double>, n_words int")
    got = sorted(map(tuple, dup.semantic_pairs(units).select("a", "b").collect()))
    assert got == [(a, b) for a in range(70) for b in range(a + 1, 70) if a % 3 != b % 3 and (a < 60) == (b < 60)]
    assert dup.like_shapes(units.select("shape", "size").distinct(), 0.82, 0.55).count() == 4


def test_helpers_are_not_paired_with_each_caller(spark):  # F16: 2,000 callers of 2,000 helpers of one name
    n = 2000
    calls = spark.range(n).select(F.lit(0).alias("file"), F.col("id").alias("unit"), F.lit("t").alias("target"), F.lit(True).alias("in_loop")).union(spark.createDataFrame([(1, 7, "t", True), (2, 8, "t", True)], "file int, unit long, target string, in_loop boolean"))
    fns = spark.range(n).select(F.lit(0).alias("file"), F.col("id").alias("unit"), F.lit("t").alias("name"), F.lit(1).alias("loops")).union(spark.createDataFrame([(1, 7, "t", 1), (2, 8, "t", 1), (2, 9, "t", 1)], "file int, unit long, name string, loops int"))
    got = smells.looping_helpers(calls, fns)
    assert {(r["file"], r["unit"]) for r in got.collect()} == {(0, i) for i in range(n)} | {(2, 8)}
    joined = got.queryExecution if hasattr(got, "queryExecution") else got._jdf.queryExecution()
    assert "min(unit" in joined.optimizedPlan().toString()


def test_pairs_are_counted_in_tasks_of_a_bounded_size(spark, monkeypatch):  # F17
    monkeypatch.setattr(dup, "PAIRS", 100)
    owned = spark.range(40).select(F.col("id").alias("o")).crossJoin(spark.range(5).select(F.col("id").alias("p")))
    got = dup.shared_properties(owned, "o", "p", 4)
    assert {tuple(r) for r in got.collect()} == {(a, b, 5) for a in range(40) for b in range(a + 1, 40)}
    assert "hashpartitioning(a" in got._jdf.queryExecution().executedPlan().toString() and ", 39)" in got._jdf.queryExecution().executedPlan().toString()


def test_deferral_of_a_batch_takes_no_task_for_each_key(spark):  # F26
    rows = [(i, f"2024-01-{1 + i % 20:02d} 00:00:00", i % 7, "ab"[i % 2]) for i in range(300)] + [(900, None, 3, "a"), (901, "2024-01-01 00:00:00", None, "b")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = log.deferred(events)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = events.groupBy("user_id", "event_type").applyInPandas(lambda key, pdf: log._shown(tuple(None if x != x else x for x in key), pdf, log.NEW)[1], log.SHOWN)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scores_are_made_a_few_at_once(spark, monkeypatch):  # F30
    monkeypatch.setattr(search, "CELLS", 8)
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(30)], "id long, vector array<double>")
    got = search.top_k_each(v, v.where("id < 7"), 3)
    rows = {i: [float(i % 5), float(i % 3)] for i in range(30)}
    score = lambda a, b: sum(x * y for x, y in zip(rows[a], rows[b]))
    assert sorted(map(tuple, got.collect())) == sorted((q, i, score(q, i)) for q in range(7) for i in sorted(rows, key=lambda i: (-score(q, i), i))[:3])


def test_entry_classes_are_not_sent_through_the_driver(spark, monkeypatch):  # F31
    plans, cut = [], dead.cut
    monkeypatch.setattr(dead, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    bases = spark.createDataFrame([(0, "a", "x.TestCase"), (0, "b", "a"), (1, "c", "a")], "file long, class string, base string")
    assert {tuple(r) for r in dead.entry_classes(bases, ["TestCase"]).collect()} == {(0, "a"), (0, "b")}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_marks_hold_over_the_chunks_of_a_diff(spark, monkeypatch):  # F21, F29
    lines = ["--- a/f", "+++ b/f", "@@ -1 +3,4 @@", "+a", " b", "+c", "-d", "+e", "@@ -9 +20,2 @@", "+g", "+h", "--- a/k", "+++ b/k", "@@ -1 +1 @@", "+z"]
    df = spark.createDataFrame([(d, i, x) for d in (1, 2) for i, x in enumerate(lines)] + [(3, 0, "+++ b/s"), (3, 1, "@@ -1 +5 @@"), (3, 2, "+q")], "diff int, n long, line string")
    want = 2 * [("f", 3, "a"), ("f", 5, "c"), ("f", 6, "e"), ("f", 20, "g"), ("f", 21, "h"), ("k", 1, "z")] + [("s", 5, "q")]
    for size in (2, 3, 5, 1 << 16):
        monkeypatch.setattr(diff, "CHUNK", size)
        assert sorted(map(tuple, diff.added_lines(df).collect())) == sorted(want)
        assert sorted(map(tuple, diff.changed_ranges(df).collect())) == sorted(2 * [("f", 3, 6), ("f", 20, 21), ("k", 1, 1)] + [("s", 5, 5)])
    rows = diff.running(df, {}, {"at": F.lit(1)}, {"base": ("at", F.col("line").startswith("@@ "))})
    assert {(r["n"], r["base"]) for r in rows.where("diff = 1").collect()} == {(i, max((j + 1 for j in range(i + 1) if lines[j].startswith("@@ ")), default=None)) for i in range(len(lines))}


def test_exact_search_deals_vectors_into_blocks(spark, monkeypatch):  # F13
    rng = np.random.default_rng(5)
    for name, value in (("WIDE", 32), ("COPIES", 64), ("PAIRS", 8)):
        monkeypatch.setattr(embedding_dedup, name, value)
    v = rng.normal(size=(150, 8))
    v = np.concatenate([v, v[:60] + 0.05 * rng.normal(size=(60, 8)), np.repeat(v[:1], 90, axis=0) + 0.01 * rng.normal(size=(90, 8))])
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "id long, v binary")
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(v.astype(float) @ v.T.astype(float) >= embedding_dedup.COSINE)) if a != b}
    edges = embedding_dedup.near_edges(table, 8, recall=1.0, spanning=False)
    assert {tuple(sorted(e)) for e in edges.collect()} == {e for e in want if e[0] < e[1]}
    assert "least(block" in edges._jdf.queryExecution().optimizedPlan().toString()

    def parts(pairs):
        lab = list(range(len(v)))
        for _ in range(len(v)):
            new = list(lab)
            for a, b in pairs:
                new[a] = new[b] = min(new[a], new[b])
            if new == lab:
                return lab
            lab = new

    for recall in (1.0, 0.9999):
        few = [tuple(e) for e in embedding_dedup.near_edges(table, 8, codes=16, block=16, recall=recall).collect()]
        assert set(few) <= want | {(b, a) for a, b in want} and parts(few) == parts(want)


def test_near_misses_are_hashed_by_file(spark):  # F28
    rows = [(1, "en", ["a", "b", "a"]), (2, "en", ["x", "y", "x"]), (3, "en", ["x", "y", "y"]), (4, "fr", ["x", "y", "x"]), (5, "en", ["a", "b", "a"]), (6, "en", ["a"]), (7, "en", []), (8, "en", None), (9, "de", ["c", "(", "c"]), (10, "de", ["d", "(", "d"]), (11, "de", ["d", "[", "d"])]
    files = spark.createDataFrame(rows, "file long, language string, words array<string>")
    got = dup.near_misses(files, 3, r"[a-z]")
    assert sorted(map(tuple, got.collect())) == [("de", 9, 2, 2, 3), ("en", 1, 3, 2, 3)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    twice = spark.createDataFrame([(1, "en", ["a", "b"]), (1, "en", ["a", "b"]), (2, "en", ["x", "x", "y", "y"]), (3, "en", ["x", "z"]), (3, "en", ["x", "z"]), (4, "en", ["p", "p", "q", "q"])], files.schema)
    assert sorted(map(tuple, dup.near_misses(twice, 1).collect())) == [("en", 1, 2, 2, 4), ("en", 2, 2, 2, 4)]


def test_only_repeated_grams_become_rows(spark, monkeypatch):  # F18, F19, F22, F23, F27
    for name, value in (("PIECE", 40), ("BUCKET", 16)):
        monkeypatch.setattr(dup, name, value)
    rng = np.random.default_rng(3)
    texts = [[f"w{x}" for x in rng.integers(0, 3, n)] for n in (0, 2, 3, 30, 70, 5, 44)] + [[f"u{i}" for i in range(100)], [f"w{i % 3}" for i in range(60)]]
    files = spark.createDataFrame([(i, "en" if i % 2 else "fr", w, [k // 7 + 1 for k in range(len(w))]) for i, w in enumerate(texts)] + [(99, "en", None, None)], "file long, language string, words array<string>, rows array<int>")
    every = dup.occurrences(files, 4)
    classes = {tuple(r[:4]): r for r in dup.gram_classes(every).collect()}
    pieces = dup.packed(files)
    assert pieces.count() > 4
    again = dup.repeated(pieces, 4)
    assert sorted(map(str, dup.gram_classes(again).collect())) == sorted(map(str, classes.values()))
    some = dup.repeated(pieces, 4, maximal=True)
    assert sorted(map(str, dup.gram_classes(some).where("left_maximal").collect())) == sorted(str(r) for r in classes.values() if r["left_maximal"])
    assert some.where("file = 7").isEmpty() and again.where("file = 7").isEmpty() and every.where("file = 7").count() == 97
    of = lambda occ: sorted(map(str, dup.members(occ, dup.gram_classes(occ).where("left_maximal")).drop("opens").collect()))
    assert of(some) == of(every)


def test_places_are_stitched_by_stretches(spark, monkeypatch):  # 3,000 places in one file aren't paired with each other
    plans, cut = [], dup.cut
    monkeypatch.setattr(dup, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = [(10 * (i // 2) + i % 2 + 1, "f", 50 * i + 1000 * g, 50 * i + 1000 * g + 20, 20) for g in (0, 1000) for i in range(1500)]
    got = dup.stitch(spark.createDataFrame(rows, "cid int, file string, start int, end int, matched int"), 30, 1)
    assert got.groupBy("matched").count().collect()[0][:] == (40, 1500)
    assert any("j#" in line and "Join Inner" in line for p in plans for line in p.splitlines())


def test_script_facts_are_columns_of_the_wanted_kinds(spark):  # no JSON in between, and no calls are made for functions only
    text = "class A extends B {\n  go(n) { while (n) { n.push(7); } return 'x\\\n y'; }\n}\nfunction f(a) { if (a && 9) { a = 1; /* c\n d */ } }\n"
    kinds = [k for k, _ in script_facts.extract(text, "typescript", frozenset(("functions",)))]
    assert kinds == ["functions"] * 2
    files = spark.createDataFrame([("a.ts", "typescript", text), ("b.rs", "rust", None)], "file string, language string, text string")
    got = script_facts.facts(files, ("functions",))["functions"]
    assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["unit"]: r for r in got.collect()}
    assert rows["A.go"]["mutated"] == ["n"] and (rows["A.go"]["start_line"], rows["A.go"]["end_line"], rows["f"]["start_line"], rows["f"]["end_line"]) == (2, 3, 5, 6)
    assert rows["f"]["assigns"] == {"a": 1} and (rows["f"]["branches"], rows["f"]["magic_numbers"], rows["f"]["comment_lines"], rows["f"]["nested_ifs"]) == (2, 1, 2, 0)
    every = script_facts.facts(files)
    assert [tuple(r)[:4] for r in every["calls"].collect()] == [("a.ts", "A.go", "push", "n")] and [r["bases"] for r in every["classes"].collect()] == [["B"]]


def test_script_imports_run_each_pattern_once(spark):  # F20
    ts = "import a, { b as c, type D } from 'x'; // import q from 'no'\nimport * as all from 'x';\r\nimport './side';\nexport { e } from \"y\";\nconst z = require( 'z' ); require('x'); /* import 'w' */ import './side';\nimport type { T } from 't';\n"
    rs = "use a::{self, b::{C, D as E}};\n  pub use std::fmt;\r use r::s; use u::v;\nlet use_ = 1; use x::no;\nuse a::b::C;\n// use q::q;\n"
    files = spark.createDataFrame([("a.ts", "typescript", ts), ("b.rs", "rust", rs), ("c.rs", "rust", None), ("d.py", "python", "import x"), ("e.js", "javascript", "")], "file string, language string, text string")
    got = lexers.imports(files)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [("a.ts", "typescript", *x) for x in (("x", ["default", "b", "D"]), ("x", ["*"]), ("y", ["e"]), ("t", ["T"]), ("./side", []), ("z", []))]
    want += [("b.rs", "rust", x, [x.split("::")[-1]]) for x in ("a", "a::b::C", "a::b::D", "std::fmt", "r::s", "u::v")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
