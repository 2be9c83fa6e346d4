"""Operators against brute force and small cases, positive and negative."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import boundaries, dead, diff, dup, graph, modules, report, search, smells, temporal
from lodestrata.streaming import log


def test_gram_classes_are_the_shared_prefixes(spark):
    """Classes of T equal words, left-maximal ones extended, against all pairs of positions."""
    r = random.Random(4)
    t, files = 3, {i: [r.choice("abc") for _ in range(r.randint(0, 25))] for i in range(6)}
    table = dup.word_rows(spark.createDataFrame([(i, "\n".join(w), "x") for i, w in files.items()], "doc_id long, text string, lang string"))
    occ = dup.occurrences(table, t)
    classes = dup.gram_classes(occ)
    groups = {}
    for i, w in files.items():
        for p in range(len(w) - t + 1):
            groups.setdefault(tuple(w[p : p + t]), []).append((i, p))
    groups = {g: m for g, m in groups.items() if len(m) > 1}
    assert {(x["first"]["file"], x["first"]["pos"] - 1): x["n"] for x in classes.collect()} == {min(m): len(m) for m in groups.values()}
    want = {}
    for m in groups.values():
        before = {files[i][p - 1] if p else (i,) for i, p in m}
        if len(before) > 1:
            k = t
            while len({tuple(files[i][p : p + k + 1]) for i, p in m}) == 1 and all(p + k < len(files[i]) for i, p in m):
                k += 1
            want[min(m)] = k
    got = dup.extended(dup.members(occ, classes.where("left_maximal")), table, t)
    assert {(x["first_file"], x["first_pos"] - 1): x["length"] for x in got.collect()} == want


def test_suppression_is_greedy(spark):
    rows = [(1, 7, 1, 5), (1, 7, 4, 9), (1, 7, 6, 8), (1, 8, 1, 1), (2, 7, 1, 5), (2, 7, 5, 9)]
    found = spark.createDataFrame(rows, "c int, file long, start_row int, end_row int")
    assert sorted(tuple(x) for x in dup.kept_places(found, ["c"]).collect()) == [(1, 7, 1, 5), (1, 7, 6, 8), (1, 8, 1, 1), (2, 7, 1, 5)]
    got = dup.suppress_overlaps(found, ["c"]).collect()
    assert [(x["c"], x["n"], tuple(x["place"])) for x in got] == [(1, 3, (7, 1, 5))]


def test_long_extensions(spark):
    """Shared prefixes around the width of a round and its powers, to a file's end and before it."""
    lengths = [20, 21, 51, 52, 53, 83, 84, 1043, 1044, 1045, 1100, 40_000]
    rows = []
    for k, n in enumerate(lengths):
        shared = [f"w{k}_{i}" for i in range(n)]
        rows += [(3 * k, ["x", *shared]), (3 * k + 1, ["y", *shared, "end", "z"]), (3 * k + 2, ["v", *shared, "other"])]
    files = spark.createDataFrame([(i, "en", w, list(range(len(w)))) for i, w in rows], "file long, language string, words array<string>, rows array<int>")
    occ = dup.occurrences(files, 20)
    got = dup.extended(dup.members(occ, dup.gram_classes(occ).where("left_maximal")), files, 20).collect()
    assert {x["first_file"] // 3: x["length"] for x in got} == dict(enumerate(lengths)) and len(got) == len(lengths)


def test_stitching(spark):
    rows = [("A", f, 0, 10, 10) for f in "xy"] + [("B", f, 12, 22, 10) for f in "xy"] + [("C", "x", 50, 60, 10), ("C", "y", 90, 99, 10)]
    c = spark.createDataFrame(rows, "cid string, file string, start int, end int, matched int")
    got = sorted(tuple(x) for x in dup.stitch(c, 5).select("cid", "file", "start", "end", "matched").collect())
    assert got == [("A", "x", 0, 22, 20), ("A", "y", 0, 22, 20), ("C", "x", 50, 60, 10), ("C", "y", 90, 99, 10)]
    assert dup.stitch(c, 1).where("cid = 'B'").count() == 2


@pytest.mark.parametrize("n, left", [(9, 1), (16, 1), (256, 1)])
def test_stitching_joins_chains(spark, n, left):
    """A chain of n fragments that follow each other at a gap of 2, in two files."""
    rows = [(i, f, i * 12, i * 12 + 10, 10) for i in range(n) for f in "xy"]
    got = dup.stitch(spark.createDataFrame(rows, "cid int, file string, start int, end int, matched int"), 5).collect()
    assert len({x["cid"] for x in got}) == left and sum(x["matched"] for x in got) == 20 * n
    assert max(x["end"] for x in got) == n * 12 - 2 and min(x["start"] for x in got) == 0


@pytest.mark.parametrize("seed", range(4))
def test_graphs(spark, seed):
    r = random.Random(seed)
    n = 14
    e = {(r.randrange(n), r.randrange(n)) for _ in range(16 + seed * 4)}
    reach = {a: {b for x, b in e if x == a} for a in range(n)}
    for _ in range(n):
        for a in range(n):
            reach[a] |= {c for b in list(reach[a]) for c in reach[b]}
    df = spark.createDataFrame(sorted(e), "src int, dst int")
    assert {tuple(x) for x in graph.closure(df).select("src", "dst").collect()} == {(a, b) for a in range(n) for b in reach[a]}
    scc = {a: min([a] + [b for b in reach[a] if a in reach[b]]) for a in range(n) if any(a in reach[b] for b in reach[a] if b != a)}
    assert {x["node"]: x["scc"] for x in graph.strongly_connected(df).collect()} == scc
    up = {a: a for a in range(n)}
    for _ in range(n):
        for a, b in e:
            up[a] = up[b] = min(up[a], up[b])
    touched = {x for a, b in e if a != b for x in (a, b)}
    assert {x["node"]: x["component"] for x in graph.connected_components(df, "src", "dst").collect()} == {a: up[a] for a in touched}


def test_type_level_cycles(spark):
    e = spark.createDataFrame([("a", "b", False), ("b", "a", True), ("c", "d", False), ("d", "c", False)], "src string, dst string, type_only boolean")
    assert [x["members"] for x in graph.type_level_cycles(e).collect()] == [["a", "b"]]
    assert [x["members"] for x in graph.cycles(e.where("not type_only")).collect()] == [["c", "d"]]


def test_dead_symbols(spark):
    form = "module string, symbol string, kind string, private boolean, exported boolean, registered boolean, entry boolean, local_uses int"
    row = lambda m, s, **k: (m, s, "function", k.get("private", False), k.get("exported", False), k.get("registered", False), k.get("entry", False), k.get("n", 0))
    s = spark.createDataFrame([row("m", "used"), row("m", "dead"), row("m", "_p", private=True), row("m", "all", exported=True), row("m", "local", n=3), row("star", "x"), row("alone", "y"), row("only", "z"), row("m", "reg", registered=True)], form)
    e = spark.createDataFrame([("a", "m", "used", False), ("t", "m", "dead", True), ("a", "star", "*", False), ("a", "only", None, False)], "source string, target string, symbol string, is_test boolean")
    got = {x["symbol"] for x in dead.dead_symbols(s, e.na.fill({"symbol": ""})).collect()}
    assert got == {"dead", "z"}


def test_methods(spark):
    bases = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "C")], "class string, base string")
    m = spark.createDataFrame([("A", "run", False, False, False), ("B", "run", False, False, False), ("B", "gone", False, False, False), ("B", "named", False, False, False), ("D", "__str__", False, False, True)], "class string, method string, private boolean, decorated boolean, dunder boolean")
    none = spark.createDataFrame([], "class string, method string")
    names = spark.createDataFrame([("named", 2)], "method string, n int")
    got = dead.unused_methods(m, bases, none, none, names, none)
    assert [(x["class"], x["method"], x["confidence"]) for x in got.collect()] == [("B", "gone", "medium")]


def test_boundaries(spark):
    rules = boundaries.with_patterns(spark, [("layer", "app.ui", "app.db"), ("glob", "lib/*", "*test*"), ("none", "zzz", "a")])
    e = spark.createDataFrame([("app.ui.view", "app.db", "app.db"), ("app.uix", "app.db", "app.db"), ("lib.a.b", "x", "my.test"), ("app.db", "app.ui", "")], "src string, dst string, literal string")
    assert {(x["src"], x["label"]) for x in boundaries.violations(e, rules).collect()} == {("app.ui.view", "layer"), ("lib.a.b", "glob")}
    assert [x["label"] for x in boundaries.unmatched(rules, e.select(F.col("src").alias("module"))).collect()] == ["none"]


def test_globs():
    import re

    assert re.match(scalar.glob_regex("src/*.py"), "src/a.py") and not re.match(scalar.glob_regex("src/*.py"), "src/a/b.py")
    assert re.match(scalar.glob_regex("src/*.py", True), "src/a/b.py")
    assert re.match(scalar.glob_regex("**/x/*"), "x/y") and re.match(scalar.glob_regex("**/x/*"), "a/b/x/y")
    assert re.match(scalar.glob_regex("{a,b}[!c]"), "ad") and not re.match(scalar.glob_regex("{a,b}[!c]"), "ac")


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(scalar.tuple_arity(F.lit("tuple[int, dict[str, int], str]"))) == 3 and val(scalar.tuple_arity(F.lit("list[int]"))) == 0
    assert val(scalar.normal_path(F.lit("a/./b/../c"))) == "a/c" and val(scalar.normal_path(F.lit("/../a"))) == "/a"
    assert val(scalar.base_type(F.lit("Map<K, V>"))) == "Map" and val(scalar.last_segment(F.lit("a.b.c"))) == "c"
    assert val(scalar.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 1.0
    assert val(scalar.round2(F.lit(0.125))) == 0.13 and val(scalar.ratio(F.lit(1.0), F.lit(0.0))) == 0.0


def test_diffs(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,0 +2,3 @@\n+a\n+b\n+c\n@@ -9 +12 @@\n-o\n+n\n@@ -20,2 +22,0 @@\n-p\n-q\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, line string")
    assert {tuple(x) for x in diff.changed_ranges(lines).collect()} == {("x", 2, 4), ("x", 12, 12)}
    assert {tuple(x) for x in diff.added_lines(lines).collect()} == {("x", 2, "a"), ("x", 3, "b"), ("x", 4, "c"), ("x", 12, "n")}
    two = [(d, i, x) for d, f, at in (("p", "f.py", 10), ("q", "g.py", 50)) for i, x in enumerate([f"--- a/{f}", f"+++ b/{f}", f"@@ -{at},0 +{at},2 @@", "+a", "+b"])]
    both = spark.createDataFrame(two, "diff string, n long, line string")
    assert {tuple(x)[:2] for x in diff.added_lines(both).collect()} == {("f.py", 10), ("f.py", 11), ("g.py", 50), ("g.py", 51)}
    long = ["--- a/l", "+++ b/l", f"@@ -1,0 +5,{3 * diff.CHUNK} @@", *["+x"] * (3 * diff.CHUNK), "@@ -1 +900000 @@", "-o", "+n"]
    found = diff.added_lines(spark.createDataFrame(list(enumerate(long)), "n long, line string"))
    assert found.agg(F.min("line_no"), F.max(F.when(F.col("text") == "x", F.col("line_no"))), F.max("line_no"), F.countDistinct("line_no")).first() == (5, 3 * diff.CHUNK + 4, 900000, 3 * diff.CHUNK + 1)
    assert {tuple(x) for x in diff.changed_ranges(spark.createDataFrame([(0, "? new.py")], "n long, line string")).collect()} == {("new.py", 1, diff.MAX)}
    places = spark.createDataFrame([(1, "x", 3, 5), (1, "z", 1, 2), (2, "x", 2, 2), (2, "x", 12, 13)], "id int, file string, start long, end long")
    hints = {x["id"]: x["hint"] for x in diff.clone_provenance(places, diff.changed_ranges(lines)).collect()}
    assert hints == {1: "copy of z:1", 2: "2 copies in this change"}


def test_modules(spark):
    f = spark.createDataFrame([("src/app/__init__.py", "python"), ("src/app/a.py", "python"), ("src/app/sub/b.py", "python"), ("web/x/index.ts", "typescript")], "file string, language string")
    m = modules.modules(modules.with_roots(f, spark.createDataFrame([("",), ("src",)], "root string")))
    assert {x["file"]: x["module"] for x in m.collect()} == {"src/app/__init__.py": "app", "src/app/a.py": "app.a", "src/app/sub/b.py": "app.sub.b", "web/x/index.ts": "web/x"}
    one = spark.range(1)
    res = lambda t, lv, mod, ix: one.select(modules.resolve_python(F.lit(t), F.lit(lv), F.lit(mod), F.lit(ix))).first()[0]
    assert res("a", 1, "app.sub.b", False) == "app.sub.a" and res("a", 2, "app.sub.b", False) == "app.a" and res("", 1, "app", True) == "app" and res("os", 0, "app", True) == "os"
    js = lambda t, mod, file: one.select(modules.resolve_script(F.lit(t), F.lit(mod), F.lit(file))).first()[0]
    assert js("../y/z.js", "web/x/a", "web/x/a.ts") == "web/y/z" and js("./b", "web/x", "web/x/index.ts") == "web/x/b" and js("react", "a", "a.ts") == "react"
    p = spark.createDataFrame([("@/*", "src/*"), ("@/ui/*", "ui/*")], "pattern string, replacement string")
    got = modules.aliased(spark.createDataFrame([("f", "@/ui/x"), ("f", "@/y"), ("f", "z")], "file string, target string"), p)
    assert {x["target"] for x in got.collect()} == {"ui/x", "src/y", "z"}


def test_ageing(spark):
    day = temporal.DAY
    now = 100 * day
    cur = spark.createDataFrame([(1, "c", "a"), (2, "c", "b"), (9, "c", "z")], "fp long, class string, label string")
    held = spark.createDataFrame([(1, "c", "a", now - 5 * day), (3, "c", "x", now - 2 * day), (4, "c", "y", 0)], "fp long, class string, label string, first_seen long")
    bank = spark.createDataFrame([(2, "c", now - 30 * day), (9, "c", now - 31 * day), (5, "c", now - day)], "fp long, class string, resolved_ts long")
    got = temporal.age(cur, held, bank, spark.createDataFrame([(4,)], "fp long"), now)
    assert {x["fp"]: x["first_seen"] for x in got["open"].collect()} == {1: now - 5 * day, 2: now, 9: now}
    assert {x["fp"]: x["age"] for x in got["resolved"].collect()} == {3: 2 * day}
    assert {x["fp"]: x["held"] for x in got["reintroduced"].collect()} == {2: 30 * day}
    assert {x["fp"] for x in got["bank"].collect()} == {3, 5}
    with pytest.raises(ValueError):
        temporal.triage(spark.createDataFrame([], "fp long, verdict string"), got["open"], "nowhere", "debt")
    assert temporal.triage(spark.createDataFrame([(1, "debt")], "fp long, verdict string"), got["open"], "A", "clear").count() == 0


def test_deferral():
    state, shown, day = log.NEW, [], 86400
    for t in (0, 1, 2, 1 + 3 * day, 2 + 3 * day, 7 * day, 11 * day, 16 * day, 21 * day + 1, 21 * day + 2, 21 * day + 3):
        state, seen = log.defer(state, t)
        shown.append(seen)
    assert shown == [True, True, False, True, True, False, False, False, True, True, False]  # after five days of absence it begins again


def test_signature_counts_equal_findings(spark):
    f = spark.createDataFrame([("a", 1, "k"), ("a", 1, "k"), ("b", 2, "k")], "file string, line int, kind string")
    one = lambda d: report.signature(d).first()[0]
    assert one(f) == one(f.orderBy("file")) != one(f.where("file = 'b'")) and one(f.limit(0)) == 0


def test_smell_rules(spark):
    u = spark.createDataFrame([("a", 11), ("b", 10), ("c", 25)], "unit string, branches int").selectExpr("unit", "branches - 1 as branches")
    r = [smells.Rule("high_complexity", "branches + 1", 10, critical=20)]
    got = {(x["unit"], x["severity"], x["action"]) for x in smells.threshold_smells(u, r, actions={"high_complexity": "info"}).collect()}
    assert got == {("a", "warning", "info"), ("c", "critical", "must_fix")}


def test_search_and_report(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id int, vector array<float>")
    assert [x["id"] for x in search.top_k(v, [1.0, 0.0], 2).collect()] == [1, 3]
    docs = spark.createDataFrame([("f", "s", "function", "hello world"), ("f", "t", "function", "")], "file string, symbol string, kind string, text string")
    cache = search.incremental(docs, spark.createDataFrame([], "key long, model_id string, vector array<float>"), "m", search.hashed_embedding)
    assert cache.count() == 2
    again = search.incremental(docs.limit(1), cache, "m", lambda d: d.where("false").withColumn("vector", F.expr("cast(array() as array<float>)")))
    assert again.count() == 1
    f = spark.createDataFrame([("smell", "k", "a/b.py", "s", 0, 0, 1.0, 1.0, "warning", "warning"), ("cycle", "cycle", None, "t", 3, 4, 2.0, 1.0, "warning", "must_fix")], "pillar string, kind string, file string, symbol string, line long, end_line long, metric double, threshold double, severity string, action string")
    assert report.gate(f, "must_fix") and not report.gate(f.where("pillar = 'smell'"), "must_fix")
    assert all('"line":0' not in x["json"] for x in report.to_json(f).collect())
    assert "cycle (1)" in report.terminal(f) and report.artifact_diff(f, f, ["line"]).count() == 0
