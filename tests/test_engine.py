"""A small tree from files to findings, and the facts of single sources."""

import textwrap

from lodestrata import engine
from lodestrata.sources import lexers, python_facts, script_facts, trees

CLONE = "\n".join(f"    total_{i} = compute(alpha_{i}, {i}) + other.value_{i} * scale[{i}]" for i in range(8))

TREE = {
    "shop/__init__.py": "",
    "shop/models.py": "from shop import orders\n\nclass Item:\n    pass\n\ndef make():\n    return orders.place(Item())\n",
    "shop/orders.py": "from shop import models\nimport json\n\ndef place(x):\n    return x\n\ndef forgotten():\n    return 1\n",
    "shop/ui.py": f"from shop.models import make\nfrom shop.orders import place\n\ndef show(compute, other, scale):\n{CLONE}\n    return make(), place(1)\n",
    "shop/copy.py": f"from shop.models import make\n\ndef again(compute, other, scale):\n{CLONE}\n    return make()\n",
    "shop/deep.py": textwrap.dedent(
        """
        from shop.ui import show
        from shop.copy import again

        def nest(a, items):
            for x in items:
                if x:
                    while a:
                        with a:
                            if a in (1, 2):
                                items.append(x)
            return show(a, a, a), again(a, a, a)
        """
    ),
    "main.py": "from shop.deep import nest\n\nprint(nest(1, []))\n",
    "broken.py": "def (:\n",
    "gen/models_pb2.py": "x = 1\n",
    "made.py": "# Code generated by a tool. DO NOT EDIT.\nx = 1\n",
    "skipped/a.py": "x = 1\n",
    ".gitignore": "skipped/\n",
    "web/a.ts": "import { b } from './b'\nexport const a = b // note\n",
    "web/b.ts": "export const b = 1\nexport function unused() {}\n",
    "pyproject.toml": "[project.scripts]\nrun = 'shop.ui:show'\n",
}


def plant(root):
    for name, text in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_tree_and_findings(spark, tmp_path):
    plant(tmp_path)
    files, issues = trees.tree(spark, str(tmp_path))
    assert {x["file"] for x in files.collect()} == {f for f in TREE if f.endswith((".py", ".ts"))} - {"gen/models_pb2.py", "made.py", "skipped/a.py"}
    assert issues.count() == 0 and trees.entry_modules(str(tmp_path)) == {"shop.ui"}
    found = [x.asDict() for x in engine.analyze(spark, str(tmp_path), rules=[("no ui below", "shop.deep", "shop.ui")], tokens=40).collect()]
    have = {(x["pillar"], x["kind"], x["file"], x["symbol"]) for x in found}
    assert ("cycle", "cycle", None, "shop.models,shop.orders") in have
    assert ("boundary", "no ui below", "shop/deep.py", "shop.ui") in have
    assert ("dead_code", "function", "shop/orders.py", "forgotten") in have
    assert ("dead_code", "import", "shop/orders.py", "json") in have
    assert not any(x[0] == "dead_code" and x[3] in ("make", "nest", "show") for x in have)
    assert any(x["pillar"] == "clone" for x in found)
    assert {("smell", "deep_nesting", "shop/deep.py", "nest"), ("smell", "mutated_parameter", "shop/deep.py", "nest"), ("smell", "literal_membership", "shop/deep.py", "nest")} <= have
    facts = engine.facts(spark, str(tmp_path))
    assert [x["file"] for x in facts["issues"].collect()] == ["broken.py"]
    assert ("web/a", "web/b") in {(x["src"], x["dst"]) for x in facts["edges"].collect()}


def rows(text, kind):
    return [r for k, r in python_facts.extract(textwrap.dedent(text)) if k == kind]


def test_function_facts():
    (f,) = rows(
        """
        def f(self, a, flag: bool, b: "dict" = None) -> tuple[int, int, str]:
            # note
            try:
                x = a.b.c.d.e.f
            except Exception:
                pass
            y = a or ""
            y = 7 if a else 8 if b else 9
            if a:
                if b:
                    return y
            for i in a:
                for j in sorted(b):
                    a[j] = i
            return 1, 2, 3
        """,
        "functions",
    )
    assert f["chain_depth"] == 5 and f["broad_handlers"] == 1 and f["empty_fallbacks"] == 1 and f["short_fallbacks"] == 1
    assert f["nested_ternaries"] == 1 and f["nested_ifs"] == 1 and f["nested_loops"] == 1 and f["sorts_in_loop"] == 1 and f["bool_params"] == 1
    assert f["return_arity"] == 3 and f["annotated_arity"] == 3 and f["mutated"] == ["a"] and f["assigns"]["y"] == 2 and f["comment_lines"] == 1 and f["max_nesting"] == 2


def test_comments_belong_to_the_innermost_function():
    f = {r["unit"]: r["comment_lines"] for r in rows("def outer():\n    # a\n    def inner():\n        # b\n        # c\n        pass\n    return inner\n# d\n", "functions")}
    assert f == {"outer": 1, "outer.inner": 2}


def test_declarations_count_as_names():
    n = {r["name"]: r["n"] for r in rows("def helper():\n    pass\n\nhelper()\nx = 1\n\ndef alone():\n    pass\n", "names")}
    assert n == {"helper": 2, "x": 1, "alone": 1}


def test_other_facts():
    src = """
    from typing import TYPE_CHECKING
    if TYPE_CHECKING:
        from a import B
    __all__ = ["C"]
    class C(B):
        x: int
        def m(self):
            return self.x["k"]
        def s(self):
            raise NotImplementedError
    """
    assert [(i["target"], i["phase"]) for i in rows(src, "imports")] == [("typing", "runtime"), ("a", "type_only")]
    (c,) = rows(src, "classes")
    assert c["stubs"] == ["s"] and c["properties"] == ["x:int"] and c["bases"] == ["B"]
    assert [(s["name"], s["in_all"]) for s in rows(src, "symbols")] == [("C", True)]
    assert rows("x = " + "(" * 300 + "1" + ")" * 300, "issues") and rows("def (", "issues")


def test_script_facts():
    text = """
class A extends B {
  run(a, {b}, c = 1) { // note
    for (const x of a) { while (x) { if (x && a.b.c.d.e.f) { a.push(7); a.sort() } } }
    return x || '';
  }
  stub() {}
}
const go = (p) => { return p ? 1 : 2 }
"""
    got = script_facts.extract(text, "typescript")
    f = {r["unit"]: r for k, r in got if k == "functions"}
    assert set(f) == {"A.run", "A.stub", "go"} and f["A.run"]["params"][0] == "a" and f["A.run"]["max_nesting"] == 3
    assert f["A.run"]["nested_loops"] == 1 and f["A.run"]["sorts_in_loop"] == 1 and f["A.run"]["chain_depth"] == 5 and f["A.run"]["mutated"] == ["a"]
    assert f["A.run"]["comment_lines"] == 1 and f["A.run"]["short_fallbacks"] == 1 and f["go"]["returns"] == 1
    (c,) = [r for k, r in got if k == "classes"]
    assert c["bases"] == ["B"] and c["methods"] == ["run", "stub"] and c["stubs"] == ["stub"]
    (r,) = [r for k, r in script_facts.extract("pub fn f<T>(mut a: Vec<T>, b: u8) -> u8 { loop { a.sort_by(k); } match b { 1 => 2, _ => 3 } }", "rust") if k == "functions"]
    assert r["params"] == ["a", "b"] and r["sorts_in_loop"] == 1 and r["branches"] == 3 and r["max_nesting"] == 1


def test_lexers(spark):
    text = "import {a} from './x'\nconst b = require('y') // z\n/* c */ export function f() { return 1 }\n"
    f = spark.createDataFrame([("a.js", "javascript", text), ("b.rs", "rust", "use crate::m::T;\npub fn g() {}\nfn h() {}\n")], "file string, language string, text string")
    assert {(x["file"], x["target"]) for x in lexers.imports(f).collect()} == {("a.js", "./x"), ("a.js", "y"), ("b.rs", "crate::m::T")}
    assert {x["name"] for x in lexers.symbols(f).collect()} == {"b", "f", "g"}
    t = {x["file"]: (x["words"], x["rows"]) for x in lexers.tokens(f).collect()}
    assert t["a.js"][0][:4] == ["const", "b", "=", "require"] and t["a.js"][1][0] == 2 and "c" not in t["a.js"][0]


def test_transcripts_and_logs(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"tool": {"file_path": "a.py", "content": "1\\n2\\n3\\n"}}\nnot json\n{"x": [{"file_path": "b.py", "new_string": "q", "start_line": 4}]}\n')
    assert {tuple(x) for x in trees.transcript(spark, str(tmp_path / "t.jsonl")).collect()} == {("a.py", 1, 3), ("b.py", 4, 4)}
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "e.json").write_text('{"kind": "scan", "ts": 5, "branch": "b"}\nbroken\n')
    assert [x["ts"] for x in trees.event_log(spark, str(tmp_path / "log")).collect()] == [5]
    trees.append_events(trees.event_log(spark, str(tmp_path / "log")), str(tmp_path / "log"))
    assert trees.event_log(spark, str(tmp_path / "log")).count() == 2
    (tmp_path / "lodestrata.toml").write_text("a = [")
    assert trees.config(str(tmp_path))[1]


GOLDEN = {
    "pkg/__init__.py": "from pkg.shapes import Shown\n",
    "pkg/shapes.py": textwrap.dedent(
        """
        from abc import ABC, abstractmethod
        import unittest

        class Base:
            size: int
            lost: int

            def area(self):
                return self.size

            def gone(self):
                return 0

        class Child(Base):
            def area(self):
                return 1

            def _secret(self):
                return 2

            def named(self):
                return 3

        def peek(base: Base):
            return base._inner

        class Shown:
            def public(self):
                return 1

        class Cases(unittest.TestCase):
            def helper_of_framework(self):
                return 1

        class Port(ABC):
            @abstractmethod
            def run(self):
                ...

        class A(Port):
            def run(self): return 1
            def a1(self): return 1
            def a2(self): return 1

        class B(Port):
            def run(self): return 2
            def b1(self): return 2
            def b2(self): return 2
        """
    ),
    "pkg/use.py": textwrap.dedent(
        """
        from pkg.shapes import Base, Child, A, B, Port

        def caller(base: Base, other, row: dict):
            base.area()
            other.named()
            base._inner
            return fill(row)

        def fill(record):
            return record["a"], record["b"], record["c"], record["d"]

        class Envious:
            def envy(self, base: Base):
                self.x = 1
                return base.p + base.q + base.r

        def one(host, port, user, word): return host
        def two(host, port, user, word): return port
        def three(host, port, user, word): return user

        def loops(items, session):
            for x in items:
                session.execute(x)
            for y in items:
                helper(y)
            for z in (1, 2):
                for w in range(3):
                    pass

        def helper(y):
            while y:
                y -= 1

        @app.route("/")
        def registered():
            return 1

        @strange
        def unsure():
            return 1

        def plain():
            return caller(1, 2, {}), Envious, A, B, Port, Child
        """
    ),
    "main.py": "from pkg.use import one, two, three, loops\nfrom pkg import shapes\nprint(one, two, three, loops, shapes)\n",
    "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["web/*"] /* all */}}}',
    "web/a.ts": "import { used } from '@/b'\nexport const a = used\n",
    "web/b.ts": "export const used = 1\nexport const unused = 2\n",
}


def test_golden_findings(spark, tmp_path):
    """What has to be reported of a small project, and what mustn't."""
    for name, text in GOLDEN.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    have = {(x["kind"], x["symbol"]) for x in engine.analyze(spark, str(tmp_path), tokens=500, every=True, rules=[("nothing", "absent", "pkg")]).collect()}
    contains = {
        ("method", "Base.gone"), ("method", "Child._secret"), ("property", "Base.lost"), ("function", "plain"), ("unmatched_rule", "nothing"), ("declaration", "unused"), ("inappropriate_intimacy", "peek"), ("implicit_schema", "fill"),
        ("implicit_schema", "caller"), ("feature_envy", "Envious.envy"), ("data_clump", "host,port,user,word"), ("divergent_abstraction", "Port"), ("repeated_iteration", "loops"), ("n_plus_one_call", "loops->execute"), ("nested_loop", "loops"), ("method", "A.a1"),
    }
    absent = {
        ("inappropriate_intimacy", "caller"),
        ("method", "Base.area"), ("method", "Child.area"), ("method", "Child.named"), ("method", "Shown.public"), ("method", "Cases.helper_of_framework"), ("property", "Base.size"), ("function", "registered"), ("function", "unsure"), ("function", "helper"), ("declaration", "used"), ("class", "Cases"), ("class", "Shown"),
    }
    assert contains <= have, contains - have
    assert not absent & have, absent & have


def test_bounded_loops_dont_nest():
    (f,) = rows("def f(xs):\n    for a in (1, 2):\n        for b in range(3):\n            for c in xs:\n                pass\n", "functions")
    assert f["nested_loops"] == 0 and f["loops"] == 1


def test_use_trees():
    assert lexers.use_leaves("crate::a::{self, b::{C, D as E}, f::*}") == ["crate::a", "crate::a::b::C", "crate::a::b::D", "crate::a::f::*"]
    assert trees.jsonc('{"a": "x // y", /* c */ "b": [1, 2,],}') == {"a": "x // y", "b": [1, 2]}
