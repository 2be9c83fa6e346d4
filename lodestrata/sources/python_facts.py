"""Facts of Python sources: one pass of the executors over the files, one typed table for each kind of fact.

A file that can't be parsed, or is nested too deeply, gives an issue and no facts. Units
are functions and methods; a fact inside a nested function belongs to the nested one.
"""

from __future__ import annotations

import ast
import io
import json
import tokenize
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import cut, ship, spread

MAX_DEPTH = 512
CHUNK = 512  # files whose facts a worker holds at once
SCHEMAS = {
    "issues": "issue string",
    "tokens": "words array<string>, rows array<int>, raw array<string>",
    "imports": "target string, level int, symbols array<string>, bindings array<string>, line int, phase string, is_inline boolean",
    "symbols": "name string, kind string, line int, end_line int, decorators array<string>, in_all boolean",
    "names": "name string, n int",
    "attributes": "base string, attr string, unit string, owner string",
    "functions": "unit string, name string, owner string, start_line int, end_line int, params array<string>, is_method boolean, is_nested boolean, decorators array<string>, branches int, cognitive int, max_nesting int, returns int, magic_numbers int, chain_depth int, nested_ifs int, nested_ternaries int, empty_fallbacks int, broad_handlers int, repeated_guards int, assigns map<string,int>, short_fallbacks int, bool_params int, return_arity int, annotated_arity int, mutated array<string>, literal_memberships int, loose_types int, nested_loops int, sorts_in_loop int, loops int, comment_lines int",
    "classes": "name string, start_line int, end_line int, bases array<string>, is_abstract boolean, methods array<string>, stubs array<string>, properties array<string>",
    "members": "class string, method string, attr string",
    "calls": "unit string, target string, base string, line int, is_member boolean, in_loop boolean",
    "keys": "unit string, receiver string, key string",
    "docs": "symbol_path string, kind string, text string, line int",
    "hints": "unit string, name string, type string",
    "passes": "unit string, receiver string, target string, position int",
    "iterations": "unit string, base string, line int, is_change boolean",
}
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)
NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOSE = {"Any", "object", "dict", "list", "Dict", "List", "Mapping", "Callable"}
#: Nodes without children or facts, and nodes that are no fact of a function by themselves.
MARKS = {c for base in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for c in base.__subclasses__()}
PLAIN = {ast.Name, ast.arg, ast.arguments, ast.Expr, ast.Tuple, ast.List, ast.keyword, ast.Starred, ast.Pass}
USES = {"hints", "iterations", "passes", "calls", "keys", "attributes", "members"}
MUTATORS = {"append", "extend", "insert", "remove", "pop", "clear", "update", "add", "discard", "setdefault", "sort", "reverse", "popitem"}


def _index(tree: ast.AST) -> tuple[list[ast.AST], int]:
    """All nodes but operators and contexts, each given its children as ``kids``; and how deep they are nested."""
    deep, todo, nodes = 0, [(tree, 1)], []
    while todo:
        n, d = todo.pop()
        nodes.append(n)
        n.kids = kids = []
        for f in n._fields:
            v = getattr(n, f, None)
            for x in v if type(v) is list else (v,):
                if isinstance(x, ast.AST):
                    if type(x) in MARKS:
                        deep = max(deep, d + 1)
                    else:
                        kids.append(x)
        deep = max(deep, d)
        todo += [(c, d + 1) for c in kids]
    return nodes, deep


def _bounded(loop: ast.AST) -> bool:
    """Whether a loop's length is written in the source: a literal, a range of constants, or a view of one."""

    def fixed(x: ast.AST) -> bool:
        if isinstance(x, (ast.Tuple, ast.List, ast.Set, ast.Dict, ast.Constant)):
            return True
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
            if x.func.id == "range":
                return all(isinstance(a, ast.Constant) for a in x.args)
            if x.func.id in ("enumerate", "reversed", "sorted", "zip", "list", "tuple"):
                return bool(x.args) and any(map(fixed, x.args)) if x.func.id == "zip" else bool(x.args) and fixed(x.args[0])
        return isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("items", "keys", "values") and fixed(x.func.value)

    return isinstance(loop, (ast.For, ast.AsyncFor)) and fixed(loop.iter)


def _name(n: ast.AST | None) -> str:
    if type(n) is ast.Name:
        return n.id
    if type(n) is ast.Attribute and type(n.value) in (ast.Name, ast.Attribute):
        return f"{_name(n.value)}.{n.attr}"
    return ast.unparse(n) if n is not None else ""


def _own(fn: ast.AST):
    """Nodes of a function without those of functions inside, each with its nesting and how many loops of open length are around it."""
    todo = [(c, 0, 0, fn) for c in reversed(fn.kids)]
    while todo:
        n, nest, loop, parent = todo.pop()
        yield n, nest, loop, parent
        if isinstance(n, (*DEFS, ast.Lambda, ast.ClassDef)):
            continue
        is_elif = isinstance(n, ast.If) and isinstance(parent, ast.If) and parent.orelse == [n]
        deeper = nest + (isinstance(n, NESTS) and not is_elif)
        todo += [(c, deeper, loop + (isinstance(n, LOOPS) and not _bounded(n)), n) for c in reversed(n.kids)]


def _chain(n: ast.AST) -> int:
    k = 0
    while isinstance(n, ast.Attribute):
        k, n = k + 1, n.value
    return k


def _stub(fn: ast.AST) -> bool:
    body = [x for x in fn.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, (str, type(...))))]
    return not body or (len(body) == 1 and (isinstance(body[0], ast.Pass) or (isinstance(body[0], ast.Raise) and "NotImplementedError" in _name(body[0].exc))))


def _tuple_arity(a: ast.AST | None) -> int:
    if isinstance(a, ast.Subscript) and _name(a.value) in ("tuple", "Tuple", "typing.Tuple") and isinstance(a.slice, ast.Tuple):
        return len(a.slice.elts)
    return 0


def function_facts(fn, own: list, unit: str, owner: str, nested: bool, comments: Counter) -> dict:
    args = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]
    params = [a.arg for a in args]
    f = Counter()
    assigns, mutated, guards = Counter(), set(), {}
    notes = [a.annotation for a in args if a.annotation] + ([fn.returns] if fn.returns else [])
    for n, nest, loop, parent in own:
        if type(n) in PLAIN:
            continue
        if isinstance(n, BRANCHES):
            f["branches"] += 1
        if isinstance(n, ast.BoolOp):
            f["branches"] += len(n.values) - 1
            f["cognitive"] += 1
        if isinstance(n, (ast.If, ast.IfExp, *LOOPS, ast.ExceptHandler, ast.Match)):
            is_elif = isinstance(n, ast.If) and isinstance(parent, ast.If) and parent.orelse == [n]
            f["cognitive"] += 1 if is_elif else 1 + nest
        if isinstance(n, NESTS):
            f["max_nesting"] = max(f["max_nesting"], nest + 1)
        if isinstance(n, ast.If):
            if not n.orelse and len(n.body) == 1 and isinstance(n.body[0], ast.If) and not n.body[0].orelse:
                f["nested_ifs"] += 1
            if len(n.body) == 1 and isinstance(n.body[0], (ast.Raise, ast.Return)):
                test = ast.dump(n.test)
                f["repeated_guards"] += test in guards and n.lineno - guards[test] <= 5
                guards[test] = n.lineno
        if isinstance(n, ast.IfExp) and isinstance(parent, ast.IfExp):
            f["nested_ternaries"] += 1
        if isinstance(n, ast.Return):
            f["returns"] += 1
            if isinstance(n.value, ast.Tuple):
                f["return_arity"] = max(f["return_arity"], len(n.value.elts))
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool) and n.value not in (0, 1, 2):
            f["magic_numbers"] += 1
        if isinstance(n, ast.Attribute) and not isinstance(parent, ast.Attribute):
            f["chain_depth"] = max(f["chain_depth"], _chain(n))
        if isinstance(n, ast.ExceptHandler):
            broad = n.type is None or _name(n.type) in ("Exception", "BaseException")
            f["broad_handlers"] += broad
            last = n.body[-1]
            empty = isinstance(last, ast.Pass) or (isinstance(last, ast.Return) and _name(last.value) in ("", "None", "[]", "{}", "''", "False", "0"))
            f["empty_fallbacks"] += empty
        if isinstance(n, ast.BoolOp) and isinstance(n.op, ast.Or) and isinstance(n.values[-1], ast.Constant) and isinstance(n.values[-1].value, str) and len(n.values[-1].value) <= 1:
            f["short_fallbacks"] += 1
        if isinstance(n, ast.Compare) and isinstance(n.ops[0], (ast.In, ast.NotIn)) and isinstance(n.comparators[0], (ast.Tuple, ast.List, ast.Set)) and n.comparators[0].elts and all(isinstance(x, ast.Constant) for x in n.comparators[0].elts):
            f["literal_memberships"] += 1
        if isinstance(n, LOOPS) and not _bounded(n):
            f["loops"] += 1
            f["nested_loops"] += loop > 0
        if isinstance(n, ast.Call):
            called = n.func.attr if isinstance(n.func, ast.Attribute) else _name(n.func)
            f["sorts_in_loop"] += bool(loop) and called in ("sort", "sorted")
            if isinstance(n.func, ast.Attribute) and called in MUTATORS and isinstance(n.func.value, ast.Name):
                mutated.add(n.func.value.id)
        for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AugAssign, ast.AnnAssign)) else []):
            for x in ast.walk(t):
                if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                    assigns[x.id] += 1
            if isinstance(t, (ast.Subscript, ast.Attribute)) and isinstance(t.value, ast.Name):
                mutated.add(t.value.id)
    out = {k: int(f[k]) for k in ("branches", "cognitive", "max_nesting", "returns", "magic_numbers", "chain_depth", "nested_ifs", "nested_ternaries", "empty_fallbacks", "broad_handlers", "repeated_guards", "short_fallbacks", "return_arity", "literal_memberships", "nested_loops", "sorts_in_loop", "loops")}
    return out | {
        "unit": unit, "name": fn.name, "owner": owner, "start_line": fn.lineno, "end_line": fn.end_lineno, "params": params, "is_method": bool(owner), "is_nested": nested, "decorators": [_name(d) for d in fn.decorator_list],
        "assigns": dict(assigns), "mutated": sorted(mutated), "bool_params": sum(_name(a.annotation) == "bool" for a in args), "annotated_arity": _tuple_arity(fn.returns), "loose_types": sum(_name(a).split("[")[0].split(".")[-1] in LOOSE and "[" not in _name(a) or _name(a) == "Any" for a in notes),
        "comment_lines": comments[id(fn)],
    }


def extract(text: str, kinds: frozenset[str] = frozenset(SCHEMAS)) -> list[tuple[str, dict]]:
    """(kind, row) of a source text, of the given kinds and issues."""
    try:
        tree = ast.parse(text)
        nodes, deep = _index(tree)
        if deep > MAX_DEPTH:
            return [("issues", {"issue": f"nested more than {MAX_DEPTH} deep"})]
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as e:
        return [("issues", {"issue": f"{type(e).__name__}: {e}"})]
    out: list[tuple[str, dict]] = []

    def add(table: str, /, **row) -> None:
        if table in kinds:
            out.append((table, row))

    uses = not kinds.isdisjoint(USES)
    spans = sorted(((n.lineno, -n.end_lineno, id(n)) for n in nodes if isinstance(n, DEFS)))
    comments: Counter = Counter()  # a comment line belongs to the innermost function around it
    for line in sorted({t.start[0] for t in tokens if t.type == tokenize.COMMENT}) if "functions" in kinds else ():
        around = [i for s, e, i in spans if s <= line <= -e]
        if around:
            comments[around[-1]] += 1
    exported = {x.value for n in tree.body if isinstance(n, ast.Assign) and any(_name(t) == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)) for x in n.value.elts if isinstance(x, ast.Constant)}
    skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
    local: dict[int, set[str]] = {}
    names, units = Counter(), {}

    def visit(n: ast.AST, path: str, owner: str, nested: bool, guard: bool, inside: bool) -> None:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            made = [a.asname or a.name.split(".")[0] for a in n.names]
            phase = "type_only" if guard else "runtime"
            if isinstance(n, ast.ImportFrom):
                add("imports", target=n.module or "", level=n.level, symbols=[a.name for a in n.names], bindings=made, line=n.lineno, phase=phase, is_inline=inside)
            else:
                for a, b in zip(n.names, made):
                    add("imports", target=a.name, level=0, symbols=[], bindings=[b], line=n.lineno, phase=phase, is_inline=inside)
            return
        if isinstance(n, DEFS):
            unit = f"{path}.{n.name}" if path else n.name
            if not path:
                add("symbols", name=n.name, kind="function", line=n.lineno, end_line=n.end_lineno, decorators=[_name(d) for d in n.decorator_list], in_all=n.name in exported)
            own = list(_own(n)) if uses or "functions" in kinds or "tokens" in kinds else []
            if "functions" in kinds:
                add("functions", **function_facts(n, own, unit, owner, nested, comments))
            bound = {a.arg for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]} | {x.id for x, *_ in own if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
            for line in range(n.lineno, n.end_lineno + 1):
                local[line] = bound
            units[unit] = n
            for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                if a.annotation and "hints" in kinds:
                    add("hints", unit=unit, name=a.arg, type=_name(a.annotation).strip("'\""))
            for m, _, loop, _ in own if uses else ():
                if type(m) in PLAIN:
                    continue
                made = isinstance(m, ast.Assign) and isinstance(m.value, ast.Call) and _name(m.value.func)
                if made and made.split(".")[-1][:1].isupper() or isinstance(m, ast.AnnAssign):
                    for t in m.targets if isinstance(m, ast.Assign) else [m.target]:
                        if isinstance(t, (ast.Name, ast.Attribute)):
                            add("hints", unit=owner if owner and _name(t).startswith("self.") else unit, name=_name(t), type=made if isinstance(m, ast.Assign) else _name(m.annotation).strip("'\""))
                if isinstance(m, (ast.For, ast.AsyncFor)) and isinstance(m.iter, (ast.Name, ast.Attribute)):
                    add("iterations", unit=unit, base=_name(m.iter), line=m.lineno, is_change=False)
                if isinstance(m, ast.Call) and isinstance(m.func, ast.Attribute) and m.func.attr in MUTATORS:
                    add("iterations", unit=unit, base=_name(m.func.value), line=m.lineno, is_change=True)
                if isinstance(m, ast.Call):
                    for i, a in enumerate(m.args):
                        if isinstance(a, ast.Name):
                            add("passes", unit=unit, receiver=a.id, target=m.func.attr if isinstance(m.func, ast.Attribute) else _name(m.func), position=i)
                    add("calls", unit=unit, target=m.func.attr if isinstance(m.func, ast.Attribute) else _name(m.func), base=_name(m.func.value) if isinstance(m.func, ast.Attribute) else "", line=m.lineno, is_member=isinstance(m.func, ast.Attribute), in_loop=loop > 0)
                if isinstance(m, ast.Subscript) and isinstance(m.value, ast.Name) and isinstance(m.slice, ast.Constant) and isinstance(m.slice.value, str):
                    add("keys", unit=unit, receiver=m.value.id, key=m.slice.value)
                if isinstance(m, ast.Attribute):
                    add("attributes", base=_name(m.value), attr=m.attr, unit=unit, owner=owner)
                    if owner and _name(m.value) in ("self", "cls"):
                        add("members", **{"class": owner, "method": n.name, "attr": m.attr})
            doc = ast.get_docstring(n) if "docs" in kinds else None
            if doc:
                add("docs", symbol_path=unit, kind="function", text=doc, line=n.lineno)
            for c in n.body:
                visit(c, unit, "", True, guard, True)
            return
        if isinstance(n, ast.ClassDef):
            methods = [m for m in n.body if isinstance(m, DEFS)]
            bases = [_name(b) for b in n.bases]
            abstract = any(b.split(".")[-1] in ("ABC", "Protocol") for b in bases) or any("abstract" in _name(d) for m in methods for d in m.decorator_list)
            props = [f"{m.target.id}:{_name(m.annotation)}" for m in n.body if isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name)]
            add("classes", name=n.name, start_line=n.lineno, end_line=n.end_lineno, bases=bases, is_abstract=abstract, methods=[m.name for m in methods], stubs=[m.name for m in methods if _stub(m)], properties=props)
            if not path:
                add("symbols", name=n.name, kind="class", line=n.lineno, end_line=n.end_lineno, decorators=[_name(d) for d in n.decorator_list], in_all=n.name in exported)
            if ast.get_docstring(n):
                add("docs", symbol_path=n.name, kind="class", text=ast.get_docstring(n), line=n.lineno)
            for c in n.body:
                visit(c, f"{path}.{n.name}" if path else n.name, n.name, nested, guard, inside)
            return
        if isinstance(n, ast.Assign) and not path:
            for t in n.targets:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    add("symbols", name=t.id, kind="variable", line=n.lineno, end_line=n.end_lineno, decorators=[], in_all=t.id in exported)
        held = guard or (isinstance(n, ast.If) and "TYPE_CHECKING" in _name(n.test))
        for c in n.kids:
            if not isinstance(c, ast.expr):  # an expression holds no statement
                visit(c, path, owner, nested, held, inside)

    for n in tree.body:
        visit(n, "", "", False, False, False)
    for n in nodes if "names" in kinds else ():
        if isinstance(n, ast.Name):
            names[n.id] += 1
        elif isinstance(n, ast.Attribute):
            names[n.attr] += 1
        elif isinstance(n, (*DEFS, ast.ClassDef)):
            names[n.name] += 1  # a declaration counts, as that of a variable does
    for k, v in names.items():
        add("names", name=k, n=v)
    if ast.get_docstring(tree):
        add("docs", symbol_path="", kind="module", text=ast.get_docstring(tree), line=1)
    if "tokens" not in kinds:
        return out
    docs = {(m.value.lineno, m.value.end_lineno) for n in nodes if isinstance(n, (ast.Module, ast.ClassDef, *DEFS)) for m in n.body[:1] if isinstance(m, ast.Expr) and isinstance(m.value, ast.Constant) and isinstance(m.value.value, str)}
    quiet = {x for s, e in docs for x in range(s, e + 1)} | {x for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for x in range(n.lineno, n.end_lineno + 1)}
    kept = [t for t in tokens if t.type not in skip and t.start[0] not in quiet]
    add("tokens", words=["\0local" if t.type == tokenize.NAME and t.string in local.get(t.start[0], ()) else t.string for t in kept], rows=[t.start[0] for t in kept], raw=[t.string for t in kept])
    return out


def facts(files: DataFrame, kinds: list[str] | None = None) -> dict[str, DataFrame]:
    """A typed table of each kind, with ``file`` first, from files (file, text); ``kinds``: of these only."""
    ship(files.sparkSession)
    wanted = frozenset(kinds or SCHEMAS)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), CHUNK):
                part = b.iloc[i : i + CHUNK]
                yield pd.DataFrame([(f, k, json.dumps(r)) for f, t in zip(part["file"], part["text"]) for k, r in extract(t or "", wanted) if k in wanted], columns=["file", "kind", "row"])

    rows = spread(files.where("language = 'python'").select("file", "text")).mapInPandas(run, "file string, kind string, row string")
    rows = cut(rows)
    return {k: rows.where(F.col("kind") == k).select("file", F.from_json("row", s).alias("r")).select("file", "r.*") for k, s in SCHEMAS.items() if k in wanted}
