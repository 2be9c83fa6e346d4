"""Unit facts of JavaScript, TypeScript and Rust from their tokens: functions, metrics, classes.

There is no grammar here: functions are found by their heads and their bodies by matching
braces, so facts are those that tokens decide (branches, nesting, returns, loops, chains,
parameters). They come in the same columns as those of Python, empty where a fact needs types.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestrata.runtime import cut, ship, spread
from lodestrata.sources.python_facts import CHUNK, MUTATORS, SCHEMAS

TOKEN = re.compile(r"""[ \t\r]*(?:(?P<w>[A-Za-z_$][\w$]*)|(?P<l>\n)|(?P<s>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<n>\b\d[\w.]*)|(?P<c>//[^\n]*|/\*.*?\*/)|(?P<o>=>|->|::|&&|\|\||\?\?|\?\.|[{}()\[\];,.:?=<>!+\-*/%&|^~@#]))""", re.S)
NOT_NAMES = {"if", "for", "while", "switch", "catch", "match", "return", "function", "else", "do", "with", "super", "loop", "await", "typeof"}
LOOPS, NESTS = {"for", "while", "loop", "do"}, {"if", "for", "while", "loop", "do", "switch", "match", "try", "catch"}
BRANCHES, MEMBER, CHANGES = {"if", "for", "while", "loop", "case", "catch"}, {".", "?."}, MUTATORS | {"push", "splice", "shift", "unshift", "set", "delete"}
METRICS = dict.fromkeys(["branches", "cognitive", "max_nesting", "returns", "magic_numbers", "chain_depth", "nested_loops", "sorts_in_loop", "loops", "short_fallbacks", "broad_handlers", "empty_fallbacks", "nested_ifs", "nested_ternaries", "repeated_guards", "bool_params", "return_arity", "annotated_arity", "literal_memberships", "loose_types"], 0)
SORTS = {"rust": lambda w: w.startswith("sort"), "other": lambda w: w == "sort"}


def _lex(text: str) -> tuple[list[tuple[str, str, int]], dict[int, int]]:
    """(type, text, line) of the tokens, and comment lines by where they begin."""
    out, comments, line = [], {}, 1
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "l":
            line += 1
            continue
        x = m[kind]
        if kind == "c":
            comments[line] = x.count("\n") + 1
        else:
            out.append((kind, x, line))
        if kind in "cs":
            line += x.count("\n")
    return out, comments


def _close(t: list, i: int) -> int:
    """The place of what closes the bracket at ``i``, or the end."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, 0
    want, own = pairs[t[i][1]], t[i][1]
    for j in range(i, len(t)):
        depth += (t[j][1] == own) - (t[j][1] == want)
        if not depth:
            return j
    return len(t) - 1


def _params(t: list, a: int, b: int) -> list[str]:
    out, depth, fresh = [], 0, True
    for kind, x, _ in t[a + 1 : b]:
        if depth == 0 and x == ",":
            fresh = True
        elif depth == 0 and fresh and kind == "w" and x not in ("mut", "ref", "public", "private", "readonly"):
            out.append(x)
            fresh = False
        depth += x in ("(", "{", "[", "<")
        depth -= x in (")", "}", "]", ">")
    return out


def _heads(t: list, rust: bool) -> list[tuple[str, int, int, int, int]]:
    """(name, start, params from, params to, body from) of the functions with a braced body."""
    out = []
    for i, (kind, x, _) in enumerate(t):
        name, p = None, None
        if x in ("fn", "function") and kind == "w":
            j = i + 1 + (t[i + 1][1] == "*" if i + 1 < len(t) else 0)
            if j < len(t) and t[j][0] == "w":
                name, p = t[j][1], j + 1
                if p < len(t) and t[p][1] == "<":
                    while p < len(t) and t[p][1] != "(":
                        p += 1
        elif not rust and x == "=>":
            j = i - 1
            if j >= 0 and t[j][1] == ")":
                depth = 0
                while j >= 0:
                    depth += (t[j][1] == ")") - (t[j][1] == "(")
                    if not depth:
                        break
                    j -= 1
                if j >= 2 and t[j - 1][1] == "=" and t[j - 2][0] == "w" and i + 1 < len(t) and t[i + 1][1] == "{":
                    out.append((t[j - 2][1], j - 2, j, i - 1, i + 1))
            continue
        elif not rust and kind == "w" and x not in NOT_NAMES and i + 1 < len(t) and t[i + 1][1] == "(" and (i == 0 or t[i - 1][1] in ("{", "}", ";", "async", "static", "get", "set")):
            j = _close(t, i + 1)
            if j + 1 < len(t) and t[j + 1][1] == "{":
                out.append((x, i, i + 1, j, j + 1))
            continue
        if name and p < len(t) and t[p][1] == "(":
            end = _close(t, p)
            k = end
            while k < len(t) and t[k][1] not in ("{", ";"):
                k += 1
            if k < len(t) and t[k][1] == "{":
                out.append((name, i, p, end, k))
    return out


def extract(text: str, language: str, kinds: frozenset[str] = frozenset(("functions", "classes", "calls"))) -> list[tuple[str, dict]]:
    """(kind, row) of a source text, of the given kinds."""
    t, comments = _lex(re.sub(r"'([A-Za-z_]\w*)(?!')\b", r"\1", text) if language == "rust" else text)  # without lifetimes
    rust, out = language == "rust", []
    heads = [(n, s, a, b, c, _close(t, c)) for n, s, a, b, c in _heads(t, rust)]
    classes = []
    for i, (kind, x, line) in enumerate(t):
        if x == "class" and kind == "w" and i + 1 < len(t) and t[i + 1][0] == "w":
            j = i
            while j < len(t) and t[j][1] != "{":
                j += 1
            if j < len(t):
                e = _close(t, j)
                classes.append((t[i + 1][1], j, e))
                if "classes" not in kinds:
                    continue
                base = [t[k + 1][1] for k in range(i, j - 1) if t[k][1] == "extends"]
                own = [h for h in heads if j < h[1] < e and sum(t[k][1] == "{" for k in range(j, h[1])) - sum(t[k][1] == "}" for k in range(j, h[1])) == 1]
                out.append(("classes", {"name": t[i + 1][1], "start_line": line, "end_line": t[e][2], "bases": base, "is_abstract": i > 0 and t[i - 1][1] == "abstract", "methods": [h[0] for h in own], "stubs": [h[0] for h in own if h[5] == h[4] + 1], "properties": []}))
    if kinds.isdisjoint(("functions", "calls")):
        return out
    t.append(("", "", 0))  # the next of the last
    for name, s, a, b, c, e in heads:
        inner = [(h[1], h[5]) for h in heads if h[1] > c and h[5] < e]
        body = [k for k in range(c + 1, e) if not any(x <= k <= y for x, y in inner)] if inner else range(c + 1, e)
        owner = next((n for n, x, y in reversed(classes) if x < s < y), "")
        f, stack, pending, assigns, mutated, chain = METRICS.copy(), [], "", {}, set(), 0
        unit = f"{owner}.{name}" if owner else name
        nest = loops = branches = deepest = longest = 0  # of the open blocks, how many nest and how many are loops
        for k in body:
            kind, x, line = t[k]
            if kind == "w":
                if x in NESTS:
                    if x != "if" or t[k - 1][1] != "else":
                        f["cognitive"] += 1 + nest if x != "try" else 0
                        if x in LOOPS:
                            f["nested_loops"] += loops > 0
                            f["loops"] += 1
                    pending = x
                if x in BRANCHES:
                    branches += 1
                elif x == "return":
                    f["returns"] += 1
                after = t[k + 1][1]
                if after == "(":
                    if x not in NOT_NAMES:
                        member = t[k - 1][1] in MEMBER
                        base = t[k - 2][1] if member and k > 1 else ""
                        f["sorts_in_loop"] += member and loops > 0 and SORTS["rust" if rust else "other"](x)
                        if member and x in CHANGES:
                            mutated.add(base)
                        if "calls" in kinds:
                            out.append(("calls", {"unit": unit, "target": x, "base": base, "line": line, "is_member": member, "in_loop": loops > 0}))
                elif after == "=" and (k + 2 >= len(t) - 1 or t[k + 2][1] not in ("=", ">")) and t[k - 1][1] not in MEMBER:
                    assigns[x] = assigns.get(x, 0) + 1
            elif kind == "o":
                if x in MEMBER:
                    chain += 1
                    longest = max(longest, chain)
                    continue
                chain = 0
                if x == "{":
                    stack.append(pending)
                    nest += pending in NESTS
                    loops += pending in LOOPS
                    deepest, pending = max(deepest, nest), ""
                elif x == "}":
                    if stack:
                        x = stack.pop()
                        nest -= x in NESTS
                        loops -= x in LOOPS
                elif x == ";":
                    pending = ""
                elif x in ("&&", "||", "??", "?"):
                    branches += 1
                    f["short_fallbacks"] += x in ("||", "??") and t[k + 1][0] == "s" and len(t[k + 1][1]) <= 3
                elif x == "=>":
                    branches += rust
            else:
                chain = 0
                f["magic_numbers"] += kind == "n" and x not in ("0", "1", "2", "0.0", "1.0")
        if "functions" not in kinds:
            continue
        f["branches"], f["max_nesting"], f["chain_depth"] = branches, deepest, longest
        start, end = t[s][2], t[e][2]
        nested = any(h[4] < s and e < h[5] for h in heads)
        out.append(("functions", f | {"unit": unit, "name": name, "owner": owner, "start_line": start, "end_line": end, "params": _params(t, a, b), "is_method": bool(owner), "is_nested": nested, "decorators": [], "assigns": assigns, "mutated": sorted(mutated), "comment_lines": sum(n for line, n in comments.items() if start <= line <= end)}))
    return out


def facts(files: DataFrame, kinds: tuple[str, ...] = ("functions", "classes", "calls")) -> dict[str, DataFrame]:
    """Tables ``functions``, ``classes`` and ``calls``, with ``file`` first, from files (file, language, text); ``kinds``: of these only."""
    ship(files.sparkSession)
    wanted = frozenset(kinds)

    form = StructType.fromDDL(", ".join(["file string", "kind string", *(f"{k} struct<{', '.join(x.replace(' ', ':', 1) for x in SCHEMAS[k].split(', '))}>" for k in kinds)]))
    types = [to_arrow_type(x.dataType) for x in form]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                found = [(f, k, r) for f, g, t in zip(*(part.column(c).to_pylist() for c in ("file", "language", "text"))) for k, r in extract(t or "", g, wanted)]
                for _, k, r in found:
                    if k == "functions":
                        r["assigns"] = list(r["assigns"].items())
                cols = [[x[0] for x in found], [x[1] for x in found], *([r if n == k else None for _, n, r in found] for k in kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=form.names)

    rows = cut(spread(files.where("language <> 'python'").select("file", "language", "text")).mapInArrow(run, form))
    return {k: rows.where(F.col("kind") == k).select("file", f"{k}.*") for k in kinds}
