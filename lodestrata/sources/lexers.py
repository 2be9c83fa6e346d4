"""Token-level facts of JavaScript, TypeScript and Rust, by Spark's own string functions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import ship

TOKEN = r"""[A-Za-z_$][A-Za-z0-9_$]*|\d[\d_.xa-fA-F]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|=>|->|::|[-+*/%=!<>&|^?:.,;(){}\[\]~@#]"""
JS_IMPORT = r"""(?:import|export)\s+(?:type\s+)?(?:[\w$*{}\s,]+\s+from\s+)?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)"""
RUST_USE = r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);"
JS_LOCAL, RUST_LOCAL = r"(?m)^[ \t]+(?:const|let|var)\s+([A-Za-z_$][\w$]*)", r"\blet\s+(?:mut\s+)?([A-Za-z_]\w*)"  # declarations inside a body
DECLARED = {
    "javascript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "typescript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
    "rust": r"(?m)^\s*pub(?:\([^)]*\))?\s+(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|trait|const|static|type|mod)\s+([A-Za-z_]\w*)",
}


def bare(text: Column) -> Column:
    """A text without its comments; lines stay where they are."""
    blocks = F.regexp_replace(text, r"/\*(?:[^*\n]|\*(?!/))*\*/[ \t]*", "")
    return F.regexp_replace(blocks, r"(?m)(^|[^:'\"`])//[^\n]*", "$1")


def tokens(files: DataFrame) -> DataFrame:
    """(file, language, words, rows, raw); import lines give no token. In ``words`` names that the file binds by itself are ``\\0local``."""
    lines = F.split(bare(F.col("text")), "\n")
    said = lambda x: F.when(F.ltrim(x).rlike(r"^(import|use|pub use)\b"), F.expr("cast(array() as array<string>)")).otherwise(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))
    bound = F.when(F.col("language") == "rust", F.regexp_extract_all("text", F.lit(RUST_LOCAL), F.lit(1))).otherwise(F.regexp_extract_all("text", F.lit(JS_LOCAL), F.lit(1)))
    base = files.where("language <> 'python'").select("file", "language", F.transform(lines, said).alias("w"), F.array_distinct(bound).alias("bound"))
    at = F.transform("w", lambda x, i: F.transform(x, lambda _: i + 1))
    raw = base.select("file", "language", F.flatten("w").alias("raw"), F.flatten(at).alias("rows"), "bound")
    words = F.transform("raw", lambda x: F.when(F.array_contains("bound", x), "\0local").otherwise(x))
    return raw.select("file", "language", words.alias("words"), "rows", "raw")


JS_NAMES = r"""(?:import|export)\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s+['"]([^'"]+)['"]"""


def imports(files: DataFrame) -> DataFrame:
    """(file, language, target, symbols) as written; a Rust use tree gives a row for each of its leaves' modules.

    Symbols are the names that are taken from the target: ``default`` for a default import, ``*`` for
    all of it. Side-effect imports and ``require`` have none.
    """
    ship(files.sparkSession)
    kind = files.schema["file"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [(k, x, y) for k, (g, t) in enumerate(zip(part.column("language").to_pylist(), part.column("text").to_pylist())) if t is not None for x, y in imported(t, g)]
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("file").take(at), part.column("language").take(at), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["file", "language", "target", "symbols"])

    return files.where("language <> 'python'").select("file", "language", "text").mapInArrow(run, f"file {kind}, language string, target string, symbols array<string>")


# the same as Spark's own patterns, whose classes are of ASCII and whose lines end as Java's do
_LINE = r"(?:^|(?<=[\n\u0085\u2028\u2029])|(?<=\r)(?!\n))(?!\Z)"
_BLOCK, _REST = re.compile(r"/\*(?:[^*\n]|\*(?!/))*\*/[ \t]*"), re.compile(f"({_LINE}|[^:'\"`])//[^\n]*", re.A)
_NAMES, _IMPORT, _USE = re.compile(JS_NAMES, re.A), re.compile(JS_IMPORT, re.A), re.compile(RUST_USE.replace("(?m)^", _LINE), re.A)
_INNER, _TYPE, _AS, _BRACES = re.compile(r"\{([^}]*)\}"), re.compile(r"^\s*type\s+", re.A), re.compile(r"\s+as\s+[^\n\r]*(?=(?:\r\n|\n|\r)?\Z)", re.A), re.compile(r"\{[^}]*\}")


def imported(text: str, language: str) -> list[tuple[str, list[str]]]:
    """(target, symbols) of the imports of one text."""
    t = _REST.sub(r"\1", _BLOCK.sub("", text)) if "/*" in text or "//" in text else text
    if language == "rust":
        return [(x, [x.split("::")[-1]]) for x in sorted({x for use in _USE.findall(t) for x in use_leaves(use)})]
    said = [(m[2], named(m[1])) for m in _NAMES.finditer(t)]
    seen = {x for x, _ in said}
    return said + [(x, []) for x in dict.fromkeys(m[1] or m[2] or "" for m in _IMPORT.finditer(t)) if x not in seen]


def named(x: str) -> list[str]:
    """What an import clause takes: names in braces as they are called at their source, a default, everything."""
    m, outer = _INNER.search(x), _BRACES.sub("", x)
    inner = [_AS.sub("", _TYPE.sub("", y).strip(" ")) for y in m[1].split(",")] if m else []
    whole = ["*"] if "*" in outer else ["default"] if re.sub(r"[\s,]", "", outer, flags=re.A) else []
    return whole + [y for y in inner if y]


def use_leaves(tree: str) -> list[str]:
    """The paths of a use tree: ``a::{b, c::{self, d as e}}`` is a::b, a::c and a::c::d."""
    tree = re.sub(r"\s+as\s+\w+", "", tree)
    out, held, at = [], [""], ""
    for x in re.sub(r"\s+", "", tree):
        if x == "{":
            held.append(held[-1] + at)
            at = ""
        elif x in ",}":
            if at:
                out.append(held[-1] + at)
            at = ""
            if x == "}" and len(held) > 1:
                held.pop()
        else:
            at += x
    out += [held[-1] + at] if at else []
    return sorted({re.sub("(::)?self$", "", x) for x in out} - {""})


def symbols(files: DataFrame) -> DataFrame:
    """(file, language, name) of top-level declarations; of Rust only public ones."""
    out = None
    for language, pattern in DECLARED.items():
        s = files.where(F.col("language") == language).select("file", "language", F.explode(F.regexp_extract_all(bare(F.col("text")), F.lit(pattern), F.lit(1))).alias("name"))
        out = s if out is None else out.union(s)
    return out.distinct()
