"""Scalar functions over columns, all built from Spark's own expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_type(x: Column) -> Column:
    """What stands before the first bracket of a type's text."""
    return F.trim(F.regexp_extract(x, r"^[^\[<]*", 0))


def identifiers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def has_identifier(x: Column, name: Column | str) -> Column:
    return F.array_contains(identifiers(x), name)


def last_segment(x: Column, sep: str = ".") -> Column:
    return F.element_at(F.split(x, re.escape(sep)), -1)


def dotted_prefix(x: Column, p: Column) -> Column:
    """Whether ``p`` is ``x`` or one of its parent packages."""
    return (x == p) | F.startswith(x, F.concat(p, F.lit(".")))


def dotted_parents(x: Column) -> Column:
    parts = F.split(x, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def normal_path(x: Column) -> Column:
    """A path without ``.`` and ``..`` parts; those above the root are dropped."""
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    empty = F.expr("cast(array() as array<string>)")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.when(F.startswith(x, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(parts, empty, step), "/"))


def tuple_arity(x: Column) -> Column:
    """Elements at the top level of ``tuple[...]``; 0 for other types."""
    inner = F.regexp_extract(x, r"(?i)^tuple\[(.*)\]$", 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("commas"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("[", "(", "{"), 1).when(c.isin("]", ")", "}"), -1).otherwise(0)
        return F.struct(depth.cast("int").alias("depth"), (acc["commas"] + F.when((c == ",") & (acc["depth"] == 0), 1).otherwise(0)).cast("int").alias("commas"))

    return F.when(F.trim(inner) == "", 0).otherwise(F.aggregate(F.split(inner, ""), zero, step)["commas"] + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(dot(a, b) / d)


def size_ratio(a: Column, b: Column) -> Column:
    return ratio(F.least(a, b).cast("double"), F.greatest(a, b).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """0 for a zero denominator."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def glob_regex(glob: str, crosses: bool = False) -> str:
    """A glob as a whole-string regular expression; ``crosses``: ``*`` and ``?`` also match ``/``."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += ".*" if crosses else "[^/]*"
        elif c == "?":
            out += "." if crosses else "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
        elif c == "{" and "}" in glob[i + 1 :]:
            end = glob.index("}", i + 1)
            out, i = out + "(?:" + "|".join(glob_regex(x, crosses)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(x: Column, globs: list[str], crosses: bool = False) -> Column:
    return x.rlike("|".join(f"(?:{glob_regex(g, crosses)})" for g in globs)) if globs else F.lit(False)
