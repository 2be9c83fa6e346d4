"""Boundary rules over an edge table: forbidden edges, and rules that match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalar import dotted_parents, glob_regex
from lodestrata.runtime import cut


def with_patterns(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(label, from_pat, to_pat, from_re, to_re) of (label, from, to) rules; a rule without ``*?[{`` is a dotted prefix."""

    def pattern(p: str) -> str:
        import re

        return glob_regex(p, crosses=True) if set(p) & set("*?[{") else f"^{re.escape(p)}([.].*)?$"

    return spark.createDataFrame([(n, a, b, pattern(a), pattern(b)) for n, a, b in rules], "label string, from_pat string, to_pat string, from_re string, to_re string")


def matches(name: Column, pattern: Column) -> Column:
    """A module name or its path form against a pattern."""
    return F.rlike(name, pattern) | F.rlike(F.replace(name, F.lit("."), F.lit("/")), pattern)


def _plain(pattern: Column) -> Column:
    return ~F.rlike(pattern, F.lit(r"[*?\[{]"))


BROADCAST_RULES = 10_000


def violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, label) of the edges (src, dst, literal) that a rule forbids; a rule's target may match the node or the import as written.

    A rule whose source is a dotted prefix meets its edges by a hash join on the source's parents,
    however many rules there are; only the rules with a glob for a source, by nature to be tried on
    every edge, are a nested loop, in blocks of at most ``BROADCAST_RULES``.
    """
    to = matches(F.col("dst"), F.col("to_re")) | matches(F.col("literal"), F.col("to_re"))
    plain = rules.where(_plain(F.col("from_pat"))).select(F.col("from_pat").alias("__p"), "to_re", "label")
    out = edges.withColumn("__p", F.explode(F.array_union(dotted_parents(F.col("src")), F.array(F.replace("src", F.lit("."), F.lit("/")))))).join(plain, "__p").where(to).select("src", "dst", "label")
    globs = cut(rules.where(~_plain(F.col("from_pat"))).withColumn("__b", F.floor(F.monotonically_increasing_id() / BROADCAST_RULES)))
    for b in [r[0] for r in globs.select("__b").distinct().collect()]:  # blocks of rules
        out = out.union(edges.join(F.broadcast(globs.where(F.col("__b") == b)), matches(F.col("src"), F.col("from_re")) & to).select("src", "dst", "label"))
    return out


def unmatched(rules: DataFrame, modules: DataFrame) -> DataFrame:
    """Rules (label, from_pat) whose source no module (module) matches."""
    return rules.join(modules, matches(F.col("module"), F.col("from_re")), "left_anti").select("label", "from_pat")
