"""Module identity and the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalar import normal_path


def with_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with the longest root (root) that their path begins with, "" by default."""
    r = roots.select(F.col("root").alias("__r"))
    hit = files.select("file").join(r, (F.col("__r") == "") | F.startswith("file", F.concat("__r", F.lit("/"))))
    best = hit.groupBy("file").agg(F.max_by("__r", F.length("__r")).alias("root"))
    return files.join(best, "file", "left").withColumn("root", F.coalesce("root", F.lit("")))


def module_name(file: Column, language: Column, root: Column) -> Column:
    """Dotted for Python, a path for other languages; a package's index file has the package's name."""
    inner = F.when(root != "", F.substr(file, F.length(root) + 2)).otherwise(file)
    stem = F.regexp_replace(inner, r"\.[A-Za-z]+$", "")
    py = F.regexp_replace(F.replace(stem, F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")
    js = F.regexp_replace(stem, "(^|/)index$", "")
    rs = F.regexp_replace(F.regexp_replace(stem, "^src/", ""), "(^|/)(mod|lib)$", "")
    return F.when(language == "python", py).when(language == "rust", rs).otherwise(js)


def modules(files: DataFrame) -> DataFrame:
    """(file, language, module): names that collide take the path in the workspace (TypeScript), then the first file wins."""
    named = files.withColumn("module", module_name(F.col("file"), F.col("language"), F.col("root")))
    n = F.count("*").over(Window.partitionBy("language", "module"))
    full = module_name(F.col("file"), F.col("language"), F.lit(""))
    named = named.withColumn("module", F.when((F.col("language") == "typescript") & (n > 1), full).otherwise(F.col("module")))
    first = F.row_number().over(Window.partitionBy("module").orderBy("file"))
    return named.withColumn("__k", first).where("__k = 1 and module <> ''").select("file", "language", "module")


def resolve_python(target: Column, level: Column, module: Column, is_index: Column) -> Column:
    """The absolute module of a relative import: a dot is the package, each more one package up."""
    parts = F.split(module, "[.]")
    up = level - F.when(is_index, 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    return F.when(level == 0, target).otherwise(F.concat_ws(".", F.when(base != "", base), F.when(target != "", target)))


def resolve_script(target: Column, module: Column, file: Column) -> Column:
    """The module of a path import; others stay as written."""
    folder = F.when(file.rlike(r"(^|/)index\.[a-z]+$"), module).otherwise(F.regexp_replace(module, "/?[^/]*$", ""))
    path = normal_path(F.concat(folder, F.lit("/"), F.regexp_replace(target, r"\.(js|ts|jsx|tsx|mjs)$", "")))
    return F.when(F.startswith(target, F.lit(".")), F.regexp_replace(F.regexp_replace(path, "^/", ""), "(^|/)index$", "")).otherwise(target)


def resolve_rust(target: Column, module: Column) -> Column:
    """crate::, self:: and super:: paths; of others the crate's name."""
    path = F.replace(target, F.lit("::"), F.lit("/"))
    parent = F.regexp_replace(module, "/?[^/]*$", "")
    return (
        F.when(F.startswith(path, F.lit("crate/")), F.substring(path, 7, 1 << 20)).when(F.startswith(path, F.lit("self/")), F.concat_ws("/", module, F.substring(path, 6, 1 << 20)))
        .when(F.startswith(path, F.lit("super/")), F.concat_ws("/", F.when(parent != "", parent), F.substring(path, 7, 1 << 20))).otherwise(F.split(path, "/")[0])
    )


def aliased(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Imports (file, target) with path aliases (pattern, replacement; one ``*`` each) applied: the longest pattern that fits wins."""
    p = paths.select("pattern", "replacement", F.substring_index("pattern", "*", 1).alias("pre"), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise("").alias("post"))
    fits = F.when(F.contains("pattern", F.lit("*")), F.startswith("target", F.col("pre")) & F.endswith("target", F.col("post"))).otherwise(F.col("target") == F.col("pattern"))
    star = F.substr("target", F.length("pre") + 1, F.length("target") - F.length("pre") - F.length("post"))
    to = F.when(F.contains("pattern", F.lit("*")), F.replace("replacement", F.lit("*"), star)).otherwise(F.col("replacement"))
    hit = imports.join(p, fits).groupBy("file", "target").agg(F.max_by(to, F.length("pattern")).alias("__to"))
    return imports.join(hit, ["file", "target"], "left").withColumn("target", F.coalesce("__to", "target")).drop("__to")


def edges(imports: DataFrame, mods: DataFrame) -> DataFrame:
    """(src, dst, symbol, line, phase, is_inline, is_external, containment, literal) from resolved imports (src, target, symbols, ...).

    A symbol that is a submodule of the target gives an edge to it, else to the target; a target
    that no module has is an external node.
    """
    m = mods.select(F.col("module").alias("__m"))
    one = imports.withColumn("symbol", F.explode_outer("symbols"))
    sub = one.join(m, F.col("__m") == F.concat_ws(".", "target", "symbol"), "left").withColumnRenamed("__m", "sub")
    got = sub.join(m, F.col("__m") == F.col("target"), "left")
    dst = F.coalesce("sub", "target")
    got = got.withColumn("dst", dst).withColumn("is_external", F.col("sub").isNull() & F.col("__m").isNull())
    return got.select("src", "dst", F.when(F.col("sub").isNull(), F.col("symbol")).alias("symbol"), "line", "phase", "is_inline", "is_external", F.startswith("dst", F.concat("src", F.lit("/"))).alias("containment"), F.col("target").alias("literal")).where("src <> dst")


def edge_stats(e: DataFrame) -> DataFrame:
    return e.agg(F.count_if(~F.col("is_external")).alias("internal"), F.count_if(F.col("is_external")).alias("external"))
