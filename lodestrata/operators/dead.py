"""Dead code: declared symbols without references, with tiers of evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalar import matches_any
from lodestrata.operators.graph import closure
from lodestrata.runtime import cut


def inbound_usage(edges: DataFrame) -> DataFrame:
    """(module, used, star, n_edges) from (source, target, symbol, is_test): what others use of a module; tests don't count."""
    e = edges.where(~F.col("is_test"))
    return e.groupBy(F.col("target").alias("module")).agg(
        F.array_sort(F.collect_set(F.when(F.col("symbol") != "*", F.col("symbol")))).alias("used"), F.max(F.col("symbol") == "*").alias("star"), F.count("*").alias("n_edges")
    )


def dead_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, symbol, kind, confidence) of the symbols that nothing uses.

    ``symbols``: (module, symbol, kind, private, exported, local_uses, registered, entry). Private,
    exported, registered, locally used symbols and those of entry modules are skipped; so are all
    of a module that is star-imported. Confidence: high if other symbols of the module are used,
    medium if it is imported without any use, low (dropped) if nothing imports it.
    """
    candidates = symbols.where("not private and not exported and not registered and not entry and local_uses <= 1")
    use = inbound_usage(edges)
    named = edges.where("not is_test and symbol <> '*'").select(F.col("target").alias("module"), "symbol").distinct()
    starred = use.where("star").select("module")
    left = candidates.join(named, ["module", "symbol"], "left_anti").join(starred, "module", "left_anti")
    tier = F.when(F.coalesce("n_edges", F.lit(0)) == 0, "low").when(F.size("used") > 0, "high").otherwise("medium")
    return left.join(use, "module", "left").select("module", "symbol", "kind", tier.alias("confidence")).where("confidence <> 'low'")


def unused_bindings(bindings: DataFrame, uses: DataFrame) -> DataFrame:
    """Import bindings (file, name, line, ...) at run time that the file's names (file, name, n) don't have."""
    used = uses.where("n > 0").select("file", "name")
    return bindings.where("phase = 'runtime' and not is_inline and not exported and not is_package_index").join(used, ["file", "name"], "left_anti")


def hierarchy(bases: DataFrame) -> DataFrame:
    """(class, ancestor) from (class, base), through any number of bases; in a cycle a class isn't its own ancestor."""
    return closure(bases, "class", "base").where("src <> dst").select(F.col("src").alias("class"), F.col("dst").alias("ancestor"))


def overrides(methods: DataFrame, bases: DataFrame) -> DataFrame:
    """Methods (class, method) that an ancestor has too."""
    up = hierarchy(bases).join(methods.select(F.col("class").alias("ancestor"), "method"), "ancestor").select("class", "method").distinct()
    return methods.join(up, ["class", "method"], "left_semi")


def unused_methods(methods: DataFrame, bases: DataFrame, typed_uses: DataFrame, self_uses: DataFrame, name_uses: DataFrame, exposed: DataFrame) -> DataFrame:
    """(class, method, confidence) of the methods without evidence of use.

    ``methods``: (class, method, private, decorated, dunder). Overrides, methods of exposed classes,
    decorated ones and dunders are skipped. Uses: typed (class, method), which also hold for
    descendants; self (class, method); unresolved by name (method, n). A method whose name has an
    unresolved use counts as used if it is the only class's with that name, else it is low and dropped.
    """
    up = hierarchy(bases)
    typed = typed_uses.select("class", "method").union(up.join(typed_uses.select(F.col("class").alias("ancestor"), "method"), "ancestor").select("class", "method"))
    own = self_uses.select("class", "method").union(up.join(self_uses, "class").select(F.col("ancestor").alias("class"), "method"))
    left = methods.where("not decorated and not dunder").join(overrides(methods, bases), ["class", "method"], "left_anti")
    left = left.join(exposed.select("class"), "class", "left_anti").join(typed.distinct(), ["class", "method"], "left_anti").join(own.distinct(), ["class", "method"], "left_anti")
    left = left.join(name_uses.select("method", "n"), "method", "left")
    tier = F.when(F.coalesce("n", F.lit(0)) > 0, "low").when(F.col("private"), "high").otherwise("medium")
    return left.select("class", "method", tier.alias("confidence")).where("confidence <> 'low'")


@dataclass(frozen=True)
class LanguageRules:
    """What a language's conventions keep alive; a project's own lists come on top of them."""

    entry_stems: frozenset = frozenset()
    entry_globs: tuple = ()
    registering: frozenset = frozenset()  # last parts of decorators that hand a symbol to a framework
    neutral: frozenset = frozenset()  # decorators that say nothing about use
    entry_bases: frozenset = frozenset()  # classes that a framework calls by inheritance

    def plus(self, **own) -> LanguageRules:
        return LanguageRules(**{f: type(getattr(self, f))([*getattr(self, f), *own.get(f, ())]) for f in self.__dataclass_fields__})


LANGUAGE_RULES = {
    "python": LanguageRules(
        frozenset({"main", "__main__", "conftest", "setup", "manage", "wsgi", "asgi"}), ("**/tests/**", "**/test_*.py", "tests/**", "test_*.py"),
        frozenset({"route", "get", "post", "put", "delete", "patch", "command", "group", "task", "shared_task", "fixture", "register", "receiver", "hookimpl", "listener", "errorhandler", "on", "event"}),
        frozenset({"staticmethod", "classmethod", "property", "setter", "getter", "deleter", "cache", "lru_cache", "cached_property", "wraps", "dataclass", "abstractmethod", "override", "final", "overload", "contextmanager", "asynccontextmanager", "total_ordering", "singledispatch", "unique"}),
        frozenset({"TestCase", "NodeVisitor", "NodeTransformer", "Thread", "Enum", "IntEnum", "StrEnum", "NamedTuple", "TypedDict", "Protocol", "BaseModel", "Model"}),
    ),
    "javascript": LanguageRules(frozenset({"index", "main", "app", "server"}), ("**/*.config.*", "**/*.test.*", "**/*.spec.*"), frozenset({"Component", "Injectable", "Controller", "Module"}), frozenset(), frozenset({"Component", "PureComponent", "HTMLElement"})),
    "typescript": LanguageRules(frozenset({"index", "main", "app", "server"}), ("**/*.config.*", "**/*.test.*", "**/*.spec.*", "**/*.d.ts"), frozenset({"Component", "Injectable", "Controller", "Module"}), frozenset(), frozenset({"Component", "PureComponent", "HTMLElement"})),
    "rust": LanguageRules(frozenset({"main", "lib", "build"}), ("tests/**", "benches/**", "examples/**")),
}


def decorator_class(decorators: Column, language: Column, rules: dict[str, LanguageRules] = LANGUAGE_RULES) -> Column:
    """``live`` if a decorator registers the symbol, ``unknown`` if one isn't known, else ``neutral``."""
    last = F.transform(decorators, lambda d: F.element_at(F.split(F.regexp_replace(d, r"\(.*$", ""), "[.]"), -1))
    out = F.lit("neutral")
    for name, r in rules.items():
        live, known = (F.array(*map(F.lit, sorted(x))).cast("array<string>") for x in (r.registering, r.registering | r.neutral))
        found = F.when(F.arrays_overlap(last, live), "live").when(F.size(F.array_except(last, known)) > 0, "unknown").otherwise("neutral")
        out = F.when(language == name, found).otherwise(out)
    return out


def is_entry(file: Column, language: Column, rules: dict[str, LanguageRules] = LANGUAGE_RULES) -> Column:
    """Whether a file starts things by its language's conventions."""
    stem, out = F.regexp_extract(file, r"([^/]*?)(\.[A-Za-z]+)?$", 1), F.lit(False)
    for name, r in rules.items():
        out |= (language == name) & (stem.isin(sorted(r.entry_stems)) | matches_any(file, list(r.entry_globs)))
    return out


def entry_classes(bases: DataFrame, roots: list[str]) -> DataFrame:
    """(file, class) that inherit from one of ``roots`` inside their file, over any number of classes of it; from (file, class, base)."""
    b = bases.select("file", F.col("class"), F.element_at(F.split("base", "[.]"), -1).alias("base")).distinct()
    b = cut(b)
    known = front = cut(b.where(F.col("base").isin(roots)).select("file", "class").distinct())
    while not front.isEmpty():  # merged, as a broadcast would send the front, or all that is known, through the driver
        step = b.join(front.select("file", F.col("class").alias("base")).hint("merge"), ["file", "base"]).select("file", "class").distinct()
        front = cut(step.join(known.hint("merge"), ["file", "class"], "left_anti"))
        known = cut(known.union(front))
    return known


def evidence(attributes: DataFrame, hints: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    """What shows that a member is used, from attribute reads (file, unit, owner, base, attr), hints (file, unit, name, type) and classes (class).

    typed: (class, method) read from a receiver whose type is one of ``classes``, or from a class itself;
    self: (class, method) read from ``self`` or ``cls``; names: (method, n) read from anything else.
    """
    a = attributes.select("file", "unit", "owner", "base", "attr")
    own = a.where("base in ('self', 'cls') and owner <> ''").select(F.col("owner").alias("class"), F.col("attr").alias("method")).distinct()
    kinds = classes.select("class").distinct()
    h = hints.select("file", F.col("unit").alias("__u"), F.col("name").alias("__n"), F.element_at(F.split(F.regexp_extract("type", r"^[\w.]*", 0), "[.]"), -1).alias("__t")).distinct()
    near = (a["file"] == h["file"]) & (a["base"] == h["__n"]) & ((a["unit"] == h["__u"]) | (a["owner"] == h["__u"]))
    at = a.where("base not in ('self', 'cls')").join(h, near, "left").select(F.coalesce("__t", "base").alias("class"), F.col("attr").alias("method"))
    typed = at.join(kinds, "class", "left_semi").distinct()
    names = at.join(kinds, "class", "left_anti").groupBy("method").agg(F.count("*").alias("n"))
    return {"typed": typed, "self": own, "names": names}


def exposed(classes: DataFrame, reexports: DataFrame, bases: DataFrame) -> DataFrame:
    """(class) that are part of an interface: in ``__all__`` (class, in_all), re-exported by a package index (symbol), and the ancestors of these."""
    out = classes.where("in_all").select("class").union(classes.join(reexports.select(F.col("symbol").alias("class")), "class", "left_semi").select("class")).distinct()
    return out.union(hierarchy(bases).join(out, "class").select(F.col("ancestor").alias("class"))).distinct()


def unused_properties(properties: DataFrame, bases: DataFrame, seen: dict[str, DataFrame], shown: DataFrame, managed: DataFrame) -> DataFrame:
    """(class, property, confidence) of typed fields (class, property) without evidence of use; classes that a framework manages (class) are left out."""
    m = properties.join(managed.select("class"), "class", "left_anti").select("class", F.col("property").alias("method"), F.startswith("property", F.lit("_")).alias("private"), F.lit(False).alias("decorated"), F.lit(False).alias("dunder"))
    return unused_methods(m, bases, seen["typed"], seen["self"], seen["names"], shown).withColumnRenamed("method", "property")


def ranked(findings: DataFrame) -> DataFrame:
    """Findings of high confidence first."""
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return findings.orderBy(order, "module", "symbol")
