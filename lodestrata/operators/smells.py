"""Design smells: thresholds over unit facts, and aggregates over members, fields and edges.

Threshold rules are data: one pass over the units checks all of them and gives a row for
each that fires, in one shape: kind, unit, metric, threshold, severity, action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import connected_components, coupling


@dataclass(frozen=True)
class Rule:
    kind: str
    metric: str  # an expression over the units' columns
    threshold: float
    severity: str = "warning"
    where: str = "true"
    at_least: bool = False  # >= instead of >
    critical: float | None = None  # severity above this
    on: bool = True


ACTIONS = {"critical": "must_fix", "warning": "warning", "info": "advisory"}

FUNCTION_RULES = [
    Rule("high_complexity", "branches + 1", 10, critical=20, on=False),
    Rule("high_cognitive_complexity", "cognitive", 15, critical=30),
    Rule("long_function", "end_line - start_line + 1", 50, on=False),
    Rule("narrating_code", "ceil(100 * comment_lines / greatest(end_line - start_line + 1, 1))", 30, "info", "comment_lines >= 5"),
    Rule("heavy_nested_function", "end_line - start_line + 1", 15, where="is_nested"),
    Rule("deep_nesting", "max_nesting", 4),
    Rule("long_parameter_list", "size(params) - cast(coalesce(get(params, 0), '') in ('self', 'cls') as int)", 5, on=False),
    Rule("too_many_returns", "returns", 4, on=False),
    Rule("magic_numbers", "magic_numbers", 0, "info", on=False),
    Rule("message_chain", "chain_depth", 4),
    Rule("unnecessary_nested_if", "nested_ifs", 0, "info"),
    Rule("nested_ternary", "nested_ternaries", 0),
    Rule("defensive_fallback", "empty_fallbacks", 2, where="broad_handlers >= 1", at_least=True, on=False),
    Rule("redundant_validation", "repeated_guards", 0, "info", "not exists(map_values(assigns), n -> n > 1)", on=False),
    Rule("magic_string_default", "short_fallbacks", 0),
    Rule("boolean_blindness", "bool_params", 2),
    Rule("tuple_packing", "greatest(return_arity, annotated_arity)", 2, "info"),
    Rule("mutated_parameter", "size(array_except(array_intersect(params, mutated), array('self', 'cls')))", 0),
    Rule("reassigned_parameter", "size(array_intersect(params, map_keys(assigns)))", 0, "info", on=False),
    Rule("literal_membership", "literal_memberships", 0, "info"),
    Rule("loose_typing", "loose_types", 0),
    Rule("nested_loop", "nested_loops", 0, on=False),
    Rule("sort_in_loop", "sorts_in_loop", 0),
]

CLASS_RULES = [
    Rule("large_class", "size(methods)", 20, on=False),
    Rule("refused_bequest", "size(stubs)", 2, where="size(bases) > 0 and not is_abstract and 2 * size(stubs) >= size(methods)", at_least=True),
]


def threshold_smells(units: DataFrame, rules: list[Rule], unit: str = "unit", disabled: set[str] = frozenset(), actions: dict[str, str] | None = None, every: bool = False) -> DataFrame:
    """(kind, unit, metric, threshold, severity, action) of every rule that fires; ``every``: those off by default too."""
    rows = []
    for r in rules:
        if r.kind in disabled or not (r.on or every):
            continue
        m = F.expr(r.metric).cast("double")
        fires = F.expr(r.where) & ((m >= r.threshold) if r.at_least else (m > r.threshold))
        sev = F.when(m > r.critical, "critical").otherwise(r.severity) if r.critical is not None else F.lit(r.severity)
        rows.append(F.when(fires, F.struct(F.lit(r.kind).alias("kind"), m.alias("metric"), F.lit(float(r.threshold)).alias("threshold"), sev.alias("severity"), F.lit(r.severity).alias("default_severity"))))
    found = units.select(F.col(unit).alias("unit"), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).select("unit", "f.*")
    return found.withColumn("action", action_of(found, actions or {})).select("kind", "unit", "metric", "threshold", "severity", "action")


def action_of(found: DataFrame, actions: dict[str, str]) -> Column:
    """The severity's action; a kind's own action counts only while the finding has the kind's default severity."""
    out = F.when(F.col("severity") == "critical", "must_fix").when(F.col("severity") == "warning", "warning").otherwise("advisory")
    for kind, a in actions.items():
        out = F.when((F.col("kind") == kind) & (F.col("severity") == F.col("default_severity")), a).otherwise(out)
    return out


def split_values(assigned: DataFrame, least: int = 2) -> DataFrame:
    """(unit, name, n) from (unit, name, n): locals that are assigned ``least`` times or more."""
    return assigned.where(F.col("n") >= max(2, least))


def cohesion(members: DataFrame, owner: str, member: str, attr: str) -> DataFrame:
    """(owner, n_members, n_components): members of an owner are joined by what they share."""
    m = members.select(F.col(owner).alias("o"), F.col(member).alias("m"), F.col(attr).alias("t")).where("t is not null").distinct()
    ids = m.select("o", "m").distinct().withColumn("id", F.xxhash64("o", "m"))
    low = m.groupBy("o", "t").agg(F.min(F.xxhash64("o", "m")).alias("b"))
    edges = m.join(low, ["o", "t"]).select(F.xxhash64("o", "m").alias("a"), "b")
    comp = connected_components(edges)
    named = ids.join(comp, ids.id == comp.node, "left").select("o", "m", F.coalesce("component", "id").alias("c"))
    return named.groupBy(F.col("o").alias(owner)).agg(F.count("*").alias("n_members"), F.countDistinct("c").alias("n_components"))


def clumps(fields: DataFrame, unit: str, field: str, size: int, least: int, first: int = 10) -> DataFrame:
    """(fields, n): sets of ``size`` fields that ``least`` units or more have, among the ``first`` fields of each unit in order."""
    f = fields.select(F.col(unit).alias("u"), F.col(field).alias("f")).where("f is not null").distinct()
    f = f.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("f"))).where(F.col("k") <= first)
    combos = f.select("u", F.array("f").alias("fields"), F.col("f").alias("last"))
    for _ in range(size - 1):
        combos = combos.join(f.select("u", F.col("f").alias("nf")), "u").where("nf > last").select("u", F.concat("fields", F.array("nf")).alias("fields"), F.col("nf").alias("last"))
    return combos.groupBy("fields").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def merged_clumps(found: DataFrame, shared: int = 3) -> DataFrame:
    """(fields, n) of clumps joined where they have ``shared`` fields or more in common: all their fields, and the most units of one."""
    c = found.withColumn("id", F.xxhash64("fields"))
    f = c.select("id", F.explode("fields").alias("f"))
    pairs = f.join(f.select("f", F.col("id").alias("other")), "f").where("id < other").groupBy("id", "other").agg(F.count("*").alias("k")).where(F.col("k") >= shared)
    comp = connected_components(pairs, "id", "other")
    named = c.join(comp, c.id == comp.node, "left").withColumn("g", F.coalesce("component", "id"))
    return named.groupBy("g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"), F.max("n").alias("n")).drop("g")


def divergence(sets: DataFrame, group: str, unit: str, items: str, extra: int = 2) -> DataFrame:
    """(group, a, b, shared, total): groups of exactly two units whose sets overlap by less than a third, each with ``extra`` items of its own."""
    pair = sets.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(items).alias("i")))).alias("p")).where("size(p) = 2")
    a, b = F.col("p")[0], F.col("p")[1]
    out = pair.select(group, a["u"].alias("a"), b["u"].alias("b"), F.size(F.array_intersect(a["i"], b["i"])).alias("shared"), F.size(F.array_union(a["i"], b["i"])).alias("total"), F.size(F.array_except(a["i"], b["i"])).alias("x"), F.size(F.array_except(b["i"], a["i"])).alias("y"))
    return out.where(F.col("x") >= extra).where(F.col("y") >= extra).where("3 * shared < total").select(group, "a", "b", "shared", "total")


def envy(uses: DataFrame, unit: str, target: str, own: str, least: int = 3) -> DataFrame:
    """(unit, target, n, own_n): units that use another target most, ``least`` times or more and over twice as often as their own, which they use at least once."""
    n = uses.groupBy(F.col(unit).alias("u"), F.col(target).alias("t"), F.col(own).alias("o")).agg(F.count("*").alias("n"))
    mine = n.where("t = o").select("u", F.col("n").alias("own_n"))
    top = n.where("t <> o").withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "t"))).where("k = 1")
    return top.join(mine, "u").where(F.col("n") >= least).where("n > 2 * own_n and own_n >= 1").select(F.col("u").alias("unit"), F.col("t").alias("target"), "n", "own_n")


def intimacy(uses: DataFrame) -> DataFrame:
    """(unit, class, names) of receivers of a known class whose ``_x`` (not ``__x``) is read, from (unit, class, name)."""
    return uses.where(F.col("name").rlike("^_[^_]")).groupBy("unit", "class").agg(F.array_sort(F.collect_set("name")).alias("names"))


def repeated(calls: DataFrame, key: list[str], order: str, is_change: Column) -> DataFrame:
    """(key, n): a key's events that are followed by another without a change between; changes are events of the same first key column."""
    w = Window.partitionBy(key[0]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = calls.withColumn("run", F.sum(F.when(is_change, 1).otherwise(0)).over(w)).where(~is_change)
    return runs.groupBy(*key, "run").agg(F.count("*").alias("n")).where("n > 1").groupBy(*key).agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


def calls_in_loops(calls: DataFrame, local: DataFrame, words: list[str]) -> DataFrame:
    """(unit, target) of member calls in loops, direct or through a local helper, that sound like access to something outside."""
    outside = F.lit(False)
    for w in words:
        outside |= F.lower(F.col("target")).contains(w)
    looping = calls.where("in_loop")
    direct = looping.where(F.col("is_member") & outside).select("unit", "target")
    helper = local.select(F.col("unit").alias("helper"), F.col("name"))
    via = looping.join(helper, looping.target == helper.name).select(F.col("unit").alias("u"), "helper")
    reached = via.join(calls.where(F.col("is_member") & outside).select(F.col("unit").alias("helper"), "target"), "helper").select(F.col("u").alias("unit"), "target")
    return direct.union(reached).distinct()


def implicit_schema(keys: DataFrame, calls: DataFrame, least: int = 4, rounds: int = 4, exempt: DataFrame | None = None) -> DataFrame:
    """(unit, receiver, keys): receivers read by ``least`` distinct string keys or more, keys of callees' parameters included.

    ``keys``: (unit, receiver, key). ``calls``: (unit, receiver, callee, param), a receiver that is passed on.
    """
    known = keys.select("unit", "receiver", "key").distinct()
    for _ in range(rounds):
        down = calls.join(known.select(F.col("unit").alias("callee"), F.col("receiver").alias("param"), "key"), ["callee", "param"]).select("unit", "receiver", "key")
        known = known.union(down).distinct()
    if exempt is not None:
        known = known.join(exempt, ["unit", "receiver"], "left_anti")
    return known.groupBy("unit", "receiver").agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") >= least)


def hazards(edges: DataFrame, internal: int, floor: int = 4, percent: int = 15) -> DataFrame:
    """(node, metric, threshold, severity): nodes with many dependents, against ``floor`` and a share of the internal nodes."""
    t = max(floor, internal * percent // 100)
    n = coupling(edges).where(F.col("fan_in") >= t)
    return n.select("node", F.col("fan_in").alias("metric"), F.lit(t).alias("threshold"), F.when(F.col("fan_in") >= 2 * t, "critical").otherwise("warning").alias("severity"))


def god_nodes(edges: DataFrame, internal: int, total: int = 25, each: int = 4, floor: int = 4, percent: int = 15) -> DataFrame:
    """(node, fan_in, fan_out): coupled both ways, and not a hazard already."""
    c = coupling(edges).where((F.col("fan_in") + F.col("fan_out") >= total) & (F.col("fan_in") >= each) & (F.col("fan_out") >= each))
    return c.join(hazards(edges, internal, floor, percent).select("node"), "node", "left_anti")


def looping_helpers(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, unit) of functions with a loop that calls a function of the same file that loops itself, from calls (file, unit, target, in_loop) and functions (file, unit, name, loops)."""
    helper = functions.where("loops > 0").groupBy("file", F.col("name").alias("target")).agg(F.min("unit").alias("__lo"), F.max("unit").alias("__hi"))  # one of the two is another unit, if there is one
    return calls.where("in_loop").select("file", "unit", "target").distinct().join(helper, ["file", "target"]).where("__lo <> unit or __hi <> unit").select("file", "unit").distinct()


def fill_spans(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Findings (file, line, end_line, ...) whose end isn't known end with the unit (file, start_line, end_line) that begins on their line."""
    u = units.groupBy("file", F.col("start_line").alias("line")).agg(F.max("end_line").alias("__e"))
    known = F.coalesce("end_line", F.lit(0)) > F.col("line")
    return findings.join(u, ["file", "line"], "left").withColumn("end_line", F.when(known, F.col("end_line")).otherwise(F.coalesce("__e", "end_line"))).drop("__e").select(*findings.columns)


def ranked(findings: DataFrame) -> DataFrame:
    """Findings in order of action, severity and metric."""
    a = F.when(F.col("action") == "must_fix", 0).when(F.col("action") == "warning", 1).when(F.col("action") == "advisory", 2).otherwise(3)
    s = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.orderBy(a, s, F.desc("metric"), "kind", "unit")


def totals(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("n"))
