"""Reports: policy, selection, ranking, limits, summaries and signatures over one findings table.

Findings have (pillar, kind, file, symbol, line, end_line, metric, threshold, severity, action).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalar import matches_any

PILLARS = ["dead_code", "cycle", "boundary", "clone", "smell"]
LEVELS = ["must_fix", "warning", "advisory", "info"]


def level(action: Column | str) -> Column:
    a = F.col(action) if isinstance(action, str) else action
    return F.array_position(F.array(*map(F.lit, LEVELS)), a).cast("int")


def with_policy(findings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A pillar's own action for its findings; smells only while at their kind's default severity, and info stays for cycles and clones."""
    out = F.col("action")
    for pillar, a in defaults.items():
        fits = F.col("pillar") == pillar
        if pillar == "smell":
            fits &= F.col("severity") == F.col("default_severity")
        if pillar in ("cycle", "clone"):
            fits &= F.col("action") != "info"
        out = F.when(fits, a).otherwise(out)
    return findings.withColumn("action", out)


def select_pillars(findings: DataFrame, chosen: list[str]) -> DataFrame:
    return findings.where(F.col("pillar").isin(chosen)) if chosen else findings


def output_glob(findings: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    """Findings whose path, path below ``root``, or a whole component of it matches a pattern."""
    inner = F.when(F.startswith("file", F.lit(root)), F.substring("file", len(root) + 1, 1 << 30)).otherwise(F.col("file"))
    parts = F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, patterns)))
    return findings.where(matches_any(F.col("file"), patterns) | matches_any(inner, patterns) | parts)


def best(findings: DataFrame, by: list[str], k: int, order: list[Column | str]) -> DataFrame:
    """The first ``k`` of each group in a total order, with ``place``."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def top_per_pillar(findings: DataFrame, k: int = 5) -> DataFrame:
    return best(findings, ["pillar"], k, [level("action"), F.desc("metric"), F.asc("file"), F.asc("symbol")])


def top_per_kind(findings: DataFrame, k: int = 3) -> DataFrame:
    return best(findings, ["kind"], k, [level("action"), F.desc("metric"), F.asc("file"), F.asc("symbol")])


def summary(findings: DataFrame, n: int) -> DataFrame:
    """(place, pillar, kind, symbol) of the first ``n``, pillars in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, PILLARS)), F.col("pillar"))
    order = [place, level("action"), F.desc("metric"), F.asc("file"), F.asc("symbol")]
    first = findings.orderBy(*order).limit(n)  # then only n rows meet in one task
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "pillar", "kind", "symbol")


def health(findings: DataFrame) -> DataFrame:
    """(pillar, total, must_fix, warning)."""
    return findings.groupBy("pillar").agg(F.count("*").alias("total"), F.count_if(F.col("action") == "must_fix").alias("must_fix"), F.count_if(F.col("action") == "warning").alias("warning"))


def per_rule(findings: DataFrame, samples: int = 2) -> DataFrame:
    """(kind, n, threshold, paths): counts, and the first sample paths of each rule."""
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.max("threshold").alias("threshold"), F.slice(F.array_sort(F.collect_set("file")), 1, samples).alias("paths"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """(file, items): an editor's diagnostics; 1 is an error, 4 a hint."""
    item = F.struct(F.coalesce("line", F.lit(0)).alias("line"), level("action").alias("severity"), "kind", "symbol")
    return findings.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("items"))


def gate(findings: DataFrame, most: str) -> bool:
    """Whether any finding has an action of level ``most`` or graver."""
    return not findings.where(level("action") <= LEVELS.index(most) + 1).limit(1).isEmpty()


def signature(findings: DataFrame) -> DataFrame:
    """(signature): one number for all places and kinds, in no order; equal findings count each."""
    total = F.sum(F.xxhash64("file", "line", "kind").cast("decimal(38,0)"))
    return findings.agg(F.coalesce(F.pmod(total, F.lit(2**61 - 1).cast("decimal(38,0)")), F.lit(0)).cast("long").alias("signature"))


def to_json(findings: DataFrame) -> DataFrame:
    """(json): a row a finding, without empty fields; an unknown line is left out."""
    cols = [F.when(F.col(c) != 0, F.col(c)).alias(c) if c in ("line", "end_line") else F.col(c) for c in findings.columns]
    return findings.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json"))


def compact(meta: DataFrame) -> DataFrame:
    return meta.drop(*[c for c in meta.columns if c.startswith("total")])


def glossary(findings: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(findings.select("kind").distinct(), "kind", "left_semi")


def comments(clones: DataFrame) -> DataFrame:
    """(id, file, start, end, marker): one row for each occurrence, with a marker that makes posting it twice harmless."""
    rows = clones.select("id", F.explode("places").alias("p")).select("id", "p.*")
    return rows.withColumn("marker", F.sha2(F.concat_ws("|", "id", "file", "start", "end"), 256))


def terminal(findings: DataFrame, k: int = 5) -> str:
    """A text with a section for each pillar; only ``k`` rows of each come to the driver."""
    rows = top_per_pillar(findings, k).orderBy("pillar", "place").collect()
    out = []
    for p in PILLARS:
        own = [r for r in rows if r["pillar"] == p]
        if own:
            out.append(f"{p} ({len(own)})")
            out += [f"  [{r['action']}] {r['kind']} {r['file']}" + (f":{r['line']}" if r["line"] else "") + f" {r['symbol'] or ''}".rstrip() for r in own]
    return "\n".join(out)


WEIGHTS = {"cycle": 5, "dead_code": 4, "clone": 3, "boundary": 2, "smell": 1}


def quality_score(counts: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(state, score) from (pillar, state, n): weighted sums by whether findings are new, existing or inherent."""
    w = counts.sparkSession.createDataFrame(list((weights or WEIGHTS).items()), "pillar string, w int")
    return counts.join(F.broadcast(w), "pillar").groupBy("state").agg(F.sum(F.col("w") * F.col("n")).alias("score"))


def paired_deltas(runs: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """(task, run, deltas) of the pairs for which both variants ran, b less a."""
    x, y = runs.where(F.col("variant") == a), runs.where(F.col("variant") == b)
    j = x.select("task", "run", *[F.col(m).alias(f"a_{m}") for m in metrics]).join(y.select("task", "run", *[F.col(m).alias(f"b_{m}") for m in metrics]), ["task", "run"])
    return j.select("task", "run", *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(m) for m in metrics])


def variant_averages(runs: DataFrame, metrics: list[str], tested: str | None = None) -> DataFrame:
    """(variant, n, means rounded to 3); ``tested``: a flag without which a run doesn't count for its column of that name."""
    means = [F.round(F.avg(m), 3).alias(m) for m in metrics]
    rate = [F.round(F.avg(F.when(F.col(tested).isNotNull(), F.col(tested).cast("double"))), 3).alias(tested)] if tested else []
    return runs.groupBy("variant").agg(F.count("*").alias("n"), *means, *rate)


def overhead(runs: DataFrame, a: str, b: str, cost: str) -> DataFrame:
    """(total_a, total_b, percent): how much more variant ``b`` costs in all."""
    total = lambda v: F.sum(F.when(F.col("variant") == v, F.col(cost)))
    t = runs.agg(total(a).alias("total_a"), total(b).alias("total_b"))
    return t.withColumn("percent", F.round(100 * (F.col("total_b") - F.col("total_a")) / F.greatest(F.col("total_a"), F.lit(1)), 1))


def latest_runs(runs: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest run of each (target, tool)."""
    return runs.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).where("__k = 1").drop("__k")


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(both, only_a, only_b, percent) of two tools' findings."""
    x, y = a.select(*keys).distinct().withColumn("x", F.lit(1)), b.select(*keys).distinct().withColumn("y", F.lit(1))
    j = x.join(y, keys, "full").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"))
    return j.withColumn("percent", F.floor(100 * F.col("both") / F.greatest(F.col("both") + F.col("only_a") + F.col("only_b"), F.lit(1))))


def artifact_diff(a: DataFrame, b: DataFrame, volatile: list[str]) -> DataFrame:
    """Rows that only one of two artifacts has, besides volatile columns, with the side."""
    x, y = a.drop(*volatile), b.drop(*volatile)
    return x.exceptAll(y).withColumn("side", F.lit("a")).union(y.exceptAll(x).withColumn("side", F.lit("b")))
