"""Findings over time: fingerprints, ageing, staleness, metrics, precision, gates, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalar import ratio, round2

DAY = 86400
BANK_DAYS, STALE_DAYS, WINDOW_DAYS, KEEP_DAYS = 30, 7, 30, 45


def fingerprint(pillar: str) -> Column:
    """Identity of a finding: never its lines or metrics."""
    ids = {
        "cycle": F.array_join(F.array_sort("members"), ","),
        "dead_code": F.concat_ws("|", "module", "symbol", "kind"),
        "boundary": F.concat_ws("|", "src", "dst", "label"),
        "clone": F.concat_ws("|", F.array_join(F.array_sort(F.array_distinct("files")), ","), F.size("files")),
        "smell": F.concat_ws("|", "kind", "file", "symbol"),
    }
    return F.xxhash64(F.lit(pillar), ids[pillar])


def age(current: DataFrame, open_: DataFrame, bank: DataFrame, ignored: DataFrame, now: int) -> dict[str, DataFrame]:
    """One ageing step. ``current``: (fp, class, label); ``open_``: (fp, class, label, first_seen); ``bank``: (fp, class, resolved_ts).

    open: what is there now, with its first sight; resolved: (fp, class, age) of what went and
    isn't ignored; reintroduced: (fp, class, held) of what was in the bank; bank: what is in it
    afterwards, nothing resolved over BANK_DAYS ago.
    """
    c = current.select("fp", "class", "label").dropDuplicates(["fp"])
    fresh = bank.where(F.lit(now) - F.col("resolved_ts") <= BANK_DAYS * DAY)
    both = c.join(open_.select("fp", F.col("class").alias("oc"), F.col("label").alias("ol"), "first_seen"), "fp", "full")
    kept = both.where("class is not null").select("fp", "class", "label", F.coalesce("first_seen", F.lit(now)).alias("first_seen"))
    gone = both.where("class is null").join(ignored.select("fp"), "fp", "left_anti").select("fp", F.col("oc").alias("class"), F.greatest(F.lit(now) - F.col("first_seen"), F.lit(0)).alias("age"))
    back = c.join(fresh.select("fp", "resolved_ts"), "fp").select("fp", "class", F.greatest(F.lit(now) - F.col("resolved_ts"), F.lit(0)).alias("held"))
    held = fresh.join(c.select("fp"), "fp", "left_anti").join(gone.select("fp"), "fp", "left_anti").union(gone.select("fp", "class", F.lit(now).alias("resolved_ts")))
    return {"open": kept, "resolved": gone, "reintroduced": back, "bank": held}


def presence_gaps(seen: DataFrame, keys: list[str], day: str, last: Column | int) -> DataFrame:
    """(keys, day, first_seen, resolved, back, held) for each run of consecutive scans that a finding is in.

    ``seen``: distinct (keys, day), day a scan's number. A run ends resolved at the next scan unless it
    reaches the last one; the next run begins reintroduced ``held`` scans later.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    rows = seen.withColumn("p", F.lag(day).over(w)).withColumn("run", F.sum(F.when(F.col("p").isNull() | (F.col(day) > F.col("p") + 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "run").agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))
    after = F.lead("first_seen").over(Window.partitionBy(*keys).orderBy("first_seen"))
    return runs.select(*keys, "first_seen", "last_seen", F.when(F.col("last_seen") < last, F.col("last_seen") + 1).alias("resolved"), after.alias("back"), (after - F.col("last_seen") - 1).alias("held"))


def stale(open_: DataFrame, triaged: DataFrame, now: int) -> DataFrame:
    """(fp, days) of open findings older than STALE_DAYS that nobody triaged."""
    old = open_.where(F.lit(now) - F.col("first_seen") > STALE_DAYS * DAY).join(triaged.select("fp"), "fp", "left_anti")
    return old.select("fp", F.floor((F.lit(now) - F.col("first_seen")) / DAY).alias("days"))


def totals(scans: DataFrame, keys: list[str], ts: str, counters: list[str], latest: list[str]) -> DataFrame:
    """Fold of an event log: counters are summed, of the ``latest`` columns the last event's value counts."""
    return scans.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counters], *[F.max_by(c, F.struct(ts, c)).alias(c) for c in latest])


def changes(scans: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n): how often a value that isn't null differs from the last one before that isn't null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(value, ignorenulls=True).over(w)
    return scans.withColumn("__p", prev).groupBy(*keys).agg(F.count_if((F.col(value) != F.col("__p")) & F.col("__p").isNotNull()).alias("n_changes"))


def within(events: DataFrame, ts: str, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    return events.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def retained(events: DataFrame, ts: str, now: Column, size: int, limit: int = 4 << 20, days: int = KEEP_DAYS) -> DataFrame:
    """The log as it is while it has ``limit`` bytes at most, else its last ``days``."""
    return within(events, ts, now, days) if size > limit else events


def detector_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector").agg(F.count("*").alias("n"))


def precision(resolved: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(detector, adjudicated, precision) from (detector) of resolved ones and (detector, verdict) of triaged ones."""
    r = resolved.groupBy("detector").agg(F.count("*").alias("resolved"))
    v = verdicts.groupBy("detector").agg(F.count_if(F.col("verdict") == "debt").alias("debt"), F.count_if(F.col("verdict") == "false_positive").alias("fp"))
    j = r.join(v, "detector", "full").na.fill(0)
    good, n = F.col("resolved") + F.col("debt"), F.col("resolved") + F.col("debt") + F.col("fp")
    return j.where(n >= 1).select("detector", n.alias("adjudicated"), round2(ratio(good, n)).alias("precision"))


def noisy(p: DataFrame, least: int = 4, below: float = 0.5) -> DataFrame:
    return p.where((F.col("adjudicated") >= least) & (F.col("precision") < below))


def resolution_days(resolved: DataFrame) -> DataFrame:
    """(detector, n, mean_days) with a row ``_overall``, from (detector, age)."""
    r = resolved.rollup("detector").agg(F.count("*").alias("n"), F.avg("age").alias("a"), F.grouping("detector").alias("g"))
    return r.select(F.when(F.col("g") == 1, "_overall").otherwise(F.col("detector")).alias("detector"), "n", round2(F.col("a") / DAY).alias("mean_days"))


def reintroduction(resolved: DataFrame, back: DataFrame) -> DataFrame:
    """(detector, back, resolved, rate, mean_held_days)."""
    r = resolved.groupBy("detector").agg(F.count("*").alias("resolved"))
    b = back.groupBy("detector").agg(F.count("*").alias("back"), F.avg("held").alias("h"))
    return b.join(r, "detector", "left").select("detector", "back", F.coalesce("resolved", F.lit(0)).alias("resolved"), round2(ratio(F.col("back"), F.coalesce("resolved", F.lit(0)))).alias("rate"), round2(F.col("h") / DAY).alias("mean_held_days"))


def funnel(scans: DataFrame, origin: str) -> DataFrame:
    """(origin, n, share)."""
    n = scans.groupBy(F.col(origin).alias("origin")).agg(F.count("*").alias("n"))
    return n.select("origin", "n", ratio(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def gate_conversion(blocked: DataFrame, open_: DataFrame) -> DataFrame:
    """(blocked, fixed, rate): how many blocked fps aren't open any more; a null rate without any baseline."""
    b = blocked.select("fp").distinct().join(open_.select("fp", F.lit(1).alias("o")).distinct(), "fp", "left")
    return b.agg(F.count("*").alias("blocked"), F.count_if(F.col("o").isNull()).alias("fixed")).crossJoin(open_.agg((F.count("*") > 0).alias("base"))).select("blocked", "fixed", F.when(F.col("base"), round2(ratio(F.col("fixed"), F.col("blocked")))).alias("rate"))


def rerank(findings: DataFrame, noisy_detectors: DataFrame) -> DataFrame:
    """Findings in their order (rank), those of noisy detectors behind the others."""
    n = noisy_detectors.select("detector", F.lit(1).alias("__n"))
    return findings.join(n, "detector", "left").orderBy(F.coalesce("__n", F.lit(0)), "rank").drop("__n")


def suppress(findings: DataFrame, triaged: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings (fp, label, pillar, detector) that aren't triaged and whose label has no accepted text (scope, text) of their pillar or detector."""
    left = findings.join(triaged.select("fp"), "fp", "left_anti")
    a = accepted.select(F.col("scope").alias("__s"), F.col("text").alias("__t"))
    for scope in ("pillar", "detector"):  # a hash join each, not a nested loop over either
        left = left.join(a, (F.col("__s") == F.col(scope)) & F.contains(F.col("label"), F.col("__t")), "left_anti")
    return left


def triage(held: DataFrame, open_: DataFrame, label_part: str, verdict: str) -> DataFrame:
    """The verdicts (fp, verdict) after one for all open findings whose label has ``label_part`` in any case; ``clear`` removes them."""
    hit = open_.where(F.contains(F.lower("label"), F.lit(label_part.lower()))).select("fp").distinct()
    if hit.isEmpty():
        raise ValueError(f"no open finding has {label_part!r} in its label")
    left = held.join(hit, "fp", "left_anti")
    return left if verdict == "clear" else left.unionByName(hit.withColumn("verdict", F.lit(verdict)))


def regressions(current: DataFrame, bank: DataFrame) -> DataFrame:
    return current.join(bank.select("fp"), "fp", "left_semi")


def gate_memory(current: DataFrame, blocked: DataFrame) -> DataFrame:
    """Findings (fp, scope) that weren't blocked in the same scope before; null is a scope."""
    b = blocked.select(F.col("fp").alias("__f"), F.col("scope").alias("__s"))
    return current.join(b, (F.col("fp") == F.col("__f")) & F.col("scope").eqNullSafe(F.col("__s")), "left_anti")


def latest_per_branch(snapshots: DataFrame, most: int = 12) -> DataFrame:
    """The newest snapshot of each branch, and of these the ``most`` newest; a null branch keeps nothing."""
    last = snapshots.where("branch is not null").withColumn("k", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("updated")))).where("k = 1").drop("k")
    return last.orderBy(F.desc("updated"), "branch").limit(most)


def health(searches: DataFrame) -> DataFrame:
    """(n, hits, empty_rate, mean_top) of search events (n_hits, top_score)."""
    e = searches.agg(F.count("*").alias("n"), F.count_if(F.col("n_hits") > 0).alias("hits"), F.avg("top_score").alias("m"))
    return e.select("n", "hits", round2(ratio(F.col("n") - F.col("hits"), F.col("n"))).alias("empty_rate"), round2(F.col("m")).alias("mean_top"))
