"""Diff mode: changed line ranges, interval joins with findings, and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX = 2**63 - 1


CHUNK = 1 << 16  # lines of a diff that one task takes at most

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def running(rows: DataFrame, last: dict[str, Column], total: dict[str, Column] | None = None, marks: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``rows`` of diffs (diff, n, ...) with each ``last`` value that isn't null up to a line, each ``total`` up to it, and for each of ``marks`` what its total was at the last line that is marked.

    Chunks of a diff are taken by different tasks; what they begin with comes from one row for each chunk before. Diffs of one chunk need none.
    """
    total, marks = total or {}, marks or {}
    w = Window.partitionBy("diff", "__c").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)

    def within(x: DataFrame) -> DataFrame:
        x = x.withColumn("__c", F.floor(F.col("n") / CHUNK))
        x = x.withColumns({f"__{k}": F.last(v, ignorenulls=True).over(w) for k, v in last.items()} | {f"__{k}": F.sum(v).over(w) for k, v in total.items()})
        return x.withColumns({f"__{k}": F.last(F.when(v, F.col(f"__{t}")), ignorenulls=True).over(w) for k, (t, v) in marks.items()}) if marks else x

    names = [*last, *total, *marks]
    long = rows.where(F.col("n") >= CHUNK).select("diff").distinct()
    ends = within(rows.join(long, "diff", "left_semi")).groupBy("diff", "__c").agg(*[F.max_by(f"__{k}", "n").alias(k) for k in names])
    before = Window.partitionBy("diff").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"__b{k}": F.coalesce(F.sum(k).over(before), F.lit(0)) for k in total}) if total else ends
    begin = ends.select("diff", "__c", *[F.last(k, ignorenulls=True).over(before).alias(f"__b{k}") for k in last], *[f"__b{k}" for k in total], *[F.last(F.col(k) + F.col(f"__b{t}"), ignorenulls=True).over(before).alias(f"__b{k}") for k, (t, _) in marks.items()])
    start = lambda k: F.coalesce(f"__b{k}", F.lit(0))
    got = within(rows).join(begin, ["diff", "__c"], "left")
    got = got.withColumns({k: F.coalesce(f"__{k}", f"__b{k}") for k in last} | {k: F.col(f"__{k}") + start(k) for k in total} | {k: F.coalesce(F.col(f"__{k}") + start(t), F.col(f"__b{k}")) for k, (t, _) in marks.items()})
    return got.drop("__c", *[f"__{k}" for k in names], *[f"__b{k}" for k in names])


def _diffs(lines: DataFrame) -> DataFrame:
    return lines if "diff" in lines.columns else lines.withColumn("diff", F.lit(0))


def changed_ranges(lines: DataFrame) -> DataFrame:
    """(file, lo, hi) of a unified diff's new side, from its lines (n, line) or those of several (diff, n, line).

    Pure deletions drop out. Untracked files, named by lines ``? name``, are changed as a whole.
    """
    name = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1), r"\s+$", ""))
    rows = running(_diffs(lines), {"file": name}).where(F.col("line").startswith("@@ "))
    rows = rows.select("file", F.regexp_extract("line", HUNK, 1).cast("long").alias("lo"), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(line, r'{HUNK}', 2), '') as bigint)"), F.lit(1)).alias("k"))
    new = _diffs(lines).where(F.col("line").startswith("? ")).select(F.substr("line", F.lit(3)).alias("file"))
    return rows.where("k > 0 and file <> '/dev/null'").select("file", "lo", (F.col("lo") + F.col("k") - 1).alias("hi")).union(whole_files(new))


def added_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, text) of the lines that diffs add, counted inside each hunk; columns as in :func:`changed_ranges`."""
    line = F.col("line")
    head = line.startswith("@@ ")
    other = line.startswith("+++ ") | line.startswith("--- ") | line.startswith("diff ") | line.startswith("index ") | line.startswith("? ")
    here = (~head & ~other & ~line.startswith("-") & ~line.startswith("\\")).cast("long")
    name = F.when(line.startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1))
    rows = running(_diffs(lines), {"file": name, "lo": F.when(head, F.regexp_extract("line", HUNK, 1).cast("long"))}, {"at": here}, {"base": ("at", head)}).where(~other & ~head & F.col("lo").isNotNull())
    return rows.where(F.col("line").startswith("+")).select("file", (F.col("lo") + F.col("at") - F.col("base") - 1).alias("line_no"), F.substr("line", F.lit(2)).alias("text"))


def whole_files(files: DataFrame) -> DataFrame:
    """Untracked files are changed from their first line to their last."""
    return files.select("file", F.lit(1).cast("long").alias("lo"), F.lit(MAX).alias("hi"))


def touched(spans: DataFrame, changed: DataFrame) -> DataFrame:
    """Spans (file, start, end) that a changed range (file, lo, hi) overlaps."""
    c = changed.select(F.col("file").alias("__f"), "lo", "hi")
    return spans.join(c, (F.col("file") == F.col("__f")) & (F.col("lo") <= F.col("end")) & (F.col("start") <= F.col("hi")), "left_semi")


def diff_filter(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings (id, pillar, places) of which a place (file, start, end) that counts is changed.

    Clones and cycles need any one of their places; cycles come with whole files as places. Dead
    code, boundaries and smells need a known line (start > 0).
    """
    p = findings.select("id", "pillar", F.explode("places").alias("p")).select("id", "pillar", "p.*").where("pillar in ('clone', 'cycle') or start > 0")
    return findings.join(touched(p, changed).select("id").distinct(), "id", "left_semi")


def clone_provenance(places: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, hint) of clones (id, file, start, end): the first unchanged copy and how many more, or that all copies are in this change."""
    marked = places.join(touched(places, changed).select("id", "file", "start", "end").distinct().withColumn("c", F.lit(1)), ["id", "file", "start", "end"], "left")
    old = F.when(F.col("c").isNull(), F.struct("file", "start"))
    g = marked.groupBy("id").agg(F.min(old).alias("first"), F.count(old).alias("olds"), F.count("*").alias("n"))
    said = F.concat(F.lit("copy of "), F.col("first.file"), F.lit(":"), F.col("first.start"), F.when(F.col("olds") > 1, F.concat(F.lit(" +"), F.col("olds") - 1, F.lit(" more"))).otherwise(""))
    return g.select("id", F.when(F.col("olds") > 0, said).otherwise(F.concat(F.col("n"), F.lit(" copies in this change"))).alias("hint"))
