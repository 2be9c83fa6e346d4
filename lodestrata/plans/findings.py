"""Diff mode and reports over one findings table made from the documents' smells and clone classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import diff, report
from lodestrata.plans import code_shapes, graphs, texts
from lodestrata.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FOUND = f"""{code_shapes.ALL_SMELLS}, {graphs.REFS}, use AS (SELECT target AS module, count(*) FILTER (symbol <> '*') AS used, bool_or(symbol = '*') AS star FROM refs WHERE NOT is_test GROUP BY 1),
copies AS (SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1),
found AS (SELECT 'smell' AS pillar, kind, source || '/' || lang || '/d' || doc_id AS file, CAST(unit AS VARCHAR) AS symbol, doc_id % 97 AS line, doc_id % 97 + lines AS end_line, metric, threshold, severity, action FROM smells JOIN units ON unit = doc_id JOIN documents USING (doc_id)
UNION ALL SELECT 'clone', 'duplication', source || '/' || lang || '/d' || doc_id, CAST(doc_id AS VARCHAR), 1, 1, CAST(n AS DOUBLE), 2.0, 'warning', CASE WHEN n > 5 THEN 'must_fix' ELSE 'warning' END FROM copies JOIN documents ON first_doc = doc_id
UNION ALL SELECT 'dead_code', d.kind, 'parts/' || d.module, d.symbol, 0, 0, 0.0, 0.0, 'info', CASE WHEN used > 0 THEN 'warning' ELSE 'advisory' END FROM declared d JOIN use USING (module) WHERE NOT star AND p_size <> 1 AND p_size <> 2
    AND NOT EXISTS (SELECT 1 FROM refs r WHERE NOT is_test AND r.target = d.module AND r.symbol = d.symbol))"""
LEVEL = "CASE action WHEN 'must_fix' THEN 1 WHEN 'warning' THEN 2 WHEN 'advisory' THEN 3 ELSE 4 END"


def all_findings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("file"))
    lines = code_shapes._units(spark, sf_dir).select("doc_id", "lines")
    s = code_shapes.threshold_smells(spark, sf_dir).join(d, F.col("unit") == F.col("doc_id")).join(lines, "doc_id")
    line = (F.col("doc_id") % 97).cast("long")
    a = s.select(F.lit("smell").alias("pillar"), "kind", "file", F.col("unit").cast("string").alias("symbol"), line.alias("line"), (line + F.col("lines")).alias("end_line"), "metric", "threshold", "severity", "action")
    one = F.lit(1).cast("long")
    c = texts.exact_duplicate_docs(spark, sf_dir).join(d, F.col("first_doc") == F.col("doc_id"))
    b = c.select(F.lit("clone").alias("pillar"), F.lit("duplication").alias("kind"), "file", F.col("doc_id").cast("string").alias("symbol"), one.alias("line"), one.alias("end_line"), F.col("n").cast("double").alias("metric"), F.lit(2.0).alias("threshold"), F.lit("warning").alias("severity"), F.when(F.col("n") > 5, "must_fix").otherwise("warning").alias("action"))
    zero = F.lit(0).cast("long")
    x = graphs.dead_parts_tiered(spark, sf_dir).select(F.lit("dead_code").alias("pillar"), "kind", F.concat(F.lit("parts/"), "module").alias("file"), "symbol", zero.alias("line"), zero.alias("end_line"), F.lit(0.0).alias("metric"), F.lit(0.0).alias("threshold"), F.lit("info").alias("severity"), F.when(F.col("confidence") == "high", "warning").otherwise("advisory").alias("action"))
    return a.union(b).union(x)


@query(f"WITH {FOUND} SELECT pillar, place, kind, file, symbol, action FROM (SELECT *, row_number() OVER (PARTITION BY pillar ORDER BY {LEVEL}, metric DESC, file, symbol, kind) AS place FROM found) WHERE place <= 5 AND pillar <> 'smell'")
def topk_per_pillar(spark, sf_dir):
    f = all_findings(spark, sf_dir).where("pillar <> 'smell'")
    return report.top_per_pillar(f).select("pillar", "place", "kind", "file", "symbol", "action")


@query(f"WITH {FOUND} SELECT kind, place, file, symbol, action, metric FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {LEVEL}, metric DESC, file, symbol) AS place FROM found) WHERE place <= 3")
def topk_per_kind(spark, sf_dir):
    return report.top_per_kind(all_findings(spark, sf_dir)).select("kind", "place", "file", "symbol", "action", "metric")


@query(f"WITH {FOUND} SELECT pillar, kind, file, symbol FROM found WHERE regexp_full_match(file, 'src[12]/[^/]*/d[^/]*') OR regexp_full_match(file, 'src7/.*') OR list_contains(string_split(file, '/'), 'es')")
def output_glob(spark, sf_dir):
    return report.output_glob(all_findings(spark, sf_dir), ["src[12]/*/d*", "src7/**", "es"]).select("pillar", "kind", "file", "symbol")


@query(f"""WITH {FOUND} SELECT place, pillar, kind, symbol FROM (SELECT *, row_number() OVER (ORDER BY CASE pillar WHEN 'dead_code' THEN 1 WHEN 'clone' THEN 4 ELSE 5 END, {LEVEL}, metric DESC, file, symbol) AS place FROM found) WHERE place <= 20""")
def summary_concat(spark, sf_dir):
    return report.summary(all_findings(spark, sf_dir), 20)


@query(f"WITH {FOUND} SELECT pillar, count(*) AS total, count(*) FILTER (action = 'must_fix') AS must_fix, count(*) FILTER (action = 'warning') AS warning FROM found GROUP BY 1")
def health_summary(spark, sf_dir):
    return report.health(all_findings(spark, sf_dir))


@query(f"WITH {FOUND} SELECT kind, count(*) AS n, max(threshold) AS threshold, (list_sort(list(DISTINCT file)))[1:2] AS paths FROM found GROUP BY 1")
def rule_summary(spark, sf_dir):
    return report.per_rule(all_findings(spark, sf_dir))


CHANGED = """changed AS (SELECT source || '/' || lang || '/d' || doc_id AS file, n_chars % 80 AS lo, n_chars % 80 + 9 AS hi FROM documents)"""


def _changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("file"), (F.col("n_chars") % 80).alias("lo"), (F.col("n_chars") % 80 + 9).alias("hi"))


@query(f"""WITH {FOUND}, {CHANGED} SELECT pillar, kind, file, symbol FROM found WHERE EXISTS (SELECT 1 FROM changed c WHERE c.file = found.file AND c.lo <= end_line AND line <= c.hi)""")
def diff_interval_join(spark, sf_dir):
    s = all_findings(spark, sf_dir).select("pillar", "kind", "file", "symbol", F.col("line").alias("start"), F.col("end_line").alias("end"))
    return diff.touched(s, _changed(spark, sf_dir)).select("pillar", "kind", "file", "symbol")


@query(f"""WITH {FOUND}, {CHANGED} SELECT pillar, kind, file, symbol FROM found WHERE (pillar = 'clone' OR line > 0) AND EXISTS (SELECT 1 FROM changed c WHERE c.file = found.file AND c.lo <= end_line AND line <= c.hi)""")
def diff_filter(spark, sf_dir):
    f = all_findings(spark, sf_dir).withColumn("id", F.xxhash64("pillar", "kind", "file", "symbol"))
    f = f.withColumn("places", F.array(F.struct("file", F.col("line").alias("start"), F.col("end_line").alias("end"))))
    return diff.diff_filter(f, _changed(spark, sf_dir)).select("pillar", "kind", "file", "symbol")


@query(f"""WITH {CHANGED}, g AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text HAVING count(*) > 1),
p AS (SELECT g.id, source || '/' || lang || '/d' || doc_id AS file, n_chars % 80 + doc_id % 20 AS s FROM documents JOIN g USING (text)),
m AS (SELECT *, EXISTS (SELECT 1 FROM changed c WHERE c.file = p.file AND c.lo <= p.s + 3 AND p.s <= c.hi) AS c FROM p),
a AS (SELECT id, min({{'f': file, 's': s}}) FILTER (NOT c) AS o, count(*) FILTER (NOT c) AS k, count(*) AS n FROM m GROUP BY 1)
SELECT id, CASE WHEN k > 0 THEN 'copy of ' || o.f || ':' || o.s || CASE WHEN k > 1 THEN ' +' || (k - 1) || ' more' ELSE '' END ELSE n || ' copies in this change' END AS hint FROM a""")
def provenance(spark, sf_dir):
    groups = texts.exact_duplicate_docs(spark, sf_dir).select(F.col("first_doc").alias("id"), F.explode("docs").alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("file"), (F.col("n_chars") % 80 + F.col("doc_id") % 20).alias("start"))
    return diff.clone_provenance(groups.join(d, "doc_id").select("id", "file", "start", (F.col("start") + 3).alias("end")), _changed(spark, sf_dir))


@query(f"""WITH {FOUND}, w(pillar, w) AS (VALUES ('cycle', 5), ('dead_code', 4), ('clone', 3), ('boundary', 2), ('smell', 1))
SELECT state, CAST(sum(w * n) AS BIGINT) AS score FROM (SELECT pillar, CASE WHEN line > 40 THEN 'new' ELSE 'existing' END AS state, count(*) AS n FROM found GROUP BY ALL) JOIN w USING (pillar) GROUP BY 1""")
def quality_score(spark, sf_dir):
    f = all_findings(spark, sf_dir).withColumn("state", F.when(F.col("line") > 40, "new").otherwise("existing"))
    return report.quality_score(f.groupBy("pillar", "state").agg(F.count("*").alias("n")))


# one tool reports the smells, the other all else; they agree on a file
@query(f"""WITH {FOUND}, a AS (SELECT DISTINCT file FROM found WHERE pillar = 'smell'), b AS (SELECT DISTINCT file FROM found WHERE pillar <> 'smell')
SELECT count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b, CAST(floor(100 * count(*) FILTER (x AND y) / count(*)) AS BIGINT) AS percent
FROM (SELECT a.file IS NOT NULL AS x, b.file IS NOT NULL AS y FROM a FULL JOIN b ON a.file = b.file)""")
def tool_agreement(spark, sf_dir):
    f = all_findings(spark, sf_dir)
    return report.agreement(f.where("pillar = 'smell'"), f.where("pillar <> 'smell'"), ["file"])


@query("""WITH r AS (SELECT o_custkey AS task, month(o_orderdate) AS run, o_orderpriority AS variant, max(o_totalprice) AS price FROM orders GROUP BY ALL)
SELECT a.task, a.run, round(b.price - a.price, 2) AS price FROM r a JOIN r b ON a.task = b.task AND a.run = b.run WHERE a.variant = '1-URGENT' AND b.variant = '5-LOW'""")
def paired_deltas(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task"), F.month("o_orderdate").alias("run"), F.col("o_orderpriority").alias("variant")).agg(F.max("o_totalprice").alias("price"))
    return report.paired_deltas(o, "1-URGENT", "5-LOW", ["price"]).select("task", "run", F.round("price", 2).alias("price"))
