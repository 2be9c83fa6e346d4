"""Sources of text (trees, diffs, transcripts, logs), rules over units, reports and search, each over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import dead, diff, dup, graph, modules, report, search, smells, temporal
from lodestrata.plans import findings
from lodestrata.runtime import cut, shared_dir, table
from lodestrata.sources import trees

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# a nation is a file of one of four languages; every seventh is made by a tool, every fifth ignored, the eleventh hidden, every thirteenth in another tool's folder
@query("""WITH n AS (SELECT n_nationkey AS k, n_name, (['py', 'ts', 'rs', 'js'])[1 + n_nationkey % 4] AS ext FROM nation)
SELECT 'r/f' || k || '.' || ext AS file, CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' ELSE 'javascript' END AS language, CAST(k + 2 AS INTEGER) AS lines FROM n WHERE k % 7 <> 6 AND k % 5 <> 4 AND k <> 11 AND k % 13 <> 12""")
def tree_scan(spark, sf_dir):
    """Files of a tree that is written from the nations, without what ignore files, headers, folders and hidden names leave out."""
    root = _folder(spark, "tree").removeprefix("file:")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # nations are a few
    os.makedirs(f"{root}/r")
    with open(f"{root}/.gitignore", "w") as f:
        f.writelines(f"r/f{r[0]}.*\n" for r in rows if r[0] % 5 == 4)
    for k, name in rows:
        folder = f"{root}/r/vendor" if k % 13 == 12 else f"{root}/r"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{'.' if k == 11 else ''}f{k}.{('py', 'ts', 'rs', 'js')[k % 4]}", "w") as f:
            f.write(("# Code generated by hand. DO NOT EDIT.\n" if k % 7 == 6 else f"# {name}\n") + "x\n" * k)
    with open(f"{root}/notes.txt", "w") as f:
        f.write("no source\n")
    return trees.tree(spark, root)[0].select("file", "language", "lines")


# an order is a diff of one file, a line a hunk that adds 1 to 3 lines after it removed one
HUNKS = """h AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, 1 + CAST(l_quantity AS INTEGER) % 3 AS k, l_partkey AS p FROM lineitem)"""


def _diff_lines(spark, sf_dir) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("diff"), place.alias("i"), (1 + F.col("l_quantity").cast("int") % 3).alias("k"), s("l_partkey").alias("p"))
    added = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: F.concat(F.lit("+"), "p", F.lit("/"), j.cast("string")))
    hunk = F.concat(F.array(F.concat(F.lit("@@ -"), (F.col("i") * 10).cast("string"), F.lit(" +"), (F.col("i") * 10).cast("string"), F.lit(","), F.col("k").cast("string"), F.lit(" @@ f")), F.lit("-old")), added)
    body = l.select("diff", (F.col("i") * 100).alias("at"), F.posexplode(hunk).alias("j", "line"))
    name = F.concat(F.lit("f"), F.col("diff").cast("string"))
    head = l.select("diff").distinct().select("diff", F.lit(0).alias("at"), F.posexplode(F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name, F.lit("\t2024")))).alias("j", "line"))
    return head.union(body).select("diff", (F.col("at") + F.col("j")).cast("long").alias("n"), "line")


@query(f"WITH {HUNKS} SELECT 'f' || o AS file, CAST(10 * i AS BIGINT) AS lo, CAST(10 * i + k - 1 AS BIGINT) AS hi FROM h")
def diff_ranges(spark, sf_dir):
    return diff.changed_ranges(_diff_lines(spark, sf_dir))


@query(f"WITH {HUNKS} SELECT 'f' || o AS file, CAST(10 * i + j - 1 AS BIGINT) AS line_no, p || '/' || j AS text FROM h, LATERAL (SELECT unnest(generate_series(1, k)) AS j)")
def diff_added_lines(spark, sf_dir):
    return diff.added_lines(_diff_lines(spark, sf_dir))


@query("""SELECT DISTINCT CASE WHEN role = 'user' THEN 'c' ELSE 'd' END || conv_id || '.py' AS file, CASE WHEN role = 'user' THEN 1 ELSE turn END AS lo,
CASE WHEN role = 'user' THEN 1 ELSE turn END + greatest(0, length(text) - length(replace(text, chr(10), '')) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS hi FROM conversations WHERE text IS NOT NULL""")
def transcript_ranges(spark, sf_dir):
    """Ranges that a session's writes (users' turns) and edits (the others') touched, from its JSON lines with broken ones between."""
    c, path = table(spark, sf_dir, "conversations"), _folder(spark, "transcript")
    name = lambda x: F.concat(F.lit(x), F.col("conv_id").cast("string"), F.lit(".py"))
    write = F.to_json(F.struct(F.struct(name("c").alias("file_path"), F.col("text").alias("content")).alias("tool")))
    edit = F.to_json(F.struct(F.array(F.struct(name("d").alias("file_path"), F.col("text").alias("new_string"), F.col("turn").alias("start_line"))).alias("edits")))
    lines = c.select(F.when(F.col("role") == "user", write).otherwise(edit).alias("value"))
    lines.union(c.select(F.concat(F.lit("{broken "), F.col("conv_id").cast("string")).alias("value"))).write.text(path)
    return trees.transcript(spark, path)


@query("""SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1""")
def event_log_compacted(spark, sf_dir):
    """The log of all events as JSON lines, appended in two parts with broken lines between, then cut to its last ten days as it is over its limit."""
    e, path = table(spark, sf_dir, "events"), _folder(spark, "log")
    rows = e.select(F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("fp"))
    trees.append_events(rows.where("fp % 2 = 0"), path)
    spark.range(5).selectExpr("concat('{\"kind\": ', id) as value").write.mode("append").text(path)
    trees.append_events(rows.where("fp % 2 = 1"), path)
    log = cut(trees.event_log(spark, path).withColumn("at", F.timestamp_micros("ts")))
    kept = temporal.retained(log, "at", F.lit(log.agg(F.max("at")).first()[0]), size=log.count(), limit=100, days=10)
    return kept.groupBy("kind").agg(F.count("*").alias("n"), F.sum("fp").alias("ids"))


NUMBERS = {  # a unit's fact: a part's key times a factor, modulo a bound
    "branches": (7, 31), "cognitive": (11, 41), "max_nesting": (3, 8), "returns": (5, 7), "magic_numbers": (1, 3), "chain_depth": (13, 7), "nested_ifs": (17, 2), "nested_ternaries": (19, 2), "empty_fallbacks": (23, 4), "broad_handlers": (29, 2), "repeated_guards": (31, 2),
    "short_fallbacks": (37, 2), "bool_params": (41, 4), "return_arity": (43, 4), "annotated_arity": (47, 4), "literal_memberships": (53, 2), "loose_types": (59, 2), "nested_loops": (61, 2), "sorts_in_loop": (67, 2), "comment_lines": (71, 9), "start_line": (73, 40),
}
UNIT = ", ".join(f"CAST(p_partkey * {a} % {b} AS INTEGER) AS {k}" for k, (a, b) in NUMBERS.items())


def _units(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as unit", "p_size", *[f"cast(p_partkey * {a} % {b} as int) as {k}" for k, (a, b) in NUMBERS.items()])
    return p.select(
        "*", (F.col("start_line") + F.col("p_size")).alias("end_line"), (F.col("unit") % 2 == 1).alias("is_nested"),
        F.concat(F.when(F.col("unit") % 3 == 0, F.array(F.lit("self"))).otherwise(F.expr("cast(array() as array<string>)")), F.transform(F.sequence(F.lit(1), (F.col("unit") % 8 + 1).cast("int")), lambda i: F.concat(F.lit("a"), i.cast("string")))).alias("params"),
        F.array(F.lit("self"), F.concat(F.lit("a"), (F.col("unit") % 11).cast("string"))).alias("mutated"),
        F.create_map(F.concat(F.lit("a"), (F.col("unit") % 5).cast("string")), (F.col("unit") % 2 + 1).cast("int")).alias("assigns"),
    )


N_PARAMS = "(unit % 8 + 1)"
RULE_SQL = {  # in DuckDB, of the rules whose expressions are about arrays or maps
    "long_parameter_list": N_PARAMS, "narrating_code": "ceil(100.0 * comment_lines / greatest(end_line - start_line + 1, 1))",
    "mutated_parameter": f"CASE WHEN unit % 11 BETWEEN 1 AND {N_PARAMS} THEN 1 ELSE 0 END", "reassigned_parameter": f"CASE WHEN unit % 5 BETWEEN 1 AND {N_PARAMS} THEN 1 ELSE 0 END",
}


def _rule(r: smells.Rule) -> str:
    m = RULE_SQL.get(r.kind, r.metric)
    where = "NOT (unit % 2 + 1 > 1)" if r.kind == "redundant_validation" else r.where
    sev = f"CASE WHEN {m} > {r.critical} THEN 'critical' ELSE '{r.severity}' END" if r.critical is not None else f"'{r.severity}'"
    return f"SELECT '{r.kind}' AS kind, unit, CAST({m} AS DOUBLE) AS metric, {sev} AS severity FROM u WHERE ({where}) AND {m} {'>=' if r.at_least else '>'} {r.threshold}"


@query(f"WITH u AS (SELECT *, start_line + p_size AS end_line, unit % 2 = 1 AS is_nested FROM (SELECT p_partkey AS unit, p_size, {UNIT} FROM part)) {' UNION ALL '.join(map(_rule, smells.FUNCTION_RULES))}")
def function_rules(spark, sf_dir):
    """Every rule over functions, those that are off by default too; a part is a function."""
    return smells.threshold_smells(_units(spark, sf_dir), smells.FUNCTION_RULES, every=True).select("kind", "unit", "metric", "severity")


@query("""SELECT 'large_class' AS kind, c_custkey AS unit, CAST(n AS DOUBLE) AS metric FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 20
UNION ALL SELECT 'refused_bequest', o_custkey, CAST(s AS DOUBLE) FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS s FROM orders GROUP BY 1) WHERE o_custkey % 2 = 0 AND o_custkey % 6 <> 0 AND 2 * s >= n AND s >= 2""")
def class_rules(spark, sf_dir):
    """A customer is a class, an order a method, an open one a stub; every second customer inherits, every sixth is abstract."""
    o = table(spark, sf_dir, "orders").withColumn("name", F.col("o_orderkey").cast("string"))
    c = o.groupBy(F.col("o_custkey").alias("unit")).agg(F.collect_list("name").alias("methods"), F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("name"))).alias("stubs"))
    c = c.withColumns({"bases": F.when(F.col("unit") % 2 == 0, F.array(F.lit("Base"))).otherwise(F.expr("cast(array() as array<string>)")), "is_abstract": F.col("unit") % 6 == 0})
    return smells.threshold_smells(c, smells.CLASS_RULES, every=True).select("kind", "unit", "metric")


@query("""SELECT c_custkey AS unit, c_custkey % 4 AS file, CAST(c_nationkey AS BIGINT) AS target FROM customer WHERE c_custkey % 2 = 0 AND EXISTS (SELECT 1 FROM customer h WHERE h.c_custkey % 3 = 0 AND h.c_nationkey = customer.c_nationkey AND h.c_custkey % 4 = customer.c_custkey % 4 AND h.c_custkey <> customer.c_custkey)""")
def looping_helpers(spark, sf_dir):
    """A customer is a function of a file; every second calls its nation's functions in a loop, every third of these loops itself."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_custkey") % 4).alias("file"), F.col("c_nationkey").cast("long").alias("target"))
    calls = c.select("file", "unit", "target", (F.col("unit") % 2 == 0).alias("in_loop"))
    fns = c.select("file", "unit", F.col("target").alias("name"), F.when(F.col("unit") % 3 == 0, 1).otherwise(0).alias("loops"))
    return smells.looping_helpers(calls, fns).join(c, ["file", "unit"])


@query(f"""WITH {findings.FOUND} SELECT pillar, kind, file, symbol, CASE WHEN action = 'info' AND pillar IN ('cycle', 'clone') THEN action WHEN pillar = 'clone' THEN 'advisory' WHEN pillar = 'dead_code' THEN 'must_fix' ELSE action END AS action FROM found WHERE pillar IN ('clone', 'dead_code')""")
def policy_and_pillars(spark, sf_dir):
    f = report.with_policy(findings.all_findings(spark, sf_dir), {"clone": "advisory", "dead_code": "must_fix"})
    return report.select_pillars(f, ["clone", "dead_code"]).select("pillar", "kind", "file", "symbol", "action")


@query(f"""WITH {findings.FOUND} SELECT file, len(list(kind)) AS n, list_sort(list({{'line': coalesce(line, 0), 'severity': {findings.LEVEL}, 'kind': kind}}))[1].line AS first_line FROM found GROUP BY 1""")
def editor_diagnostics(spark, sf_dir):
    return report.diagnostics(findings.all_findings(spark, sf_dir)).select("file", F.size("items").cast("long").alias("n"), F.col("items")[0]["line"].alias("first_line"))


@query(f"""WITH {findings.FOUND} SELECT kind, count(*) AS n, count(*) FILTER (line <> 0) AS with_line FROM found GROUP BY 1""")
def findings_json(spark, sf_dir):
    """Findings as JSON, read again: none is lost, and unknown lines are left out."""
    j = report.to_json(findings.all_findings(spark, sf_dir)).select(F.from_json("json", "kind string, line long").alias("j"))
    return j.groupBy(F.col("j.kind").alias("kind")).agg(F.count("*").alias("n"), F.count("j.line").alias("with_line"))


@query(f"""WITH {findings.FOUND}, t(kind, text) AS (VALUES ('duplication', 'copies'), ('long_function', 'lines'), ('nothing', 'never')) SELECT kind, text FROM t WHERE kind IN (SELECT kind FROM found)""")
def glossary(spark, sf_dir):
    return report.glossary(findings.all_findings(spark, sf_dir), spark.createDataFrame([("duplication", "copies"), ("long_function", "lines"), ("nothing", "never")], "kind string, text string"))


@query("""WITH g AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text HAVING count(*) > 1) SELECT id, 'd' || doc_id AS file, doc_id % 50 AS start, doc_id % 50 + 3 AS "end", sha256(id || '|d' || doc_id || '|' || doc_id % 50 || '|' || (doc_id % 50 + 3)) AS marker FROM documents JOIN g USING (text)""")
def review_comments(spark, sf_dir):
    """A comment for each copy of a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    g = d.groupBy("h", "m").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("n > 1")
    place = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 50 + 3).alias("end"))
    return report.comments(d.join(g, ["h", "m"]).groupBy("id").agg(F.collect_list(place).alias("places")))


@query("""SELECT o_orderpriority AS variant, count(*) AS n, round(avg(o_totalprice), 3) AS price FROM orders GROUP BY 1""")
def variant_averages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_totalprice").alias("price"))
    return report.variant_averages(o, ["price"]).select("variant", "n", "price")


@query("""SELECT round(a, 2) AS total_a, round(b, 2) AS total_b, round(100 * (b - a) / greatest(a, 1), 1) AS percent FROM (SELECT sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, sum(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS b FROM orders)""")
def cost_overhead(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_totalprice").alias("price"))
    return report.overhead(o, "1-URGENT", "5-LOW", "price").select(F.round("total_a", 2).alias("total_a"), F.round("total_b", 2).alias("total_b"), "percent")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def newest_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return report.latest_runs(e, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id")


@query("""SELECT 'a' AS side, user_id, event_type FROM (SELECT user_id, event_type FROM events WHERE day(ts) <= 15 EXCEPT ALL SELECT user_id, event_type FROM events WHERE day(ts) > 15)
UNION ALL SELECT 'b', user_id, event_type FROM (SELECT user_id, event_type FROM events WHERE day(ts) > 15 EXCEPT ALL SELECT user_id, event_type FROM events WHERE day(ts) <= 15)""")
def artifact_difference(spark, sf_dir):
    """What only one half of the month has, the events' volatile columns aside."""
    e = table(spark, sf_dir, "events")
    return report.artifact_diff(e.where("day(ts) <= 15"), e.where("day(ts) > 15"), ["event_id", "ts", "value", "props"]).select("side", "user_id", "event_type")


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_id % 5 > 0) AS hits, avg(value) AS m FROM events) SELECT n, hits, floor((n - hits) / n * 100 + 0.5) / 100 AS empty_rate, floor(m * 100 + 0.5) / 100 AS mean_top FROM n""")
def search_health(spark, sf_dir):
    return temporal.health(table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("n_hits"), F.col("value").alias("top_score")))


@query("""WITH f AS (SELECT doc_id, source AS detector, row_number() OVER (ORDER BY doc_id) AS rank FROM documents), j AS (SELECT source AS detector, avg(toxic) AS bad FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN coalesce(bad, 0) > 0.1 THEN 1 ELSE 0 END, rank) AS place FROM f LEFT JOIN j USING (detector)""")
def reranked(spark, sf_dir):
    """Documents as findings in order of their ids, those of noisy sources behind the others."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("detector"), F.col("doc_id").alias("rank"))
    bad = table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("detector").agg(F.avg("toxic").alias("bad")).where("bad > 0.1")
    return _placed(temporal.rerank(d, bad))


def _placed(ordered: DataFrame) -> DataFrame:
    """(doc_id, place) of a sorted table: places inside a partition, plus the rows of those before it."""
    at = cut(ordered.withColumns({"p": F.spark_partition_id(), "m": F.monotonically_increasing_id()}))
    before, n = {}, 0
    for p, k in sorted(map(tuple, at.groupBy("p").count().collect())):  # a row per partition
        before[p], n = n, n + k
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("p"))
    return at.select("doc_id", (F.col("m") - F.shiftleft(F.col("p").cast("long"), 33) + start + 1).alias("place"))


@query("""WITH s AS (SELECT o_custkey % 40 AS branch, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_custkey % 40 <> 0)
SELECT branch, o_orderkey FROM s WHERE k = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12""")
def newest_snapshots(spark, sf_dir):
    """Of each branch the newest order, and of these the twelve newest; a null branch keeps nothing."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 40 != 0, F.col("o_custkey") % 40).alias("branch"), "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("updated"))
    return temporal.latest_per_branch(o).select("branch", "o_orderkey")


@query("""WITH w AS (SELECT p_partkey AS k, p_name, string_split(p_name, ' ') AS w FROM part) SELECT count(*) AS n, count(DISTINCT p_name) AS texts FROM w""")
def cached_vectors(spark, sf_dir):
    """Vectors of all part names: half come from a cache, the others are made; every part has one, equal names share it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.lit("f").alias("file"), F.col("p_name").alias("symbol"), F.lit("function").alias("kind"), F.col("p_name").alias("text"))
    none = spark.createDataFrame([], "key long, model_id string, vector array<float>")
    old = cut(search.incremental(p.where("p_partkey % 2 = 0"), none, "m", search.hashed_embedding))
    new = search.incremental(p, old, "m", search.hashed_embedding)
    at = p.withColumn("key", F.xxhash64(*search.content_key())).join(new, "key")
    return at.agg(F.count("*").alias("n"), F.countDistinct("key").alias("texts"))


@query("""SELECT p_partkey AS k, CAST(1 + p_partkey % 4 AS INTEGER) AS arity, 'a/b' || p_partkey AS path, p_brand AS base, p_partkey % 2 = 0 AS inside, [split_part(p_brand, '#', 1), split_part(p_brand, '#', 1) || '.' || split_part(p_brand, '#', 2)] AS parents, (['brand', 'x'])[1 + p_partkey % 2] IN ('brand') AS has, floor(p_retailprice / 7 * 100 + 0.5) / 100 AS rounded FROM part""")
def scalar_functions(spark, sf_dir):
    """Arity, path, base type, prefixes, parents, identifiers and rounding, of expressions that are written from every part."""
    p = table(spark, sf_dir, "part")
    k, dotted = F.col("p_partkey").cast("string"), F.replace("p_brand", F.lit("#"), F.lit("."))
    tuple_ = F.concat(F.lit("tuple["), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int")), lambda i: F.lit("dict[str, int]")), ", "), F.lit("]"))
    path = F.concat(F.lit("a/./x/../b"), k, F.lit("/c/.."))
    return p.select(
        F.col("p_partkey").alias("k"), scalar.tuple_arity(tuple_).alias("arity"), scalar.normal_path(path).alias("path"), scalar.base_type(F.concat("p_brand", F.lit("<K, V>[]"))).alias("base"),
        scalar.dotted_prefix(dotted, F.when(F.col("p_partkey") % 2 == 0, F.substring_index(dotted, ".", 1)).otherwise(F.concat(dotted, F.lit("x")))).alias("inside"), scalar.dotted_parents(dotted).alias("parents"),
        scalar.has_identifier(F.when(F.col("p_partkey") % 2 == 0, F.lit("a brand(x)")).otherwise(F.lit("brandx = x")), "brand").alias("has"), scalar.round2(scalar.ratio(F.col("p_retailprice"), F.lit(7.0))).alias("rounded"),
    )


@query("""WITH i AS (SELECT p_partkey AS k, (['@/ui/' || p_size, '@/' || p_size, 'react', '@app'])[1 + p_partkey % 4] AS t FROM part)
SELECT k, CASE WHEN starts_with(t, '@/ui/') THEN 'src/widgets/' || substr(t, 6) WHEN starts_with(t, '@/') THEN 'src/' || substr(t, 3) WHEN t = '@app' THEN 'src/main' ELSE t END AS target FROM i""")
def path_aliases(spark, sf_dir):
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.element_at(F.array(F.concat(F.lit("@/ui/"), F.col("p_size").cast("string")), F.concat(F.lit("@/"), F.col("p_size").cast("string")), F.lit("react"), F.lit("@app")), (1 + F.col("p_partkey") % 4).cast("int")).alias("target"))
    rules = trees.jsonc('{"paths": {/* a */ "@/*": ["src/*"], "@/ui/*": ["src/widgets/*"], // b\n "@app": ["src/main"],}}')["paths"]
    p = spark.createDataFrame([(k, v[0]) for k, v in rules.items()], "pattern string, replacement string")
    return modules.aliased(i, p).select(F.col("file").cast("long").alias("k"), "target")


# three suppliers are a cycle: the first edge at run time, the last one type-only in every second three
TYPED = """s AS (SELECT s_suppkey AS k, s_suppkey - s_suppkey % 3 AS g FROM supplier), g AS (SELECT g, list_sort(list(k)) AS members FROM s GROUP BY 1 HAVING count(*) = 3)"""


def _typed_edges(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    to = F.col("src") - F.col("src") % 3 + (F.col("src") + 1) % 3
    e = s.select("src", to.alias("dst"), ((F.col("src") % 3 == 2) & (F.col("src") % 2 == 0)).alias("type_only"))
    return e.join(s.select(F.col("src").alias("dst")), "dst").select("src", "dst", "type_only")


@query(f"WITH {TYPED} SELECT members FROM g WHERE members[3] % 2 = 0")
def type_only_cycles(spark, sf_dir):
    return graph.type_level_cycles(_typed_edges(spark, sf_dir)).select("members")


@query(f"WITH {TYPED} SELECT members FROM g WHERE members[3] % 2 = 1 AND NOT (members[1] % 5 = 0 AND members[2] % 5 = 0) AND len(list_filter(members, lambda x: x % 5 <> 0)) > 0")
def cycles_outside_globs(spark, sf_dir):
    """Run-time cycles that have a member outside the excluded files, which every fifth supplier is."""
    e = _typed_edges(spark, sf_dir)
    mods = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("module"), F.concat(F.when(F.col("s_suppkey") % 5 == 0, "gen/").otherwise("src/"), F.col("s_suppkey").cast("string")).alias("file"))
    return graph.reported(graph.cycles(e.where("not type_only")), mods, ["gen/**"]).select("members")


@query("""WITH m AS (SELECT DISTINCT c_nationkey AS class, month(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT n_nationkey AS c, n_nationkey % 5 AS b FROM nation WHERE n_nationkey >= 5)
SELECT m.class, 'm' || m.m AS method FROM m JOIN n ON m.class = n.c WHERE EXISTS (SELECT 1 FROM m u WHERE u.class = n.b AND u.m = m.m)""")
def overridden_methods(spark, sf_dir):
    """A nation is a class that inherits from one of the first five, a month with orders a method."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("class"), F.concat(F.lit("m"), F.month("o_orderdate").cast("string")).alias("method")).distinct()
    bases = table(spark, sf_dir, "nation").where("n_nationkey >= 5").select(F.col("n_nationkey").alias("class"), (F.col("n_nationkey") % 5).alias("base"))
    return dead.overrides(m, bases)


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'live' WHEN p_partkey % 3 = 1 THEN 'neutral' ELSE 'unknown' END AS said, p_partkey % 4 IN (0, 1) AS entry FROM part""")
def language_rules(spark, sf_dir):
    """What decorators say, and which files start things, by a language's rules."""
    p = table(spark, sf_dir, "part")
    deco = F.element_at(F.array(F.array(F.lit("app.route('/x')"), F.lit("cache")), F.array(F.lit("functools.lru_cache(maxsize=1)"), F.lit("staticmethod")), F.array(F.lit("mine.special"))), (1 + F.col("p_partkey") % 3).cast("int"))
    file = F.element_at(F.array(F.lit("a/main.py"), F.lit("tests/x.py"), F.lit("a/b.py"), F.lit("a/domain.py")), (1 + F.col("p_partkey") % 4).cast("int"))
    return p.select(F.col("p_partkey").alias("k"), dead.decorator_class(deco, F.lit("python")).alias("said"), dead.is_entry(file, F.lit("python")).alias("entry"))


@query("""SELECT p_partkey AS unit, p_partkey % 10 AS file FROM part WHERE (p_partkey - p_partkey % 10) // 10 % 2 = 0""")
def entry_class_closure(spark, sf_dir):
    """Parts of a file inherit from each other in a chain of ten, of which every second ends in a class that a framework calls."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    g = F.floor(F.col("k") / 10)
    base = F.when(F.col("k") % 10 == 0, F.when(g % 2 == 0, "unittest.TestCase").otherwise("Base")).otherwise((F.col("k") - 1).cast("string"))
    b = p.select(g.alias("file"), F.col("k").cast("string").alias("class"), base.alias("base"))
    return dead.entry_classes(b, ["TestCase"]).select(F.col("class").cast("long").alias("unit"), (F.col("class").cast("long") % 10).alias("file"))


@query("""WITH u AS (SELECT s_suppkey AS k, s_nationkey AS f, s_suppkey % 7 + 1 AS a, s_nationkey % 5 + 1 AS b FROM supplier),
p AS (SELECT x.k AS a, y.k AS b, (x.a * y.a + x.b * y.b) / (sqrt(x.a * x.a + x.b * x.b) * sqrt(y.a * y.a + y.b * y.b)) AS c FROM u x JOIN u y ON x.k < y.k AND x.f <> y.f AND x.k % 3 = y.k % 3 AND least(x.a + x.b, y.a + y.b) >= greatest(x.a + x.b, y.a + y.b) * 0.55)
SELECT a, b, round(c, 9) AS cosine FROM p WHERE c >= 0.99""")
def semantic_pairs(spark, sf_dir):
    """Suppliers as functions, nations as files: alike in a shape of two counts and in one of three comment vectors, in different nations."""
    a, b = (F.col("s_suppkey") % 7 + 1).cast("int"), (F.col("s_nationkey") % 5 + 1).cast("int")
    axis = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(F.col("s_suppkey") % 3 == i, 1.0).otherwise(0.0))
    u = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("file"), F.array(a, b).alias("shape"), (a + b).alias("size"), axis.alias("vector"), F.lit(9).alias("n_words"))
    return dup.semantic_pairs(u, shape=0.99, tokens=0).select("a", "b", F.round("cosine", 9).alias("cosine"))
