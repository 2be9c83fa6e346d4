"""Smell rules over tables of the units' shape: documents are functions, users call events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import smells
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


DOC_RULES = [
    smells.Rule("high_complexity", "commas + 1", 40, critical=80),
    smells.Rule("long_function", "lines", 12),
    smells.Rule("narrating_code", "ceil(100 * short_lines / greatest(lines, 1))", 30, "info", "short_lines >= 5"),
    smells.Rule("deep_nesting", "longest_line", 900),
    smells.Rule("too_many_returns", "stops", 60),
    smells.Rule("magic_numbers", "digits", 0, "info"),
    smells.Rule("defensive_fallback", "upper", 100, where="commas >= 1", at_least=True),
]

UNITS = """units AS (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, chr(10), '')) + 1 AS lines,
    len(list_filter(string_split(text, chr(10)), lambda x: length(x) < 40)) AS short_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest_line,
    length(text) - length(replace(text, '.', '')) AS stops, len(regexp_extract_all(text, '[0-9]+')) AS digits, len(regexp_extract_all(text, '[A-Z]')) AS upper FROM documents)"""


def _units(spark, sf_dir):
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    parts = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", count(",").alias("commas"), (count("\n") + 1).alias("lines"), F.size(F.filter(parts, lambda x: F.length(x) < 40)).alias("short_lines"),
        F.array_max(F.transform(parts, lambda x: F.length(x))).alias("longest_line"), count(".").alias("stops"),
        F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("digits"), F.size(F.regexp_extract_all("text", F.lit("[A-Z]"), F.lit(0))).alias("upper"),
    )


def _rule_sql(r: smells.Rule) -> str:
    m = r.metric.replace("100 *", "100.0 *")
    sev = f"CASE WHEN {m} > {r.critical} THEN 'critical' ELSE '{r.severity}' END" if r.critical is not None else f"'{r.severity}'"
    act = {k: v for k, v in smells.ACTIONS.items()}
    action = f"CASE {sev} WHEN 'critical' THEN 'must_fix' WHEN 'warning' THEN 'warning' ELSE 'advisory' END"
    assert act
    return f"SELECT '{r.kind}' AS kind, doc_id AS unit, CAST({m} AS DOUBLE) AS metric, CAST({r.threshold} AS DOUBLE) AS threshold, {sev} AS severity, {action} AS action FROM units WHERE ({r.where}) AND {m} {'>=' if r.at_least else '>'} {r.threshold}"


ALL_SMELLS = f"{UNITS}, smells AS ({' UNION ALL '.join(map(_rule_sql, DOC_RULES))})"


@query(f"WITH {ALL_SMELLS} SELECT * FROM smells")
def threshold_smells(spark, sf_dir):
    return smells.threshold_smells(_units(spark, sf_dir), DOC_RULES, "doc_id")


@query(f"WITH {ALL_SMELLS} SELECT kind, count(*) AS n FROM smells GROUP BY 1")
def smell_totals(spark, sf_dir):
    return smells.totals(threshold_smells(spark, sf_dir))


@query("SELECT l_orderkey AS unit, l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2")
def split_values(spark, sf_dir):
    return smells.split_values(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n")))


@query("SELECT conv_id AS unit, max(turn) - min(turn) + 1 AS metric FROM conversations GROUP BY 1 HAVING max(turn) - min(turn) + 1 > 3")
def long_units(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("start_line"), F.max("turn").alias("end_line"))
    rule = smells.Rule("long_function", "end_line - start_line + 1", 3)
    return smells.threshold_smells(c, [rule], "conv_id").select("unit", F.col("metric").cast("long").alias("metric"))


@query("""SELECT conv_id AS unit, ceil(100.0 * count(*) FILTER (role = 'user') / count(*)) AS metric FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') >= 2 AND ceil(100.0 * count(*) FILTER (role = 'user') / count(*)) > 30""")
def comment_ratio(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("comment_lines"), F.count("*").alias("lines"))
    rule = smells.Rule("narrating_code", "ceil(100 * comment_lines / greatest(lines, 1))", 30, "info", "comment_lines >= 2")
    return smells.threshold_smells(c, [rule], "conv_id").select("unit", "metric")


# a user belongs to the type of its number; every event is a use of the event's type
OWN = "(['view', 'click', 'purchase', 'signup', 'error'])[1 + user_id % 5]"


def _own():
    return F.element_at(F.array(*map(F.lit, ["view", "click", "purchase", "signup", "error"])), (1 + F.col("user_id") % 5).cast("int"))


@query(f"""WITH n AS (SELECT user_id AS u, event_type AS t, {OWN} AS o, count(*) AS n FROM events GROUP BY ALL), mine AS (SELECT u, n AS own_n FROM n WHERE t = o),
top AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, t) AS k FROM n WHERE t <> o)
SELECT u AS unit, t AS target, n, own_n FROM top JOIN mine USING (u) WHERE k = 1 AND n >= 3 AND n > 2 * own_n AND own_n >= 1""")
def feature_envy(spark, sf_dir):
    return smells.envy(table(spark, sf_dir, "events").withColumn("own", _own()), "user_id", "event_type", "own")


@query(r"""WITH u AS (SELECT user_id AS unit, event_type AS class, CASE event_id % 3 WHEN 0 THEN '_' WHEN 1 THEN '__' ELSE '' END || regexp_extract(props, '"(\w+)"', 1) || CAST(event_id % 2 AS VARCHAR) AS name FROM events)
SELECT unit, class, list_sort(list(DISTINCT name)) AS names FROM u WHERE regexp_matches(name, '^_[^_]') GROUP BY ALL""")
def intimacy(spark, sf_dir):
    mark = F.when(F.col("event_id") % 3 == 0, "_").when(F.col("event_id") % 3 == 1, "__").otherwise("")
    name = F.concat(mark, F.regexp_extract("props", r'"(\w+)"', 1), (F.col("event_id") % 2).cast("string"))
    return smells.intimacy(table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("class"), name.alias("name")))


@query("""WITH r AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
n AS (SELECT user_id, event_type, run, count(*) AS n FROM r WHERE event_type <> 'purchase' GROUP BY ALL HAVING count(*) > 1)
SELECT user_id, event_type, count(*) AS n_runs, max(n) AS longest FROM n GROUP BY ALL""")
def repeated_iteration(spark, sf_dir):
    return smells.repeated(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", F.col("event_type") == "purchase")


@query("""WITH c AS (SELECT user_id AS unit, CASE WHEN event_type = 'signup' THEN 'f' || CAST(event_id % 150 AS VARCHAR) ELSE event_type END AS target, event_type <> 'signup' AS is_member, value > 50 AS in_loop FROM events),
o AS (SELECT DISTINCT unit, target FROM c WHERE is_member AND (contains(lower(target), 'purch') OR contains(lower(target), 'err'))),
d AS (SELECT DISTINCT unit, target FROM c WHERE in_loop AND is_member AND (contains(lower(target), 'purch') OR contains(lower(target), 'err'))),
v AS (SELECT DISTINCT c.unit, o.target FROM c JOIN o ON c.target = 'f' || CAST(o.unit AS VARCHAR) WHERE in_loop)
SELECT * FROM d UNION SELECT * FROM v""")
def n_plus_one(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    signup = F.col("event_type") == "signup"
    calls = e.select(F.col("user_id").alias("unit"), F.when(signup, F.concat(F.lit("f"), (F.col("event_id") % 150).cast("string"))).otherwise(F.col("event_type")).alias("target"), (~signup).alias("is_member"), (F.col("value") > 50).alias("in_loop"))
    local = e.select(F.col("user_id").alias("unit"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name")).distinct()
    return smells.calls_in_loops(calls, local, ["purch", "err"])


@query("""WITH s AS (SELECT user_id AS u, user_id // 2 AS g, list_sort(list(DISTINCT event_type || CAST(hour(ts) AS VARCHAR))) AS i FROM events GROUP BY ALL),
p AS (SELECT a.g, a.u AS a, b.u AS b, a.i AS x, b.i AS y FROM s a JOIN s b ON a.g = b.g AND a.u < b.u)
SELECT g, a, b, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, CAST(len(x) + len(y) - len(list_intersect(x, y)) AS INTEGER) AS total FROM p
WHERE len(x) - len(list_intersect(x, y)) >= 2 AND len(y) - len(list_intersect(x, y)) >= 2 AND 3 * len(list_intersect(x, y)) < len(x) + len(y) - len(list_intersect(x, y))""")
def jaccard_divergence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sets = e.groupBy("user_id").agg(F.collect_set(F.concat("event_type", F.hour("ts").cast("string"))).alias("items")).withColumn("g", F.floor(F.col("user_id") / 2))
    return smells.divergence(sets, "g", "user_id", "items")


@query(r"""WITH RECURSIVE k AS (SELECT DISTINCT user_id AS unit, event_type AS receiver, regexp_extract(props, '"(\w+)"', 1) || CAST(event_id % 7 AS VARCHAR) AS key FROM events),
c AS (SELECT DISTINCT user_id AS unit, event_type AS receiver, event_id % 150 AS callee, event_type AS param FROM events),
r AS (SELECT unit, receiver, key, 0 AS d FROM k UNION SELECT c.unit, c.receiver, r.key, r.d + 1 FROM r JOIN c ON c.callee = r.unit AND c.param = r.receiver WHERE r.d < 4)
SELECT unit, receiver, list_sort(list(DISTINCT key)) AS keys FROM r GROUP BY ALL HAVING count(DISTINCT key) >= 4""")
def implicit_schema(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = e.select(F.col("user_id").alias("unit"), F.col("event_type").alias("receiver"), F.concat(F.regexp_extract("props", r'"(\w+)"', 1), (F.col("event_id") % 7).cast("string")).alias("key"))
    calls = e.select(F.col("user_id").alias("unit"), F.col("event_type").alias("receiver"), (F.col("event_id") % 150).alias("callee"), F.col("event_type").alias("param")).distinct()
    return smells.implicit_schema(keys, calls)
