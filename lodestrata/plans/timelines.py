"""Ageing, metrics, precision, gates and triage over events and labels: a day is a scan, (user, type) a finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import temporal
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


SEEN = """seen AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
g AS (SELECT *, lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS p FROM seen),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR day > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY day) AS run FROM g),
runs AS (SELECT user_id, event_type, run, min(day) AS first_seen, max(day) AS last_seen FROM r GROUP BY ALL),
lives AS (SELECT user_id, event_type, first_seen, last_seen, lead(first_seen) OVER (PARTITION BY user_id, event_type ORDER BY first_seen) AS back, (SELECT max(day) FROM seen) AS final FROM runs)"""


def _day():
    return F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))


def _lives(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select("user_id", "event_type", _day().alias("day")).distinct()
    return temporal.presence_gaps(seen, ["user_id", "event_type"], "day", F.lit(seen.agg(F.max("day")).first()[0]))


@query(f"WITH {SEEN} SELECT user_id, event_type, first_seen, last_seen + 1 AS resolved, last_seen + 1 - first_seen AS age FROM lives WHERE last_seen < final")
def aging_resolved(spark, sf_dir):
    return _lives(spark, sf_dir).where("resolved is not null").select("user_id", "event_type", "first_seen", "resolved", (F.col("resolved") - F.col("first_seen")).alias("age"))


@query(f"WITH {SEEN} SELECT user_id, event_type, back, back - last_seen - 1 AS held FROM lives WHERE back IS NOT NULL AND back - last_seen - 1 <= 30")
def aging_reintroduced(spark, sf_dir):
    return _lives(spark, sf_dir).where(f"held <= {temporal.BANK_DAYS}").select("user_id", "event_type", "back", "held")


def _step(spark, sf_dir):
    """One ageing step from the first half of the month to the second."""
    e = table(spark, sf_dir, "events").select(F.xxhash64("user_id", "event_type").alias("fp"), F.col("event_type").alias("class"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("label"), _day().alias("day"))
    current = e.where("day >= 20").select("fp", "class", "label").distinct()
    held = e.where("day between 10 and 19").groupBy("fp", "class", "label").agg((F.min("day") * temporal.DAY).alias("first_seen"))
    bank = e.where("day < 10").join(held.select("fp"), "fp", "left_anti").groupBy("fp", "class").agg((F.max("day") * temporal.DAY).alias("resolved_ts"))
    ignored = e.where("day < 2").select("fp").distinct()
    return temporal.age(current, held, bank, ignored, 25 * temporal.DAY)


AGE = """e AS (SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS label, event_type AS class, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
cur AS (SELECT DISTINCT label, class FROM e WHERE day >= 20), held AS (SELECT label, class, min(day) * 86400 AS first_seen FROM e WHERE day BETWEEN 10 AND 19 GROUP BY ALL),
bank AS (SELECT label, class, max(day) * 86400 AS ts FROM e WHERE day < 10 AND label NOT IN (SELECT label FROM held) GROUP BY ALL), ign AS (SELECT DISTINCT label FROM e WHERE day < 2)"""


@query(f"""WITH {AGE} SELECT class, 'open' AS what, count(*) AS n, CAST(sum(coalesce(first_seen, 2160000)) AS BIGINT) AS total FROM cur LEFT JOIN held USING (label, class) GROUP BY 1
UNION ALL SELECT class, 'resolved', count(*), CAST(sum(2160000 - first_seen) AS BIGINT) FROM held WHERE label NOT IN (SELECT label FROM cur) AND label NOT IN (SELECT label FROM ign) GROUP BY 1
UNION ALL SELECT class, 'reintroduced', count(*), CAST(sum(2160000 - ts) AS BIGINT) FROM bank WHERE label IN (SELECT label FROM cur) GROUP BY 1""")
def aging_step(spark, sf_dir):
    s = _step(spark, sf_dir)
    fold = lambda df, what, c: df.groupBy("class").agg(F.count("*").alias("n"), F.sum(c).cast("long").alias("total")).select("class", F.lit(what).alias("what"), "n", "total")
    return fold(s["open"], "open", "first_seen").union(fold(s["resolved"], "resolved", "age")).union(fold(s["reintroduced"], "reintroduced", "held"))


@query(f"""WITH {AGE}, o AS (SELECT label, coalesce(first_seen, 2160000) AS f FROM cur LEFT JOIN held USING (label, class))
SELECT label, (2160000 - f) // 86400 AS days FROM o WHERE 2160000 - f > 7 * 86400 AND label NOT IN (SELECT label FROM ign)""")
def staleness(spark, sf_dir):
    s = _step(spark, sf_dir)
    ignored = table(spark, sf_dir, "events").where(_day() < 2).select(F.xxhash64("user_id", "event_type").alias("fp")).distinct()
    return temporal.stale(s["open"], ignored, 25 * temporal.DAY).join(s["open"].select("fp", "label"), "fp").select("label", "days")


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS cents, arg_max(event_type, {'ts': ts, 'e': event_type}) AS event_type FROM events GROUP BY 1""")
def totals_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return temporal.totals(e, ["user_id"], "ts", ["cents"], ["event_type"])


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1""")
def window_30d(spark, sf_dir):
    """The trailing window, of 10 days here, as the table spans 30."""
    e = table(spark, sf_dir, "events")
    return temporal.within(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]), 10).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN value > 30 THEN event_type END AS h FROM events),
p AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v)
SELECT user_id, count(*) FILTER (p IS NOT NULL AND h <> p) AS n_changes FROM p GROUP BY 1""")
def config_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("h", F.when(F.col("value") > 30, F.col("event_type")))
    return temporal.changes(e, ["user_id"], ["event_id"], "h")


@query("SELECT event_type AS origin, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def scan_funnel(spark, sf_dir):
    return temporal.funnel(table(spark, sf_dir, "events"), "event_type").select("origin", "n", F.round("share", 6).alias("share"))


# a labelled document is an adjudicated finding of its source's detector; good ones are resolved
PREC = """j AS (SELECT source AS detector, quality, toxic FROM labels JOIN documents USING (doc_id)),
a AS (SELECT detector, count(*) FILTER (quality = 1 AND toxic = 0) AS res, count(*) FILTER (NOT (quality = 1 AND toxic = 0) AND toxic = 1) AS debt, count(*) FILTER (toxic = 0 AND quality = 0) AS fp FROM j GROUP BY 1),
p AS (SELECT detector, res + debt + fp AS adjudicated, floor((res + debt) / (res + debt + fp) * 100 + 0.5) / 100 AS precision FROM a WHERE res + debt + fp >= 1)"""


def _precision(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("detector")), "doc_id")
    good = "quality = 1 and toxic = 0"
    return temporal.precision(j.where(good), j.where(f"not ({good})").withColumn("verdict", F.when(F.col("toxic") == 1, "debt").otherwise("false_positive")))


@query(f"WITH {PREC} SELECT * FROM p")
def precision_by_detector(spark, sf_dir):
    return _precision(spark, sf_dir)


@query(f"WITH {PREC} SELECT * FROM p WHERE adjudicated >= 4 AND precision < 0.9")
def noisy_detectors(spark, sf_dir):
    return temporal.noisy(_precision(spark, sf_dir), below=0.9)


@query(f"""WITH {SEEN}, x AS (SELECT event_type, (last_seen + 1 - first_seen) * 86400 AS age FROM lives WHERE last_seen < final)
SELECT coalesce(event_type, '_overall') AS detector, count(*) AS n, floor(avg(age) / 86400 * 100 + 0.5) / 100 AS mean_days FROM x GROUP BY ROLLUP (event_type)""")
def rollup_resolution(spark, sf_dir):
    r = aging_resolved(spark, sf_dir).select(F.col("event_type").alias("detector"), (F.col("age") * temporal.DAY).alias("age"))
    return temporal.resolution_days(r)


@query(f"""WITH {SEEN}, b AS (SELECT event_type AS detector, count(*) AS back, avg(back - last_seen - 1) AS h FROM lives WHERE back IS NOT NULL GROUP BY 1), q AS (SELECT event_type AS detector, count(*) AS resolved FROM lives WHERE last_seen < final GROUP BY 1)
SELECT detector, back, resolved, floor(back / resolved * 100 + 0.5) / 100 AS rate, floor(h * 100 + 0.5) / 100 AS mean_held_days FROM b JOIN q USING (detector)""")
def reintroduction_rate(spark, sf_dir):
    lives = _lives(spark, sf_dir).withColumnRenamed("event_type", "detector")
    return temporal.reintroduction(lives.where("resolved is not null"), lives.where("back is not null").withColumn("held", F.col("held") * temporal.DAY))


# a finding is a user's event type in an hour of the day; the month's first half is the past
HALVES = """h AS (SELECT DISTINCT user_id, event_type || ':' || hour(ts) AS event_type, day(ts) > 15 AS late FROM events),
b AS (SELECT user_id, event_type FROM h WHERE NOT late), o AS (SELECT user_id, event_type FROM h WHERE late)"""


def _halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat_ws(":", "event_type", F.hour("ts").cast("string")).alias("event_type"), (F.dayofmonth("ts") > 15).alias("late")).distinct()
    e = e.withColumn("fp", F.xxhash64("user_id", "event_type"))
    return e.where("not late").select("fp", "user_id", "event_type"), e.where("late").select("fp", "user_id", "event_type")


@query(f"""WITH {HALVES} SELECT count(*) AS blocked, count(*) FILTER (NOT f) AS fixed, floor(count(*) FILTER (NOT f) / count(*) * 100 + 0.5) / 100 AS rate FROM (SELECT EXISTS (SELECT 1 FROM o WHERE o.user_id = b.user_id AND o.event_type = b.event_type) AS f FROM b)""")
def gate_conversion(spark, sf_dir):
    return temporal.gate_conversion(*_halves(spark, sf_dir))


@query(f"WITH {HALVES} SELECT user_id, event_type FROM o SEMI JOIN b USING (user_id, event_type)")
def regressions(spark, sf_dir):
    b, o = _halves(spark, sf_dir)
    return temporal.regressions(o, b).select("user_id", "event_type")


@query(f"""WITH {HALVES} SELECT user_id, event_type FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE o.user_id = b.user_id AND o.event_type = b.event_type
AND (CASE WHEN o.user_id % 3 = 0 THEN NULL ELSE o.user_id % 2 END) IS NOT DISTINCT FROM (CASE WHEN b.user_id % 3 = 0 THEN NULL ELSE 1 END))""")
def gate_memory(spark, sf_dir):
    b, o = _halves(spark, sf_dir)
    scope = lambda x: F.when(F.col("user_id") % 3 != 0, x)
    return temporal.gate_memory(o.withColumn("scope", scope((F.col("user_id") % 2).cast("long"))), b.withColumn("scope", scope(F.lit(1).cast("long")))).select("user_id", "event_type")


@query(f"""WITH {HALVES} SELECT user_id, event_type FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE o.user_id = b.user_id AND o.event_type = b.event_type)
AND NOT (split_part(event_type, ':', 1) = 'view' AND contains(CAST(user_id AS VARCHAR) || ':' || event_type, '1:v')) AND NOT contains(CAST(user_id AS VARCHAR) || ':' || event_type, '22:')""")
def suppression(spark, sf_dir):
    b, o = _halves(spark, sf_dir)
    f = o.select("fp", "user_id", "event_type", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("label"), F.lit("smell").alias("pillar"), F.substring_index("event_type", ":", 1).alias("detector"))
    accepted = spark.createDataFrame([("view", "1:v"), ("smell", "22:")], "scope string, text string")
    return temporal.suppress(f, b, accepted).select("user_id", "event_type")


@query(f"""WITH {HALVES}, v AS (SELECT user_id, event_type, 'debt' AS verdict FROM b)
SELECT user_id, event_type, verdict FROM v WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = v.user_id AND o.event_type = v.event_type AND contains(lower(o.event_type), 'rch'))
UNION ALL SELECT user_id, event_type, 'false_positive' FROM o WHERE contains(lower(event_type), 'rch')""")
def triage_upsert(spark, sf_dir):
    b, o = _halves(spark, sf_dir)
    names = b.union(o).distinct()
    held = b.select("fp", F.lit("debt").alias("verdict"))
    return temporal.triage(held, o.withColumn("label", F.col("event_type")), "RCH", "false_positive").join(names, "fp").select("user_id", "event_type", "verdict")
