"""Dead code, cycles, boundaries, coupling and cohesion over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import boundaries, dead, graph, smells
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


# modules are brands, a symbol is a part at a line's place (1 to 7); a line uses one, a returned one in a test
STAR = "l_linenumber = 7 AND l_discount = 0.1 AND l_tax = 0.08 AND l_quantity > 45"
REFS = f"""refs AS (SELECT l_suppkey AS source, p_brand AS target, CASE WHEN {STAR} THEN '*' ELSE l_partkey || ':' || l_linenumber END AS symbol, l_returnflag = 'R' AS is_test
    FROM lineitem JOIN part ON l_partkey = p_partkey),
declared AS (SELECT p_brand AS module, p_partkey || ':' || place AS symbol, p_type AS kind, p_size FROM part, generate_series(1, 7) t(place))"""


def _refs(spark, sf_dir):
    symbol = F.when(F.expr(STAR), "*").otherwise(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")))
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select(F.col("l_suppkey").alias("source"), F.col("p_brand").alias("target"), symbol.alias("symbol"), (F.col("l_returnflag") == "R").alias("is_test"))


@query(f"""WITH {REFS} SELECT target AS module, CAST(count(DISTINCT symbol) FILTER (symbol <> '*') AS INTEGER) AS n_used, bool_or(symbol = '*') AS star, count(*) AS n_edges FROM refs WHERE NOT is_test GROUP BY 1""")
def inbound_usage(spark, sf_dir):
    return dead.inbound_usage(_refs(spark, sf_dir)).select("module", F.size("used").alias("n_used"), "star", "n_edges")


@query(f"""WITH {REFS}, use AS (SELECT target AS module, count(*) FILTER (symbol <> '*') AS used, bool_or(symbol = '*') AS star, count(*) AS n FROM refs WHERE NOT is_test GROUP BY 1)
SELECT module, symbol, kind, CASE WHEN used > 0 THEN 'high' ELSE 'medium' END AS confidence
FROM declared d JOIN use USING (module) WHERE NOT star AND p_size <> 1 AND p_size <> 2 AND n > 0
AND NOT EXISTS (SELECT 1 FROM refs r WHERE NOT is_test AND r.target = d.module AND r.symbol = d.symbol)""")
def dead_parts_tiered(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(7))))
    symbols = p.select(
        F.col("p_brand").alias("module"), F.concat_ws(":", F.col("p_partkey").cast("string"), F.col("place").cast("string")).alias("symbol"), F.col("p_type").alias("kind"), (F.col("p_size") == 1).alias("private"),
        (F.col("p_size") == 2).alias("exported"), F.lit(False).alias("registered"), F.lit(False).alias("entry"), F.lit(0).alias("local_uses"),
    )
    return dead.dead_symbols(symbols, _refs(spark, sf_dir))


# a binding is a customer's month of the year, an order uses one
@query("""WITH used AS (SELECT DISTINCT o_custkey, month(o_orderdate) AS m FROM orders)
SELECT c_custkey AS line, c_name || '#' || m AS name, 'c' || c_nationkey AS file FROM customer, generate_series(1, 12) t(m) WHERE c_mktsegment <> 'MACHINERY' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.o_custkey = c_custkey AND u.m = t.m)""")
def unused_customers(spark, sf_dir):
    file, name = F.concat(F.lit("c"), F.col("c_nationkey").cast("string")), lambda m: F.concat_ws("#", "c_name", m.cast("string"))
    c = table(spark, sf_dir, "customer").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    c = c.select(file.alias("file"), name(F.col("m")).alias("name"), F.col("c_custkey").alias("line"), F.lit("runtime").alias("phase"), F.lit(False).alias("is_inline"), (F.col("c_mktsegment") == "MACHINERY").alias("exported"), F.lit(False).alias("is_package_index"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    uses = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return dead.unused_bindings(c, uses.select(file.alias("file"), name(F.col("m")).alias("name"), "n")).select("line", "name", "file")


TRADE = """trade AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
reach AS (SELECT src, dst FROM trade UNION SELECT r.src, t.dst FROM reach r JOIN trade t ON r.dst = t.src)"""


def _trade(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    return l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("src <> dst").select("src", "dst").distinct()


@query(f"WITH RECURSIVE {TRADE} SELECT src, dst FROM reach")
def class_closure(spark, sf_dir):
    return graph.closure(_trade(spark, sf_dir)).select("src", "dst")


@query(f"""WITH RECURSIVE {TRADE}, alive AS (SELECT 0 AS node, 0 AS depth UNION SELECT t.dst, a.depth + 1 FROM alive a JOIN trade t ON a.node = t.src WHERE a.depth < 30)
SELECT node, min(depth) AS depth FROM alive GROUP BY 1""")
def live_closure(spark, sf_dir):
    return graph.live(_trade(spark, sf_dir), spark.createDataFrame([(0,)], "node int"))


SCC = f"""{TRADE}, both_ AS (SELECT a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst),
scc AS (SELECT node, least(node, min(other)) AS scc FROM both_ GROUP BY 1)"""


@query(f"WITH RECURSIVE {SCC} SELECT scc, list_sort(list(node)) AS members, count(*) AS n FROM scc GROUP BY 1")
def trade_scc(spark, sf_dir):
    return graph.cycles(_trade(spark, sf_dir))


@query(f"WITH RECURSIVE {SCC} SELECT a.node, a.scc, min(t.dst) AS next FROM scc a JOIN trade t ON t.src = a.node JOIN scc b ON b.node = t.dst AND a.scc = b.scc GROUP BY ALL")
def scc_next_hop(spark, sf_dir):
    t = _trade(spark, sf_dir)
    return graph.next_hops(t, graph.strongly_connected(t))


RULES = [("america to asia", "AMERICA", "ASIA"), ("no china", "EUROPE", "ASIA.CHINA"), ("i to j", "*.I*", "*.J*"), ("nowhere", "ATLANTIS", "ASIA"), ("path", "AFRICA/*", "EUROPE/R*")]
NAMES = """named AS (SELECT n_nationkey AS k, r_name || '.' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _names(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("k"), F.concat_ws(".", "r_name", "n_name").alias("module"))


@query(f"""WITH RECURSIVE {TRADE}, {NAMES}, e AS (SELECT a.module AS src, b.module AS dst FROM trade JOIN named a ON a.k = src JOIN named b ON b.k = dst)
SELECT src, dst, 'america to asia' AS label FROM e WHERE (src = 'AMERICA' OR src LIKE 'AMERICA.%') AND (dst = 'ASIA' OR dst LIKE 'ASIA.%')
UNION ALL SELECT src, dst, 'no china' FROM e WHERE src LIKE 'EUROPE.%' AND (dst = 'ASIA.CHINA' OR dst LIKE 'ASIA.CHINA.%')
UNION ALL SELECT src, dst, 'i to j' FROM e WHERE src LIKE '%.I%' AND dst LIKE '%.J%'
UNION ALL SELECT src, dst, 'path' FROM e WHERE src LIKE 'AFRICA.%' AND dst LIKE 'EUROPE.R%'""")
def boundary_violations(spark, sf_dir):
    n = _names(spark, sf_dir)
    e = _trade(spark, sf_dir).join(n.select(F.col("k").alias("src"), F.col("module").alias("a")), "src").join(n.select(F.col("k").alias("dst"), F.col("module").alias("b")), "dst")
    return boundaries.violations(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("b").alias("literal")), boundaries.with_patterns(spark, RULES))


@query(f"""WITH {NAMES}, r(label, from_pat, p) AS (VALUES ('america to asia', 'AMERICA', 'AMERICA.%'), ('no china', 'EUROPE', 'EUROPE.%'), ('i to j', '*.I*', '%.I%'), ('nowhere', 'ATLANTIS', 'ATLANTIS.%'), ('path', 'AFRICA/*', 'AFRICA.%'))
SELECT label, from_pat FROM r WHERE NOT EXISTS (SELECT 1 FROM named WHERE module LIKE p)""")
def unmatched_rules(spark, sf_dir):
    return boundaries.unmatched(boundaries.with_patterns(spark, RULES), _names(spark, sf_dir).select("module"))


# suppliers and brands are nodes; returned lines go the other way
DEPS = """deps AS (SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN p_brand ELSE 's' || l_suppkey END AS src, CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey ELSE p_brand END AS dst FROM lineitem JOIN part ON l_partkey = p_partkey),
fi AS (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM deps WHERE src <> dst GROUP BY 1), fo AS (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM deps GROUP BY 1),
fan AS (SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM fi FULL JOIN fo USING (node)), many AS (SELECT greatest(4, count(*) * 15 // 100) AS t FROM fan)"""


def _deps(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    back, s = F.col("l_returnflag") == "R", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return l.select(F.when(back, F.col("p_brand")).otherwise(s).alias("src"), F.when(back, s).otherwise(F.col("p_brand")).alias("dst")).distinct()


def _internal(deps) -> int:
    return deps.select("src").union(deps.select("dst")).distinct().count()


@query(f"WITH {DEPS} SELECT * FROM fan")
def fan_in_out(spark, sf_dir):
    return graph.coupling(_deps(spark, sf_dir))


@query(f"WITH {DEPS} SELECT node, fan_in AS metric, CAST(t AS INTEGER) AS threshold, CASE WHEN fan_in >= 2 * t THEN 'critical' ELSE 'warning' END AS severity FROM fan, many WHERE fan_in >= t")
def blast_hazard(spark, sf_dir):
    d = _deps(spark, sf_dir)
    return smells.hazards(d, _internal(d))


# here suppliers and parts are nodes
PART_DEPS = DEPS.replace("p_brand", "('p' || l_partkey)")


@query(f"WITH {PART_DEPS} SELECT node, fan_in, fan_out FROM fan, many WHERE fan_in + fan_out >= 25 AND fan_in >= 4 AND fan_out >= 4 AND fan_in < t")
def god_nodes(spark, sf_dir):
    l, back = table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R"
    s, p = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("s", "l_suppkey"), ("p", "l_partkey")))
    d = l.join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst")).distinct()
    return smells.god_nodes(d, _internal(d))


COHESION = """m AS (SELECT DISTINCT c_nationkey AS o, c_custkey AS m, o_orderpriority || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(o_orderdate AS DATE) AS t FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH RECURSIVE {COHESION}, e AS (SELECT DISTINCT a.o, a.m AS x, b.m AS y FROM m a JOIN m b USING (o, t)), r AS (SELECT o, x, y FROM e UNION SELECT r.o, r.x, e.y FROM r JOIN e ON r.o = e.o AND r.y = e.x),
c AS (SELECT o, x, min(y) AS c FROM r GROUP BY ALL) SELECT o AS c_nationkey, count(*) AS n_members, count(DISTINCT c) AS n_components FROM c GROUP BY 1""")
def lcom_components(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = F.concat(F.col("o_orderpriority"), F.month("o_orderdate").cast("string"), F.lit("-"), F.to_date("o_orderdate").cast("string"))
    return smells.cohesion(o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "c_custkey", t.alias("t")), "c_nationkey", "c_custkey", "t")


@query("""WITH f AS (SELECT u, f FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY f) AS k FROM (SELECT DISTINCT l_orderkey AS u, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE k <= 10)
SELECT [a.f, b.f, c.f] AS fields, count(*) AS n FROM f a JOIN f b ON a.u = b.u AND a.f < b.f JOIN f c ON b.u = c.u AND b.f < c.f GROUP BY 1 HAVING count(*) >= 3""")
def data_clumps(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return smells.clumps(l, "l_orderkey", "p_brand", 3, 3)
