"""Duplication and text-shaped queries over documents, conversations, pages and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scalar
from lodestrata.operators import dup, search
from lodestrata.runtime import cut, table

T = 20
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


W = f"""
d AS (SELECT doc_id AS file, lang AS language, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
w AS (SELECT file, language, flatten(list_transform(lines, lambda l: regexp_extract_all(l, '{dup.WORD}'))) AS words,
    flatten(list_transform(lines, lambda l, i: list_transform(regexp_extract_all(l, '{dup.WORD}'), lambda x: CAST(i AS INTEGER)))) AS rows FROM d)"""
OCC = f"""{W},
occ AS (SELECT file, language, pos, array_to_string(words[pos:pos + {T - 1}], ' ') AS gram, CASE WHEN pos > 1 THEN words[pos - 1] ELSE '|' || file END AS prev, rows[pos] AS start_row, rows[pos + {T - 1}] AS end_row
    FROM (SELECT *, CAST(unnest(generate_series(1, len(words) - {T - 1})) AS INTEGER) AS pos FROM w WHERE len(words) >= {T})),
classes AS (SELECT language, gram, count(*) AS n, count(DISTINCT file) AS n_files, min({{'file': file, 'pos': pos}}) AS f, min(prev) <> max(prev) AS lm FROM occ GROUP BY ALL HAVING count(*) >= 2)"""
MAXIMAL = f"""{OCC},
found AS (SELECT occ.*, c.f.file AS first_file, c.f.pos AS first_pos FROM occ JOIN classes c USING (language, gram) WHERE lm)"""


def _words(spark, sf_dir) -> DataFrame:
    return dup.word_rows(table(spark, sf_dir, "documents"))


def _classes(spark, sf_dir):
    """Packed words, occurrences and classes of the left-maximal grams."""
    pieces = dup.packed(_words(spark, sf_dir))
    occ = cut(dup.repeated(pieces, T, maximal=True))
    return pieces, occ, dup.gram_classes(occ).where("left_maximal")


@query(f"WITH {OCC} SELECT language, f.file AS first_file, f.pos AS first_pos, n, n_files FROM classes")
def clone_gram_classes(spark, sf_dir):
    classes = dup.gram_classes(dup.repeated(dup.packed(_words(spark, sf_dir)), T))
    return classes.select("language", F.col("first.file").alias("first_file"), F.col("first.pos").alias("first_pos"), "n", "n_files")


@query(f"WITH {OCC} SELECT language, f.file AS first_file, f.pos AS first_pos, n FROM classes WHERE lm")
def clone_left_maximal(spark, sf_dir):
    return _classes(spark, sf_dir)[2].select("language", F.col("first.file").alias("first_file"), F.col("first.pos").alias("first_pos"), "n")


EXTENDED = f"""{MAXIMAL},
tails AS (SELECT f.language, f.gram, first_file, first_pos, a.words[f.pos + {T}:] AS x, b.words[first_pos + {T}:] AS y FROM found f JOIN w a ON a.file = f.file JOIN w b ON b.file = first_file),
ext AS (SELECT language, gram, first_file, first_pos, CAST({T} + min(coalesce(list_position(list_transform(generate_series(1, least(len(x), len(y))), lambda k: x[k] = y[k]), false) - 1, least(len(x), len(y)))) AS INTEGER) AS length FROM tails GROUP BY ALL)"""


@query(f"WITH {EXTENDED} SELECT language, first_file, first_pos, length FROM ext")
def clone_extended_len(spark, sf_dir):
    pieces, occ, classes = _classes(spark, sf_dir)
    return dup.extended(dup.members(occ, classes), pieces, T).select("language", "first_file", "first_pos", "length")


SUPPRESSED = """lists AS (SELECT language, gram, first_file, first_pos, list_sort(list({'f': file, 's': start_row, 'e': end_row})) AS l FROM found GROUP BY ALL),
kept AS (SELECT language, gram, first_file, first_pos, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN a[-1].f = x[1].f AND x[1].s <= a[-1].e THEN a ELSE list_concat(a, x) END) AS k FROM lists)"""


@query(f"WITH {MAXIMAL}, {SUPPRESSED} SELECT language, first_file, first_pos, CAST(len(k) AS INTEGER) AS n FROM kept WHERE len(k) >= 2")
def clone_overlap_suppressed(spark, sf_dir):
    _, occ, classes = _classes(spark, sf_dir)
    found = dup.members(occ, classes)
    return dup.suppress_overlaps(found, [*dup.KEY, "first_file", "first_pos"]).select("language", "first_file", "first_pos", "n")


@query(f"""WITH {EXTENDED}, {SUPPRESSED}
SELECT rank, language, first_file, first_pos, length, n FROM (SELECT *, row_number() OVER (ORDER BY length * n DESC, first_file, first_pos, length) AS rank FROM (
SELECT DISTINCT ON (sites, length) language, first_file, first_pos, length, n FROM (SELECT language, first_file, first_pos, length, CAST(len(k) AS INTEGER) AS n, list_transform(k, lambda x: {{'f': x.f, 's': x.s}}) AS sites FROM kept JOIN ext USING (language, gram, first_file, first_pos) WHERE len(k) >= 2) ORDER BY first_file, first_pos)) WHERE rank <= 50""")
def clone_impact_topk(spark, sf_dir):
    """The 50 clone classes of greatest length times occurrences; classes at the same places and of the same length count once."""
    pieces, occ, classes = _classes(spark, sf_dir)
    found = cut(dup.members(occ, classes))
    keys = [*dup.KEY, "first_file", "first_pos"]
    one = dup.suppress_overlaps(found, keys).join(dup.extended(found, pieces, T), keys)
    one = one.groupBy("sites", "length").agg(F.min_by(F.struct("language", "first_file", "first_pos", "n"), F.struct("first_file", "first_pos")).alias("x")).select("x.*", "length")
    order = Window.orderBy((F.col("length") * F.col("n")).desc(), "first_file", "first_pos", "length")
    top = one.orderBy((F.col("length") * F.col("n")).desc(), "first_file", "first_pos", "length").limit(50)
    return top.withColumn("rank", F.row_number().over(order)).select("rank", "language", "first_file", "first_pos", "length", "n")


def _stitched(gap: int, passes: int = 8) -> str:
    """The passes of gap stitching, one set of tables each."""
    out = [f"s0 AS (SELECT first_file * 10000000 + first_pos AS cid, file, pos AS s, pos + length AS e, length AS matched FROM found JOIN ext USING (language, gram, first_file, first_pos))"]
    for i in range(passes):
        out.append(f"""pick{i} AS (SELECT * FROM (SELECT a.cid, a.file, a.s, b.cid AS b, b.e AS be, b.matched AS bm, row_number() OVER (PARTITION BY a.cid, a.file, a.s ORDER BY b.s, b.cid DESC) AS k FROM s{i} a JOIN s{i} b ON a.file = b.file AND a.cid <> b.cid AND b.s BETWEEN a.e AND a.e + {gap}) WHERE k = 1),
size{i} AS (SELECT cid, count(*) AS n FROM s{i} GROUP BY 1),
all{i} AS (SELECT p.cid, p.b FROM (SELECT cid, min(b) AS b, max(b) AS b2, count(*) AS k FROM pick{i} GROUP BY 1) p JOIN size{i} x ON x.cid = p.cid JOIN size{i} y ON y.cid = p.b WHERE b = b2 AND k = x.n AND x.n = y.n),
pair{i} AS (SELECT b, min(cid) AS cid FROM all{i} GROUP BY 1),
rank{i} AS (SELECT cid, b, 0 AS d FROM pair{i} WHERE cid NOT IN (SELECT b FROM pair{i}) UNION ALL SELECT p.cid, p.b, d + 1 FROM rank{i} r JOIN pair{i} p ON p.cid = r.b),
even{i} AS (SELECT cid, b FROM rank{i} WHERE d % 2 = 0),
s{i + 1} AS (SELECT * FROM s{i} WHERE cid NOT IN (SELECT cid FROM even{i} UNION ALL SELECT b FROM even{i})
    UNION ALL SELECT cid, file, s.s, be, s.matched + bm FROM even{i} JOIN pick{i} USING (cid, b) JOIN s{i} s USING (cid, file, s))""")
    return ", ".join(out)


@query(f"""WITH RECURSIVE {EXTENDED}, {_stitched(15)}
SELECT matched, count(DISTINCT cid) AS n_classes, count(*) AS n_places FROM s8 GROUP BY 1""")
def clone_gap_stitched(spark, sf_dir):
    """Left-maximal classes at their full length after gap stitching: (matched, n_classes, n_places)."""
    pieces, occ, classes = _classes(spark, sf_dir)
    found = cut(dup.members(occ, classes))
    full = found.join(dup.extended(found, pieces, T), [*dup.KEY, "first_file", "first_pos"])
    c = full.select((F.col("first_file") * 10_000_000 + F.col("first_pos")).alias("cid"), "file", F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("end"), F.col("length").alias("matched"))
    return dup.stitch(c, 15).groupBy("matched").agg(F.countDistinct("cid").alias("n_classes"), F.count("*").alias("n_places"))


@query(f"""WITH {W}, p AS (SELECT file, language, words, CAST(unnest(generate_series(1, len(words))) AS INTEGER) AS pos FROM w WHERE len(words) >= 3),
o AS (SELECT file, language, pos, words[pos] AS word, min(pos) OVER (PARTITION BY file, words[pos]) AS o FROM p),
k AS (SELECT file, language, string_agg(o::VARCHAR, ' ' ORDER BY pos) AS shape, string_agg(word, ' ' ORDER BY pos) AS raw, count(*) AS n_words FROM o GROUP BY ALL)
SELECT language, min(file) AS first_file, count(*) AS n, count(DISTINCT raw) AS n_raw, CAST(n_words AS INTEGER) AS n_words FROM k GROUP BY language, shape, n_words HAVING count(*) >= 2 AND count(DISTINCT raw) > 1""")
def near_miss_docs(spark, sf_dir):
    return dup.near_misses(_words(spark, sf_dir), 3)


@query("""WITH s AS (SELECT conv_id AS file, turn AS start, turn + length(text) % 4 AS "end" FROM conversations),
m AS (SELECT *, max("end") OVER (PARTITION BY file ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT file, start, "end" FROM m WHERE m IS NULL OR "end" > m""")
def outermost_spans(spark, sf_dir):
    return dup.outermost(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("start"), (F.col("turn") + F.length("text") % 4).alias("end")))


@query("SELECT min(doc_id) AS first_doc, count(*) AS n, list_sort(list(doc_id)) AS docs FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    return d.groupBy("h", "m").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("docs")).where("n > 1").drop("h", "m")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"""WITH h AS (SELECT user_id AS u, {", ".join(f"count(*) FILTER (event_type = '{k}') AS k{i}" for i, k in enumerate(KINDS))} FROM events GROUP BY 1),
s AS (SELECT *, k0 + k1 + k2 + k3 + k4 AS m FROM h)
SELECT a.u AS a, b.u AS b, (a.k0*b.k0 + a.k1*b.k1 + a.k2*b.k2 + a.k3*b.k3 + a.k4*b.k4) / (sqrt(a.k0*a.k0 + a.k1*a.k1 + a.k2*a.k2 + a.k3*a.k3 + a.k4*a.k4) * sqrt(b.k0*b.k0 + b.k1*b.k1 + b.k2*b.k2 + b.k3*b.k3 + b.k4*b.k4)) AS cosine
FROM s a JOIN s b ON a.u < b.u AND least(a.m, b.m) >= greatest(a.m, b.m) * 0.55 AND a.m > 0 AND b.m > 0
WHERE (a.k0*b.k0 + a.k1*b.k1 + a.k2*b.k2 + a.k3*b.k3 + a.k4*b.k4) / (sqrt(a.k0*a.k0 + a.k1*a.k1 + a.k2*a.k2 + a.k3*a.k3 + a.k4*a.k4) * sqrt(b.k0*b.k0 + b.k1*b.k1 + b.k2*b.k2 + b.k3*b.k3 + b.k4*b.k4)) >= 0.995""")
def shape_cosine_pairs(spark, sf_dir):
    return dup.shape_pairs(dup.histogram(table(spark, sf_dir, "events"), "user_id", "event_type", KINDS), 0.995, 0.55)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, list_dot_product(v.e, q.e) AS score FROM v, v AS q WHERE q.vec_id % 50 = 0)
SELECT query, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 10""")
def embedding_topk(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50, the stated query set, among all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return search.top_k_each(e, e.where("vec_id % 50 = 0"), 10, "vec_id", "embedding").select("query", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT a.s AS a, b.s AS b, count(*) AS shared FROM o a JOIN o b ON a.p = b.p AND a.s < b.s GROUP BY ALL HAVING count(*) >= 4""")
def property_overlap_pairs(spark, sf_dir):
    return dup.shared_properties(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 4)


@query("SELECT p_name AS name, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def same_name_groups(spark, sf_dir):
    return dup.same_names(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(regexp_extract(url, '^https?://([^/]+)', 1), '([^.]+)$', 1) AS last,
list_count(regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_]*')) AS identifiers FROM pages""")
def url_keys(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), scalar.last_segment(host).alias("last"), F.size(scalar.identifiers(F.col("url"))).cast("long").alias("identifiers"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<!--[\\s\\S]*?-->')) AS n, coalesce(list_sum(list_transform(regexp_extract_all(html, '<!--[\\s\\S]*?-->'), lambda x: length(x))), 0)::BIGINT AS chars FROM pages WHERE html LIKE '%<!--%'""")
def html_comment_spans(spark, sf_dir):
    c = F.regexp_extract_all("html", F.lit(r"<!--[\s\S]*?-->"), F.lit(0))
    p = table(spark, sf_dir, "pages").where(F.contains("html", F.lit("<!--"))).select("page_id", c.alias("c"))
    return p.select("page_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("""SELECT conv_id AS file, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS bundle FROM conversations WHERE (role <> 'system' OR turn <= 40) AND text <> '' GROUP BY 1""")
def bundle_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return search.bundles(c.select(F.col("conv_id").alias("file"), F.when(F.col("role") == "system", "module").otherwise("symbol").alias("kind"), F.col("turn").alias("line"), F.col("role").alias("symbol_path"), "text"))
