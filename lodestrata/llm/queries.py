"""The subpackage's queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, embedding_dedup, line_dedup, mixing, simhash_dedup, substring_dedup, suffix_dedup, token_records, toxicity, url_filter
from lodestrata.runtime import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules(spark))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier rejects; ``toxicity.score`` gives every document's score."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).where("toxic")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.write_records(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


#: How far the copies of :func:`embedding_groups_moved` lie: about half of them are within the operator's threshold.
SHIFT = 0.33


def embedding_groups_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of op5 over all vectors and as many copies that are moved along the first axis; the given vectors alone may have no near pair. All lists in reach are probed, so the SQL can be matched."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    moved = F.concat(F.array((F.element_at("embedding", 1) + F.lit(SHIFT)).cast("float")), F.slice("embedding", 2, 1 << 30))
    return embedding_dedup.groups(e.union(e.select((-F.col("vec_id") - 1).alias("vec_id"), moved.alias("embedding"))), recall=1.0)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.groups(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_substrings(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_token_records, op4_decontamination, op5_embedding_dedup, op6_simhash_dedup, op7_mixing, op8_substring_dedup, op9_line_dedup, op10_suffix_dedup, pipeline, embedding_groups_moved)}

WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{decontaminate.PATTERN}')"


def _rules_sql() -> str:
    """The rules as a table; those of the junk hosts' sections as a product of lists."""
    junk, domains, langs = (f"(VALUES {', '.join(f'({x!r})' for x in xs)})" for xs in (url_filter.JUNK, url_filter.DOMAINS, url_filter.LANGUAGES))
    pages = "(SELECT '' AS n UNION ALL SELECT CAST(range AS VARCHAR) FROM range(10) UNION ALL SELECT lpad(CAST(range AS VARCHAR), 2, '0') FROM range(100))"
    own = [(h, p, a) for h, p, a in url_filter.RULES if p is None or not any(h.startswith(f"{name}.") for name in url_filter.JUNK)]
    listed = ", ".join(f"('{url_filter.rule_prefix(h, p)}', '{a}')" for h, p, a in own)
    return f"""SELECT * FROM (VALUES {listed}) UNION ALL
    SELECT array_to_string(list_reverse(string_split(d.x, '.')), ',') || ',' || j.x || ', /' || l.x || '/' || p.n, 'drop' FROM {junk} j(x), {domains} d(x), {langs} l(x), {pages} p"""


OP1 = f"""
WITH rules(prefix, action) AS ({_rules_sql()}),
cut AS (SELECT page_id, trim(url) AS u FROM pages),
parts AS (SELECT page_id,
    lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//[^/?#]*([^#]*)', 1) AS path FROM cut),
keyed AS (SELECT row_number() OVER () AS r, page_id,
    CASE WHEN host <> '' THEN array_to_string(list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')), ',') || ', ' || CASE WHEN path = '' OR path[1] = '?' THEN '/' || path ELSE path END END AS key FROM parts),
hits AS (SELECT r, page_id, action, prefix, count(prefix) OVER (PARTITION BY r) AS n, row_number() OVER (PARTITION BY r ORDER BY length(prefix) DESC) AS k
    FROM keyed LEFT JOIN rules ON starts_with(key, prefix))
SELECT page_id, coalesce(action, 'keep') AS action, prefix AS rule, CAST(n AS INTEGER) AS n_open FROM hits WHERE k = 1
"""

OP4 = f"""
WITH RECURSIVE items AS (SELECT row_number() OVER () AS i, {WORDS} AS w FROM benchmark),
test AS (SELECT DISTINCT least({decontaminate.N}, len(w)) AS k, array_to_string(w[s:s + least({decontaminate.N}, len(w)) - 1], ' ') AS gram
    FROM (SELECT w, unnest(generate_series(1, len(w) - least({decontaminate.N}, len(w)) + 1)) AS s FROM items WHERE len(w) >= {decontaminate.SHORTEST})),
sizes AS (SELECT DISTINCT k FROM test),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS gram FROM (SELECT r, doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT r, doc_id, s - 1 AS s, s - 1 + k AS e FROM win SEMI JOIN test USING (k, gram)),
far AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hits),
runs AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s, e) AS g FROM far)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word, CAST(count(*) AS INTEGER) AS n_windows FROM runs GROUP BY r, doc_id, g
"""

def _groups_sql(vectors: str) -> str:
    return f"""
WITH RECURSIVE v AS ({vectors}),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {embedding_dedup.COSINE}),
reach AS (SELECT DISTINCT a AS x, a AS y FROM pairs UNION SELECT x, b FROM reach JOIN pairs ON y = a)
SELECT x AS vec_id, min(y) AS group_id FROM reach GROUP BY x
"""


OP5 = _groups_sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
MOVED = _groups_sql(f"""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    UNION ALL SELECT -vec_id - 1, CAST(list_concat([CAST(embedding[1] + {SHIFT} AS FLOAT)], embedding[2:]) AS DOUBLE[]) FROM embeddings""")

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, s, md5(array_to_string(w[s:s + {substring_dedup.LENGTH - 1}], ' ')) AS gram FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {substring_dedup.LENGTH - 1})) AS s FROM d WHERE len(w) >= {substring_dedup.LENGTH})),
again AS (SELECT gram FROM win GROUP BY gram HAVING count(*) > 1),
hits AS (SELECT r, doc_id, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM win SEMI JOIN again USING (gram)),
runs AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + {substring_dedup.LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g FROM hits)
SELECT doc_id, CAST(min(s) - 1 AS INTEGER) AS start_word, CAST(max(s) - 1 + {substring_dedup.LENGTH} AS INTEGER) AS end_word FROM runs GROUP BY r, doc_id, g
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, i, l[i] AS line, trim(regexp_replace(lower(l[i]), '[ \\t\\r\\f\\v]+', ' ', 'g')) AS n FROM (SELECT r, doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d)),
often AS (SELECT n FROM x WHERE n <> '' GROUP BY n HAVING count(DISTINCT doc_id) > {line_dedup.MOST}),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (n NOT IN (SELECT n FROM often)) AS text, count(*) FILTER (n IN (SELECT n FROM often)) AS gone FROM x GROUP BY r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(gone, 0) AS INTEGER) AS n_dropped FROM d LEFT JOIN kept USING (r)
"""

ORACLE_SQL = {"op1_url_filters": OP1, "op4_decontamination": OP4, "op5_embedding_dedup": OP5, "embedding_groups_moved": MOVED, "op8_substring_dedup": REPEATS, "op9_line_dedup": OP9, "op10_suffix_dedup": REPEATS}
