"""The registered queries against their SQL, and what must hold of those that SQL can't express, on the smallest tables."""

import duckdb
import pytest
from test_oracle import SF, TABLES, rows

from lodestrata.llm import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = rows(queries.QUERIES[name](spark, SF).toPandas())
    assert got == rows(duck.sql(queries.ORACLE_SQL[name]).df())
    assert got[1] or name == "op5_embedding_dedup"  # the given vectors have no near pair


def test_the_others(spark):
    """op2, op3, op6 and op7 are held against brute force elsewhere; here their queries cover their tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {x[0] for x in docs.select("doc_id").collect()}
    assert {x["doc_id"] for x in queries.op3_token_records(spark, SF).collect()} == ids
    copies = queries.op7_mixing(spark, SF).collect()
    assert {x["doc_id"] for x in copies} == ids and abs(sum(x["copies"] for x in copies) - len(ids)) <= 1
    assert {x["doc_id"] for x in queries.op2_toxicity(spark, SF).collect()} <= ids
    same = {x["doc_id"]: x["group_id"] for x in queries.op6_simhash_dedup(spark, SF).collect()}
    exact = docs.groupBy("text").agg({"doc_id": "collect_list"}).where("count(*) > 1").collect()
    assert exact and all(len({same[i] for i in x[1]}) == 1 for x in exact if x[0] and x[0].strip())
