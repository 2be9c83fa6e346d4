"""The pipeline over a small table with planted cases, each stage against what it should do."""

import random
from collections import Counter

import corpus_pipeline
from lodestrata.llm import decontaminate, simhash_dedup, token_records


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    r = random.Random(2)
    item = bench.orderBy("item_id").first()["text"]
    words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 999)}" for _ in range(300)]
    near = [("swapped" if i in (40, 200) else w) for i, w in enumerate(words)]
    planted = [(90001, " ".join(words), "en", "src1", 1), (90002, " ".join(near), "en", "src1", 1), (90003, " ".join(words[:20]) + " " + item + " tail", "en", "src1", 1), (90004, "a clean text that shares nothing with others", "en", "src2", 1)]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = at.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_').replace('/', '_')}")
        out = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_').replace('/', '_')}")
        ids = {x[0] for x in out.select("doc_id").collect()}
        if name == "toxicity":
            assert out.columns == at.columns and before * 0.8 < out.count() < before and {90001, 90002, 90003, 90004} <= ids
        if name == "simhash near-dedup":
            assert 90001 in ids and 90002 not in ids and {90003, 90004} <= ids
            assert simhash_dedup.groups(out).count() <= 0.01 * out.count()
        if name == "benchmark decontamination":
            assert 90003 not in ids and 90004 in ids and decontaminate.contaminated_spans(out, bench).count() == 0
        if name == "mixing sources to target weights":
            assert abs(out.count() - at.count()) <= 1 and out.columns == at.columns
        if name == "token-ID / binary output":
            assert out.count() == at.count()
            back = {(x[0], token_records.encoder(token_records.RANKS).decode(x[1])) for x in token_records.read_records(out).collect()}
            assert back == {(x[0], x[1]) for x in at.select("doc_id", "text").collect()}
        at = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, copies int, score double"


def planted(spark, tmp_path, rows, labels, bench):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 0.5) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def through(spark, tmp_path):
    """Rows after each stage, by (doc_id, text); the last stage's index by doc_id."""
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        out.append(Counter((x["doc_id"], x["text"] if "text" in docs.columns else None) for x in docs.collect()))
    return out


def prose(r, n):
    return " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 999)}" for _ in range(n))


def test_odd_rows(spark, tmp_path):
    """Nulls, empty, repeated and very long rows, against what each stage says of them, by plain loops."""
    r = random.Random(6)
    item = prose(r, 20)
    rows = [(i, prose(r, 40), f"s{i % 2}") for i in range(30)]
    rows += [(40, None, "s0"), (40, None, "s0"), (41, "", None), (None, prose(r, 30), "s1"), (None, None, None), (42, rows[3][1], "s1"), (43, rows[4][1], "s0"), (43, rows[4][1], "s0"), (44, prose(r, 5) + " " + item, "s0"), (45, prose(r, 60_000), "s1")]
    planted(spark, tmp_path, rows, [(1, 1, 0), (None, 1, 1), (2, None, None)], [(1, item), (2, None), (3, "")])
    have = Counter((i, t) for i, t, _ in rows)
    a, b, c, d, e = through(spark, tmp_path)
    assert a == have  # labels of one kind only
    assert b == have - Counter({(42, rows[3][1]): 1, (43, rows[4][1]): 2})
    assert c == b - Counter({(44, rows[38][1]): 1})
    assert set(d) <= set(c) and abs(sum(d.values()) - sum(c.values())) <= 1 + 1  # the repeated null row of s0 is drawn alike
    assert sum(e.values()) == sum(d.values()) and {i for i, _ in e} == {i for i, _ in d}


def test_empty_tables(spark, tmp_path):
    planted(spark, tmp_path / "none", [], [], [])
    assert not any(sum(x.values()) for x in through(spark, tmp_path / "none")) and corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    r = random.Random(1)
    rows = [(i, prose(r, 30), "s") for i in range(12)]
    planted(spark, tmp_path / "some", rows, [], [])
    assert [sum(x.values()) for x in through(spark, tmp_path / "some")] == [12] * 5
