"""The registered rule table: junk hosts go on every domain, other hosts stay."""

from lodestrata.llm import queries

JUNK = ["casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"]


def test_junk_hosts_go_and_clean_domains_stay(spark, tmp_path):
    hosts = [f"{sub}{name}.example.{top}" for sub in ("", "www.", "m.", "blog.") for name in [*JUNK, "tionsh", "xcasino-win"] for top in ("com", "net", "org")]
    rows = [(i, f"https://{h}/en/12{tail}") for i, (h, tail) in enumerate((h, t) for h in hosts for t in ("", "?page=2", ".html"))]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x["page_id"]: x["action"] for x in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    junk = {i for i, u in rows if any(name in u.replace("xcasino-win", "") for name in JUNK)}
    assert {i for i, a in got.items() if a == "drop"} == junk and len(got) == len(rows)


def test_nested_path_rules_decide(spark, tmp_path):
    rows = [(0, "http://ththan.example.net/en/7"), (1, "http://ththan.example.net/en/6"), (2, "http://ththan.example.net/fr/7"), (3, "http://thther.example.org/fr/1"), (4, "http://thther.example.org/en/1")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x["page_id"]: (x["action"], x["n_open"]) for x in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    assert {i: a for i, (a, _) in got.items()} == {0: "drop", 1: "keep", 2: "keep", 3: "drop", 4: "keep"} and got[0][1] == 2 and got[3][1] == 3
