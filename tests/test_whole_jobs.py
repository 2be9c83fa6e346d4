"""Queries over small tables whose rows lie where a filter by value, rank or id would lose them."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestrata.plans import catalog


@pytest.fixture
def ask(spark, tmp_path):
    def run(name, **tables):
        for t, rows in tables.items():
            pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{t}.parquet")
        return [tuple(x) for x in catalog.QUERIES[name](spark, str(tmp_path)).collect()]

    return run


def line(supplier, part, quantity=1.0, flag="N", n=1):
    return {"l_orderkey": 1, "l_suppkey": supplier, "l_partkey": part, "l_linenumber": n, "l_quantity": quantity, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": flag}


def part(key, brand="B"):
    return {"p_partkey": key, "p_brand": brand, "p_type": "t", "p_size": 9}


def test_small_lines_use_parts(ask):
    tables = {"lineitem": [line(1, 1), line(1, 2, 50.0), line(2, 2, 7.0), line(2, 3, 7.0, "R")], "part": [part(1), part(2), part(3)]}
    assert ask("inbound_usage", **tables) == [("B", 2, False, 3)]
    places = {f"{p}:{n}" for p in (1, 2, 3) for n in range(1, 8)}
    assert {x[:2] for x in ask("dead_parts_tiered", **tables)} == {("B", x) for x in places - {"1:1", "2:1"}}


def test_small_lines_are_edges(ask):
    tables = {"lineitem": [line(s, 1, float(s)) for s in range(1, 26)] + [line(s, 1, float(s), "R") for s in range(1, 5)], "part": [part(1)]}
    fan = {x[0]: x[1:] for x in ask("fan_in_out", **tables)}
    assert fan["B"] == (25, 4) and fan["s1"] == (1, 1) and fan["s25"] == (0, 1)
    assert ask("blast_hazard", **tables) == [("B", 25, 4, "critical")]


def test_small_lines_make_god_nodes(ask):
    parts = [part(b) for b in range(200)]
    lines = [line(s, 0) for s in range(20)] + [line(s, 0, flag="R") for s in range(20, 40)] + [line(100 + b, b) for b in range(1, 200)]
    assert ask("god_nodes", lineitem=lines, part=parts) == [("p0", 20, 20)]


def test_any_order_uses_a_customer(ask):
    customers = [{"c_custkey": k, "c_name": f"n{k}", "c_nationkey": 1, "c_mktsegment": "BUILDING"} for k in (1, 2, 3)]
    orders = [{"o_custkey": 1, "o_orderpriority": "1-URGENT", "o_orderdate": dt.datetime(2024, 5, 1)}, {"o_custkey": 2, "o_orderpriority": "5-LOW", "o_orderdate": dt.datetime(2023, 6, 9)}]
    assert set(ask("unused_customers", customer=customers, orders=orders)) == {(k, f"n{k}#{m}", "c1") for k in (1, 2, 3) for m in range(1, 13)} - {(1, "n1#5", "c1"), (2, "n2#6", "c1")}


def trade(flows):
    """Tables in which nation a buys from nation b as many lines as flows has for (a, b)."""
    nations = sorted({x for e in flows for x in e})
    lines = [{"l_orderkey": a, "l_suppkey": b} for (a, b), n in flows.items() for _ in range(n)]
    return {
        "lineitem": lines, "orders": [{"o_orderkey": k, "o_custkey": k} for k in nations], "customer": [{"c_custkey": k, "c_nationkey": k} for k in nations], "supplier": [{"s_suppkey": k, "s_nationkey": k} for k in nations],
        "nation": [{"n_nationkey": k, "n_name": f"N{k}", "n_regionkey": int(k > 3)} for k in nations], "region": [{"r_regionkey": 0, "r_name": "AMERICA"}, {"r_regionkey": 1, "r_name": "ASIA"}],
    }


FOURTH = {(0, 1): 4, (0, 2): 4, (0, 3): 4, (0, 4): 1, (4, 0): 1}


@pytest.mark.parametrize("name, want", [
    ("class_closure", {(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (4, 0), (4, 1), (4, 2), (4, 3), (4, 4)}), ("live_closure", {(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)}), ("scc_next_hop", {(0, 0, 4), (4, 0, 0)}),
    ("boundary_violations", {("AMERICA.N0", "ASIA.N4", "america to asia")}), ("trade_scc", {(0, (0, 4), 2)}),
])
def test_fourth_partners_are_edges(ask, name, want):
    got = ask(name, **trade(FOURTH))
    assert {tuple(tuple(c) if isinstance(c, list) else c for c in x[: len(next(iter(want)))]) for x in got} == want


def event(i, user, kind="view", value=50.0, key="k", day=1, hour=0):
    return {"event_id": i, "ts": dt.datetime(2024, 1, day, hour), "user_id": user, "event_type": kind, "value": value, "props": f'{{"{key}": 1}}'}


def test_events_of_any_value_are_names(ask):
    assert ask("intimacy", events=[event(0, 1, value=10.0), event(3, 1, value=95.0), event(4, 1, value=50.0)]) == [(1, "view", ["_k0", "_k1"])]


def test_events_of_any_value_are_items(ask):
    events = [event(i, 2 + i % 2, ["view", "click"][i % 2], 10.0, hour=i) for i in range(4)]
    assert ask("jaccard_divergence", events=events) == [(1, 2, 3, 0, 4)]


def test_events_of_any_value_are_keys_and_calls(ask):
    # 1 reads four keys; 151's event 301 calls user 1 with its view
    events = [event(i, 1, key=k) for i, k in ((3, "a"), (5, "b"), (8, "c"), (9, "d"))] + [event(301, 151)]
    got = {x[:2]: len(x[2]) for x in ask("implicit_schema", events=events)}
    assert got == {(1, "view"): 4, (151, "view"): 5}


@pytest.mark.parametrize("name, want", [
    ("gate_conversion", [(2, 1, 0.5)]), ("regressions", [(1, "view:0")]), ("gate_memory", [(3, "click:0")]), ("suppression", [(3, "click:0")]),
    ("triage_upsert", [(1, "view:0", "debt"), (2, "view:0", "debt"), (3, "purchase:0", "false_positive")]),
])
def test_halves_have_events_of_any_value(ask, name, want):
    # 1 is seen in both halves, 2 in the first and 3 in the second, all at a value of 10
    third = "purchase" if name == "triage_upsert" else "click"
    events = [event(1, 1, value=10.0), event(2, 2, value=10.0), event(3, 1, value=10.0, day=20), event(4, 3, third, 10.0, day=20)]
    assert sorted(ask(name, events=events)) == want


def doc(i, text, n_chars):
    return {"doc_id": i, "text": text, "lang": "en", "source": "src1", "n_chars": n_chars}


def test_every_document_has_a_changed_range(ask):
    # doc_id 1 and 4 are 1 modulo 3; a copy of doc_id d starts at n_chars % 80 + d % 20
    rows = [doc(1, "a b", 3), doc(4, "a b", 3), doc(7, "c", 3), doc(27, "c", 83)]
    assert sorted(ask("provenance", documents=rows)) == [(1, "2 copies in this change"), (7, "2 copies in this change")]


@pytest.mark.parametrize("name", ["diff_interval_join", "diff_filter"])
def test_findings_of_every_document_are_touched(ask, name):
    rows = [doc(i, "1 " + "\n" * 20 + str(i), 0) for i in (1, 2, 4)]
    got = ask(name, documents=rows, lineitem=[line(1, 1)], part=[part(1)])
    assert {x[3] for x in got if x[0] == "smell"} == {"1", "2", "4"}
