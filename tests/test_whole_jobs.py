"""Registered queries read every row: small tables with the rows that were once left out."""

from __future__ import annotations

import datetime

import pytest

from annalist import registry
from annalist.plans.query import run
from annalist.sources.tables import TableSource
from annalist.sources.transact import owner_rows, swap_rows


def test_why_provenance_has_users_of_any_id(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    rows = [(1, at(1), 39, "view"), (2, at(2), 40, "view"), (3, at(3), 40, "click"), (4, at(4), 10**6, "buy")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["why_provenance"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.v, r.source, r.rx_source) for r in found) == [(39, "view", "view", None), (40, "click", "click", None), (40, "view", "view", "click"), (10**6, "buy", "buy", None)]


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.mark.parametrize("files", [1, 3])
def test_lines_do_not_share_an_id(spark, tmp_path, files):
    # Equal rows have equal hashes, as different rows have where these collide.
    day = datetime.datetime(1996, 1, 1)
    rows = [(1, 1, 1, 1, 2.0, 10.0, 0.0, 0.0, "A", "F", day)] * 2 + [(k, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "A", "F", day) for k in range(2, 30)]
    path = tmp_path / "a b%20c"
    spark.createDataFrame(rows, LINE).repartition(files).write.parquet(f"{path}/lineitem.parquet")
    found = registry.QUERIES["agg_sum_float"](spark, str(path)).collect()
    assert [tuple(r) for r in found] == [("A", "F", 32.0, 48.0)]
    ids = TableSource(spark, str(path)).intervals("lineitem/quantity")
    assert ids.select("e").distinct().count() == len(rows)


def test_conversations_of_any_size_of_id(spark, tmp_path):
    rows = [(5, 0, "user", "a"), (10**6, 1, "user", "b"), (10**11 + 7, 999_999, "user", "c")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    source = TableSource(spark, str(tmp_path))
    query = {"find": ["?c", "?t"], "where": [["?c", "conversations/role", "user"], ["?c", "conversations/text", "?t"]]}
    assert sorted(map(tuple, run(source, query).collect())) == [("conversations:1000000-1", "b"), ("conversations:100000000007-999999", "c"), ("conversations:5-0", "a")]
    assert [r.t for r in run(source, {"find": ["?t"], "where": [["conversations:100000000007-999999", "conversations/text", "?t"]]}).collect()] == ["c"]


def test_a_conversation_without_room_is_an_error(spark, tmp_path):
    spark.createDataFrame([(2**40, 1, "user", "a")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    with pytest.raises(Exception, match="no id for conversation"):
        TableSource(spark, str(tmp_path)).intervals("conversations/text").collect()


def test_dangling_references_know_every_nation(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}", 0) for k in range(25)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, 3), (2, 20), (3, 24), (4, 25)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert [r.e for r in registry.QUERIES["dangling_references"](spark, str(tmp_path)).collect()] == [4]


FACTS = [(1, "a", None), (2, "b", None), (3, "b", None), (4, "old", 7), (4, "new", None), (5, "gone", 8)]


def test_owners_of_wanted_values(spark):
    facts = spark.createDataFrame(FACTS, "e long, v string, rx long")
    wanted = spark.createDataFrame([(v,) for v in ("a", "b", "old", "new", "gone", "none")], "v string")
    assert sorted(map(tuple, owner_rows(facts, wanted).collect()), key=str) == [("a", 1, 1), ("b", 2, 2), ("b", 3, 2), ("gone", None, 0), ("new", 4, 1), ("none", None, 0), ("old", None, 0)]


def test_what_a_swap_expects(spark):
    facts = spark.createDataFrame([*FACTS, (6, "x", None), (6, "y", None)], "e long, v string, rx long")
    asked = [(1, "a", True), (1, "b", False), (1, None, False), (4, "old", False), (4, "new", True), (5, "gone", False), (5, None, True), (6, "x", False), (6, None, False), (9, None, True), (9, "a", False)]
    found = swap_rows(facts, spark.createDataFrame([x[:2] for x in asked], "e long, expected string")).collect()
    assert {tuple(r) for r in found} == set(asked) and len(found) == len(asked)


@pytest.mark.parametrize("name, function", [("upsert_resolve", "owner_rows"), ("cas_outcome", "swap_rows")])
def test_queries_reach_the_write_algebra(spark, monkeypatch, name, function):
    from annalist.sources import transact

    called = []
    real = getattr(transact, function)
    monkeypatch.setattr(transact, function, lambda *a: called.append(function) or real(*a))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert called == [function]
