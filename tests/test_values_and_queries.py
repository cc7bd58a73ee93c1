"""Value semantics, parsing and the registered queries."""

from __future__ import annotations

import itertools
import os

import pytest
from pyspark.sql import functions as F

from annalist import registry
from annalist.errors import QueryError, TooLarge, ValueTypeError
from annalist.functions import values as V
from annalist.plans import ast
from annalist.plans.query import run
from annalist.sources.tables import TableSource

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize(
    "x,text",
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (1.5, "1.5"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (1e21, "1e+21"), (1.25e22, "1.25e+22"), (123456.789, "123456.789"), (-2.5e-9, "-2.5e-9"), (1e20, "1e+20"), (2.0**63, "9.223372036854776e+18"), (-(2.0**63), "-9223372036854775808"), (-1.5e19, "-1.5e+19"), (9007199254740993.0, "9007199254740992")],
)
def test_canonical_numbers(x, text):
    assert V.canonical_number(x) == text


def test_canonical_json():
    assert V.canonical_json({"b": [1, 1.0, True, None], "a": "é\n", "A": {}}) == '{"A":{},"a":"é\\n","b":[1,1,true,null]}'
    with pytest.raises(TooLarge):
        V.encode({"json": __import__("functools").reduce(lambda x, _: [x], range(80), 1)})


def test_instants():
    assert V.parse_instant("1970-01-01T00:00:01.5Z") == 1_500_000
    assert V.parse_instant("2026-01-01T01:00:00+01:00") == V.parse_instant("2026-01-01T00:00:00Z")
    assert V.render_instant(V.parse_instant("0001-01-01T00:00:00Z")) == "0001-01-01T00:00:00.000000Z"
    for bad in ("2026-13-01T00:00:00Z", "2026-01-01", "2026-01-01T00:00:00", "2026-01-01T00:00:00.0000001Z", 5):
        with pytest.raises(ValueTypeError):
            V.parse_instant(bad)


@pytest.mark.parametrize("bad", [None, 2**63, float("nan"), {"vector": []}, {"vector": ["x"]}, {"bytes": "?"}, {"x": 1}, {"instant": "no"}, "\ud800"])
def test_bad_values(bad):
    with pytest.raises(ValueTypeError):
        V.encode(bad)


def test_integers_and_floats_compare_exactly(spark):
    ints = [0, 1, -1, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
    floats = [0.0, -0.0, 0.5, -0.5, 1.0, 2.0**53, 2.0**63, -(2.0**63), -(2.0**63) * 1.5, 1e300, -1e300, 1e-300, 1.5]
    pairs = list(itertools.product(ints, floats))
    rows = spark.createDataFrame(pairs, "i long, d double").select("i", "d", V.int_float_order(F.col("i"), F.col("d")).alias("o")).collect()
    assert all(r.o == (r.i > r.d) - (r.i < r.d) for r in rows)


@pytest.mark.parametrize(
    "query",
    [
        {"find": ["?x"], "where": [["?e", "a/b", "?y"]]},
        {"find": ["?e"], "where": [["<", "?y", 1], ["?e", "a/b", "?y"]]},
        {"find": ["?e"], "where": [["?e", "a/b", "_"], {"not": [["?x", "a/b", 1]]}]},
        {"find": ["?e"], "where": [["?e", "a/b", "_"], {"or": [[["?e", "a/b", "?x"]], [["?e", "a/b", "?y"]]]}]},
        {"find": [["sum", "?e"], ["pull", "?e", ["a/b"]]], "where": [["?e", "a/b", "_"]]},
        {"find": ["?e"], "where": [["?e", "a/b", "_"]], "extra": 1},
        {"find": ["?e"], "where": [{"rule": ["r", "?e"]}]},
        {"find": ["?e"], "where": [{"rule": ["r", "?e"]}], "rules": [{"head": ["r", "?x"], "body": [{"rule": ["s", "?x"]}]}, {"head": ["s", "?x"], "body": [{"rule": ["r", "?x"]}]}]},
        {"find": ["?e"], "where": [{"rule": ["r", "?e"]}], "rules": [{"head": ["r", "?x"], "body": [["?y", "a/b", 1]]}]},
        {"find": ["?e"], "where": [["?e", "a/b", "_"]], "order": [["?z", "asc"]]},
        {"find": [["sum", "?e"]], "where": [["?e", "a/b", "?z"]], "order": [["?z", "asc"]]},
        {"find": ["?e"], "where": [["?e", "a/b", "_"]], "limit": -1},
        {"find": [["pull", "?e", [42]]], "where": [["?e", "a/b", "_"]]},
        {"find": [], "where": [["?e", "a/b", "_"]]},
        {"find": ["?e"], "where": [["?e", "a/b"]]},
        {"find": ["?e"], "where": [["?e", "a/b", None]]},
    ],
)
def test_what_no_data_can_make_right(query):
    with pytest.raises(QueryError):
        ast.parse(query)


def test_wrong_arguments_and_types(spark):
    source = TableSource(spark, SF)
    with pytest.raises(QueryError):
        run(source, {"find": ["?e"], "where": [["?e", "nation/name", "?n"]], "in": ["?n"]})
    for clause in (["<", "?n", 1], ["contains", "?k", "x"], ["<", "?k", 5]):
        with pytest.raises(QueryError):
            run(source, {"find": ["?k"], "where": [["?k", "nation/name", "?n"], clause]})
    with pytest.raises(QueryError):
        run(source, {"find": [["sum", "?n"]], "where": [["?k", "nation/name", "?n"]]})
    # Nothing gets as far as to be compared.
    assert run(source, {"find": ["?k"], "where": [["?k", "nation/name", "?n"], ["=", "?n", "none"], ["<", "?n", 1]]}).collect() == []
    assert run(source, {"find": ["?k"], "where": [["?k", "nation/name", "?n"], ["=", "?k", 65]]}).collect() == []


def test_plans_prune_columns_and_push_filters(spark):
    source = TableSource(spark, SF)
    df = run(source, {"find": ["?c"], "where": [["?c", "customer/mktsegment", "BUILDING"]]})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "EqualTo(c_mktsegment,BUILDING)" in plan and "Exchange" not in plan


def test_wanted_keys_reach_the_scan(spark):
    source = TableSource(spark, SF)
    for where, pushed in ((["nation:3", "nation/name", "?n"], "EqualTo(n_nationkey,3)"), (["?n", "customer/nation", {"ref": "nation:3"}], "EqualTo(c_nationkey,3)"), (["user:5", "user/last-type", "?n"], "EqualTo(user_id,5)")):
        assert pushed in run(source, {"find": ["?n"], "where": [where]})._jdf.queryExecution().executedPlan().toString()


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_query(spark, oracle, name):
    assert name in registry.ORACLES
    found = registry.QUERIES[name](spark, SF)
    cursor = oracle.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(columns))) for r in found.collect())
    want = sorted(repr(tuple(plain(r[columns.index(c)]) for c in sorted(columns))) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert registry.entry(spark).count() == 25


def test_recursion_from_a_constant_derives_only_what_is_asked(spark, monkeypatch):
    from annalist.plans import compiler
    from annalist.plans.query import run
    from annalist.sources.tables import TableSource

    sizes, write = [], compiler.stored
    monkeypatch.setattr(compiler, "stored", lambda df, tag: sizes.append((tag, (out := write(df, tag)).count())) or out)
    rules = [{"head": ["reach", "?x", "?y"], "body": [["?x", "part/next", "?y"]]}, {"head": ["reach", "?x", "?z"], "body": [["?x", "part/next", "?y"], {"rule": ["reach", "?y", "?z"]}]}]
    for where in ([{"rule": ["reach", {"ref": "part:9"}, "?y"]}], [{"rule": ["reach", "?y", {"ref": "part:9"}]}]):
        sizes.clear()
        got = run(TableSource(spark, "/root/testdata/sf0.001"), {"find": ["?y"], "where": where, "rules": rules}).collect()
        assert sorted(r["y"] for r in got) == sorted(f"part:{k}" for k in range(8, 16))
        assert max(n for _, n in sizes) <= 64  # the eight parts of one ring; the whole closure has 1,600 rows
