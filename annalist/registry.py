"""The registered queries of the fact-graph engine and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import values as V
from annalist.functions.text import bm25, postings, tokens
from annalist.operators import datoms as index
from annalist.operators import schema, search, temporal
from annalist.operators.pull import documents
from annalist.plans.query import run
from annalist.sources.keywords import KeywordIndex
from annalist.sources.tables import ATTRIBUTES, ORDER, SPAN, TURNS, TableSource
from annalist.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: An instant inside the events, as microseconds and as SQL.
MID, MID_SQL = 1705320000000000, "epoch_us(ts) <= 1705320000000000"
LATE = 1705924800000000


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ask(name: str, sql: str, find: list, where: list, args: dict[str, Any] | None = None, then: Callable[[DataFrame], DataFrame] | None = None, **more: Any) -> None:
    """Register a Datalog query; ``then`` shapes its result for the comparison."""
    query = {"find": find, "where": where, **more}

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(TableSource(spark, sf_dir), query, args)
        return then(out) if then else out

    QUERIES[name] = f
    ORACLES[name] = sql


# ---------------------------------------------------------------- patterns, joins, predicates

ask("pattern_scan", "SELECT 'customer:' || c_custkey AS c, c_name AS n FROM customer", ["?c", "?n"], [["?c", "customer/name", "?n"]])
ask("pattern_const", "SELECT DISTINCT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'", ["?c"], [["?c", "customer/mktsegment", "BUILDING"]])
ask("pattern_entity_const", "SELECT n_name AS n FROM nation WHERE n_nationkey = 7", ["?n"], [["nation:7", "nation/name", "?n"]])
ask("pattern_missing_const", "SELECT n_name AS n FROM nation WHERE false", ["?n"], [["no-such:1", "nation/name", "?n"]])
ask("pattern_missing_attribute", "SELECT n_name AS n FROM nation WHERE false", ["?n"], [["?e", "nation/name", "?n"], ["?e", "nation/unheard-of", "?x"]])
ask("pattern_transaction", "SELECT 'region:' || r_regionkey AS e, 1 AS tx, true AS added FROM region", ["?e", "?tx", "?added"], [["?e", "region/name", "_", "?tx", "?added"]],
    then=lambda df: df.select("e", F.regexp_replace("tx", "region:", "").cast("int").alias("tx"), "added"))
ask("wildcard_semi", "SELECT DISTINCT 'nation:' || c_nationkey AS k FROM customer", ["?k"], [["?k", "nation/name", "_"], ["_", "customer/nation", "?k"]])
ask("variable_attribute", "SELECT 'nation:3' AS e, 'nation/name' AS a, n_name AS v FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'nation:3', 'nation/region', 'region:' || n_regionkey FROM nation WHERE n_nationkey = 3",
    ["?a", "?v"], [["nation:3", "?a", "?v"]],
    then=lambda df: df.select(F.lit("nation:3").alias("e"), "a", F.coalesce("v.s", F.concat(F.lit("region:"), F.col("v.i").cast("string"))).alias("v")))
ask("unify_repeated", "SELECT 'part:' || p_partkey AS p FROM part WHERE p_partkey - p_partkey % 8 + (p_partkey + 1) % 8 = p_partkey", ["?p"], [["?p", "part/next", "?p"]])
ask("join_two_hop", "SELECT 'customer:' || c_custkey AS c, n_name AS n, r_name AS r FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    ["?c", "?n", "?r"], [["?c", "customer/nation", "?k"], ["?k", "nation/name", "?n"], ["?k", "nation/region", "?g"], ["?g", "region/name", "?r"]])
ask("join_three_hop", "SELECT DISTINCT r_name AS r, o_orderpriority AS p FROM orders, customer, nation, region WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    ["?r", "?p"], [["?o", "orders/orderpriority", "?p"], ["?o", "orders/cust", "?c"], ["?c", "customer/nation", "?k"], ["?k", "nation/region", "?g"], ["?g", "region/name", "?r"]])
ask("join_self_refs", "SELECT DISTINCT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name < b.n_name",
    ["?x", "?y"], [["?a", "nation/region", "?r"], ["?b", "nation/region", "?r"], ["?a", "nation/name", "?x"], ["?b", "nation/name", "?y"], ["<", "?x", "?y"]])
ask("cross_theta", "SELECT n_name AS n, r_name AS r FROM nation, region WHERE n_name > r_name", ["?n", "?r"], [["?a", "nation/name", "?n"], ["?b", "region/name", "?r"], [">", "?n", "?r"]])
ask("pred_eq", "SELECT 'part:' || p_partkey AS p FROM part WHERE p_size = 7", ["?p"], [["?p", "part/size", "?s"], ["=", "?s", 7]])
ask("pred_not_eq", "SELECT 'part:' || p_partkey AS p FROM part WHERE p_size <> 7", ["?p"], [["?p", "part/size", "?s"], ["!=", "?s", 7]])
ask("pred_range", "SELECT 'part:' || p_partkey AS p, p_retailprice AS v FROM part WHERE p_retailprice >= 1000 AND p_retailprice < 1200.5", ["?p", "?v"], [["?p", "part/retailprice", "?v"], [">=", "?v", 1000], ["<", "?v", 1200.5]])
ask("pred_contains", "SELECT 'documents:' || doc_id AS d FROM documents WHERE contains(text, 'tion of')", ["?d"], [["?d", "documents/text", "?t"], ["contains", "?t", "tion of"]])
ask("pred_starts_with", "SELECT 'part:' || p_partkey AS p FROM part WHERE starts_with(p_name, 'part 1') OR starts_with(p_name, 'Part')", ["?p"], [["?p", "part/name", "?n"], {"or": [[["starts-with", "?n", "part 1"]], [["starts-with", "?n", "Part"]]]}])
ask("pred_numeric_mixed", "SELECT 'part:' || p_partkey AS p FROM part WHERE p_size::DOUBLE = 12.0 OR p_size::DOUBLE > 48.5", ["?p"], [["?p", "part/size", "?s"], {"or": [[["=", "?s", 12.0]], [[">", "?s", 48.5]]]}])
ask("pred_instant", "SELECT 'orders:' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'", ["?o"], [["?o", "orders/orderdate", "?d"], [">=", "?d", {"instant": "1996-01-01T00:00:00Z"}]])
ask("not_exists", "SELECT 'customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", ["?c"], [["?c", "customer/name", "_"], {"not": [["?o", "orders/cust", "?c"]]}])
ask("not_local_var", "SELECT 'customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    ["?c"], [["?c", "customer/name", "_"], {"not": [["?o", "orders/cust", "?c"], ["?o", "orders/totalprice", "?t"], [">", "?t", "?min"]]}], args={"min": 100000.0}, **{"in": ["?min"]})
ask("not_missing_label", "SELECT 'documents:' || d.doc_id AS d FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id", ["?d"], [["?d", "documents/lang", "_"], {"not": [["?d", "documents/quality", "_"]]}])
ask("or_union", "SELECT 'part:' || p_partkey AS p FROM part WHERE p_size = 1 OR p_brand = 'Brand#11'", ["?p"], [["?p", "part/name", "_"], {"or": [[["?p", "part/size", 1]], [["?p", "part/brand", "Brand#11"]]]}])
ask("or_binds", "SELECT 'customer:' || c_custkey AS e, c_name AS n FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier WHERE s_nationkey = 4",
    ["?e", "?n"], [{"or": [[["?e", "customer/nation", {"ref": "nation:4"}], ["?e", "customer/name", "?n"]], [["?e", "supplier/nation", {"ref": "nation:4"}], ["?e", "supplier/name", "?n"]]]}])
ask("in_args", "SELECT 'orders:' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000.0", ["?o"], [["?o", "orders/orderstatus", "?s"], ["?o", "orders/totalprice", "?t"], [">", "?t", "?min"]], args={"s": "F", "min": 200000.0}, **{"in": ["?s", "?min"]})

# ---------------------------------------------------------------- aggregates, order

ask("agg_count", "SELECT n_name AS n, count(*) AS count_c FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY 1", ["?n", ["count", "?c"]], [["?c", "customer/nation", "?k"], ["?k", "nation/name", "?n"]])
ask("agg_count_distinct", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS count_distinct_c FROM orders GROUP BY 1", ["?s", ["count-distinct", "?c"]], [["?o", "orders/orderstatus", "?s"], ["?o", "orders/cust", "?c"]])
ask("agg_sum_int", "SELECT p_brand AS b, sum(p_size)::BIGINT AS sum_s FROM part GROUP BY 1", ["?b", ["sum", "?s"]], [["?p", "part/brand", "?b"], ["?p", "part/size", "?s"]])
ask("agg_sum_float", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS sum_q, round(sum(l_extendedprice), 0) AS sum_p FROM lineitem GROUP BY 1, 2",
    ["?f", "?s", ["sum", "?q"], ["sum", "?p"]], [["?l", "lineitem/returnflag", "?f"], ["?l", "lineitem/linestatus", "?s"], ["?l", "lineitem/quantity", "?q"], ["?l", "lineitem/extendedprice", "?p"]],
    then=lambda df: df.select("f", "s", F.round("sum_q", 2).alias("sum_q"), F.round("sum_p", 0).alias("sum_p")))
ask("agg_sum_set", "SELECT sum(x) AS sum_q FROM (SELECT DISTINCT l_quantity AS x FROM lineitem)", [["sum", "?q"]], [["_", "lineitem/quantity", "?q"]])
ask("agg_avg", "SELECT c_mktsegment AS m, round(avg(c_acctbal), 4) AS avg_b FROM customer GROUP BY 1", ["?m", ["avg", "?b"]], [["?c", "customer/mktsegment", "?m"], ["?c", "customer/acctbal", "?b"]], then=lambda df: df.select("m", F.round("avg_b", 4).alias("avg_b")))
ask("agg_min_max", "SELECT p_brand AS b, min(p_size)::BIGINT AS min_s, max(p_retailprice) AS max_v FROM part GROUP BY 1", ["?b", ["min", "?s"], ["max", "?v"]], [["?p", "part/brand", "?b"], ["?p", "part/size", "?s"], ["?p", "part/retailprice", "?v"]])
ask("agg_group_multi", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS count_o FROM orders GROUP BY 1, 2", ["?s", "?p", ["count", "?o"]], [["?o", "orders/orderstatus", "?s"], ["?o", "orders/orderpriority", "?p"]])
ask("agg_empty", "SELECT count(*) AS count_p, sum(p_size)::BIGINT AS sum_s, max(p_size)::BIGINT AS max_s FROM part WHERE p_size < -5", [["count", "?p"], ["sum", "?s"], ["max", "?s"]], [["?p", "part/size", "?s"], ["<", "?s", -5]])
ask("agg_empty_grouped", "SELECT p_brand AS b, count(*) AS count_p FROM part WHERE p_size < -5 GROUP BY 1", ["?b", ["count", "?p"]], [["?p", "part/size", "?s"], ["?p", "part/brand", "?b"], ["<", "?s", -5]])
ask("order_limit_offset", "SELECT 'orders:' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, 'orders:' || o_orderkey LIMIT 15 OFFSET 5", ["?o", "?t"], [["?o", "orders/totalprice", "?t"]], order=[["?t", "desc"], ["?o", "asc"]], limit=15, offset=5)
ask("order_unprojected", "SELECT c_name AS n FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 10", ["?n"], [["?c", "customer/name", "?n"], ["?c", "customer/acctbal", "?b"]], order=[["?b", "desc"], ["?n", "asc"]], limit=10)
ask("order_by_aggregate", "SELECT n_name AS n, count(*) AS count_s FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", ["?n", ["count", "?s"]], [["?s", "supplier/nation", "?k"], ["?k", "nation/name", "?n"]], order=[["count(?s)", "desc"], ["?n", "asc"]], limit=5)

# An integer and a float attribute meet in one variable: sizes and prices, and names beside them.
_MIXED = {"or": [[["?p", "part/size", "?v"]], [["?p", "part/retailprice", "?v"]]]}
_ANY = {"or": [[["?p", "part/size", "?v"]], [["?p", "part/retailprice", "?v"]], [["?p", "part/name", "?v"]], [["?p", "part/next", "?v"]]]}
_MIXED_SQL = "WITH m AS (SELECT p_partkey AS k, p_brand AS b, p_size::DOUBLE AS v, 2 AS t FROM part UNION ALL SELECT p_partkey, p_brand, p_retailprice, 3 FROM part) "


def _number() -> Column:
    return F.coalesce(F.col("v.d"), F.col("v.i").cast("double"))


ask("order_mixed", _MIXED_SQL + "SELECT 'part:' || k AS p, v, t FROM (SELECT *, row_number() OVER (ORDER BY v, 'part:' || k) AS n FROM m) WHERE n > 20 AND n <= 2100",
    ["?p", "?v"], [_MIXED], order=[["?v", "asc"], ["?p", "asc"]], limit=2080, offset=20, then=lambda df: df.select("p", _number().alias("v"), F.col("v.t").cast("int").alias("t")))
ask("order_mixed_kinds", "WITH m AS (SELECT p_partkey AS k, 1 AS c, p_size::DOUBLE AS v, '' AS s FROM part UNION ALL SELECT p_partkey, 1, p_retailprice, '' FROM part UNION ALL SELECT p_partkey, 2, 0, p_name FROM part UNION ALL SELECT p_partkey, 3, 0, 'part:' || (p_partkey - p_partkey % 8 + (p_partkey + 1) % 8) FROM part WHERE p_partkey - p_partkey % 8 + (p_partkey + 1) % 8 IN (SELECT p_partkey FROM part)), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, v DESC, s DESC, 'part:' || k DESC) AS n FROM m) SELECT 'part:' || k AS p, n, c FROM r",
    ["?p", "?v"], [_ANY], order=[["?v", "desc"], ["?p", "desc"]],
    then=lambda df: df.select("p", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("n"), F.when(F.col("v.t").isin(V.INT, V.FLOAT), 1).when(F.col("v.t") == V.REF, 3).otherwise(2).alias("c")))
ask("agg_mixed_min_max", _MIXED_SQL + "SELECT b, min(v) AS least, 2 AS least_t, max(v) AS most, 3 AS most_t FROM m GROUP BY b", ["?b", ["min", "?v"], ["max", "?v"]], [["?p", "part/brand", "?b"], _MIXED],
    then=lambda df: df.select("b", F.col("min_v.i").cast("double").alias("least"), F.col("min_v.t").cast("int").alias("least_t"), F.col("max_v.d").alias("most"), F.col("max_v.t").cast("int").alias("most_t")))
ask("agg_mixed_sum", _MIXED_SQL + "SELECT b, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, count(*) AS n FROM m GROUP BY b", ["?b", ["sum", "?v"], ["avg", "?v"], ["count", "?v"]], [["?p", "part/brand", "?b"], _MIXED],
    then=lambda df: df.select("b", F.round("sum_v.d", 2).alias("total"), F.round("avg_v", 4).alias("mean"), F.col("count_v").alias("n")))
ask("agg_mixed_sum_of_integers", "SELECT p_brand AS b, sum(p_size)::BIGINT AS total, 2 AS t FROM part GROUP BY 1", ["?b", ["sum", "?v"]], [["?p", "part/brand", "?b"], _MIXED, ["?p", "part/size", "?s"], ["=", "?v", "?s"]],
    then=lambda df: df.select("b", F.col("sum_v.i").alias("total"), F.col("sum_v.t").cast("int").alias("t")))

# ---------------------------------------------------------------- rules

_REGION = [{"head": ["in-region", "?x", "?r"], "body": [["?x", "customer/nation", "?k"], ["?k", "nation/region", "?g"], ["?g", "region/name", "?r"]]}]
ask("rule_view", "SELECT c_name AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = (SELECT min(r_name) FROM region WHERE r_regionkey = 1)",
    ["?n"], [["region:1", "region/name", "?r"], {"rule": ["in-region", "?c", "?r"]}, ["?c", "customer/name", "?n"]], rules=_REGION)
ask("rule_union", "SELECT DISTINCT n_name AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) OR n_nationkey IN (SELECT s_nationkey FROM supplier)",
    ["?n"], [{"rule": ["used", "?k"]}, ["?k", "nation/name", "?n"]], rules=[{"head": ["used", "?k"], "body": [["_", "customer/nation", "?k"]]}, {"head": ["used", "?k"], "body": [["_", "supplier/nation", "?k"]]}])
_REACH = [{"head": ["reach", "?x", "?y"], "body": [["?x", "{}", "?y"]]}, {"head": ["reach", "?x", "?z"], "body": [["?x", "{}", "?y"], {"rule": ["reach", "?y", "?z"]}]}]


def _reach(attribute: str) -> list:
    import json

    return json.loads(json.dumps(_REACH).replace("{}", attribute))


ask("rule_recursive", "SELECT 'conversations:' || a.conv_id || '-' || a.turn AS x, 'conversations:' || b.conv_id || '-' || b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = a.conv_id)",
    ["?x", "?y"], [{"rule": ["reach", "?x", "?y"]}, {"not": [["?w", "conversations/next", "?x"]]}], rules=_reach("conversations/next"))
ask("rule_recursive_cyclic", "WITH RECURSIVE e AS (SELECT p_partkey AS x, p_partkey - p_partkey % 8 + (p_partkey + 1) % 8 AS y FROM part WHERE p_partkey - p_partkey % 8 + (p_partkey + 1) % 8 IN (SELECT p_partkey FROM part)), r AS (SELECT x, y FROM e UNION SELECT e.x, r.y FROM e JOIN r ON e.y = r.x) SELECT 'part:' || x AS x, count(*) AS count_y FROM r GROUP BY 1",
    ["?x", ["count", "?y"]], [{"rule": ["reach", "?x", "?y"]}], rules=_reach("part/next"))

ask("rule_recursive_from", "SELECT 'part:' || p_partkey AS y FROM part WHERE p_partkey BETWEEN 8 AND 15", ["?y"], [{"rule": ["reach", {"ref": "part:9"}, "?y"]}], rules=_reach("part/next"))
ask("rule_recursive_to", "SELECT 'part:' || p_partkey AS x FROM part WHERE p_partkey BETWEEN 8 AND 15", ["?x"], [{"rule": ["reach", "?x", {"ref": "part:9"}]}], rules=_reach("part/next"))

# ---------------------------------------------------------------- time

_FOLD = "WITH c AS (SELECT user_id, epoch_us(ts) AS tx, event_type AS v FROM events), k AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY tx) AS p FROM c), f AS (SELECT user_id, v, tx, lead(tx) OVER (PARTITION BY user_id ORDER BY tx) AS rx FROM k WHERE p IS NULL OR p <> v) "


def _last_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TableSource(spark, sf_dir).intervals("user/last-type")


def _user(df: DataFrame, *columns: Any) -> DataFrame:
    return df.select((F.col("e") % SPAN).alias("user_id"), *columns)


@register(_FOLD + "SELECT user_id, v, tx FROM f WHERE rx IS NULL")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(temporal.visible(_last_type(spark, sf_dir)), "v", "tx")


@register(_FOLD + f"SELECT user_id, v, tx FROM f WHERE tx <= {MID} AND (rx IS NULL OR rx > {MID})")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(temporal.visible(_last_type(spark, sf_dir), MID), "v", "tx")


@register(_FOLD + f"SELECT 'user:' || user_id AS u, v AS t FROM f WHERE tx <= {MID} AND (rx IS NULL OR rx > {MID})")
def as_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(TableSource(spark, sf_dir).at(LATE).at(MID), {"find": ["?u", "?t"], "where": [["?u", "user/last-type", "?t"]]})


@register(_FOLD + f"SELECT user_id, v, tx, CASE WHEN rx <= {MID} THEN rx END AS rx FROM f WHERE tx <= {MID}")
def history_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(temporal.history(_last_type(spark, sf_dir), basis=MID), "v", "tx", "rx")


@register(_FOLD + "SELECT user_id, v, tx, true AS added FROM f UNION ALL SELECT user_id, v, rx, false FROM f WHERE rx IS NOT NULL")
def history_added_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(temporal.datoms(_last_type(spark, sf_dir)), "v", "tx", "added")


ask("history_source", _FOLD + "SELECT 'user:' || user_id AS u, v AS t, false AS added, count(*) AS count_tx FROM f WHERE rx IS NOT NULL GROUP BY 1, 2", ["?u", "?t", "?added", ["count", "?tx"]], [["?u", "user/last-type", "?t", "?tx", "?added"], ["=", "?added", False]], source="history")


@register(_FOLD + f"SELECT 'asserted' AS side, user_id, v, tx AS at FROM f WHERE tx > {MID} AND tx <= {LATE} UNION ALL SELECT 'retracted', user_id, v, rx FROM f WHERE rx > {MID} AND rx <= {LATE}")
def diff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    asserted, retracted = temporal.diff(_last_type(spark, sf_dir), MID, LATE)
    return _user(asserted, F.lit("asserted").alias("side"), "v", F.col("tx").alias("at")).unionByName(_user(retracted, F.lit("retracted").alias("side"), "v", F.col("rx").alias("at")))


@register(_FOLD + f"SELECT user_id, v, tx AS at FROM f WHERE tx > {LATE}")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(temporal.diff(_last_type(spark, sf_dir), LATE, 2**62)[0], "v", F.col("tx").alias("at"))


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return TableSource(spark, sf_dir).table("events").select(at.alias("tx"), at.alias("at"), F.concat(F.lit("user:"), F.col("user_id")).alias("by"), F.col("event_type").alias("source"))


@register(_FOLD + "SELECT f.user_id, v, tx, a.event_type AS source, b.event_type AS rx_source FROM f JOIN events a ON epoch_us(a.ts) = tx LEFT JOIN events b ON epoch_us(b.ts) = rx")
def why_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(temporal.with_provenance(_last_type(spark, sf_dir), _transactions(spark, sf_dir)), "v", "tx", "source", "rx_source")


@register("SELECT epoch_us(ts) AS tx, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS basis_tx, 'user:' || user_id AS \"by\" FROM events")
def receipt_prior_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _transactions(spark, sf_dir).select("tx", F.lag("tx").over(Window.partitionBy("by").orderBy("tx")).alias("basis_tx"), "by")


@register(f"SELECT max(epoch_us(ts)) AS basis FROM events WHERE {MID_SQL}")
def basis_at_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transactions(spark, sf_dir).where(F.col("at") <= MID).agg(F.max("tx").alias("basis"))


# ---------------------------------------------------------------- index pages, pull


def _physical(source: TableSource, names: list[str]) -> DataFrame:
    """The facts of some attributes in the physical layout."""
    out = None
    for n in names:
        s = V.to_struct(ATTRIBUTES[n].kind, F.col("v"))
        rows = source.intervals(n).select(F.abs(F.xxhash64("e", F.lit(n), "tx")).alias("id"), "e", F.lit(source.attribute_id(n)).cast("long").alias("a"), *(s[c].alias(c) for c in ("t", "i", "d", "s", "b", "f")), "tx", "rx")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("SELECT n_nationkey AS k, n_name AS s, n_regionkey AS r FROM nation ORDER BY 1 LIMIT 12")
def datoms_eavt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, order = index.index_rows(_physical(TableSource(spark, sf_dir), ["nation/name", "nation/region"]), "eavt", [], basis=9)
    top = rows.orderBy(*order).limit(24)
    return top.groupBy((F.col("e") % SPAN).alias("k")).agg(F.max("s").alias("s"), F.max("i").cast("int").alias("r"))


@register("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 20")
def datoms_avet_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    rows, order = index.index_rows(_physical(source, ["supplier/acctbal", "supplier/name"]), "avet", [source.attribute_id("supplier/acctbal")], basis=9)
    return rows.orderBy(*order).limit(20).select((F.col("e") % SPAN).alias("k"), F.col("d").alias("v"))


@register("SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 3")
def datoms_vaet(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    rows, _ = index.index_rows(_physical(source, ["supplier/nation"]), "vaet", [source.entity("nation:3")], basis=9)
    return rows.select((F.col("e") % SPAN).alias("k"))


@register("SELECT n_nationkey AS k, n_name AS s FROM nation ORDER BY 1 LIMIT 7 OFFSET 7")
def datoms_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _physical(TableSource(spark, sf_dir), ["nation/name"])
    _, cursor = index.page(facts, "eavt", limit=7, basis=9)
    rows, _ = index.page(facts, "eavt", limit=7, cursor=cursor, basis=9)
    return spark.createDataFrame([(r["e"] % SPAN, r["s"]) for r in rows], "k long, s string")


@register("""SELECT 'region:' || r_regionkey AS e, '{"region/name":"' || r_name || '"}' AS doc FROM region""")
def pull_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    return _named(source, documents(source, source.scan("region/name").df.select("e"), ["region/name"]))


def _named(source: TableSource, df: DataFrame) -> DataFrame:
    return source.named(df, "e", "n").select(F.col("n").alias("e"), "doc")


ask("pull_nested", """SELECT n_name AS n, '{"nation/name":"' || n_name || '","nation/region":{"region/name":"' || r_name || '"}}' AS pull_k FROM nation, region WHERE n_regionkey = r_regionkey""",
    ["?n", ["pull", "?k", ["nation/name", {"nation/region": ["region/name"]}]]], [["?k", "nation/name", "?n"]])


@register("""SELECT 'region:' || n_regionkey AS e, '{"nation/_region":[' || string_agg('{"ref":"nation:' || n_nationkey || '"}', ',' ORDER BY 'nation:' || n_nationkey || '"') || ']}' AS doc FROM nation GROUP BY n_regionkey""")
def pull_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    return _named(source, documents(source, source.scan("region/name").df.select("e"), ["nation/_region"]))


# ---------------------------------------------------------------- search


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(TableSource(spark, sf_dir).table("embeddings").where("vec_id = 5").first()["embedding"])


_COSINE = "SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5)) AS c FROM embeddings"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TableSource(spark, sf_dir).scan("embeddings/embedding").df
    return rows.select(F.col("e").alias("fact"), "e", "v")


@register(f"SELECT vec_id, round(c, 9) AS score FROM ({_COSINE}) ORDER BY c DESC, vec_id LIMIT 50")
def vector_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_candidates(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    return found.select((F.col("e") % SPAN).alias("vec_id"), F.round("score", 9).alias("score"))


@register(f"SELECT vec_id, round(c, 9) AS score FROM ({_COSINE}) WHERE label = 3 ORDER BY c DESC, vec_id LIMIT 50")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    allowed = search.filtered(source.scan("embeddings/label").df.select("e"), [source.scan("embeddings/label").df.where("v = 3")])
    found = search.vector_candidates(_vectors(spark, sf_dir).join(allowed, "e", "left_semi"), _query_vector(spark, sf_dir), 10)
    return found.select((F.col("e") % SPAN).alias("vec_id"), F.round("score", 9).alias("score"))


_TOKENS = r"SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ts FROM documents"
_BM25 = f"""WITH t AS ({_TOKENS}), c AS (SELECT doc_id, len(ts) AS dl, len(list_filter(ts, lambda x: x = 'the')) AS a, len(list_filter(ts, lambda x: x = 'ered')) AS b FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c),
    r AS (SELECT doc_id, -(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / m))) AS rank FROM c, s WHERE a > 0 AND b > 0) """


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TableSource(spark, sf_dir).scan("documents/text").df
    return rows.select(F.col("e").alias("fact"), "e", F.col("v").alias("text"))


_indexes: dict[tuple[str, str], KeywordIndex] = {}


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The keyword index of ``documents``, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = KeywordIndex.build(_texts(spark, sf_dir).select("fact", "text"), f"{shared_dir(spark)}/annalist-keywords-{uuid.uuid4().hex}")
    return _indexes[key]


@register(_BM25 + "SELECT doc_id, round(rank, 8) AS rank FROM r")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_index(spark, sf_dir).bm25("the ered").select((F.col("fact") % SPAN).alias("doc_id"), F.round("rank", 8).alias("rank"))


@register(_BM25 + "SELECT doc_id, round(rank, 8) AS rank FROM r")
def bm25_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(_texts(spark, sf_dir).select("fact", "text"), "the ered").select((F.col("fact") % SPAN).alias("doc_id"), F.round("rank", 8).alias("rank"))


@register(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS term FROM ({_TOKENS})) GROUP BY term")
def postings_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(_texts(spark, sf_dir).select("fact", "text")).groupBy("term").agg(F.count("fact").alias("df"), F.sum("tf").cast("long").alias("n"))


@register(_BM25 + f""", k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY rank, doc_id) AS p FROM r QUALIFY p <= 50),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY c DESC, vec_id) AS p FROM ({_COSINE}) QUALIFY p <= 50),
    u AS (SELECT 'x:' || id AS name, sum(1.0 / (60 + p)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY 1)
    SELECT name, round(score, 9) AS score FROM u ORDER BY u.score DESC, name LIMIT 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.placed(search.keyword_candidates(_texts(spark, sf_dir), "the ered", 10, index=keyword_index(spark, sf_dir)), F.col("rank"), F.col("fact"))
    vectors = search.placed(search.vector_candidates(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10), F.desc("score"), F.col("fact"))
    same = [x.select((F.col("e") % SPAN).alias("e"), F.concat(F.lit("x:"), F.col("e") % SPAN).alias("name"), "place") for x in (words, vectors)]
    return search.fused(same, 10).select("name", F.round("score", 9).alias("score"))


@register("""WITH e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
    SELECT DISTINCT b AS e, 1 AS hop FROM x WHERE a = 'nation:2' UNION ALL SELECT DISTINCT y.b, 2 FROM x JOIN x y ON x.b = y.a WHERE x.a = 'nation:2' AND y.b <> 'nation:2'""")
def expand_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    edges = source.scan("nation/region").df.select(F.col("e").alias("fact"), F.col("e").alias("src"), F.col("v").alias("dst"))
    out = search.expand(edges, spark.createDataFrame([(source.entity("nation:2"),)], "e long"), 2)
    return source.named(out, "e", "n").select(F.col("n").alias("e"), "hop")


@register("SELECT count(*) AS n, sum(len(ts)) AS tokens FROM (" + _TOKENS + ")")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("tokens"))


# ---------------------------------------------------------------- schema, counters, write algebra as sets


def _live(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return temporal.visible(_physical(TableSource(spark, sf_dir), names))


@register("SELECT 'customer/acctbal' AS a, count(*) AS live_facts, count(DISTINCT c_custkey) AS entities, 'float' AS types FROM customer UNION ALL SELECT 'customer/nation', count(*), count(DISTINCT c_custkey), 'ref' FROM customer UNION ALL SELECT 'documents/text', count(*), count(DISTINCT doc_id), 'text' FROM documents")
def schema_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    out = schema.observed(_live(spark, sf_dir, ["customer/acctbal", "customer/nation", "documents/text"]))
    return source.named(out, "a", "n").select(F.col("n").alias("a"), "live_facts", "entities", "types")


@register(_FOLD + "SELECT count(*) AS facts, count(*) FILTER (WHERE rx IS NULL) AS live_facts, count(DISTINCT user_id) AS entities, (SELECT count(*) FROM events) AS transactions FROM f")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _last_type(spark, sf_dir).agg(F.count("*").alias("facts"), F.count_if(F.col("rx").isNull()).alias("live_facts"), F.count_distinct("e").alias("entities"))
    return counted.crossJoin(_transactions(spark, sf_dir).agg(F.count("*").alias("transactions")))


@register("SELECT 'documents:' || doc_id AS e, 'documents/quality' AS attribute FROM documents ANTI JOIN labels USING (doc_id)")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    out = schema.missing(source.scan("documents/lang").df, {"documents/quality": source.scan("documents/quality").df, "documents/text": source.scan("documents/text").df})
    return source.named(out, "e", "n").select(F.col("n").alias("e"), "attribute")


@register("SELECT text AS v, count(DISTINCT doc_id) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.unique_violations(TableSource(spark, sf_dir).scan("documents/text").df)


@register("SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1")
def cardinality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    lines = source.scan("lineitem/order").df.select(F.col("e").alias("l"), F.col("v").alias("e")).join(source.scan("lineitem/linenumber").df.select(F.col("e").alias("l"), "v"), "l")
    return schema.cardinality_violations(lines.select("e", "v")).select((F.col("e") % SPAN).alias("k"), "n")


@register("SELECT c_custkey AS e FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    known = source.scan("nation/name").df.select(F.col("e").alias("id"))
    return schema.dangling(source.scan("customer/nation").df.select("e", "v"), known).select((F.col("e") % SPAN).alias("e"))


@register(_FOLD + f"SELECT user_id, 'retract' AS op, v FROM f WHERE tx = (SELECT max(tx) FROM f WHERE tx <= {MID}) AND rx IS NULL UNION ALL SELECT user_id, 'assert', v FROM f WHERE rx = (SELECT max(tx) FROM f WHERE tx <= {MID})")
def undo_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annalist.sources.transact import undo_rows

    facts = _last_type(spark, sf_dir)
    target = facts.where(F.col("tx") <= MID).agg(F.max("tx").alias("target"))
    return _user(undo_rows(facts, target), "op", "v")


@register("SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 3")
def excise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annalist.sources.transact import without_entity

    source = TableSource(spark, sf_dir)
    return without_entity(_physical(source, ["customer/nation"]), source.entity("nation:3")).select((F.col("e") % SPAN).alias("k"))


@register("WITH n AS (SELECT c_name AS name, c_custkey + 1 AS k FROM customer) SELECT n.name, c.c_custkey AS owner FROM n LEFT JOIN customer c ON c.c_name = n.name")
def upsert_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annalist.sources.transact import owner_rows

    names = TableSource(spark, sf_dir).intervals("customer/name")
    return owner_rows(names, names.select("v")).select(F.col("v").alias("name"), (F.col("owner") % SPAN).alias("owner"))


@register(_FOLD + "SELECT user_id, v = 'click' AS fits FROM f WHERE rx IS NULL")
def cas_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annalist.sources.transact import swap_rows

    facts = _last_type(spark, sf_dir)
    return _user(swap_rows(facts, temporal.visible(facts).select("e", F.lit("click").alias("expected"))), "fits")


@register("SELECT event_id, epoch_us(ts) AS at, event_type AS type FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = TableSource(spark, sf_dir)
    out = run(source, {"find": ["?e", "?at", "?type"], "where": [["?e", "events/ts", "?at"], ["?e", "events/event-type", "?type"]]})
    return out.select(F.substring_index("e", ":", -1).cast("long").alias("event_id"), "at", "type")


@register(_FOLD + "SELECT user_id, v, tx, rx FROM f")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user(_last_type(spark, sf_dir), "v", "tx", "rx")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Customers per nation."""
    query = {"find": ["?n", ["count", "?c"]], "where": [["?c", "customer/nation", "?k"], ["?k", "nation/name", "?n"]], "order": [["?n", "asc"]]}
    return run(TableSource(spark, sf_dir), query)
