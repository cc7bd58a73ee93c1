"""Registered queries that go through the versioned store: a store of all regions and nations, its write algebra, logs and views."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.errors import Conflict, EngineError
from annalist.operators import search
from annalist.operators.pull import documents
from annalist.registry import register
from annalist.sources import logs
from annalist.sources.store import Db
from annalist.sources.transact import SYS
from annalist.storage import shared_dir
from annalist.streaming import follow

#: The first tick of a store's clock, which then counts seconds.
START = 1767225600000000
_made: dict[tuple[str, str], Db] = {}
#: Transactions of the store in order: three declarations, two loads, two edits.
_STEPS = "(1, NULL, NULL, 0), (2, NULL, NULL, 1), (3, NULL, NULL, 2), (4, NULL, NULL, 3), (5, 'loader', 'region.parquet', 4), (6, 'loader', 'nation.parquet', 5), (7, 'editor', NULL, 6), (8, 'editor', NULL, 7)"
#: What holds in the end: every fifth nation's rank was raised by 100, nation 3 has none.
_NOW = "SELECT 'nation:' || n_nationkey AS e, n_name AS name, n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 100 ELSE 0 END AS rank, 'region:' || n_regionkey AS r FROM nation WHERE n_nationkey <> 3"
_RANKS = {"find": ["?e", "?name", "?rank", "?r"], "where": [["?e", "nation/name", "?name"], ["?e", "nation/rank", "?rank"], ["?e", "nation/region", "?r"]]}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/annalist-store-{name}-{uuid.uuid4().hex}"


def _new(spark: SparkSession, name: str) -> Db:
    ticks = itertools.count(START, 1_000_000)
    return Db(spark, _place(spark, name), clock=lambda: next(ticks), event_factory=lambda tx: str(uuid.uuid5(uuid.UUID(int=7), f"{name}:{tx}")))


def _rows(spark: SparkSession, sf_dir: str, name: str) -> list[Any]:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").orderBy(f"{name[0]}_{name}key").collect()  # a dimension of a few rows


def store(spark: SparkSession, sf_dir: str) -> Db:
    """All regions and nations as a store, made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        db = _new(spark, "geo")
        db.declare("region/name", type="text", unique=True)
        db.declare("nation/name", type="text", unique=True)
        db.declare("nation/region", type="ref")
        nations = _rows(spark, sf_dir, "nation")
        db.transact([{"id": f"region:{r.r_regionkey}", "region/name": r.r_name} for r in _rows(spark, sf_dir, "region")], by="loader", source="region.parquet")
        db.transact([{"id": f"nation:{r.n_nationkey}", "nation/name": r.n_name, "nation/region": {"ref": f"region:{r.n_regionkey}"}, "nation/rank": r.n_nationkey} for r in nations], by="loader", source="nation.parquet")
        db.transact([{"id": f"nation:{r.n_nationkey}", "nation/rank": r.n_nationkey + 100} for r in nations if r.n_nationkey % 5 == 0], by="editor")
        db.transact(["retract", "nation:3", "nation/rank"], by="editor")
        _made[key] = db
    return _made[key]


def _order(db: Db) -> dict[int, int]:
    """Place of each transaction in the store, from 1 for the first."""
    return {r["tx"]: i + 1 for i, r in enumerate(db.events().select("tx").orderBy("tx").collect())}


def _table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _said(spark: SparkSession, steps: list[tuple[str, Callable[[], dict]]]) -> DataFrame:
    """step and outcome: the status of each write, or the kind of its error."""
    out = []
    for name, step in steps:
        try:
            out.append((name, step()["status"]))
        except EngineError as x:
            out.append((name, type(x).__name__))
    return _table(spark, out, "step string, outcome string")


# ---------------------------------------------------------------- reads of the present, the past and provenance


@register(_NOW)
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).q(_RANKS)


@register("SELECT 'nation:' || n_nationkey AS e, n_name AS name, n_nationkey AS rank, 'region:' || n_regionkey AS r FROM nation")
def store_at_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).at("2026-01-01T00:00:05.500000Z").q(_RANKS)


@register("""SELECT 'region:' || r_regionkey AS e, '{"region/name":"' || r_name || '"}' AS doc FROM region UNION ALL
    SELECT 'nation:' || n_nationkey, '{"nation/name":"' || n_name || '"' || CASE WHEN n_nationkey = 3 THEN '' ELSE ',"nation/rank":' || (n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 100 ELSE 0 END) END || ',"nation/region":{"region/name":"' || r_name || '"}}' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def store_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    every = db.ids().where("name LIKE 'region:%' OR name LIKE 'nation:%'").select(F.col("id").alias("e"), "name")
    return documents(db, every.select("e"), ["*"], depth=2).join(every, "e").select(F.col("name").alias("e"), "doc")


@register("SELECT n_name AS name, n_nationkey AS rank, 'loader' AS \"by\", 'nation.parquet' AS source, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey = 3 THEN 'editor' END AS rx_by FROM nation UNION ALL SELECT n_name, n_nationkey + 100, 'editor', NULL, NULL FROM nation WHERE n_nationkey % 5 = 0")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    names = db.q({"find": ["?e", "?n"], "where": [["?e", "nation/name", "?n"]]})
    out = None
    for r in names.collect():  # a history is one entity's; there are 25
        own = db.history(r["e"], "nation/rank").select(F.lit(r["n"]).alias("name"), F.col("i").cast("int").alias("rank"), "by", "source", "rx_by")
        out = own if out is None else out.unionByName(own)
    return out


@register("SELECT n_name AS name, '{\"sys/at\":{\"instant\":\"2026-01-01T00:00:06.000000Z\"},\"sys/by\":\"editor\"}' AS why FROM nation WHERE n_nationkey = 5")
def store_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    name = db.q({"find": ["?n"], "where": [["nation:5", "nation/name", "?n"]]}).first()["n"]
    return db.why("nation:5", "nation/rank").select(F.lit(name).alias("name"), F.col("transaction").alias("why"))


@register(f"SELECT n, {START} + (n - 1) * 1000000 AS at, u AS \"by\", s AS source, p AS basis FROM (VALUES {_STEPS}) x(n, u, s, p) WHERE n > 1")
def store_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    place = _order(db)
    receipts = [db.receipt(tx) for tx in place if tx > 64]
    return _table(spark, [(place[r["tx"]], r["at"], r.get("by"), r.get("source"), place[r["basis_tx"]]) for r in receipts], "n int, at long, by string, source string, basis int")


@register("SELECT 'nation:' || n_nationkey AS e, 'asserted' AS side, n_nationkey + 100 AS rank FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'nation:' || n_nationkey, 'retracted', n_nationkey FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey = 3")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    since = sorted(_order(db))[5]
    out = None
    for side, rows in zip(("asserted", "retracted"), db.changes(since), strict=True):
        own = db.named(rows.where(F.col("a") == db.id_of("nation/rank")), "e", "n").select(F.col("n").alias("e"), F.lit(side).alias("side"), F.col("i").cast("int").alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out


@register("SELECT attribute, count(*) AS n FROM (SELECT 'region/name' AS attribute FROM region UNION ALL SELECT 'nation/name' FROM nation UNION ALL SELECT 'nation/region' FROM nation UNION ALL SELECT 'nation/rank' FROM nation WHERE n_nationkey <> 3) GROUP BY 1")
def store_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = f"v{uuid.uuid4().hex[:8]}_"
    store(spark, sf_dir).register_views(prefix)
    return spark.sql(f"SELECT attribute, count(*) AS n FROM {prefix}facts_now WHERE attribute LIKE 'region/%' OR attribute LIKE 'nation/%' GROUP BY 1")


@register("SELECT * FROM (VALUES (0, 'pattern', 'avet'), (1, 'predicate', 'barrier'), (2, 'pattern', 'eavt/ea'), (3, 'not', 'barrier'), (4, 'pattern', 'scan')) x(n, clause, access)")
def store_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = store(spark, sf_dir).explain({"find": ["?n"], "where": [["?e", "nation/rank", 7], [">", 2, 1], ["?e", "nation/name", "?n"], {"not": [["?e", "nation/region", "region:1"]]}, ["?x", "?a", "?v"]]})
    return _table(spark, [(i, p["clause"], p["access"]) for i, p in enumerate(plan)], "n int, clause string, access string")


@register("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS named, 4 AS attributes, 8 AS transactions, 18 AS fields, true AS counted")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    s = db.stats()
    named = db.ids().where("name RLIKE '^(region|nation):'").count()
    own = db.ids().where("name RLIKE '^(region|nation)/'").count()
    same = s["facts"] == db.facts().count() and s["live_facts"] == db.live().count() and s["transactions"] == db.events().count()
    return _table(spark, [(named, own, s["transactions"], len(SYS), same)], "named long, attributes long, transactions long, fields long, counted boolean")


# ---------------------------------------------------------------- schema and health


@register("SELECT * FROM (VALUES ('nation/name', 'text', true, 'text'), ('nation/rank', NULL, false, 'int'), ('nation/region', 'ref', false, 'ref'), ('region/name', 'text', true, 'text')) x(name, type, is_unique, seen) JOIN (SELECT 'nation/name' AS name, count(*) AS n FROM nation UNION ALL SELECT 'nation/rank', count(*) FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'nation/region', count(*) FROM nation UNION ALL SELECT 'region/name', count(*) FROM region) USING (name)")
def store_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store(spark, sf_dir).schema()["attributes"]
    return _table(spark, [(x["name"], x["declared"].get("type"), x["effective"]["unique"], ",".join(x["observed"]["types"]), x["observed"]["live_facts"]) for x in found], "name string, type string, is_unique boolean, seen string, n long")


@register("SELECT * FROM (VALUES ('before', true, 2), ('after', true, 0)) x(step, valid, changes)")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir).speculate()
    wanted = db.export_schema()
    wanted["attributes"] = [x | {"declared": x["declared"] | {"doc": "its name"}} if x["name"] == "nation/name" else x for x in wanted["attributes"]]
    wanted["shapes"] = [{"name": "a-nation", "required": ["nation/name", "nation/rank"], "allowed": [], "closed": False}]
    del wanted["digest"]
    before = store(spark, sf_dir).check_schema(wanted)
    db.apply_schema(wanted)
    now = db.export_schema()
    left = [x for x in now["attributes"] + now["shapes"] if x not in wanted["attributes"] + wanted["shapes"]]
    return _table(spark, [("before", before["valid"], len(before["changes"])), ("after", now["digest"] == before["desired_digest"], len(left))], "step string, valid boolean, changes int")


@register("SELECT 'nation:' || n_nationkey AS e, 'required' AS code, 'nation/name' AS attribute, 'SchemaError' AS refused FROM nation WHERE n_regionkey = 1")
def store_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are required; writes keep that, so the names of region 1's nations are ended behind the store's back."""
    db = logs.backup(store(spark, sf_dir), _place(spark, "shapes"))
    names = [r["e"] for r in db.q({"find": ["?e"], "where": [["?e", "nation/name", "_"]]}).collect()]
    db.declare_shape("a-nation", required=["nation/name"])
    shape = db.id_of("a-nation")
    db.transact([], _change=lambda p: [p.add(p.entity(n), SYS["sys/shape"], "ref", shape) for n in names])
    refused = _said(spark, [("retract", lambda: db.transact(["retract", names[0], "nation/name"]))]).first()["outcome"]
    lost = db.facts().where(F.col("a") == db.id_of("nation/name")).join(db.facts().where((F.col("a") == db.id_of("nation/region")) & (F.col("i") == db.id_of("region:1"))).select("e"), "e").collect()
    db._commit([{"kind": "end", "id": r["id"], "rx": db.basis_tx()} for r in lost])
    db.refresh()
    return _table(spark, [(n, v["code"], v["attribute"], refused) for n in names for v in db.validate(n)], "e string, code string, attribute string, refused string")


@register("SELECT * FROM (VALUES ('a fact ends before it begins', 1), ('a live fact is there twice', 1), ('a reference leads nowhere', 1), ('an event does not match its hash', 1), ('fact ids repeat', 1), ('names repeat', 1)) x(problem, n)")
def store_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the store with six damages, and what the doctor finds."""
    healthy = store(spark, sf_dir)
    db = logs.backup(healthy, _place(spark, "damaged"))
    f = db.facts().where(F.col("a") == db.id_of("nation/rank")).orderBy("id").limit(4).collect()
    to = db.facts().where(F.col("a") == db.id_of("nation/region")).first()
    last = db.facts().agg(F.max("id")).first()[0]
    one, tx = f[1], db.basis_tx()

    def fact(**more: Any) -> dict:
        return {"kind": "fact", "e": one["e"], "a": one["a"], "t": one["t"], "tx": one["tx"], **more}

    db._commit([
        fact(id=one["id"], i=901, rx=tx), fact(id=last + 1, i=one["i"]), fact(id=last + 2, i=903, rx=one["tx"]), fact(id=last + 3, a=to["a"], t=to["t"], i=10**9, rx=tx),
        {"kind": "id", "id": tx - 1, "name": "nation:1", "tx": tx}, {"kind": "event", "tx": tx, "event": "damaged", "hash": "0", "data": "{}"},
    ])
    assert healthy.doctor() == []
    found = {p["problem"] for p in db.doctor()}
    known = ("a fact ends before it begins", "a live fact is there twice", "a reference leads nowhere", "an event does not match its hash", "fact ids repeat", "names repeat")
    return _table(spark, [(p, 1) for p in known if p in found], "problem string, n int")


# ---------------------------------------------------------------- the write algebra


@register("SELECT 'nation:' || n_nationkey AS e, 'the ' || n_name AS note FROM nation UNION ALL SELECT 'new', 'the Land of Nowhere'")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir).speculate()
    names = [r["n"] for r in db.q({"find": ["?n"], "where": [["_", "nation/name", "?n"]]}).collect()]
    db.transact([{"nation/name": n, "nation/note": f"the {n}"} for n in [*names, "Land of Nowhere"]])
    out = db.q({"find": ["?e", "?note"], "where": [["?e", "nation/note", "?note"]]})
    return out.select(F.when(F.col("e").startswith("nation:"), F.col("e")).otherwise("new").alias("e"), "note")


@register("SELECT 'region:' || r_regionkey AS e, CASE WHEN r_regionkey % 2 = 0 THEN 'applied' ELSE 'Conflict' END AS outcome, CASE WHEN r_regionkey % 2 = 0 THEN 'New ' || r_name ELSE r_name END AS name FROM region")
def store_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir).speculate()
    out = {}
    for r in db.q({"find": ["?e", "?n"], "where": [["?e", "region/name", "?n"]]}).collect():
        right = int(r["e"].split(":")[1]) % 2 == 0
        try:
            out[r["e"]] = db.transact(["cas", r["e"], "region/name", r["n"] if right else "something else", f"New {r['n']}"])["status"]
        except Conflict:
            out[r["e"]] = "Conflict"
    now = db.q({"find": ["?e", "?n"], "where": [["?e", "region/name", "?n"]]}).collect()
    return _table(spark, [(r["e"], out[r["e"]], r["n"]) for r in now], "e string, outcome string, name string")


@register("SELECT 'city ' || n_nationkey AS city, n_name AS nation FROM nation")
def store_tempids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new city for each nation, known by a temporary id that its mayor refers to, found by a lookup of the nation's name."""
    db = store(spark, sf_dir).speculate()
    nations = db.q({"find": ["?e", "?n"], "where": [["?e", "nation/name", "?n"]]}).collect()
    records = []
    for r in nations:
        key = r["e"].split(":")[1]
        records += [{"id": {"tmp": f"c{key}"}, "city/name": f"city {key}", "city/nation": {"ref": r["e"]}}, {"id": f"mayor:{key}", "mayor/of": {"tmp": f"c{key}"}}]
    report = db.transact(records)
    assert set(report["ids"]) == {f"c{r['e'].split(':')[1]}" for r in nations}
    return db.q({"find": ["?c", "?n"], "where": [["?m", "mayor/of", "?t"], ["?t", "city/name", "?c"], ["?t", "city/nation", "?k"], ["?k", "nation/name", "?n"]]}).select(F.col("c").alias("city"), F.col("n").alias("nation"))


@register("SELECT * FROM (VALUES ('first', 'applied'), ('again', 'already_applied'), ('another request', 'Conflict'), ('nothing new', 'noop'), ('a stale basis', 'Conflict'), ('an unknown entity', 'NotFound'), ('a system attribute', 'SchemaError'), ('two values of one', 'Conflict'), ('a second owner', 'Conflict'), ('a wrong type', 'SchemaError'), ('a null', 'ValueTypeError')) x(step, outcome)")
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir).speculate()
    basis = db.basis_tx()
    record = {"id": "nation:1", "nation/rank": 501}
    taken = db.q({"find": ["?n"], "where": [["nation:2", "nation/name", "?n"]]}).first()["n"]
    return _said(spark, [
        ("first", lambda: db.transact(record, operation_id="op-1")),
        ("again", lambda: db.transact(record, operation_id="op-1", if_basis_tx=1)),
        ("another request", lambda: db.transact({"id": "nation:1", "nation/rank": 502}, operation_id="op-1")),
        ("nothing new", lambda: db.transact(record)),
        ("a stale basis", lambda: db.transact({"id": "nation:1", "nation/rank": 503}, if_basis_tx=basis)),
        ("an unknown entity", lambda: db.transact(["retract", "nation:none"])),
        ("a system attribute", lambda: db.transact({"id": "nation:1", "sys/by": "x"})),
        ("two values of one", lambda: db.transact([{"id": "nation:1", "nation/rank": 1}, {"id": "nation:1", "nation/rank": 2}])),
        ("a second owner", lambda: db.transact({"id": "nation:1", "nation/name": taken})),
        ("a wrong type", lambda: db.transact({"id": "nation:1", "nation/name": 7})),
        ("a null", lambda: db.transact({"id": "nation:1", "nation/rank": None})),
    ])


@register("SELECT side, e, rank FROM (SELECT 'store' AS side, e, rank FROM (" + _NOW + ") UNION ALL SELECT 'trial', 'nation:' || n_nationkey, -1 FROM nation)")
def store_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    trial = db.speculate()
    names = [r["e"] for r in db.q({"find": ["?e"], "where": [["?e", "nation/name", "_"]]}).collect()]
    trial.transact([{"id": n, "nation/rank": -1} for n in names])
    ranks = {"find": ["?e", "?rank"], "where": [["?e", "nation/rank", "?rank"]]}
    return trial.q(ranks).select(F.lit("trial").alias("side"), "e", "rank").unionByName(db.q(ranks).select(F.lit("store").alias("side"), "e", "rank"))


@register("SELECT 'nation:' || n_nationkey AS e, n_nationkey AS rank, 'undone' AS note FROM nation WHERE n_nationkey % 5 = 0")
def store_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = logs.backup(store(spark, sf_dir), _place(spark, "undo"))
    edit = sorted(_order(db))[6]
    report = db.undo(edit, by="editor")
    assert json.loads(documents(db, _table(spark, [(report["tx"],)], "e long"), ["*"]).first()["doc"])["sys/undoes"] == {"ref": edit}
    back = {db._shown(f.e) for f in [db._fact(r) for r in db.facts().where(F.col("tx") == report["tx"]).collect()] if f.a == db.id_of("nation/rank")}
    return db.q({"find": ["?e", "?rank"], "where": [["?e", "nation/rank", "?rank"]]}).where(F.col("e").isin(sorted(back))).select("e", "rank", F.lit("undone").alias("note"))


@register("SELECT 'nation:' || n_nationkey AS e, n_name AS name, 2 AS redacted FROM nation WHERE n_regionkey <> 2")
def store_excise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without region 2: no fact refers to it any more, and of its events (its load, and that of its nations) only hashes are left."""
    db = logs.backup(store(spark, sf_dir), _place(spark, "excise"))
    report = db.excise("region:2")
    gone = {r["event"] for r in db.events().where("data IS NULL").collect()}
    assert gone == set(report["redacts"]) and db.doctor() == []
    out = db.q({"find": ["?e", "?name"], "where": [["?e", "nation/name", "?name"], ["?e", "nation/region", "_"]]})
    return out.select("e", "name", F.lit(len(gone)).alias("redacted"))


@register("SELECT 'nation:' || n_nationkey AS e, n_name AS name, (SELECT count(*) FROM nation) // 10 + CASE WHEN (SELECT count(*) FROM nation) % 10 > 0 THEN 1 ELSE 0 END AS batches FROM nation")
def store_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _new(spark, "ingest")
    lines = [r["line"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.to_json(F.struct(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("nation/name"))).alias("line")).collect()]
    reports = logs.ingest(db, lines, batch_size=10, operation_id="load")
    again = logs.ingest(db, lines, batch_size=10, operation_id="load")
    assert {r["status"] for r in again} == {"already_applied"}
    return db.q({"find": ["?e", "?n"], "where": [["?e", "nation/name", "?n"]]}).select("e", F.col("n").alias("name"), F.lit(len(reports)).cast("long").alias("batches"))


# ---------------------------------------------------------------- logs and streams


@register("SELECT n, CASE n WHEN 5 THEN (SELECT count(*) FROM region) WHEN 6 THEN 3 * (SELECT count(*) FROM nation) WHEN 7 THEN (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) WHEN 8 THEN 0 ELSE k END AS asserted, CASE n WHEN 7 THEN (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0) WHEN 8 THEN 1 ELSE 0 END AS retracted FROM (VALUES (1, 0), (2, 2), (3, 2), (4, 1), (5, 0), (6, 0), (7, 0), (8, 0)) x(n, k)")
def store_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = [json.loads(x) for x in logs.tail(store(spark, sf_dir))]
    return _table(spark, [(i + 1, len(x["asserted"]), len(x["retracted"])) for i, x in enumerate(events)], "n int, asserted int, retracted int")


@register(_NOW)
def store_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, replica = store(spark, sf_dir), _new(spark, "replica")
    lines = list(logs.tail(db, 64))
    assert {r["status"] for r in logs.apply(replica, lines)} == {"applied"} and {r["status"] for r in logs.apply(replica, lines)} == {"already_applied"}
    return replica.q(_RANKS)


@register(_NOW)
def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = list(logs.snapshot(store(spark, sf_dir)))
    copy = logs.restore(spark, _place(spark, "restored"), lines)
    assert list(logs.snapshot(copy)) == lines
    return copy.q(_RANKS)


@register(_NOW)
def store_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.backup(store(spark, sf_dir), _place(spark, "backup")).q(_RANKS)


@register(_NOW)
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = logs.backup(store(spark, sf_dir), _place(spark, "compact"))
    db.transact({"id": "nation:1", "nation/extra": 1})
    db.compact()
    return db.q(_RANKS)


@register(_NOW)
def store_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    replica = _new(spark, "follower")
    follow.replicate(store(spark, sf_dir), replica, _place(spark, "progress")).awaitTermination()
    return replica.q(_RANKS)


# ---------------------------------------------------------------- search


_PATHS = "SELECT 'nation:' || n_nationkey AS e, 1 AS hop, 'region:1>nation:' || n_nationkey AS path FROM nation WHERE n_regionkey = 1"


@register(_PATHS)
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found by a region's name, with the index and without; what refers to it, with the way there."""
    db = logs.backup(store(spark, sf_dir), _place(spark, "search"))
    name = db.q({"find": ["?n"], "where": [["region:1", "region/name", "?n"]]}).first()["n"]
    plain = db.search(text=name, k=1, text_attributes=["region/name"], expand=1)
    db.index_texts()
    assert db.search(text=name, k=1, text_attributes=["region/name"], expand=1) == plain
    hit = plain["hits"][0]
    assert hit["entity"] == "region:1" and hit["matched"][0]["v"] == name and "[" in hit["matched"][0]["snippet"] and hit["pull"] == {"region/name": name}
    return _table(spark, [(x["entity"], x["hop"], ">".join(x["path"])) for x in plain["expanded"]], "e string, hop int, path string")


@register("SELECT 'nation:' || n_nationkey AS e, 'nation/alias' AS name, 'alias ' || lpad(i::VARCHAR, 2, '0') AS j FROM nation, range(32) t(i)")
def store_compact_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with 40 aliases, of which a compact document shows 32."""
    source = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = source.select(F.concat(F.lit("nation:"), "n_nationkey").alias("e"), F.lit("nation/alias").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("fact"))
    return search.compact(rows.withColumn("j", F.concat(F.lit("alias "), F.lpad(F.col("fact").cast("string"), 2, "0")))).select("e", "name", "j")


@register("SELECT * FROM (VALUES (0, false, 100, 20), (1, true, 0, 19)) x(n, cut, expanded, hits)")
def store_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that fits, and one of which expanded entities, evidence and last hits go until it does: 19 hits of 55 kB in 1 MiB."""
    out = []
    for n, size in enumerate((10, 55_000)):
        hits = [{"entity": f"e{i}", "matched": [{"v": "x"}], "pull": {"a/b": "y" * size}} for i in range(20)]
        got = search.bounded({"hits": hits, "expanded": [{"entity": "z" * 20} for _ in range(100)], "truncated": False})
        out.append((n, got["truncated"], len(got["expanded"]), len(got["hits"])))
    return _table(spark, out, "n int, cut boolean, expanded int, hits int")


@register("SELECT * FROM (VALUES ('no such entity', 'NotFound'), ('no such transaction', 'NotFound'), ('a view is read only', 'ReadOnly'), ('a trial of a trial', 'Unsupported'), ('a diff backwards', 'QueryError'), ('a malformed event', 'ValueTypeError'), ('a broken snapshot', 'FormatError')) x(step, outcome)")
def store_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store(spark, sf_dir)
    return _said(spark, [
        ("no such entity", lambda: db.history("nation:none")), ("no such transaction", lambda: db.receipt(10**9)),
        ("a view is read only", lambda: db.at(70).transact({"id": "a", "x/y": 1})), ("a trial of a trial", lambda: db.speculate().speculate()),
        ("a diff backwards", lambda: db.diff(80, 70)), ("a malformed event", lambda: logs.apply(db, ["{}"])), ("a broken snapshot", lambda: logs.restore(spark, _place(spark, "broken"), ["{}", "{}"])),
    ])


